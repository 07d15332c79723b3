"""HTML extraction by wrappers: for each host the pages' token streams are
aligned into one union-free regular expression of tags, text slots, optional
parts and repeated groups; the wrapper's slots then say which texts of a page
belong to the article.

A page is reduced to its form first: elements as nested lists, neighbours of
one kind folded into a repeated group, texts as slots.  Pages of one form merge
in each task, so a host with many pages shuffles few rows; forms of a host are
then aligned: equal parts match, a mismatch is resolved by skipping to the next
match on either side, and what was skipped becomes optional.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, materialise, without

#: Elements that hold no text of the article.
DROPPED = frozenset("""
head title script style noscript template iframe object svg math canvas audio video map
nav footer aside form button select textarea input label option dialog menu
""".split())
#: Words in class, id or role that mark menus, notices, adverts and comments.
MARKED = frozenset("""
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc
header masthead footer sidebar aside side widget widgets related recommended recommendations
comment comments reply replies respond disqus discussion
cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login
share sharing social search complementary contentinfo skip
""".split())
#: Words that may stand beside those in one name (`site-header`, `share-buttons`); with any other word
#: (`entry-header`, `has-sidebar`) the name marks nothing.
BESIDE = frozenset("""
area bar block bottom box button buttons card container form global group inner item items left link links list lower
page panel posts primary reader right row secondary section site slot text thread title top unit upper user users wrap wrapper x
""".split())
#: Marks of readers' comments.
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())
#: Marks of the article's own element.
MAIN = frozenset("article main story post entry articlebody content".split())
#: Elements without an end, and elements that break the flow of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""
address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends an open element of these (up to the given container).
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)),
        "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements that are part of a text's slot.
INLINE = frozenset("a abbr b bdi bdo big br cite code dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title".split())
#: Pages that must share a text of a slot before it counts as the site's own.
FIXED_PAGES = 3
#: Longest group of different neighbours that is folded.
PERIOD = 4
#: Forms of a host that one task aligns; more are dealt to several and their wrappers aligned, by rounds.
FORMS = 256
#: Levels of a form; what lies deeper is text of the slot above (the texts themselves have no such bound).
LEVELS = 100
#: Where the article is looked for, and the share of the page's varying text that it must hold there: in `article`
#: elements, in `main` elements, in elements of a telling class.
ZONES = (("a", 0.25), ("m", 0.25), ("c", 0.5))

# a quote delimits a value only after "="
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|"
                    r"<(?P<end>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "sign", "role", "kids")

    def __init__(self, tag: str, sign: str = "", role: str = ""):
        self.tag, self.sign, self.role, self.kids = tag, sign, role, []


def _marked(name: str, main: bool) -> str:
    """What a whole class, id or role marks: "comment", "other" or nothing.
    All its words must be marks or stand beside them; names of several words
    mark no `article` or `main` element."""
    words = [w.lower() for w in _NAME.findall(name)]
    marks = [w for w in words if w in MARKED]
    if not marks or (main and len(words) > 1) or any(w not in MARKED and w not in BESIDE for w in words):
        return ""
    return "comment" if COMMENTS.intersection(marks) else "other"


def _role(tag: str, attrs: str) -> tuple[str, str]:
    """(sign, role): class and id without digits; `drop` by the element or
    `hidden`, `comment` or `other` by a mark, else the article's zone (`a`,
    `m`, `c`) or nothing."""
    if not attrs.strip(" /"):
        attrs = ""
    names, marked, zone = [], "", ""
    page = tag in ("body", "html")
    role = "drop" if tag in DROPPED else ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            role = "drop"
        elif key == "itemprop":
            zone = "c" if value.lower() == "articlebody" else zone
        elif key in ("class", "id", "role"):
            for word in value.split():
                names.append(re.sub(r"\d+", "", word.lower()))
                if not page:
                    marked = marked or _marked(word, tag in ("article", "main"))
                if MAIN.intersection(w.lower() for w in _NAME.findall(word)):
                    zone = "m" if key == "role" else zone or "c"
    if not role:
        role = marked or {"article": "a", "main": "m"}.get(tag, zone)
    return " ".join(sorted(names)), role


def parse(source: str) -> Node:
    """A tolerant tree of elements and texts; unknown ends are passed over."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)

    def add(text: str, decode: bool = True) -> None:
        if text:
            stack[-1].kids.append(html.unescape(text) if decode else text)

    last = source.rfind(">")  # nothing after it is a tag
    while at < n:
        m = _TOKEN.search(source, at) if at <= last else None
        if not m:
            add(source[at:].split("<!--", 1)[0])
            break
        add(source[at:m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"], False)
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS:
            ended, within = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended.split():
                    del stack[i:]
                    break
                if stack[i].tag in within:
                    break
        node = Node(tag, *_role(tag, m["attrs"]))
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if m["attrs"].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            node.kids.append(source[at:end.start()] if end else source[at:])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _flow(root: Node):
    """Texts in page order, None where the flow breaks: (text, dropped, mark,
    zones, header and link marks, slot).  The walk keeps its own stack, so
    elements may be nested to any depth."""
    todo = [(iter(root.kids), (False, "", "", "", ""), 0, None)]
    while todo:
        kids, state, level, after = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
            if after is not None:
                yield (None, *after)
            continue
        if isinstance(kid, str):
            yield (kid, *state)
            continue
        drop, mark, zones, within, path = state
        if kid.tag == "br":
            yield (" ", *state)
        gone, inner, deeper = drop or kid.role == "drop", within, kid.tag not in INLINE
        if kid.tag == "header":  # a page's header goes; an article's header keeps its headings
            gone, inner = gone or not zones, within + ("h" if zones else "")
        else:
            inner += ("a" if kid.tag == "a" else "") + ("t" if kid.tag in HEADING else "")
        below = path
        if deeper and level < LEVELS:
            below = f"{path}/{kid.tag} {kid.sign}".rstrip()
        marked = mark or (kid.role if kid.role in ("comment", "other") else "")
        zoned = zones + kid.role if kid.role in ("a", "m", "c") and kid.role not in zones else zones
        breaks = kid.tag in BLOCK
        if breaks:
            yield (None, *state)
        todo.append((iter(kid.kids), (gone, marked, zoned, inner if len(inner) < 8 else inner[-8:], below), level + deeper, state if breaks else None))


def blocks(root: Node) -> list[tuple]:
    """(text, dropped, mark, zones, "h" in a header outside its headings, share of links, slot) of each block with text, in page order."""
    out, part, state = [], [], None
    linked, slot = 0, ""

    def close() -> None:
        nonlocal part, linked
        text = " ".join("".join(part).split())
        if text:
            out.append((text, *state, linked / max(1, sum(map(len, part))), slot))
        part, linked = [], 0

    for text, gone, mark, zones, within, path in _flow(root):
        now = (gone, mark, zones, "h" if "h" in within and "t" not in within else "")
        if text is None:
            close()
            continue
        if part and now != state:
            if not (gone or mark or text.strip()):
                continue
            close()
        if not part:
            state, slot = now, path
        part.append(text)
        linked += len(text) if "a" in within else 0
    close()
    return out


# a form: a list of ("s", text or None) and ("e", sign, times, optional, form)


def _key(item) -> str:
    return "s" if item[0] == "s" else item[1]


def _inline_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif at.tag == "br":
            out.append(" ")
        elif at.tag not in ("script", "style"):
            todo += reversed(at.kids)
    return "".join(out)


def form_of(node: Node, level: int = 0) -> list:
    """The page's form: inner elements first, then folded neighbours.  Text and
    the inline elements in it are one slot, as is all that lies below LEVELS."""
    out, run = [], []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(["s", text])

    for kid in node.kids:
        if isinstance(kid, str):
            run.append(kid)
        elif kid.tag in INLINE or (level >= LEVELS and kid.tag not in ("script", "style")):
            run.append(" " if kid.tag == "br" else _inline_text(kid))
        elif kid.tag not in ("script", "style"):
            close()
            out.append(["e", f"{kid.tag} {kid.sign}".strip(), False, False, form_of(kid, level + 1)])
    close()
    return fold(out)


def fold(items: list) -> list:
    """Neighbouring repeats of up to PERIOD elements become one, repeated."""
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(items):
            out.append(items[i])
            i += 1
            while len(out) >= period and len(items) - i >= period and all(
                    _key(a) == _key(b) for a, b in zip(out[-period:], islice(items, i, i + period))) and any(x[0] == "e" for x in out[-period:]):
                for k in range(period):
                    merged = _join(out[k - period], items[i + k])
                    if merged[0] == "e":
                        merged[2] = True
                    out[k - period] = merged
                i += period
        items = out
    return items


def _join(a: list, b: list) -> list:
    if a[0] == "s":
        return ["s", a[1] if a[1] == b[1] else None]
    return ["e", a[1], a[2] or b[2], a[3] or b[3], align(a[4], b[4])]


def _optional(items: list) -> list:
    return [["e", x[1], x[2], True, x[4]] if x[0] == "e" else ["s", None] for x in items]


def align(a: list, b: list) -> list:
    """One form that generates both."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    where_a, where_b = _places(a), _places(b)
    while i < len(a) and j < len(b):
        if _key(a[i]) == _key(b[j]):
            out.append(_join(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        skip_a, skip_b = _next(where_a, _key(b[j]), i), _next(where_b, _key(a[i]), j)
        if skip_a is None and skip_b is None:
            out += _optional([a[i], b[j]])
            i, j = i + 1, j + 1
        elif skip_b is None or (skip_a is not None and skip_a - i <= skip_b - j):
            out += _optional(a[i:skip_a])
            i = skip_a
        else:
            out += _optional(b[j:skip_b])
            j = skip_b
    return out + _optional(a[i:]) + _optional(b[j:])


def _places(items: list) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, x in enumerate(items):
        out.setdefault(_key(x), []).append(k)
    return out


def _next(places: dict[str, list[int]], key: str, start: int) -> int | None:
    from bisect import bisect_left

    at = places.get(key, ())
    k = bisect_left(at, start)
    return at[k] if k < len(at) else None


def fixed_slots(form: list, path: str = "") -> list[str]:
    """The wrapper's slots with one and the same text: slot, tab, text."""
    out = []
    for x in form:
        if x[0] == "s":
            if x[1] is not None:
                out.append(f"{path}\t{x[1]}")
        elif not x[3]:
            out += fixed_slots(x[4], f"{path}/{x[1]}")
    return out


def as_regex(form: list) -> str:
    """The wrapper as text: #PCDATA slots, (...)+ repeated, (...)? optional."""
    parts = []
    for x in form:
        if x[0] == "s":
            parts.append("#PCDATA" if x[1] is None else x[1])
        else:
            body = f"<{x[1]}>{as_regex(x[4])}</{x[1].split()[0]}>"
            mark = {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}[bool(x[2]), bool(x[3])]
            parts.append(f"({body}){mark}" if mark else body)
    return "".join(parts)


def _weight(found: list[tuple]) -> float:
    return sum(len(text) * (1 - links) for text, *_, links, _ in found)


def main_text(source: str | None, fixed: frozenset[str] = frozenset()) -> str:
    """The article's text, by the slots of the host's wrapper: blocks in slots
    whose text varies or repeats are content, those that the site says alike
    on every page (``fixed``) aren't.  Marks of menus and the like are taken
    out of the content, and it is narrowed to the article's element where that
    holds its share (ZONES) of the varying text; an article that doesn't vary
    at all is taken as it stands.  Without such an element blocks that are
    mostly links go.  Where marks would leave nothing, an `article` or `main`
    inside a marked element other than comments is taken."""
    if not source:
        return ""
    found = [b for b in blocks(parse(source)) if not b[1]]
    kept = _content([b for b in found if not b[2] and not b[4]], fixed)
    if not kept:
        kept = _content([b for b in found if b[2] == "other" and not b[4] and ("a" in b[3] or "m" in b[3])], fixed)
    return "\n".join(b[0] for b in kept)


def _content(own: list[tuple], fixed: frozenset[str]) -> list[tuple]:
    varying = [b for b in own if f"{b[6]}\t{b[0]}" not in fixed] if fixed else own
    whole = _weight(varying)
    for zone, share in ZONES:
        inside = [b for b in varying if zone in b[3]]
        held = _weight(inside)
        if not inside:
            inside = [b for b in own if zone in b[3]]
            held = _weight(inside)
            if inside and held >= share * (whole + held):
                return inside
        elif held >= share * whole:
            return inside
    return [b for b in varying if b[5] < 0.5]


def host_of(url):
    at = F.instr(url, "://")
    return ascii_lower(F.coalesce(F.regexp_extract(F.when(at > 0, F.substr(url, at + 3)), "^([^/?#]*)", 1), F.lit("")))


def _canonical(form: list) -> str:
    return json.dumps(form, ensure_ascii=False, separators=(",", ":"))


def _shape(form: list) -> list:
    return [["s"] if x[0] == "s" else [x[1], x[2], _shape(x[4])] for x in form]


def induce_wrappers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, wrapper, form, n_pages, told_apart): every page takes part.  Pages
    of one shape merge inside a task, then by shape; the shapes of a host are
    aligned in groups of about FORMS, the groups' wrappers likewise until one
    is left, so no host meets in one task as pages or as parts.  ``told_apart``
    is the number of different pages, counted up to FIXED_PAGES.  Pages without
    text form no wrapper."""
    columns = "form string, n long, marks array<string>"

    def fewest(marks) -> list[str]:
        return sorted(set(marks))[:FIXED_PAGES]

    def per_task(batches):
        seen: dict[tuple[str, str], list] = {}
        for b in batches:
            for host, page in zip(b["host"], b["html"]):
                form = form_of(parse(page))
                if not form:
                    continue
                key = (host, hashlib.md5(json.dumps(_shape(form)).encode()).hexdigest())
                mark = hashlib.md5(page.encode("utf-8", "surrogatepass")).hexdigest()
                old = seen.get(key)
                if old:
                    seen[key] = [align(old[0], form), old[1] + 1, fewest([*old[2], mark])]
                else:
                    seen[key] = [form, 1, [mark]]
                if len(seen) >= 4096:
                    yield _frame(seen)
                    seen = {}
        yield _frame(seen)

    def _frame(seen):
        return pd.DataFrame([(h, k, _canonical(f), n, m) for (h, k), (f, n, m) in seen.items()], columns=["host", "shape", "form", "n", "marks"])

    def merge(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "form"], ascending=[False, True])
        forms = map(json.loads, pdf["form"])
        whole = next(forms)
        for f in forms:
            whole = align(whole, f)
        marks = fewest(m for ms in pdf["marks"] for m in ms)
        return pd.DataFrame([(*pdf.iloc[0][keys], _canonical(whole), int(pdf["n"].sum()), marks)], columns=[*keys, "form", "n", "marks"])

    per_page = (pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html")).filter("html is not null and html <> ''")
                .mapInPandas(per_task, f"host string, shape string, {columns}"))
    shapes = per_page.groupBy("host", "shape").applyInPandas(lambda k, d: merge(d, ["host", "shape"]), f"host string, shape string, {columns}")
    shapes = materialise(shapes, "wrapper-shapes")
    counts = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("parts"))
    most = counts.agg(F.max("parts")).first()[0] or 0
    left = shapes.withColumn("part", F.xxhash64("shape")).join(counts, "host")
    keys = ["host", "part", "parts"]
    while True:
        most = -(-most // FORMS)
        left = left.withColumn("parts", F.ceil(F.col("parts") / FORMS).cast("long")).withColumn("part", F.pmod(F.col("part"), F.col("parts")))
        left = left.groupBy(*keys).applyInPandas(lambda k, d: merge(d, keys), f"host string, part long, parts long, {columns}")
        if most <= 1:
            return left.select("host", "form", F.col("n").alias("n_pages"), F.size("marks").alias("told_apart"))


def extract(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (input columns of these names are
    replaced).  A null or empty page gives an empty text; pages without a host
    share the empty host's wrapper; repeated rows get equal texts and count as
    one page: a text only counts as the site's own where at least FIXED_PAGES
    different pages share it in a slot of the wrapper.  Very long and deeply
    nested pages are taken whole.  An empty table gives no rows."""
    df = without(pages, "text", "n_chars", "_host", "_fixed")
    wrappers = materialise(induce_wrappers(df, url, source), "wrappers")

    def fixed(forms: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(fixed_slots(json.loads(f)))) for f in forms])

    known = (wrappers.filter(F.col("told_apart") >= FIXED_PAGES)
             .select(F.col("host").alias("_host"), F.pandas_udf(fixed, "array<string>")("form").alias("_fixed")))

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, sites: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset(s) if s is not None else frozenset()) for h, s in zip(htmls, sites)], dtype=object)

    out = (df.join(known, host_of(F.col(url)) == F.col("_host"), "left")
           .withColumn("text", text_of(F.col(source), F.col("_fixed"))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "text", F.length("text").cast("long").alias("n_chars"))


def extraction_report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
