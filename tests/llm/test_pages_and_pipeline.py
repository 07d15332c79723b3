"""URL filter, HTML extraction, the pipeline, and the registered queries."""

import hashlib
import html
import re
from collections import Counter

import duckdb
import pytest
from conftest import SCHEMA, prose

import corpus_pipeline
from ledgerlens.llm import line_dedup, queries, simhash, url_lm, wrappers
from ledgerlens.llm.common import table

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, rule int")


def test_rules_by_brute_force(spark):
    urls = ["https://A.example.com/en/x?q", "http://example.com/en/", "http://www.example.com/en/1", "http://x.www.example.com/en/1#f", "http://notexample.com/en/1",
            "http://com/", "http://com", "http://a.net/es/1", "http://a.net/ES/1", "http://a.net/fr/", "ftp://a.netx/fr/", None, "", "nothing", "http://", "http://h/?a/b",
            "http://h?x://y/z", "http://É.com/ü", "http://a.com:80/en/"]

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), v, h + p) for v, h, p in url_lm.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[1]) if fit else (host, path, None, None)

    df = url_lm.judge_urls(pages_of(spark, [(u, None) for u in urls]))
    assert df.columns.count("rule") == 1 and "text" in df.columns
    for r in df.collect():
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_language_models_tell_unruled_urls_apart(spark):
    rows = [(f"http://good{i}.com/reading/page{i}", None) for i in range(60)] + [(f"http://x{i}.net/es/casino-win{i}", None) for i in range(60)]
    rows += [("http://b.org/reading/page7", None), ("http://b.org/casino-win8", None)]
    got = {r.url: r for r in url_lm.judge_urls(pages_of(spark, rows)).collect()}
    assert got["http://b.org/reading/page7"].verdict == "allow" and got["http://b.org/casino-win8"].verdict == "block"


def test_urls_empty_table(spark):
    assert url_lm.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_joins_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []

    def seen(name):
        old = getattr(url_lm, name)

        def run(*a):
            out = old(*a)
            plans.extend(x._jdf.queryExecution().executedPlan().toString() for x in (*a, out) if hasattr(x, "_jdf"))
            return out
        monkeypatch.setattr(url_lm, name, run)

    seen("gram_scores")
    seen("calibrate")
    df = url_lm.judge_urls(pages_of(spark, [(f"http://a{i}.net/{'es' if i % 2 else 'de'}/{i}", None) for i in range(40)]))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert df.count() == 40


def test_wrapper_is_inferred_and_texts_extracted(spark):
    def page(k, extra=""):
        items = "".join(f"<li>m{j}" for j in range(2 + k % 3))
        return (f"<html><head><title>t{k}</title><script>var a='<p>no</p>';</script></head><body><div id=top>My &amp; site</div><ul class='nav'>{items}</ul>"
                f"<div class=wrap><h1>Head {k}</h1>{extra}<p>One&nbsp;{k} <b>bold</b> 5 &lt; 6<p>Two  {k}<br>more</div><aside>side {k}</aside>"
                f"<div class='cookie-notice'>We use cookies</div><section id=comments><p>nice {k}</p></section><div>All rights reserved</div></body>")

    pages = [(f"http://h.example/{k}", page(k, "<blockquote>quoted</blockquote>" if k == 2 else "")) for k in range(4)]
    pages += [("http://other.example/", None), (None, ""), (None, "just text"), ("http://broken.example/", "<p>a <b>b<p>c</div></p> &copy; <unclosed")]
    df = pages_of(spark, pages)
    got = {r.page_id: r for r in wrappers.extract(df).collect()}
    assert got[0].text == "Head 0\nOne 0 bold 5 < 6\nTwo 0 more" and got[2].text == "Head 2\nquoted\nOne 2 bold 5 < 6\nTwo 2 more"
    assert [got[k].text for k in (4, 5, 6)] == ["", "", "just text"] and got[7].text.startswith("a b\nc")
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(pages)
    w = {r.host: wrappers.as_regex(__import__("json").loads(r.form)) for r in wrappers.induce_wrappers(df).collect()}["h.example"]
    assert "(<li>#PCDATA</li>)+" in w and "(<blockquote>quoted</blockquote>)?" in w and "My & site" in w and "(<p>#PCDATA</p>)+" in w
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_marks_are_whole_names_and_depth_has_no_bound():
    body = "<p>the whole article is here, and it goes on</p>"
    for opening in ("<div class='content has-sidebar'>", "<div id='main-social'>", "<section class='post related-posts-on'>", "<article class='post no-comments'>"):
        tag = re.match("<([a-z]+)", opening)[1]
        assert wrappers.main_text(f"{opening}{body}</{tag}><footer>foot</footer>") == "the whole article is here, and it goes on"
    for name in ("sidebar", "site-header", "comment-list", "relatedPosts", "ad_300x250", "share-buttons", "user-comments"):
        assert wrappers.main_text(f"<article>{body}<div class='{name}'>away</div></article>") == "the whole article is here, and it goes on"
    assert wrappers.main_text("<article><div class='entry-header'><h1>Title</h1></div><p>b</p></article>") == "Title\nb"
    assert wrappers.main_text(f"<div class=story>teaser</div><div class=b>{body}</div>") == "teaser\nthe whole article is here, and it goes on"
    assert wrappers.main_text("<p class=it's>one</p><p title='a > b'>two's</p>") == "one\ntwo's"
    assert wrappers.main_text(f"<div class=widget><article>{body}</article></div>") == "the whole article is here, and it goes on"
    assert wrappers.main_text("<article></article><section id=comments><article><p>nice</p></article></section>") == ""
    for depth in (250, 20_000):
        deep = "<div id=page><article>" + "<div>" * depth + "<p>deep text</p>" + "</div>" * depth + "<p>later text</p></article></div><div>outside</div>"
        assert wrappers.main_text(deep) == "deep text\nlater text"
        assert wrappers.form_of(wrappers.parse(deep))
    assert wrappers.main_text("<a b=\"" * 20_000 + "x").startswith("<a b")


def test_host_without_article_by_its_wrapper(spark):
    """Constant texts of a host go, varying and repeated ones stay, in page
    order; the twin counts the texts of the host's pages."""
    def page(k):
        paras = "".join(f"<p>Paragraph {k}.{j} of the text" for j in range(1 + k % 4))
        note = "<div class=note>A note of some pages</div>" if k % 3 == 0 else ""
        return (f"<html><body><div class=top>The site's own name</div><div class=claim>We <b>print</b> what you read</div>{note}"
                f"<div class=body><h1>Head {k}</h1>{paras}</div><div class=foot>Printed &amp; bound by us</div></body></html>")

    pages = [page(k) for k in range(12)] + [page(0)]
    texts = [[" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:div|p|h1|body|html)[^>]*>", p)] for p in pages]
    everywhere = Counter(t for p in {tuple(t) for t in texts} for t in set(p))
    want = ["\n".join(t for t in p if t and everywhere[t] < 12) for p in texts]
    rows = [(f"http://plain.example/{k}", p) for k, p in enumerate(pages)]
    rows += [("http://copies.example/", page(1))] * 5  # one page five times tells nothing apart
    got = {r.page_id: r.text for r in wrappers.extract(pages_of(spark, rows)).collect()}
    assert [got[k] for k in range(13)] == want and "own name" not in want[0] and "A note of some pages" in want[0]
    assert all(got[k] == "\n".join(t for t in texts[1] if t) for k in range(13, 18))


def test_parts_of_a_host_are_aligned_by_rounds(spark, monkeypatch):
    pages = [(f"http://many.example/{k}", "<div>same</div>" + "".join(f"<{t}>x{k}</{t}>" for b, t in enumerate(("p", "h2", "pre", "ul")) if k >> b & 1))
             for k in range(1, 16)]
    whole = wrappers.extract(pages_of(spark, pages)).select("page_id", "text").collect()
    monkeypatch.setattr(wrappers, "FORMS", 2)
    rounds = wrappers.extract(pages_of(spark, pages)).select("page_id", "text").collect()
    assert sorted(whole) == sorted(rounds) and all("same" not in r.text for r in rounds)
    assert [r.n_pages for r in wrappers.induce_wrappers(pages_of(spark, pages)).collect()] == [15]


def test_wrapper_alignment_generates_both_sides():
    a = wrappers.form_of(wrappers.parse("<div><h2>x</h2><p>1</p><p>2</p><hr></div>"))
    b = wrappers.form_of(wrappers.parse("<div><p>1</p><table><tr><td>k</table><hr></div>"))
    text = wrappers.as_regex(wrappers.align(a, b))
    assert "(<h2>x</h2>)?" in text and ")?" in text.split("<table")[1] and "<hr></hr>" in text


def test_extraction_query_against_the_article_element(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in queries.op5_html_extraction(spark, SF).collect():
        m = re.search(r"<article>(.*?)</article>", pages[r.page_id] or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in parts) if x)
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    out = c.execute(queries.ORACLE[name])
    at = {d[0]: i for i, d in enumerate(out.description)}
    assert sorted(at) == cols
    assert Counter(tuple(r[k] for k in cols) for r in df.collect()) == Counter(tuple(r[at[k]] for k in cols) for r in out.fetchall())


def test_pipeline_against_plain_python(spark):
    """Stage by stage on its predecessor's rows, by brute force."""
    from test_documents import brute_contamination, component

    docs = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    kept = {r.doc_id for r in queries.op8_quality_rules(spark, SF).collect() if r.kept}
    a = steps["quality_rules"](spark, docs, SF).cache()
    assert {r.doc_id for r in a.collect()} == kept and a.columns == docs.columns
    rows = a.collect()
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    n = Counter(k for r in rows for k in {key(x) for x in r.text.split("\n")} if k)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if n[key(x)] < 10) for r in rows}
    b = steps["line_dedup"](spark, a, SF).cache()
    assert {r.doc_id: r.text for r in b.collect()} == want and all(r.n_chars == len(r.text) for r in b.collect()) and b.columns == docs.columns
    fp = {i: simhash.fingerprint(t) for i, t in want.items()}
    comp = component(fp, [(x, y) for x in fp for y in fp if x < y and (fp[x] ^ fp[y]).bit_count() <= 4])
    c = steps["simhash_near_dedup"](spark, b, SF).cache()
    assert sorted(r.doc_id for r in c.collect()) == sorted(set(comp.values())) and c.columns == docs.columns
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {x[0] for x in brute_contamination([(r.doc_id, r.text) for r in c.collect()], bench) if x[5]}
    d = steps["benchmark_decontamination"](spark, c, SF).cache()
    assert {r.doc_id for r in d.collect()} == set(comp.values()) - bad and d.columns == docs.columns
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in d.collect()}
    assert {r.doc_id: r.text for r in final} == {r.doc_id: r.text for r in d.collect()}


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, no_docs):
    odd = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
        assert stage(spark, odd, SF).count() <= 2 * odd.count(), name


def test_line_digest_is_of_the_kept_text(spark):
    text = prose(3, 30)
    df = spark.createDataFrame([(1, text, "en", "s", 1)], SCHEMA)
    assert line_dedup.line_dedup_digest(df).first().kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
