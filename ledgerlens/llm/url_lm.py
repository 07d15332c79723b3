"""URL filters: host and path rules, and for URLs without a rule the ratio of
two character language models.  DataFrame functions only.

The URLs that rules allow and block train two variable-order Markov models
(contexts of up to ORDER characters, Witten-Bell smoothing: each order is mixed
with the next shorter one by the count of distinct followers).  A URL's score
is the difference of its log-likelihoods over its length; a fold of the ruled
URLs that trains nothing calibrates the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.once import select_once
from ledgerlens.llm.common import ascii_lower, materialise, without

#: (verdict, host, path): fixed values of the filter.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Longest context in characters.
ORDER = 4
#: One ruled URL in so many calibrates and doesn't train.
FOLDS = 5
#: Tasks that the rows of one single character, or of a context of at most one, are dealt to.
SALTS = 64
#: Symbols assumed by the shortest model.
ALPHABET = 256
_BEGIN, _END = "\x02", "\x03"
#: Log-ratios are added in millionths, so that sums don't hang on their order.
_UNIT = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above
    it and starts the path; of equally long ones a block; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """Every character of a text (and its end) behind its context."""
    s = F.concat(F.lit(_BEGIN), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(2), F.length(s)), lambda i: F.substr(
        s, F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))))


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, allowed, blocked): how often each string of 1 to ORDER + 1
    characters ends at a position of the training URLs (s, verdict, n)."""
    longest = (urls.select("verdict", "n", F.explode(_grams(F.col("s"))).alias("g"))
               .groupBy("g").agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allowed"),
                                 F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("blocked")))
    return (longest.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("g")), lambda k: F.right("g", k))).alias("gram"),
                           "allowed", "blocked")
            .groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))


def _dealt(df: DataFrame, text: str, short: int, salt: str) -> DataFrame:
    """``df`` with a column ``salt``: rows of at most ``short`` characters are there under every salt, others under 0."""
    salts = F.sequence(F.lit(0), F.when(F.length(text) <= short, SALTS - 1).otherwise(0))
    return df.withColumn(salt, F.explode(salts))


def gram_scores(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(g, lr): log-ratio of the models for the last character of each g, in
    millionths.  ``grams`` holds distinct g."""
    followers = counts.groupBy(F.expr("substr(gram, 1, length(gram) - 1)").alias("ctx")).agg(
        F.sum("allowed").alias("na"), F.sum("blocked").alias("nb"),
        F.sum((F.col("allowed") > 0).cast("int")).alias("ta"), F.sum((F.col("blocked") > 0).cast("int")).alias("tb"))
    parts = grams.select("g", F.explode(F.sequence(F.lit(1), F.length("g"))).alias("k")).select(
        "g", "k", F.expr("right(g, k)").alias("gram"), F.expr("substr(right(g, k), 1, k - 1)").alias("ctx"))
    # every g has a last character and the empty context: their few keys are dealt to SALTS tasks each
    salt = F.pmod(F.xxhash64("g"), F.lit(SALTS)).cast("int")
    parts = parts.select("*", F.when(F.col("k") == 1, salt).otherwise(0).alias("_g"), F.when(F.col("k") <= 2, salt).otherwise(0).alias("_c"))
    parts = (parts.join(_dealt(counts, "gram", 1, "_g").hint("merge"), ["gram", "_g"], "left")
             .join(_dealt(followers, "ctx", 1, "_c").hint("merge"), ["ctx", "_c"], "left").fillna(0))
    orders = parts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "allowed", "blocked", "na", "nb", "ta", "tb"))).alias("o"))

    def model(n: str, total: str, kinds: str) -> Column:
        def mix(p: Column, x: Column) -> Column:
            first = (x[n] + 1.0) / (x[total] + ALPHABET)
            seen = x[total] + x[kinds]
            return F.when(x["k"] == 1, first).when(seen == 0, p).otherwise((x[n] + x[kinds] * p) / seen)
        return F.aggregate("o", F.lit(0.0), mix)

    lr = F.log(model("allowed", "na", "ta")) - F.log(model("blocked", "nb", "tb"))
    return orders.select("g", F.round(lr * _UNIT).cast("long").alias("lr"))


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (null under a rule);
    input columns of these names are replaced.

    A null URL, or one without ``://``, has empty host and path and is judged by
    the models like any other without a rule.  Equal URLs are scored once and
    train as often as they occur.  Without ruled URLs of a kind its model is
    uniform; without any, all scores are 0 and the verdict is allow.  An empty
    table gives no rows.

    Counts are combined in each task; hot characters only meet as counts, and
    the join of positions with scores is split where it is skewed.  All joins
    are merge joins: the tables of grams and of URLs grow with the input, and
    pass through the driver where Spark takes them for small by their files.
    """
    host, path = host_and_path(F.col(url))
    df = without(pages, "host", "path", "rule", "verdict", "score")
    keep = [F.col(f"`{c}`") for c in df.columns]
    # parsed once a row: a plain projection would be repeated in each use of host and path
    df = select_once(df, [*keep, host.alias("host"), path.alias("path")])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = select_once(df, [*keep, "host", "path", rule.alias("rule"), verdict.alias("_verdict"), F.concat("host", "path").alias("_s")])
    fold = F.pmod(F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 7), 16, 10).cast("int"), F.lit(FOLDS))
    strings = materialise(df.groupBy(F.col("_s").alias("s"), F.col("_verdict").alias("verdict")).agg(F.count("*").alias("n"))
                          .withColumn("held", fold == 0), "url-strings")
    counts = materialise(gram_counts(strings.filter("verdict is not null and not held")), "url-grams")
    asked = strings.filter("verdict is null or held").select(F.md5(F.col("s").cast("binary")).alias("u"), "s", "verdict", "n")
    places = asked.select("u", F.explode(_grams(F.col("s"))).alias("g")).groupBy("u", "g").agg(F.count("*").alias("c"))
    scored = gram_scores(places.select("g").distinct(), counts)
    total = (places.join(scored.hint("merge"), "g").groupBy("u").agg(F.sum(F.col("c") * F.col("lr")).alias("lr"), F.sum("c").alias("len")))
    total = materialise(total.select("u", F.floor(F.col("lr") / F.col("len")).cast("long").alias("score")), "url-scores")
    threshold = calibrate(asked.filter("verdict is not null").join(total.hint("merge"), "u"))
    score = total.select(F.col("u").alias("_u"), (F.col("score") / _UNIT).alias("score"), F.col("score").alias("_n"))
    # a ruled row takes no part in the join with scores
    ruled = df.filter("rule is not null").select(*keep, "host", "path", "rule", F.col("_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    rest = df.filter("rule is null").join(score.hint("merge"), F.md5(F.col("_s").cast("binary")) == F.col("_u"), "left").select(
        *keep, "host", "path", "rule", F.when(F.col("_n") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
    return ruled.unionByName(rest)


def calibrate(scored: DataFrame) -> int:
    """The threshold of the best balanced accuracy over (verdict, n, score):
    half-way between neighbouring thousandths of a log unit that hold scores;
    nearest to 0 of equally good ones."""
    step = _UNIT // 1000
    bins = (scored.groupBy((F.floor(F.col("score") / step) * step).cast("long").alias("t"))
            .agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
                 F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("b")))
    # bins are bounded by the range of a log-ratio, not by the rows
    below = Window.partitionBy(F.lit(1)).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    gain = (F.coalesce(F.sum("b").over(below), F.lit(0)) * F.greatest(F.sum("a").over(whole), F.lit(1))
            - F.coalesce(F.sum("a").over(below), F.lit(0)) * F.greatest(F.sum("b").over(whole), F.lit(1)))
    middle = F.floor((F.col("t") + F.coalesce(F.lag("t").over(Window.partitionBy(F.lit(1)).orderBy("t")), F.col("t"))) / 2).cast("long")
    best = bins.select(middle.alias("t"), gain.alias("gain")).orderBy(F.desc("gain"), F.abs("t"), "t").first()
    return int(best.t) if best else 0


def url_report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    when = lambda pick: "CASE " + " ".join(
        f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{pick(r)}'" for r in ordered) + " END"
    prev = {"a": None, "b": None}
    cols, joins = [], []
    for k in range(1, ORDER + 2):
        sub, ctx = f"right(g, {k})", f"left(right(g, {k}), {k - 1})"
        joins.append(f"LEFT JOIN c c{k} ON length(g) >= {k} AND c{k}.gram = {sub} LEFT JOIN f f{k} ON length(g) >= {k} AND f{k}.ctx = {ctx}")
        for x in "ab":
            n, t, d = f"coalesce(c{k}.{x}, 0)", f"coalesce(f{k}.n{x}, 0)", f"coalesce(f{k}.t{x}, 0)"
            if k == 1:
                prev[x] = f"(({n} + 1.0::DOUBLE) / ({t} + {ALPHABET}))"
            else:
                prev[x] = f"(CASE WHEN length(g) < {k} OR {t} + {d} = 0 THEN {prev[x]} ELSE ({n} + {d} * {prev[x]}) / ({t} + {d}) END)"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS MATERIALIZED (SELECT *, host || path AS s, {when(lambda r: r[1] + r[2])} AS rule, {when(lambda r: r[0])} AS v FROM h),
s AS MATERIALIZED (SELECT s, v, count(*) AS n, (('0x' || left(md5(s), 7))::BIGINT % {FOLDS}) = 0 AS held,
   chr(2) || s || chr(3) AS t FROM p GROUP BY s, v),
g AS MATERIALIZED (SELECT s, v, n, held, substr(t, greatest(i - {ORDER}, 1), least(i, {ORDER + 1})::BIGINT) AS g
   FROM (SELECT *, unnest(range(2, length(t) + 1)) AS i FROM s)),
l AS (SELECT g, sum(n) FILTER (WHERE v = 'allow') AS a, sum(n) FILTER (WHERE v = 'block') AS b FROM g WHERE v IS NOT NULL AND NOT held GROUP BY g),
c AS MATERIALIZED (SELECT right(g, k) AS gram, coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b
   FROM (SELECT *, unnest(range(1, length(g) + 1)) AS k FROM l) GROUP BY 1),
f AS MATERIALIZED (SELECT left(gram, length(gram) - 1) AS ctx, sum(a) AS na, sum(b) AS nb, count(*) FILTER (WHERE a > 0) AS ta,
   count(*) FILTER (WHERE b > 0) AS tb FROM c GROUP BY 1),
q AS MATERIALIZED (SELECT DISTINCT g FROM g WHERE v IS NULL OR held),
r AS MATERIALIZED (SELECT g, round((ln({prev['a']}) - ln({prev['b']})) * {_UNIT})::BIGINT AS lr FROM q {' '.join(joins)}),
z AS MATERIALIZED (SELECT s, v, any_value(n) AS n, floor(sum(lr) / count(*))::BIGINT AS score FROM g JOIN r USING (g)
   WHERE v IS NULL OR held GROUP BY s, v),
b AS (SELECT floor(score / 1000)::BIGINT * 1000 AS t, coalesce(sum(n) FILTER (WHERE v = 'allow'), 0) AS a,
   coalesce(sum(n) FILTER (WHERE v = 'block'), 0) AS b FROM z WHERE v IS NOT NULL GROUP BY 1),
th AS (SELECT coalesce((SELECT t FROM (SELECT (t + coalesce(lag(t) OVER (ORDER BY t), t)) // 2 AS t, coalesce(sum(b) OVER w, 0) * greatest(sum(a) OVER (), 1)
   - coalesce(sum(a) OVER w, 0) * greatest(sum(b) OVER (), 1) AS gain
   FROM b WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) ORDER BY gain DESC, abs(t), t LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(p.v, CASE WHEN score >= (SELECT t FROM th) THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN (SELECT s, score FROM z WHERE v IS NULL) z ON p.s = z.s AND p.rule IS NULL
"""


ORACLE = _oracle()
