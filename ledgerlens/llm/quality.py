"""Quality rules with adaptive thresholds.

Fixed base rules reject short and repetitive texts.  The rest is held against
fences learnt for each language and source: quantiles from mergeable sketches
(counts of log-linear buckets, relative error 1/64, merged by adding counts),
joined back to the rows.  A fence lies beyond a high (low) quantile by
multiples of its distance from the median.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, materialise, without

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A group with fewer rows takes its language's fences, and that of a small language those of all rows.
MIN_GROUP = 100
#: measure: (quantile in hundredths, spreads beyond it, least spread, lower fence too); a spread is the quantile's distance
#: from the median.  Symbols and word length tell whole kinds of junk (up to a tenth of a source), the others a few odd rows.
#: Ratios in 1/10,000, word length in 1/1,000 characters; least spreads only keep one odd sign from rejecting a text.
MEASURES = {
    "symbols": (90, 3, 20, False),
    "dup_lines": (98, 1, 100, False),
    "repeats": (98, 1, 100, False),
    "word_length": (90, 3, 100, True),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BITS = 7


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (long) and n_text_lines.  Null: no words.

    Repeated three-word windows are found in each row: hashes of the windows
    with their places in the low bits are sorted, equal neighbours are
    candidates, and candidates are compared as words.
    """
    names = [*FEATURES, "n_text_lines"]
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    empty = F.array().cast("array<string>")
    place = F.lit((1 << 31) - 1)
    df = without(docs, *names, "_w", "_l", "_s", "_c", "_g", "_p")
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(
        *keep,
        F.when(trimmed == "", empty).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias("_w"),
        F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("_l"))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_text_lines"),
        "_w",
        F.when(F.size("_w") < 4, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
            .bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(i.cast("long"))))).alias("_s"))
    keep2 = [*keep, *[F.col(n) for n in names if n != "n_repeat_words"]]
    same = lambda a, b: F.coalesce(F.shiftright(a, 31) == F.shiftright(b, 31), F.lit(False))
    df = df.select(*keep2, "_w", F.filter(
        "_s", lambda x, i: same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1))).alias("_c"))
    # neighbours of one hash are the same three words, or else all candidates of the row are compared as text
    at = lambda x: x.bitwiseAND(place).cast("int")
    word = lambda x, k: F.get("_w", at(x) + k)
    clash = F.filter("_c", lambda x, i: same(x, F.get("_c", i - 1)) & ~(
        (word(x, 0) == word(F.get("_c", i - 1), 0)) & (word(x, 1) == word(F.get("_c", i - 1), 1)) & (word(x, 2) == word(F.get("_c", i - 1), 2))))
    df = df.select(*keep2, "_w", "_c", F.when(F.size(clash) > 0, F.sort_array(F.transform("_c", lambda x: F.struct(
        F.concat_ws(" ", F.slice("_w", at(x) + 1, F.lit(3))).alias("g"), at(x).alias("p"))))).alias("_g"))
    equal = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
    df = df.select(*keep2, F.sort_array(F.when(F.col("_g").isNull(), F.transform("_c", at)).otherwise(F.transform(F.filter(
        "_g", lambda x, i: equal(x, F.get("_g", i - 1)) | equal(x, F.get("_g", i + 1))), lambda x: x["p"]))).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*keep, *[F.col(n) for n in names if n != "n_repeat_words" and n != "n_text_lines"],
                     F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_text_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def _measures() -> dict[str, Column]:
    return {
        "symbols": F.expr("10000 * n_symbols div greatest(word_chars, 1)"),
        "dup_lines": F.expr("10000 * n_dup_lines div greatest(n_text_lines, 1)"),
        "repeats": F.expr("10000 * n_repeat_words div greatest(n_words, 1)"),
        "word_length": F.expr("1000 * word_chars div greatest(n_words, 1)"),
    }


def bucket(v: Column) -> Column:
    """The log-linear bucket of a whole number of 0 or more."""
    half = 1 << (_BITS - 1)
    shift = F.length(F.bin(v)) - _BITS
    return F.when(v < 2 * half, v).otherwise(shift * half + F.call_function("shiftright", v, shift)).cast("int")


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    half = 1 << (_BITS - 1)
    shift = F.floor(b / half).cast("int") - 1
    return F.when(b < 2 * half, b.cast("long")).otherwise(F.call_function("shiftleft", (b - shift * half).cast("long"), shift))


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over the rows that pass the base
    rules: a sketch of each group, of bounded size, merged by adding n."""
    m = _measures()
    return (features.filter(~base_failed())
            .select("lang", "source", F.explode(F.array(*[
                F.struct(F.lit(k).alias("measure"), bucket(c).alias("bucket")) for k, c in m.items()])).alias("x"))
            .groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n")))


def thresholds(features: DataFrame) -> DataFrame:
    """One row for each (lang, source) of ``features``: lang, source and the
    fences hi_<measure> (and lo_word_length), null without any sketched row."""
    s = materialise(sketches(features), "quality-sketch")
    levels = (s.select("lang", "source", "measure", "bucket", "n", F.lit(0).alias("level"))
              .unionByName(s.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
                           .select("lang", F.lit(None).cast("string").alias("source"), "measure", "bucket", "n", F.lit(1).alias("level")))
              .unionByName(s.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
                           .select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
                                   "measure", "bucket", "n", F.lit(2).alias("level"))))
    w = Window.partitionBy("level", "lang", "source", "measure")
    ranked = (levels.withColumn("total", F.sum("n").over(w))
              .withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))))
    least = lambda share: bucket_floor(F.min(F.when(100 * F.col("upto") >= share * F.col("total"), F.col("bucket"))))
    high = F.element_at(F.create_map(*[F.lit(v) for k, m in MEASURES.items() for v in (k, m[0])]), F.col("measure"))
    q = (ranked.groupBy("level", "lang", "source", "measure").agg(
        F.first("total").alias("total"), least(50).alias("mid"), least(high).alias("high"), least(100 - high).alias("low")))
    fences = []
    for k, (_, spreads, floor, down) in MEASURES.items():
        beyond = lambda d: spreads * F.greatest(d, F.lit(floor))
        fences.append(F.max(F.when(F.col("measure") == k, F.col("high") + beyond(F.col("high") - F.col("mid")))).alias(f"hi_{k}"))
        if down:
            fences.append(F.max(F.when(F.col("measure") == k, F.col("low") - beyond(F.col("mid") - F.col("low")))).alias(f"lo_{k}"))
    names = [f"hi_{k}" for k in MEASURES] + [f"lo_{k}" for k, m in MEASURES.items() if m[3]]
    wide = materialise(q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *fences), "quality-fences")
    groups = features.select("lang", "source").distinct()
    pick = lambda lv, extra=(): wide.filter(f"level = {lv}" + (f" and total >= {MIN_GROUP}" if lv < 2 else ""))
    own = pick(0).select(F.col("lang").alias("l0"), F.col("source").alias("s0"), F.struct(*names).alias("own"))
    lang = pick(1).select(F.col("lang").alias("l1"), F.struct(*names).alias("of_lang"))
    top = pick(2).select(F.struct(*names).alias("of_all"), F.lit(1).alias("one"))
    return (groups.join(own, F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
            .join(lang, F.col("lang").eqNullSafe(F.col("l1")), "left")
            .withColumn("one", F.lit(1)).join(F.broadcast(top), "one", "left")  # one row at most
            .select("lang", "source", F.coalesce("own", "of_lang", "of_all").alias("f")).select("lang", "source", "f.*"))


def judge(features: DataFrame, fences: DataFrame) -> DataFrame:
    """``features`` with base_failed and kept: neither base rule failed and
    every measure inside the fences of the row's language and source (a null
    one is a group like any other)."""
    m = _measures()
    inside = F.lit(True)
    for k, (*_, down) in MEASURES.items():
        inside = inside & F.coalesce(m[k] <= F.col(f"_f_hi_{k}"), F.lit(True))
        if down:
            inside = inside & F.coalesce(m[k] >= F.col(f"_f_lo_{k}"), F.lit(True))
    f = fences.select(*[F.col(c).alias(f"_f_{c}") for c in fences.columns])
    df = without(features, "base_failed", "kept")
    return (df.join(f, F.col("lang").eqNullSafe(F.col("_f_lang")) & F.col("source").eqNullSafe(F.col("_f_source")), "left")
            .select(*[F.col(f"`{c}`") for c in df.columns], base_failed().alias("base_failed"),
                    (~base_failed() & inside).alias("kept")))


def quality_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept.  The
    texts are read once; the counts are written to the shared folder.  Null
    and empty texts fail the base rules; repeated rows are judged alike; an
    empty table gives no rows."""
    f = materialise(with_features(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-features")
    return judge(f, materialise(thresholds(f), "quality-thresholds")).select("doc_id", *FEATURES, "base_failed", "kept")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    f = with_features(docs.select("lang", "source", "text"))
    fences = materialise(thresholds(materialise(f.drop("text"), "quality-features")), "quality-thresholds")
    row = docs.select("lang", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # a filter must not pass the projections of the counts, which it would repeat in every lambda: they stop at a column
    # that is not deterministic
    counted = with_features(row).withColumn("_stop", F.monotonically_increasing_id())
    return judge(counted, fences).filter("kept and _stop >= 0").select("_row.*")


def _oracle() -> str:
    half = 1 << (_BITS - 1)
    fence = []
    for k, (_, spreads, floor, down) in MEASURES.items():
        fence.append(f"max(CASE WHEN measure = '{k}' THEN high + {spreads} * greatest(high - mid, {floor}) END) AS hi_{k}")
        if down:
            fence.append(f"max(CASE WHEN measure = '{k}' THEN low - {spreads} * greatest(mid - low, {floor}) END) AS lo_{k}")
    share = "CASE measure " + " ".join(f"WHEN '{k}' THEN {m[0]}" for k, m in MEASURES.items()) + " END"
    names = [x.rsplit(" ", 1)[1] for x in fence]
    pick = ", ".join(f"CASE WHEN o.level IS NOT NULL THEN o.{n} WHEN l.level IS NOT NULL THEN l.{n} ELSE a.{n} END AS {n}" for n in names)
    floor_of = lambda b: f"CASE WHEN {b} < {2 * half} THEN {b} ELSE ({b} - ({b} // {half} - 1) * {half}) << ({b} // {half} - 1)::INT END"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n
      FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
      GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_text_lines
      FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
        10000 * n_symbols // greatest(word_chars, 1) AS symbols, 10000 * n_dup_lines // greatest(n_text_lines, 1) AS dup_lines,
        10000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS word_length FROM f),
v AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure,
        unnest([symbols, dup_lines, repeats, word_length]) AS v FROM b WHERE NOT base_failed),
k AS (SELECT lang, source, measure, CASE WHEN v < {2 * half} THEN v
        ELSE (length(bin(v)) - {_BITS}) * {half} + (v >> (length(bin(v)) - {_BITS})::INT) END AS bucket FROM v),
lv AS (SELECT 0 AS level, lang, source, measure, bucket, count(*) AS n FROM k GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM k GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, measure, bucket, count(*) FROM k GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
        sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto FROM lv),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(CASE WHEN 100 * upto >= 50 * total THEN bucket END) AS b5,
        min(CASE WHEN 100 * upto >= {share} * total THEN bucket END) AS b9,
        min(CASE WHEN 100 * upto >= (100 - {share}) * total THEN bucket END) AS b1 FROM c GROUP BY ALL),
qq AS (SELECT *, {floor_of('b1')} AS low, {floor_of('b5')} AS mid, {floor_of('b9')} AS high FROM q),
wide AS (SELECT level, lang, source, max(total) AS total, {', '.join(fence)} FROM qq GROUP BY ALL),
th AS (SELECT x.lang, x.source, {pick} FROM (SELECT DISTINCT lang, source FROM b) x
  LEFT JOIN (SELECT * FROM wide WHERE level = 0 AND total >= {MIN_GROUP}) o
    ON x.lang IS NOT DISTINCT FROM o.lang AND x.source IS NOT DISTINCT FROM o.source
  LEFT JOIN (SELECT * FROM wide WHERE level = 1 AND total >= {MIN_GROUP}) l ON x.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN (SELECT * FROM wide WHERE level = 2) a ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join([f"coalesce({k} <= hi_{k}, true)" for k in MEASURES])}
  AND coalesce(word_length >= lo_word_length, true) AS kept
FROM b LEFT JOIN th ON b.lang IS NOT DISTINCT FROM th.lang AND b.source IS NOT DISTINCT FROM th.source
"""


ORACLE = _oracle()
