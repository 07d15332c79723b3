"""Line dedup: explode normalised lines, hash, count distinct documents per
hash, drop lines over the threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, ascii_lower, materialise, without

MIN_DOCS = 10
MIN_CHARS = 1


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                      text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (input columns of these
    names are replaced).

    A line's key of at least ``min_chars`` code points that is found in at
    least ``min_docs`` documents loses all its lines in every document; the
    others stay in order.  A null or empty text is one empty line.  Every row
    is a document of its own, also when it repeats another or its id is null;
    a key found twice in one row counts once.  An empty table gives no rows.

    Keys travel as 128-bit hashes, made once and written with their row's
    number to the shared folder; texts are moved once, for the last join.  A key is counted after a combine in each task, and the
    join on hot keys splits a skewed partition (adaptive execution).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marked = (without(docs, "n_lines", "n_dropped", "kept_text", "_ld_t", "_ld_d", "_ld_l")
              .withColumn("_ld_t", F.xxhash64(body)))
    # step by step: a lambda would compute anew what it names twice
    trimmed = F.transform(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))
    lowered = F.transform(trimmed, ascii_lower)
    keys = materialise(marked.select(
        F.col(doc_id).alias("d"), F.col("_ld_t").alias("t"),
        F.transform(lowered, lambda x: F.when(F.length(x) >= max(min_chars, 1), F.unhex(F.md5(x.cast("binary"))))).alias("ks")), "line-keys")
    hot = (keys.select(F.explode(F.array_distinct("ks")).alias("k")).filter("k is not null")
           .groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("k"))
    dropped = (keys.select("d", "t", F.posexplode("ks").alias("p", "k")).filter("k is not null")
               .join(hot, "k", "left_semi")
               .groupBy("d", "t").agg(F.collect_set("p").alias("_ld_drop")))
    joined = (marked.join(dropped, F.col(doc_id).eqNullSafe(F.col("d")) & (F.col("_ld_t") == F.col("t")), "left")
              .withColumn("_ld_l", F.split(body, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_l") - 1), F.col("_ld_drop"))
    return joined.select(
        *[F.col(f"`{c}`") for c in marked.columns if c != "_ld_t"],
        F.size("_ld_l").cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_ld_drop").isNull(), body)
         .otherwise(F.array_join(F.transform(kept, lambda p: F.get("_ld_l", p)), "\n")).alias("kept_text"))


def line_dedup_digest(docs: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_common_lines(docs.select("doc_id", "text"), **kw).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT row, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
hot AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM hot)), '')) AS kept_sha256
FROM l GROUP BY row, doc_id
"""
