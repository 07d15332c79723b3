"""Temperature mixing of sources: weights are token shares to a power that is
bisected to meet a target entropy or a repetition limit; the weights are then
realised as budgeted permutations of blocks.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, materialise, without

#: Target entropy as a share of the greatest possible.
ENTROPY = 0.99
#: Most epochs of any source.
MAX_EPOCHS = 4
#: Tokens of a block; a block is the largest group that is ordered as a whole.
BLOCK_TOKENS = 1_000_000
SEED = 7
#: The exponent is found to 2 ** -20: each round halves its bracket _HALVINGS times at once.
_HALVINGS, _ROUNDS = 5, 4


def n_tokens(text: Column) -> Column:
    """Words of a text (0 for null): the unit of shares and budgets."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> float:
    """The largest exponent in [0, 1] at which the weights' entropy is at least
    ``entropy`` of the greatest possible, raised where needed to the smallest
    at which no source is repeated more than ``max_epochs`` times (1 where
    none is).  ``sources`` has (tokens).  A round evaluates all midpoints of
    several halvings in one aggregate; the driver gets its 66 rows."""
    pos = sources.filter("tokens > 0")
    top = pos.agg(F.sum("tokens").cast("double").alias("n"), F.count("*").alias("k")).first()
    if not top.k:
        return 1.0
    target = entropy * math.log(top.k) - 1e-12
    wide = 1 << _HALVINGS
    lo, step = {"entropy": 0.0, "epochs": 0.0}, 1.0
    for _ in range(_ROUNDS):
        step /= wide
        grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(min(1.0, lo[k] + i * step)).alias("a"))
                         for k in lo for i in range(wide + 1)])
        rows = (pos.select((F.col("tokens") / F.lit(top.n)).alias("p"), F.explode(grid).alias("g")).select("p", "g.*")
                .groupBy("k", "i", "a")
                .agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("zl"),
                     F.min("p").alias("least"), F.max("p").alias("most"))
                .select("k", "i", (F.log("z") - F.col("a") * F.col("zl") / F.col("z")).alias("h"),
                        _epochs("least", "most", "a", "z", budget, top.n).alias("r")).collect())
        # both hold for small exponents and end to hold somewhere: the last place where they hold
        holds = {"entropy": [x.i for x in rows if x.k == "entropy" and x.h >= target],
                 "epochs": [x.i for x in rows if x.k == "epochs" and x.r > max_epochs + 1e-12]}
        for k in lo:
            lo[k] = min(1.0, lo[k] + max(holds[k], default=0) * step)
    repeated = bool(holds["epochs"])
    return min(1.0, max(lo["entropy"], lo["epochs"] + step if repeated else 0.0))


def _epochs(p: str, most: str, a: str, z: str, budget: int | None, n: float) -> Column:
    """Epochs of a source of share ``p``: weight times budget over its tokens.
    Without a budget: as many tokens as give the largest source one epoch."""
    if budget is None:
        return F.pow(F.col(most) / F.col(p), 1 - F.col(a))
    return F.pow(F.col(p), F.col(a) - 1) / F.col(z) * F.lit(budget / n)


def source_plan(sources: DataFrame, alpha: float, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, tokens, weight, epochs, whole, rest, n_blocks): whole epochs,
    and the tokens of the last, partial one.  Sources without tokens get
    weight 0 and one epoch."""
    top = sources.filter("tokens > 0").agg(F.sum("tokens").cast("double").alias("n"), F.max("tokens").alias("big")).first()
    n, big = (top.n or 1.0), (top.big or 1)
    p = F.col("tokens") / F.lit(n)
    z = sources.filter("tokens > 0").agg(F.sum(F.pow(p, F.lit(alpha)))).first()[0] or 1.0
    df = (sources.withColumn("p", p).withColumn("most", F.lit(big / n)).withColumn("a", F.lit(alpha)).withColumn("z", F.lit(z))
          .withColumn("weight", F.when(F.col("tokens") > 0, F.pow("p", "a") / F.col("z")).otherwise(0.0))
          .withColumn("epochs", F.when(F.col("tokens") > 0, _epochs("p", "most", "a", "z", budget, n)).otherwise(1.0))
          .withColumn("whole", F.floor(F.col("epochs") + 1e-9).cast("int")))
    return df.select(
        "source", "tokens", F.round("weight", 9).alias("weight"), F.round("epochs", 9).alias("epochs"), "whole",
        F.floor(F.greatest(F.col("epochs") - F.col("whole"), F.lit(0.0)) * F.col("tokens") + 1e-6).cast("long").alias("rest"),
        F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("int").alias("n_blocks"))


def mix(docs: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None,
        block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``docs``, each row as often as its source's epochs ask, with n_tokens,
    epoch (from 0), block, block_rank (the block's place in the epoch's
    permutation of the source's blocks) and place_key (order inside a block).

    Without ``budget`` the largest source gets one epoch, so no row is lost.
    In the last, partial epoch whole blocks are taken in permuted order while
    the source's budget lasts; the block at the cut gives the rows that still
    fit, in the order of place_key.  A null source is a source; rows without
    tokens cost nothing; repeated rows tie and are taken together; an empty
    table gives no rows.

    Counts are combined in each task, only blocks (not rows) of a source are
    ordered together, and the rows of a block only for the block at the cut.
    """
    df = without(docs, "n_tokens", "epoch", "block", "block_rank", "place_key", "_src", "_row_key")
    keep = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(
        *keep, n_tokens(F.col("text")).alias("n_tokens"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                          F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("_row_key"))
    narrow = materialise(rows.select("source", "n_tokens", "_row_key"), "mix-rows")
    sources = materialise(narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "mix-sources")
    plan = materialise(source_plan(sources, exponent(sources, entropy, max_epochs, budget), budget, block_tokens), "mix-plan")
    p = plan.select(F.col("source").alias("_src"), "whole", "rest", "n_blocks")
    of_block = F.pmod(F.conv(F.substring("_row_key", 1, 8), 16, 10).cast("long"), F.col("n_blocks")).cast("int")
    order = lambda key: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), key).cast("binary"))
    dealt = (narrow.join(p, F.col("source").eqNullSafe(F.col("_src"))).withColumn("block", of_block))
    epochs = F.explode(F.sequence(F.lit(0), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)))
    blocks = (dealt.groupBy("source", "block", "whole", "rest").agg(F.sum("n_tokens").alias("t"))
              .filter("whole > 0 or rest > 0").withColumn("epoch", epochs)
              .withColumn("o", order(F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("block").cast("string")))))
    w = Window.partitionBy("source", "epoch").orderBy("o", "block")
    blocks = (blocks.withColumn("block_rank", F.row_number().over(w) - 1)
              .withColumn("before", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t"))
              .withColumn("left", F.when(F.col("epoch") < F.col("whole"), F.col("t")).otherwise(F.col("rest") - F.col("before")))
              .filter("left > 0 or t = 0"))
    blocks = materialise(blocks.select(F.col("source").alias("_src"), F.col("block").alias("_block"), "epoch", "block_rank", "left",
                                       (F.col("left") < F.col("t")).alias("cut")), "mix-blocks")
    cut = (dealt.join(blocks.filter("cut").withColumnRenamed("_src", "s"),
                      F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("_block")))
           .withColumn("place_key", order(F.col("_row_key"))))
    w = Window.partitionBy("source", "epoch").orderBy("place_key").rangeBetween(Window.unboundedPreceding, 0)
    upto = (cut.withColumn("u", F.sum("n_tokens").over(w)).filter("u <= left")
            .groupBy("s", "epoch").agg(F.max("place_key").alias("last")))
    chosen = materialise(
        blocks.join(upto.select(F.col("s").alias("_s"), F.col("epoch").alias("_e"), "last"),
                    F.col("_src").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & F.col("cut"), "left")
        .select(F.col("_src").alias("_bsrc"), "_block", "epoch", "block_rank", "cut", "last"), "mix-chosen")
    return (rows.join(p, F.col("source").eqNullSafe(F.col("_src"))).withColumn("block", of_block)
            .join(chosen, F.col("source").eqNullSafe(F.col("_bsrc")) & (F.col("block") == F.col("_block")))
            .withColumn("place_key", order(F.col("_row_key")))
            .filter("not cut or place_key <= last")
            .select(*keep, "n_tokens", "epoch", "block", "block_rank", "place_key"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_rank, place_key of every row of the mix."""
    return mix(docs.select("doc_id", "source", "text"), **kw).drop("text")


ORACLE = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
p AS MATERIALIZED (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM s)::DOUBLE AS p FROM s WHERE tokens > 0),
h(step, lo) AS (SELECT 0, 0::BIGINT UNION ALL
  SELECT step + 1, CASE WHEN (SELECT ln(sum(pow(p, (lo + (1048576 >> step)) / 1048576.0))) - (lo + (1048576 >> step)) / 1048576.0
      * sum(pow(p, (lo + (1048576 >> step)) / 1048576.0) * ln(p)) / sum(pow(p, (lo + (1048576 >> step)) / 1048576.0)) FROM p)
      >= {ENTROPY} * ln((SELECT count(*) FROM p)) - 1e-12 AND lo + (1048576 >> step) <= 1048576
    THEN lo + (1048576 >> step) ELSE lo END FROM h WHERE step <= 20),
a AS MATERIALIZED (SELECT greatest((SELECT max(lo) FROM h) / 1048576.0,
   CASE WHEN ratio > {MAX_EPOCHS} THEN least(1.0, (floor((1 - ln({MAX_EPOCHS}) / ln(ratio)) * 1048576) + 1) / 1048576.0) ELSE 0 END) AS a
   FROM (SELECT max(p) / min(p) AS ratio FROM p)),
e AS (SELECT s.source, tokens, CASE WHEN tokens > 0 THEN pow((SELECT max(p) FROM p) / (tokens / (SELECT sum(tokens) FROM s)::DOUBLE), 1 - a) ELSE 1.0 END AS epochs
      FROM s, a),
pl AS MATERIALIZED (SELECT source, floor(epochs + 1e-9)::INT AS whole,
   floor(greatest(epochs - floor(epochs + 1e-9), 0) * tokens + 1e-6)::BIGINT AS rest,
   greatest(ceil(tokens / {BLOCK_TOKENS}.0), 1)::INT AS nb FROM e),
x AS MATERIALIZED (SELECT doc_id, d.source, n_tokens, k, whole, rest, (('0x' || substr(k, 1, 8))::BIGINT % nb)::INT AS block
   FROM d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source),
o AS (SELECT *, md5('{SEED}|' || epoch || '|' || coalesce(source, '') || '|' || block) AS o FROM
   (SELECT source, block, whole, rest, t, unnest(range(0, whole + (rest > 0)::INT)) AS epoch
    FROM (SELECT source, block, whole, rest, sum(n_tokens)::BIGINT AS t FROM x GROUP BY ALL))),
r AS (SELECT *, row_number() OVER w - 1 AS block_rank, sum(t) OVER w - t AS before FROM o WINDOW w AS (PARTITION BY source, epoch ORDER BY o, block)),
c AS MATERIALIZED (SELECT *, CASE WHEN epoch < whole THEN t ELSE rest - before END AS lft FROM r),
y AS (SELECT x.doc_id, x.source, x.n_tokens, c.epoch, c.block, c.block_rank, md5('{SEED}|' || c.epoch || '|' || x.k) AS place_key, lft, t
   FROM x JOIN c ON x.source IS NOT DISTINCT FROM c.source AND x.block = c.block WHERE lft > 0 OR t = 0)
SELECT doc_id, source, n_tokens, epoch, block, block_rank, place_key FROM
  (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY place_key RANGE UNBOUNDED PRECEDING) AS u FROM y)
WHERE lft >= t OR u <= lft
"""
