"""What-if variants of the correlation inputs: append one synthetic row
(U2, with A4 medians for the unspecified values) and replace values in the
latest row (W3 + U4).

``WhatIfState`` keeps what any number of such variants of one ledger need:
the pairwise co-moments of all rows but the latest, the latest row itself
with its number of exact repeats, and the column medians.  A variant then
only adds rows to moments (never subtracts: the latest row was left out), so
it reads a few hundred stored rows and no ledger row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import correlate
from ledgerlens.operators.medians import exact_medians
from ledgerlens.shared import materialise


def append_row(df: DataFrame, cols: list[str], values: dict[str, float],
               extra: dict | None = None, written: bool = False) -> DataFrame:
    """``df[cols]`` plus one row: the given value where supplied, else
    the exact column median (A4); a column without values stays without.  ``extra`` adds literal columns to the new
    row (e.g. its month); they are NULL-typed elsewhere.  ``written``: ``df`` is read from files."""
    med = exact_medians(df, [], cols, written)
    row = med.select(*[(F.when(F.col(c).isNotNull(), F.lit(float(values[c]))) if values.get(c) is not None else F.col(c))
                       .cast("double").alias(c) for c in cols],
                     *[F.lit(v).alias(k) for k, v in (extra or {}).items()])
    return df.select(*cols, *[F.col(k) for k in (extra or {}) if k in df.columns]).unionByName(
        row, allowMissingColumns=True)


def _literal(value, kind: str) -> Column:
    if isinstance(value, Row):
        value = F.struct(*[F.lit(v).alias(k) for k, v in value.asDict().items()])
        return value.cast(kind)
    return F.lit(value).cast(kind)


def _latest(df: DataFrame, order_cols: list[str]) -> tuple[DataFrame, DataFrame, Row, Column] | None:
    """(all rows below the greatest value of the first order column, the rows
    at it, the latest of these, whether one of these equals it); None without
    rows.  Just the rows at the greatest value (a date's) are written and
    ordered by all columns, and only they are compared with the latest one."""
    order = [*order_cols, *sorted(c for c in df.columns if c not in order_cols)]
    types = dict(df.dtypes)
    top = df.agg(F.max(order[0])).first()[0]
    at_top = F.col(order[0]).eqNullSafe(_literal(top, types[order[0]]))
    rows = materialise(df.where(at_top), "latest-rows")
    last = rows.orderBy(*[F.col(c).desc_nulls_last() for c in order]).first()
    if last is None:
        return None
    is_last = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(_literal(last[c], types[c])) for c in order])
    return df.where(~at_top), rows, last, is_last


def replace_latest(df: DataFrame, order_cols: list[str], values: dict[str, float]) -> DataFrame:
    """W3 + U4: overwrite ``values`` in the one latest row (D4: by
    ``order_cols``, then by all other columns; of wholly equal rows one: only
    these are numbered)."""
    found = _latest(df, order_cols)
    if found is None:
        return df
    below, rows, _, is_last = found
    types = dict(df.dtypes)
    new = {c: v for c, v in values.items() if v is not None and c in df.columns}
    numbered = rows.where(is_last).withColumn("_nth", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.lit(1))))
    changed = numbered.withColumns({c: F.when(F.col("_nth") == 1, F.lit(float(v))).otherwise(F.col(c)).cast(types[c])
                                    for c, v in new.items()}).drop("_nth")
    return below.unionByName(rows.where(~is_last)).unionByName(changed)


@dataclass
class WhatIfState:
    """Co-moments, latest row and medians of one table (see the module)."""

    cols: list[str]
    moments: DataFrame            # one part per pair of all columns, latest rows left out
    latest: dict[str, float | None]
    repeats: int                  # rows equal to the latest one; 0: an empty table
    medians: dict[str, float | None]

    @classmethod
    def build(cls, df: DataFrame, cols: list[str], order_cols: list[str]) -> "WhatIfState":
        """Reads ``df`` for its latest row, then its numbers, which are written
        once and read from there."""
        found = _latest(df, order_cols)
        flat = lambda rows, is_last: rows.select(*[F.col(c).cast("double").alias(c) for c in cols], is_last.alias("_last"))
        if found is None:
            last, flat = None, materialise(flat(df, F.lit(False)), "whatif-rows")
        else:
            below, rows, last, is_last = found
            flat = materialise(flat(below, F.lit(False)).unionByName(flat(rows, is_last)), "whatif-rows")
        pairs = correlate.pairs_of(cols, cols, cols)
        moments = materialise(correlate.merge_parts(correlate.moment_parts(flat.where("not _last"), cols, pairs)), "whatif-moments")
        med = exact_medians(flat, [], cols, written=True).first()
        latest = {c: None if last is None or last[c] is None else float(last[c]) for c in cols}
        return cls(cols, moments, latest, flat.where("_last").count(), {c: med[c] for c in cols})

    def save(self, path: str) -> None:
        """Moments and rows as parquet tables below ``path``."""
        spark = self.moments.sparkSession
        self.moments.write.mode("overwrite").parquet(f"{path}/moments")
        spark.createDataFrame([(k, c, self.latest[c], self.medians[c], self.repeats) for k, c in enumerate(self.cols)],
                              "k int, name string, latest double, median double, repeats long"
                              ).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "WhatIfState":
        rows = spark.read.parquet(f"{path}/columns").orderBy("k").collect()
        return cls([r.name for r in rows], spark.read.parquet(f"{path}/moments"), {r.name: r.latest for r in rows},
                   rows[0].repeats if rows else 0, {r.name: r["median"] for r in rows})

    def matrix(self, append: dict | None = None, replace_latest: dict | None = None,
               rows: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The matrix as it is, with one row appended (given values, medians
        for the rest; a column without values stays without) or with values
        replaced in the one latest row."""
        rows, columns = rows or self.cols, columns or self.cols
        spark, pairs = self.moments.sparkSession, correlate.pairs_of(self.cols, self.cols, self.cols)
        given = {c: v for c, v in (append or replace_latest or {}).items() if v is not None}
        kept, new = self.repeats, None
        if append:
            new = {c: None if m is None else given.get(c, m) for c, m in self.medians.items()}
        elif replace_latest and self.repeats:
            kept, new = self.repeats - 1, {**self.latest, **{c: v for c, v in given.items() if c in self.latest}}
        parts = self.moments.unionByName(correlate.row_parts(spark, self.cols, pairs, self.latest, kept))
        if new is not None:
            parts = parts.unionByName(correlate.row_parts(spark, self.cols, pairs, new))
        idx = correlate.pairs_of(self.cols, rows, columns)
        asked = (F.col("i") * len(self.cols) + F.col("j")).isin([i * len(self.cols) + j for i, j in idx])
        return correlate.correlation_of(correlate.merge_parts(parts.where(asked)), self.cols, rows, columns)
