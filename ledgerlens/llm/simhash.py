"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the bitwise majority over the XXH64 hashes of its
word shingles.  Equal fingerprints form one class; links between classes are
searched with tables of Hamming distances to reference fingerprints (pivots):
by the triangle inequality a pair whose coordinates differ by more than the
allowed distance at any pivot can't be a link; survivors are verified.

So that no two arbitrary rows need meet, rows meet by pigeonhole: with
``blocks`` blocks of bits, a pair within ``max_bits`` bits agrees on at least
``blocks - max_bits`` whole blocks, whose bits are an equi-join key.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import connected_components, materialise, without

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Blocks of the pigeonhole key; more blocks: longer keys, more rows (C(blocks, max_bits) for each class).
BLOCKS = 7
#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: Rows of one key that are compared in one cell; larger keys are split into pairs of cells.
CELL = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    if len(words) <= shingle:
        parts = [joined]
    else:
        parts = [joined[s:e - 1] for s, e in zip(starts, ends[shingle - 1:])]
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text",
                     out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, udf(F.col(text)))


def _masks(blocks: int, max_bits: int) -> list[int]:
    """Signed masks of every choice of ``blocks - max_bits`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    whole = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of 0 .. n-1."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def _links_in_runs(run: np.ndarray, fp: np.ndarray, refs: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, member) joining what is linked inside runs of equal
    ``run`` numbers.  Links chain inside a run, so a star has the same
    components as all its links."""
    n = len(fp)
    near = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    i, label = np.arange(n), np.arange(n)
    left, right = [], []
    for shift in range(1, n):
        i = i[i + shift < n]
        i = i[run[i] == run[i + shift]]
        if not len(i):
            break
        j = i + shift
        ok = (np.abs(near[i] - near[j]) <= max_bits).all(1)
        a, b = i[ok], j[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        if ok.any():
            left.append(a[ok])
            right.append(b[ok])
        if len(left) >= 256:
            label = _merge(label, left, right)
            left, right = [], []
    label = _merge(label, left, right)
    moved = np.flatnonzero(label != np.arange(n))
    return fp[label[moved]], fp[moved]


def _merge(label: np.ndarray, left: list, right: list) -> np.ndarray:
    if not left:
        return label
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def links(classes: DataFrame, fp: str = "fingerprint", max_bits: int = MAX_BITS, blocks: int = BLOCKS,
          n_pivots: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct
    fingerprints within ``max_bits`` bits.  A key of more than ``cell`` rows
    is dealt into cells, and each pair of cells is a task's unit, so no group
    is held whole; inside a unit links are reduced to stars at once."""
    masks = _masks(blocks, max_bits)
    keyed = (classes.select(F.col(fp).alias("f"))
             .select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "k")))
    big = (keyed.groupBy("c", "k").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
           .select("c", "k", F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("nb")))
    # only keys with a second row can hold a link; the rest is dropped by the scan of runs
    units = (keyed.join(big, ["c", "k"], "left")
             .withColumn("nb", F.coalesce("nb", F.lit(1)))
             .withColumn("s", F.pmod(F.xxhash64("f"), F.col("nb")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("c", "k", F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"), "f"))
    refs = pivots(n_pivots)

    def search(batches):
        def emit(t):
            cols = [t.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            f = cols[4].astype(np.int64).view(np.uint64)
            if len(f) < 2:
                return None
            new = np.zeros(len(f), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            run = np.cumsum(new)
            same = np.flatnonzero(run[1:] == run[:-1])
            keep = np.union1d(same, same + 1)
            if not len(keep):
                return None
            a, b = _links_in_runs(run[keep], f[keep], refs, max_bits)
            if not len(a):
                return None
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            cols = [t.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            last = np.ones(t.num_rows, bool)
            for c in cols:
                last &= c == c[-1]
            cut = t.num_rows - int(last[::-1].argmin() if not last.all() else t.num_rows)
            held = t.slice(cut)
            if cut and (out := emit(t.slice(0, cut))) is not None:
                yield out
        if held is not None and (out := emit(held)) is not None:
            yield out

    return (units.repartition("c", "k", "x", "y").sortWithinPartitions("c", "k", "x", "y")
            .mapInArrow(search, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))


def _rooted(docs: DataFrame, shingle: int, max_bits: int, blocks: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash of the text, fingerprint) of every row, and (fingerprint, first doc_id, root of its component)."""
    made = materialise(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), _text_hash(F.col(text)).alias("hash")),
                                        shingle, text="_t").drop("_t"), "simhash")
    classes = made.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    comp = connected_components(links(classes, max_bits=max_bits, blocks=blocks), tag="simhash-links")
    return made, (classes.join(comp, F.col("fingerprint") == F.col("node"), "left")
                  .select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")))


def _text_hash(text):
    return F.when(text.isNotNull(), F.xxhash64(text))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links, itself included).

    A null or wordless text has fingerprint zero and links like any other.
    Repeated rows share a class; a null doc_id never names a component unless
    its component holds no other id.  An empty table gives no rows.
    """
    made, rooted = _rooted(docs, shingle, max_bits, blocks, text, doc_id)
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fingerprint", "component_id")
    return (made.join(named, "fingerprint")
            .select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest
    doc_id (a null one last), of an id's texts that of the smallest hash, and
    any one of rows equal in id and text.  Rows of other components stay, also
    where they share an id or have none."""
    made, rooted = _rooted(docs, shingle, max_bits, blocks, text, doc_id)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    best = made.groupBy("fingerprint").agg(F.min(rank).alias("best"))
    keep = (best.join(rooted.select("fingerprint", "root"), "fingerprint").groupBy("root").agg(F.min("best").alias("best"))
            .select("best._id", "best._hash"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_i"), _text_hash(F.col(text)).alias("_h"))
    # id and hash name a text, and so its component
    named = row.join(keep, F.col("_i").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_hash")), "left_semi")
    return named.dropDuplicates(["_i", "_h"]).select("_row.*")
