"""Benchmark decontamination with an FM-index for each shard of training text.

The phrases (windows of benchmark words) are the query set; every shard of
documents gets an index of its own, built and searched in the task that reads
the shard.  Phrases are searched backwards through wavelet-matrix ranks, their
occurrences located through sampled suffix positions, and the occurrences
merged into removal spans.

The index's alphabet is the benchmark's vocabulary: a word outside it can't be
part of an occurrence and ends a run, and runs shorter than the shortest phrase
hold none, so neither is indexed.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import without

WINDOW = 13
#: Words of a shard (a longer document is a shard of its own).
SHARD_WORDS = 1 << 21
#: Every so many places of a shard keep their suffix position.
SAMPLE = 8
#: Benchmark bytes of a pass; a larger benchmark takes several passes over the documents.
PASS_BYTES = 16 << 20
#: A document is contaminated if at least this share of its words is hit.
MIN_SHARE = 20

# bytes of words (digits, letters, all of non-ASCII) stay, A-Z lower-cased; the rest becomes a space
_TO_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORD).split() if text else []


class Phrases:
    """Distinct phrases of some benchmark items as rows of word numbers (0
    pads at the left), with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            w = [self.words.setdefault(x, len(self.words) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                rows.setdefault(tuple(w[i:i + window]), set()).add(name)
        self.items = [sorted(v) for v in rows.values()]
        self.length = np.array([len(r) for r in rows], np.int64)
        width = int(self.length.max(initial=0))
        self.rows = np.zeros((len(rows), width), np.int32)
        for k, r in enumerate(rows):
            self.rows[k, width - len(r):] = r
        self.shortest = int(self.length.min()) if len(rows) else 1


class FMIndex:
    """Over word numbers 1 .. sigma - 1; 0 ends a run and never matches.
    The last number must be 0."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(seq)
        sa = _suffix_array(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        bwt = np.where(sa > 0, seq[sa - 1], 0)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.n_zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            z = np.zeros(n + 1, np.int32)
            np.cumsum(1 - one, out=z[1:])
            self.zeros.append(z)
            self.n_zeros.append(int(z[-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))
        known = (sa % sample == 0) | (bwt == 0)  # starts of runs are known too: no step leads past them
        self.known = known
        self.known_rank = np.cumsum(known) - 1
        self.sampled = sa[known]

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (z, nz) in enumerate(zip(self.zeros, self.n_zeros)):
            b = (c >> (self.bits - 1 - k)) & 1
            zi = z[i]
            i = np.where(b == 1, nz + i - zi, zi)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows before i whose suffixes, with c put before them, sort there."""
        return self.first[c] + self._down(c, i) - self.start[c]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi) of the phrases that occur."""
        k = np.flatnonzero(self.first[rows[:, -1] + 1] > self.first[rows[:, -1]])
        lo, hi = self.first[rows[k, -1]], self.first[rows[k, -1] + 1]
        for j in range(rows.shape[1] - 2, -1, -1):
            c = rows[k, j]
            more = np.flatnonzero(c > 0)
            if len(more):
                lo, hi = lo.copy(), hi.copy()
                lo[more], hi[more] = self.step(c[more], lo[more]), self.step(c[more], hi[more])
                ok = lo < hi
                k, lo, hi = k[ok], lo[ok], hi[ok]
        return k, lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Places of the suffixes in rows i."""
        out, back, at = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.arange(len(i))
        while len(at):
            known = self.known[i]
            out[at[known]] = self.sampled[self.known_rank[i[known]]] + back[at[known]]
            i, at = i[~known], at[~known]
            back[at] += 1
            c, j = np.zeros(len(i), np.int64), i
            for z, nz in zip(self.zeros, self.n_zeros):
                zj = z[j]
                one = z[j + 1] == zj
                c = 2 * c + one
                j = np.where(one, nz + j - zj, zj)
            i = self.first[c] + j - self.start[c]
        return out


def _suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; only places whose order is still open are sorted
    again.  Zeros differ from each other (by place), so runs bound the depth."""
    n = len(seq)
    key = seq.astype(np.int64) + n
    ends = seq == 0
    key[ends] = np.arange(int(ends.sum()))
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    open_, old, depth = np.arange(n), np.zeros(n, np.int64), 0
    while len(open_):
        o = np.argsort(key, kind="stable")
        key, open_, old = key[o], open_[o], old[o]
        head = np.ones(len(o), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.ones(len(o), bool)
        group[1:] = old[1:] != old[:-1]
        idx = np.arange(len(o))
        fresh = old + np.maximum.accumulate(np.where(head, idx, 0)) - np.maximum.accumulate(np.where(group, idx, 0))
        rank[open_] = fresh
        single = head.copy()
        single[:-1] &= head[1:]
        open_, old = open_[~single], fresh[~single]
        depth = 2 * depth or 1
        key = old * (n + 2) + rank[np.minimum(open_ + depth, n)] + 1
    sa = np.zeros(n, np.int64)
    sa[rank[:n]] = np.arange(n)
    return sa


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and (text, first word, phrase) of each occurrence."""
    numbers = [np.fromiter(map(phrases.words.get, w, repeat(0)), np.int32, len(w)) for w in map(words_of, texts)]
    n_words = np.array([len(x) for x in numbers], np.int64)
    none = np.zeros(0, np.int64)
    if not len(phrases.items) or not n_words.sum():
        return n_words, none, none, none
    end = np.zeros(1, np.int32)
    seq = np.concatenate([x for pair in zip(numbers, repeat(end)) for x in pair])
    begins = np.concatenate([[0], np.cumsum(n_words + 1)[:-1]])
    ends = np.flatnonzero(seq == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    long = ends - starts >= phrases.shortest
    if not long.any():
        return n_words, none, none, none
    delta = np.zeros(len(seq) + 1, np.int32)
    np.add.at(delta, starts[long], 1)
    np.add.at(delta, ends[long] + 1, -1)
    place = np.flatnonzero(np.cumsum(delta[:-1]))
    index = FMIndex(seq[place], len(phrases.words) + 1)
    k, lo, hi = index.search(phrases.rows)
    many = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
    at = place[index.locate(rows)]
    text = np.searchsorted(begins, at, side="right") - 1
    return n_words, text, at - begins[text], np.repeat(k, many)


def _merge_spans(text: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or adjoining spans of a text become one."""
    o = np.lexsort((first, text))
    text, first, after = text[o], first[o], after[o]
    if not len(o):
        return text, first, after
    wide = int(after.max()) + 2
    reach = np.maximum.accumulate(text * wide + after)
    new = np.ones(len(o), bool)
    new[1:] = text[1:] * wide + first[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    last = np.concatenate([heads[1:] - 1, [len(o) - 1]])
    return text[heads], first[heads], reach[last] - text[heads] * wide


SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())])
HITS = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def _annotate(batch: pa.RecordBatch, phrases: Phrases, text: str, keep: list[str], again: bool) -> pa.RecordBatch:
    name, *inner = text.split(".")
    column = batch.column(name)
    for x in inner:
        column = column.field(x)
    texts = column.cast(pa.binary()).to_pylist()
    n = len(texts)
    sizes = np.cumsum([len(t) if t else 0 for t in texts])
    cuts = [0]
    while cuts[-1] < n:  # a word takes two bytes at least
        base = sizes[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sizes, base + 4 * SHARD_WORDS, side="right"))))
    found = [search_shard(texts[a:b], phrases) for a, b in zip(cuts, cuts[1:])]
    n_words = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    row = np.concatenate([f[1] + a for f, a in zip(found, cuts)]) if found else np.zeros(0, np.int64)
    first = np.concatenate([f[2] for f in found]) if found else row
    phrase = np.concatenate([f[3] for f in found]) if found else row
    after = first + phrases.length[phrase]
    items: dict[int, set[str]] = {}
    if len(row):
        for r, p in np.unique(np.stack([row, phrase]), axis=1).T:
            items.setdefault(int(r), set()).update(phrases.items[p])
    if again:  # with what earlier passes found
        for r, (sp, it) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
            if sp:
                row = np.concatenate([row, np.full(len(sp), r)])
                first = np.concatenate([first, [s["first"] for s in sp]])
                after = np.concatenate([after, [s["after"] for s in sp]])
            if it:
                items.setdefault(r, set()).update(it)
    row, first, after = _merge_spans(row, first, after)
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(after, pa.int64())], ["first", "after"]))
    names = pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n_words, pa.int64()), spans, names], [*keep, "n_words", "spans", "items"])


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, spans (array of first word and word after, merged)
    and items (sorted item_ids, as strings, that have an occurring window);
    input columns of these names are replaced.

    A null or empty text has no words.  Benchmark rows with a null id or
    without words are left out; rows with one id are one item, equal items
    each count.  An empty benchmark finds nothing, an empty table gives no
    rows.  The benchmark is the query set: it passes the documents in blocks
    of PASS_BYTES, each broadcast at that bound; no shuffle takes place.
    """
    df = without(docs, "n_words", "spans", "items")
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = int(total // PASS_BYTES) + 1
    spark, again = docs.sparkSession, False
    for k in range(passes):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r.i, r.t.encode()) for r in block], window))
        keep = [c for c in df.columns if c not in ("n_words", "spans", "items") and (c != text or keep_text or k < passes - 1)]
        fields = [df.schema[c] for c in keep]

        def run(batches, phrases=phrases, keep=keep, again=again):
            for batch in batches:
                yield _annotate(batch, phrases.value, text, keep, again)

        df, again = df.mapInArrow(run, T.StructType([*fields, *HITS])), True
    return df


def n_hit():
    """Words inside any span."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["after"] - s["first"])


def contaminated():
    return (n_hit() > 0) & (MIN_SHARE * n_hit() >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_passages(docs.select("doc_id", "text"), benchmark, keep_text=False, **kw).select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return find_passages(row, benchmark, text="_row.text").filter(~contaminated()).select("_row.*")
