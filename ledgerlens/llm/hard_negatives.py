"""Hard negatives by cover trees over norm-augmented vectors.

A coordinate sqrt(M^2 - |x|^2) (M: the greatest norm) puts all candidates on a
sphere, where inner products with a query fall with distance.  Candidates go to
the nearest of a bounded number of centres, each such cell to shards of bounded
size, and each shard becomes a cover tree: every level's centres cover the
points below them within a radius 1 / ``BASE`` of the level above.  The radii
bound inner products from both sides; a best-first descent leaves out nodes
outside the windows asked for and scores the points it meets exactly.
"""

from __future__ import annotations

import heapq
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise
from ledgerlens.llm.vectors import matrix, on_grid, usable

BASE = 1.3
#: Sets of this many points or fewer are not split further.
LEAF = 16
#: Rows of a shard (on average), cells at most, rows of the sample that the cells' centres are chosen from.
SHARD_ROWS, MAX_CELLS, SAMPLE_ROWS = 4096, 256, 4096
#: Anchors that meet a tree in one task (on average).
TASK_ANCHORS = 8192
#: Anchors that descend a tree together.
BLOCK = 256
POSITIVES, NEGATIVES = 5, 3
#: Negatives lie between these hundredths of the positive's score.
LOW, HIGH = 50, 95
ANCHOR_EVERY = 50
_LONG = 2 ** 63


# ---- the tree ---------------------------------------------------------------------
class CoverTree:
    """Arrays of a tree.  Points (by row): x, vec_id, no_id, rid, label, extra
    (the augmenting coordinate).  Nodes (children of a node are neighbours):
    point, own (the point is met here first), radius, first, count, least and
    greatest label below."""

    FIELDS = ("x", "vec_id", "no_id", "rid", "label", "point", "own", "radius", "first", "count", "least", "greatest")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)
        self._float = self.x.astype(np.float64)
        self._reach = float(np.abs(self._float).max(initial=0.0))

    def scores(self, points: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products, queries by points: float64 while it holds them,
        then Python's whole numbers, which end where a long does."""
        if self._reach * float(np.abs(q.astype(np.float64)).max(initial=0.0)) * max(1, q.shape[1]) < 2 ** 52:
            return q.astype(np.float64) @ self._float[points].T
        return np.minimum(np.maximum(q.astype(object) @ self.x[points].astype(object).T, -_LONG), _LONG - 1)

    def to_bytes(self) -> bytes:
        x, out = self.x, io.BytesIO()
        top = int(np.abs(x).max(initial=0)) if x.size and x.min() > -_LONG else _LONG
        small = np.int16 if top < 2 ** 15 else np.int32 if top < 2 ** 31 else np.int64
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS if f != "x"}, x=x.astype(small))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> "CoverTree":
        with np.load(io.BytesIO(data)) as z:
            return CoverTree(**{f: z[f] for f in CoverTree.FIELDS} | {"x": z["x"].astype(np.int64)})


def build(x: np.ndarray, vec_id, no_id, rid, label, norm2: float) -> CoverTree:
    """A cover tree of the rows of ``x`` (none twice, equal ones allowed)."""
    f = x.astype(np.float64)
    p = np.column_stack([f, np.sqrt(np.maximum(norm2 - (f * f).sum(axis=1), 0.0))])
    slack = 1e-6 * np.sqrt(norm2)  # rounding of the distances
    square = (p * p).sum(axis=1)

    def distances(to: int, of: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[of] + square[to] - 2 * (p[of] @ p[to]), 0.0))

    nodes = []  # point, own, radius, first, count, least, greatest
    below = []  # the points below each node and their distances

    def node(point, own, members, apart) -> None:
        labels = label[np.append(members, point)]
        nodes.append([point, own, 0.0, 0, 0, labels.min(), labels.max()])
        below.append((members, apart))

    everything = np.arange(1, len(x))
    node(0, True, everything, distances(0, everything))
    k = 0
    none = np.zeros(0, np.int64)
    while k < len(nodes):
        members, apart = below[k]
        below[k] = None
        if len(members):
            radius = float(apart.max())
            nodes[k][2], nodes[k][3] = radius + slack, len(nodes)
            def child(point, own, below_it, d) -> None:
                # few points need no node above them: they stand beside it
                few = len(below_it) <= LEAF or radius <= slack
                if own or not few:
                    node(point, own, none if few else below_it, none if few else d)
                for m in below_it if few else ():
                    node(m, True, none, none)

            cover = radius / BASE
            near = apart <= cover if radius > slack else apart <= radius
            child(nodes[k][0], False, members[near], apart[near])
            rest = members[~near]
            while len(rest):
                d = distances(rest[0], rest[1:])
                near = d <= cover
                child(rest[0], True, rest[1:][near], d[near])
                rest = rest[1:][~near]
            nodes[k][4] = len(nodes) - nodes[k][3]
        k += 1
    cols = list(zip(*nodes))
    kinds = (np.int32, bool, np.float64, np.int32, np.int32, np.int64, np.int64)
    point, own, radius, first, count, least, greatest = (np.array(c, t) for c, t in zip(cols, kinds))
    return CoverTree(x=x, vec_id=vec_id, no_id=no_id, rid=rid, label=label, point=point, own=own, radius=radius, first=first,
                     count=count, least=least, greatest=greatest)


def bounds(score, q2, norm2: float, radius) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of a query (squared norm ``q2``) with
    points of squared norm ``norm2`` at most, within ``radius`` (on the sphere)
    of a centre whose inner product is ``score``."""
    score = np.asarray(score, np.float64)
    away = np.sqrt(np.maximum(q2 + norm2 - 2 * score, 0.0))
    slack = 1e-9 * (q2 + norm2) + 1e-9
    high = np.minimum(score + np.sqrt(q2) * radius, (q2 + norm2 - np.maximum(away - radius, 0.0) ** 2) / 2)
    low = np.maximum(score - np.sqrt(q2) * radius, (q2 + norm2 - (away + radius) ** 2) / 2)
    return np.minimum(low - slack, float(_LONG)), np.maximum(high + slack, -float(_LONG))


class Windows:
    """The ``k`` best rows found so far of each window (lows[a, w], highs[a, w])
    of a block of queries."""

    def __init__(self, tree: CoverTree, lows: np.ndarray, highs: np.ndarray, k: int):
        self.tree, self.highs, self.k = tree, highs, k
        self.least = lows.copy()  # no score below these can enter any more
        self.found: list[tuple | None] = [None] * lows.shape[1]  # by window: queries, scores, points; best first by query

    def offer(self, asked: np.ndarray, points: np.ndarray, scores: np.ndarray, fit: np.ndarray) -> None:
        """Scores of ``points`` for the queries ``asked``, where ``fit`` allows them."""
        for w in range(len(self.found)):
            hit = fit & (scores >= self.least[asked, w][:, None]) & (scores <= self.highs[asked, w][:, None])
            if hit.shape[1] > 4 * self.k and hit.any():
                # of many, those from the k-th best on
                ranked = np.sort(np.where(hit, scores, -_LONG), axis=1) if scores.dtype == object else \
                    np.partition(np.where(hit, scores, -np.inf), -self.k, axis=1)
                hit &= scores >= ranked[:, -self.k][:, None]
            a, p = np.nonzero(hit)
            if not len(a):
                continue
            new = asked[a], scores[a, p], points[p]
            if self.found[w] is not None:
                touched = np.isin(self.found[w][0], new[0])
                rest = tuple(c[~touched] for c in self.found[w])
                new = tuple(np.concatenate([c[touched], n]) for c, n in zip(self.found[w], new))
            else:
                rest = tuple(n[:0] for n in new)
            q, score, point = new
            order = self._order(q, score, point)
            q, score, point = q[order], score[order], point[order]
            starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            q, score, point = q[rank < self.k], score[rank < self.k], point[rank < self.k]
            last = rank[rank < self.k] == self.k - 1
            self.least[q[last], w] = np.maximum(self.least[q[last], w], score[last])
            self.found[w] = tuple(np.concatenate([r, n]) for r, n in zip(rest, (q, score, point)))

    def _order(self, q, score, point) -> np.ndarray:
        """By query, then best score, then smallest vec_id (none: last), then rid."""
        t = self.tree
        if score.dtype == object:
            score = np.unique(score, return_inverse=True)[1]
        return np.lexsort((t.rid[point], t.vec_id[point], t.no_id[point], -score, q))

    def rows(self) -> list[tuple]:
        """(query, window, score, no_id, vec_id, rid)"""
        t, out = self.tree, []
        for w, got in enumerate(self.found):
            if got is not None:
                q, score, point = got
                out += [(int(a), w, int(s), bool(t.no_id[p]), int(t.vec_id[p]), int(t.rid[p])) for a, s, p in zip(q, score, point)]
        return out


def descend(tree: CoverTree, q: np.ndarray, rid: np.ndarray, label: np.ndarray, same: bool, lows: np.ndarray, highs: np.ndarray, k: int,
            norm2: float) -> list[tuple]:
    """For each query of a block (rows of ``q``) and each of its windows of
    scores [low, high] the ``k`` best rows of the query's label (or of other
    labels) but the query itself: (query, window, score, no_id, vec_id, rid).

    Nodes are met by the best score they could add to any window of any query;
    a node is scored for those queries alone whose windows it reaches into."""
    q2 = (q.astype(np.float64) ** 2).sum(axis=1)
    best = Windows(tree, lows, highs, k)
    order = itertools.count()
    heap: list[tuple] = []

    def wanted(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The best score that nodes could add for queries (queries by nodes), -inf for none."""
        top = np.full(low.shape, -np.inf)
        for w in range(lows.shape[1]):
            least, most = (m[asked, w].astype(np.float64)[:, None] for m in (best.least, highs))
            top = np.maximum(top, np.where((high >= least) & (low <= most), np.minimum(high, most), -np.inf))
        return top

    def meet(asked: np.ndarray, first: int, count: int) -> None:
        node = np.arange(first, first + count)
        points, mine = tree.point[node], label[asked][:, None]
        s = tree.scores(points, q[asked])
        alike = tree.label[points] == mine
        best.offer(asked, points, s, tree.own[node] & (alike if same else ~alike) & (tree.rid[points] != rid[asked][:, None]))
        inner = np.flatnonzero(tree.count[node] > 0)
        if len(inner):
            n = node[inner]
            low, high = bounds(s[:, inner], q2[asked][:, None], norm2, tree.radius[n])
            fit = (tree.least[n] <= mine) & (mine <= tree.greatest[n]) if same else (tree.least[n] != mine) | (tree.greatest[n] != mine)
            top = np.where(fit, wanted(asked, low, high), -np.inf)
            for j, one in enumerate(n):
                reach = np.flatnonzero(top[:, j] > -np.inf)
                if len(reach):
                    heapq.heappush(heap, (-top[reach, j].max(), next(order), int(one), asked[reach], low[reach, j], high[reach, j]))

    meet(np.arange(len(q)), 0, 1)
    while heap:
        _, _, n, asked, low, high = heapq.heappop(heap)
        asked = asked[wanted(asked, low[:, None], high[:, None])[:, 0] > -np.inf]
        if len(asked):
            meet(asked, int(tree.first[n]), int(tree.count[n]))
    return best.rows()


# ---- Spark jobs -------------------------------------------------------------------
def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first centres: the top level of a cover tree over the sample."""
    chosen = [0]
    apart = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and apart.max() > 0:
        chosen.append(int(np.argmax(apart)))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _augmented(x: np.ndarray, norm2: float) -> np.ndarray:
    f = x.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(norm2 - (f * f).sum(axis=1), 0.0))])


def _route(size: int, norm2: float, centres: np.ndarray):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                p = _augmented(matrix(pdf["x"], size), norm2)
                d = np.maximum((p * p).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (p @ centres.T), 0.0)
                pdf["cell"] = d.argmin(axis=1).astype(np.int32)
                pdf["apart"] = np.sqrt(((p - centres[pdf["cell"]]) ** 2).sum(axis=1))
                yield pdf

    return run


def _build(size: int, norm2: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        none = pdf["vec_id"].isna().to_numpy()
        ids = pdf["vec_id"].astype("Int64").fillna(0).to_numpy(np.int64)
        tree = build(matrix(pdf["x"], size), ids, none, pdf["rid"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), norm2)
        return pd.DataFrame({"cell": [key[0]], "salt": [key[1]], "tree": [tree.to_bytes()]})

    return run


def _visits(size: int, norm2: float, centres: np.ndarray, radii: np.ndarray):
    """Anchors times the cells that can hold a row of one of their windows."""
    slack = 1e-6 * np.sqrt(norm2)

    def run(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrix(pdf["x"], size).astype(np.float64)
            q2 = (x * x).sum(axis=1)
            cells = []
            for row, square, lows, highs in zip(x, q2, pdf["lows"], pdf["highs"]):
                low, high = bounds(centres[:, :-1] @ row, square, norm2, radii + slack)
                hit = np.zeros(len(centres), bool)
                for a, b in zip(lows, highs):
                    hit |= (high >= a) & (low <= b)
                cells.append(np.flatnonzero(hit).tolist())
            yield pdf.assign(cells=cells)

    return run


def _search(size: int, norm2: float, same: bool, best: int):
    names = ["rid", "place", "score", "no_id", "vec_id", "other"]

    def run(anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(trees):
            tree = CoverTree.from_bytes(trees["tree"].iloc[0])
            rid, label = anchors["rid"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
            width = anchors["lows"].map(len).to_numpy()
            for w in np.unique(width):  # anchors of as many windows go together
                at = np.flatnonzero(width == w)
                for k in range(0, len(at), BLOCK):
                    some = at[k:k + BLOCK]
                    lows, highs = (matrix(anchors[c].iloc[some], w) for c in ("lows", "highs"))
                    got = descend(tree, matrix(anchors["x"].iloc[some], size), rid[some], label[some], same, lows, highs, best, norm2)
                    out += [(rid[some[a]], place, score, *row) for a, place, score, *row in got]
        return pd.DataFrame(out, columns=names).astype({"rid": "int64", "place": "int32", "score": "int64", "no_id": "bool", "vec_id": "int64",
                                                        "other": "int64"})

    return run


class Index:
    """Cover trees of all rows, in the shared folder."""

    def __init__(self, rows: DataFrame):
        """``rows``: rid, vec_id, label (long), x (array of long), written."""
        top = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("size"), F.max(F.aggregate(
            "x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("norm2")).first()
        self.n, self.size, self.norm2 = top.n, top.size or 0, (top.norm2 or 0.0) * (1 + 1e-12)
        sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE_ROWS).select("x").toPandas()
        cells = min(MAX_CELLS, max(1, -(-self.n // SHARD_ROWS)))
        points = _augmented(matrix(sample["x"], self.size), self.norm2)
        self.centres = _centres(points, cells) if self.n else points
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        routed = materialise(rows.mapInPandas(_route(self.size, self.norm2, self.centres), f"{schema}, cell int, apart double"), "negatives-cells")
        of_cell = {r.cell: r for r in routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}
        # a cell without rows has no radius that could meet a window
        self.radii = np.array([of_cell[c].radius if c in of_cell else -np.inf for c in range(len(self.centres))])
        self.salts = [-(-of_cell[c].n // SHARD_ROWS) if c in of_cell else 0 for c in range(len(self.centres))]
        salts = F.element_at(F.array(*[F.lit(max(1, s)) for s in self.salts] or [F.lit(1)]), F.col("cell") + 1)
        self.rows = routed.withColumn("salt", F.pmod(F.xxhash64("rid"), salts).cast("int"))
        self.trees = materialise(self.rows.groupBy("cell", "salt").applyInPandas(
            _build(self.size, self.norm2), "cell int, salt int, tree binary"), "negatives-trees")

    def search(self, anchors: DataFrame, same: bool, k: int, parts: int, everywhere: bool = True) -> DataFrame:
        """(rid, place, score, no_id, vec_id, other): the ``k`` best rows of
        each window (lows[place], highs[place]) of the anchors (rid, label, x,
        lows, highs; cell and salt unless ``everywhere``)."""
        cols = ["rid", "label", "x", "lows", "highs"]
        if everywhere:
            schema = ", ".join(f"{c} {anchors.schema[c].dataType.simpleString()}" for c in cols)
            counts = F.array(*[F.lit(s) for s in self.salts] or [F.lit(0)])
            anchors = (anchors.select(*cols).mapInPandas(_visits(self.size, self.norm2, self.centres, self.radii), f"{schema}, cells array<int>")
                       .select(*cols, F.explode("cells").alias("cell"))
                       .withColumn("salts", F.element_at(counts, F.col("cell") + 1)).where("salts > 0")
                       .select(*cols, "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
        keys = ["cell", "salt", "part"]
        asked = anchors.select(*cols, "cell", "salt", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
        trees = self.trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        hits = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(
            _search(self.size, self.norm2, same, k), "rid long, place int, score long, no_id boolean, vec_id long, other long")
        w = Window.partitionBy("rid", "place").orderBy(F.col("score").desc(), "no_id", "vec_id", "other")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         vector: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Rows need a label and a vector without null or non-finite entries; a
    component counts as floor(256 * c), shorter vectors as padded with zeros.
    Anchors are the rows where ``is_anchor`` (vec_id divisible by 50) holds.
    An anchor's positives are its best other rows of the same label, its
    negatives those of other labels with ``low`` * p <= 100 * score <= ``high``
    * p for the positive's score p; ties go to the smaller vec_id, null last.  Each
    row counts for itself, also when it repeats another or its id is null; a
    positive without negatives has no row; an empty table gives none.  Scores
    are exact; beyond a long they count as its end.
    """
    is_anchor = F.col(vec_id) % ANCHOR_EVERY == 0 if is_anchor is None else is_anchor
    rows = materialise(
        vectors.where(F.col(label).isNotNull() & usable(vector))
        .select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                on_grid(vector).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "negatives-rows")
    index = Index(rows)
    anchors = index.rows.where("anchor")
    parts = max(1, -(-anchors.count() // TASK_ANCHORS))
    top = F.array(F.lit(_LONG - 1))
    # the anchor's own shard first: its last positive bounds the search of the others
    own = index.search(anchors.withColumn("lows", F.array(F.lit(-_LONG))).withColumn("highs", top), True, positives, parts, everywhere=False)
    least = own.where(F.col("rank") == positives).select("rid", F.col("score").alias("least"))
    first = anchors.join(least, "rid", "left").withColumn(
        "lows", F.array(F.coalesce("least", F.lit(-_LONG)))).withColumn("highs", top)
    found = materialise(index.search(first, True, positives, parts), "negatives-positives")
    windows = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").alias("r"), F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score"))).alias("pos"))
    near = (anchors.join(windows, "rid")
            .withColumn("lows", F.transform("pos", lambda p: F.ceil(p["score"] * F.lit(low).cast("decimal(4,0)") / 100).cast("long")))
            .withColumn("highs", F.transform("pos", lambda p: F.floor(p["score"] * F.lit(high).cast("decimal(4,0)") / 100).cast("long"))))
    near = materialise(near.select("rid", F.col("vec_id").alias("anchor_id"), "label", "x", "pos", "lows", "highs"), "negatives-windows")
    hits = index.search(near, False, negatives, parts)
    return (hits.join(near.select("rid", "anchor_id", "pos"), "rid")
            .select("anchor_id", F.col("pos")[F.col("place")]["vec_id"].alias("positive_id"), "rank",
                    F.when(~F.col("no_id"), F.col("vec_id")).alias("negative_id"),
                    F.col("pos")[F.col("place")]["score"].alias("positive_score"), F.col("score").alias("negative_score")))


def negatives_report(vectors: DataFrame) -> DataFrame:
    """``mine`` after every seventh label is moved to the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"))


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, o.rid AS other, o.vec_id, a.label = o.label AS same, list_inner_product(a.x, o.x)::BIGINT AS score
      FROM v a JOIN v o ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.rid <> o.rid),
p AS (SELECT rid, anchor_id, other AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         (row_number() OVER (PARTITION BY p.rid, positive ORDER BY score DESC, vec_id NULLS LAST, other))::INT AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT same
  WHERE {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
WHERE rank <= {NEGATIVES}
"""
