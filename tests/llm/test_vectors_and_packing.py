"""Hard negatives, whitening and packing against brute force and on odd input."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import hard_negatives, packing, queries, whitening
from ledgerlens.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int, score double, rid string, cell string, component int, x int"


def vectors_of(spark, rows):
    """Rows (vec_id, vector, label) with extra columns of names that the operators use."""
    return spark.createDataFrame([(i, v, g, 1.0, "r", "c", 9, 8) for i, v, g in rows], VECTORS)


def grid(v, size):
    return [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] + [0] * (size - len(v))


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def cloud(n, size, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, size))
    v = centres[r.integers(0, 6, n)] + spread * r.standard_normal((n, size))
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).tolist()


def odd_vectors():
    r = random.Random(4)
    v = cloud(260, 6, 5)
    rows = [(i, v[i], r.randrange(3)) for i in range(260)]
    rows += [(100, v[100], 1), (100, v[100], 1), (None, v[3], 0), (None, v[3], 2), (400, None, 1), (450, v[9], None), (500, [float("nan")] + v[1][1:], 1),
             (550, v[2][:4], 1), (600, [None] * 6, 1), (650, [], 2), (700, [float("inf")] * 6, 2), (750, [0.0, -0.0, 0.0, 0.0, 0.0, 0.0], 1), (-50, v[8], 0)]
    return rows + [(1000 + i, v[7], i % 2) for i in range(120)]  # one vector in a third of the rows


# 11: hard negatives

def brute_negatives(rows, moved=False):
    kept = [(k, i, (g + 1) % 10 if moved and i is not None and i % 7 == 0 else g, v) for k, (i, v, g) in enumerate(rows) if g is not None and good(v)]
    size = max((len(v) for *_, v in kept), default=0)
    kept = [(k, i, g, np.array(grid(v, size), object)) for k, i, g, v in kept]
    order = lambda s, i, k: (-s, i is None, i or 0, k)
    out = []
    for k, i, g, v in kept:
        if i is None or i % 50:
            continue
        scored = sorted(((order(int(v.dot(w)) if size else 0, j, m), h) for m, j, h, w in kept if m != k), key=lambda t: t[0])
        for (s, nil, j, _), _ in [t for t in scored if t[1] == g][:5]:
            p = -s
            inside = [t for t in scored if t[1] != g and 50 * p <= -100 * t[0][0] <= 95 * p][:3]
            out += [(i, None if nil else j, r + 1, None if t[0][1] else t[0][2], p, -t[0][0]) for r, t in enumerate(inside)]
    return Counter(out)


@pytest.mark.parametrize("shard", [4096, 50])
def test_negatives_on_odd_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "TASK_ANCHORS", 3)
    rows = odd_vectors()
    got = hard_negatives.negatives_report(vectors_of(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, moved=True)


def test_negatives_of_an_empty_table(spark):
    assert hard_negatives.mine(vectors_of(spark, [])).collect() == []
    assert hard_negatives.mine(vectors_of(spark, [(50, None, 1)])).collect() == []
    assert hard_negatives.mine(vectors_of(spark, [(50, [1.0], 1)])).collect() == []


def test_negatives_of_huge_components_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.uniform(-1, 1) * 2.0 ** 18)) for _ in range(3)], i % 3) for i in range(0, 60, 5)]
    assert Counter(map(tuple, hard_negatives.mine(vectors_of(spark, rows)).collect())) == brute_negatives(rows)


def test_negatives_beyond_a_long_do_not_crash(spark):
    rows = [(i, [1e12 + i, -1e11 * i], i % 2) for i in range(0, 100, 10)]
    got = hard_negatives.mine(vectors_of(spark, rows)).collect()
    assert all(r.positive_score == 2 ** 63 - 1 for r in got)


def test_tree_covers_every_point_once_and_descends_exactly():
    r = np.random.default_rng(8)
    for spread, n in ((0.05, 900), (1.0, 300), (0.0, 200)):
        x = np.floor(256 * np.array(cloud(n, 8, n, spread))).astype(np.int64)
        labels = r.integers(0, 4, n)
        norm2 = float((x * x).sum(axis=1).max())
        tree = hard_negatives.build(x, np.arange(n), np.zeros(n, bool), np.arange(n), labels, norm2)
        tree = hard_negatives.CoverTree.from_bytes(tree.to_bytes())
        assert sorted(tree.point[tree.own]) == list(range(n))
        p = hard_negatives._augmented(x, norm2)

        def below(k):
            for c in range(tree.first[k], tree.first[k] + tree.count[k]):
                yield c
                yield from below(c)

        for k in range(len(tree.point)):
            inside = [tree.point[c] for c in below(k)]
            assert all(np.linalg.norm(p[j] - p[tree.point[k]]) <= tree.radius[k] + 1e-6 for j in inside)
        asked = np.arange(0, n, 37)
        s = x @ x[asked].T
        lows = np.column_stack([s.min(axis=0) + 5, np.full(len(asked), 20_000), np.full(len(asked), 70_000)])
        highs = np.column_stack([np.full(len(asked), h) for h in (40_000, 50_000, 10)])
        got = Counter(hard_negatives.descend(tree, x[asked], asked, labels[asked], False, lows, highs, 4, norm2))
        assert got == Counter((c, w, int(s[j, c]), False, j, j) for c, a in enumerate(asked) for w in range(3) for j in sorted(
            (j for j in range(n) if labels[j] != labels[a] and lows[c, w] <= s[j, c] <= highs[c, w]), key=lambda j: (-s[j, c], j))[:4])


def test_descent_leaves_out_most_of_a_clustered_table(monkeypatch):
    x = np.floor(256 * np.array(cloud(3000, 8, 1, 0.03))).astype(np.int64)
    norm2 = float((x * x).sum(axis=1).max())
    tree = hard_negatives.build(x, np.arange(3000), np.zeros(3000, bool), np.arange(3000), np.arange(3000) % 2, norm2)
    seen = []
    plain = hard_negatives.CoverTree.scores
    monkeypatch.setattr(hard_negatives.CoverTree, "scores", lambda self, points, q: seen.append(len(points)) or plain(self, points, q))
    hard_negatives.descend(tree, x[5:6], np.array([5]), np.array([1]), True, np.array([[-2 ** 63]]), np.array([[2 ** 63 - 1]]), 5, norm2)
    assert sum(seen) < 1000


# 12: whitening

def brute_whitening(rows):
    kept = [(i, v) for i, v, _ in rows if good(v)]
    size = max(len(v) for _, v in kept)
    x = np.array([grid(v, size) for _, v in kept], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit - s / n).astype(float)
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    return [i for i, _ in kept], ((n * x - s) ** 2).sum(axis=1), (x - s / n).astype(float) @ q / np.sqrt(e), e / np.trace(v), n


@pytest.mark.parametrize("rows", [odd_vectors(), [(r, v, 1) for r, v in enumerate(cloud(500, 20, 3))]], ids=["odd", "plain"])
def test_whitening_against_a_dense_solver(spark, rows):
    ids, deviation, w, explained, n = brute_whitening(rows)
    got = whitening.whitening_report(vectors_of(spark, rows)).toPandas()
    assert len(got) == 4 * len(ids) and set(got.n) == {n}
    assert got.identity_error.max() < 1e-9
    assert Counter(zip(got.vec_id.fillna(-1), got.deviation)) == Counter({k: 4 * c for k, c in Counter(
        (-1 if i is None else i, d) for i, d in zip(ids, deviation)).items()})
    for c in range(4):
        one = got[got.component == c + 1].sort_values(["deviation", "whitened"])
        assert np.allclose(one.explained, explained[c], rtol=1e-10)
        sums = [np.array(sorted(sign * w[:, c])) for sign in (1, -1)]
        assert any(np.allclose(np.sort(one.whitened), s, atol=1e-8) for s in sums)


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25], 1)] * 3)).collect() == []  # no direction at all
    got = whitening.whiten(vectors_of(spark, [(1, [0.0, 0.0, 1.0], 1), (2, [0.0, 0.0, 0.5], 1), (2, [0.0, 0.0, 0.5], 1)])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in got) == [
        (1, 1, 2, 128 ** 2, 1.0), (2, 1, 2, 128 ** 2, 1.0), (2, 1, 2, 128 ** 2, 1.0)]


def test_whitening_of_vectors_beyond_a_long(spark):
    rows = [(i, [float(i % 3) * 2.0 ** 40, float(i) * 2.0 ** 41], 1) for i in range(5)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert len(got) == 10 and all(r.deviation is None or r.deviation >= 0 for r in got) and got[0].identity_error < 1e-9


def test_contour_integration_and_inertia_against_a_dense_solver():
    r = np.random.default_rng(0)
    for n in range(1, 30):
        z = r.standard_normal((n, n))
        z = z + z.T
        w = np.linalg.eigvalsh(z)
        inertia = whitening.Inertia(z)
        assert inertia.above(0.0) == (w > 0).sum()
        assert inertia.above((w[1:] + w[:-1]) / 2).tolist() == list(range(n - 1, 0, -1))
        low = (w[n // 2] + w[n // 2 - 1]) / 2 if n > 1 else w[0] - 1
        e, v = whitening.feast(z, low, w[-1] + 1, inertia.above(low))
        assert np.allclose(e, w[w > low][::-1]) and np.allclose(z @ v, v * e, atol=1e-10)
    assert np.allclose(whitening.top_components(np.diag([3.0, 3, 3, 2, 0]), 2)[0], [3, 3], rtol=1e-13)
    for power in (1.0, 4.0, 1e-3):  # steep, and so flat that the next eigenvalues lie close by
        q, _ = np.linalg.qr(r.standard_normal((60, 60)))
        w = np.sort(1000.0 * (1 + np.arange(60) / 60) ** power)[::-1]
        e, v = whitening.top_components((q * w) @ q.T, 4)
        assert np.allclose(e, w[:4], rtol=1e-12) and np.allclose(np.abs(np.sum(v * q[:, :4], axis=0)), 1, atol=1e-9)
    with pytest.raises(ArithmeticError):  # the interval doesn't hold what is asked of it
        whitening.feast(np.diag([5.0, 1.0, 0.5]), 4.0, 6.0, 2)


# 13: packing

def library_ids(text, encoder=Tokenizer.from_file(WORDS)):
    return encoder.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_packed(rows, docs, window):
    """Every id in one piece, sequences gapless, none padded but full or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0)
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(library_ids(t))
    assert set(by_doc) == set(want)
    for i, texts in want.items():
        left = list(by_doc[i])
        for ids in texts:  # repeated ids: each row's pieces are there
            at = 0
            while at < len(ids):
                r = next(r for r in left if r.start == at and r.doc_tokens == len(ids)
                         and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()))
                left.remove(r)
                at += r.length
            assert at == len(ids)
        assert not left


def test_packing_query_round_trip(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    check_packed(queries.op13_packing(spark, SF).collect(), docs, 2048)


def test_packing_odd_documents(spark, odd):
    rows = packing.packing_report(odd, WORDS).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in odd.collect()], 2048)
    assert packing.packing_report(odd.limit(0), WORDS).collect() == []
    assert [r for r in rows if r.doc_id == 2][0].doc_tokens == 1


@pytest.mark.parametrize("max_open", [2, 4096])
def test_packer_cuts_and_fills(max_open):
    r = random.Random(6)
    for sizes in ([r.randrange(1, 40) for _ in range(300)], [12] * 100, [16, 32, 33], [1], []):
        packer, made = packing.Packer(16, max_open), []
        for k, n in enumerate(sizes):
            made += packer.add(k, np.arange(n) + 100 * k)
            assert packer.n_open <= max_open
            assert packer.counts.tolist() == [len(p) for p in packer.open]
        made += packer.finish()
        ends = Counter(sum(len(p[2]) for p in s) for s in made)
        assert all(n == 16 or (n & (n - 1) == 0 and c == 1) for n, c in ends.items())
        got = defaultdict(dict)
        for s in made:
            for doc, start, ids, total in s:
                assert total == sizes[doc]
                got[doc].update({start + j: int(v) for j, v in enumerate(ids)})
        assert all(got[k] == {j: 100 * k + j for j in range(n)} for k, n in enumerate(sizes))


def test_level_has_the_least_sum_of_squares():
    r = random.Random(9)
    for _ in range(300):
        packer = packing.Packer(16)
        packer.counts[1:16] = [r.choice([0, 0, 1, 2, 5]) for _ in range(15)]
        size = r.randrange(1, 16)

        def total(level):
            n = packer.counts.copy()
            n[level] -= level > 0
            n[level + size] += 1
            return int((n[1:16] ** 2).sum())

        best = min((total(h), -h) for h in range(0, 17 - size) if h == 0 or packer.counts[h])
        assert packer.level_for(size) == -best[1]


def test_chunks_have_the_librarys_ids():
    r = random.Random(1)
    letters = "aAßsS’'s t\n\t\r\x1c\x85  Σσς́ÅÅé12<|endoftext|>中文한Ⅳ½İ​\x0b\x0c　é.,;!_-"
    encoder = packing.ChunkEncoder(WORDS)
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(25))) + r.choice(["", "<|endoftext|>", "a <|startoftext|> b", "'ll we'Ve", "Ab." * 30])
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library_ids(text)[:-1]
    with pytest.raises(ValueError):
        packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
