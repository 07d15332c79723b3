"""Operators over documents against brute force and on odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest import SCHEMA, prose
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, line_dedup, mixing, quality, queries, simhash, substring_dedup, token_prefixes, toxicity
from ledgerlens.llm.common import connected_components, table

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def component(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# 1: substring dedup

def test_substring_finds_exact_fuzzy_and_copied_passages(spark):
    shared = prose(50, 70)
    fuzzy = shared.split()
    for i in range(9, 70, 14):
        fuzzy[i] = "changed"
    texts = [prose(1, 200) + "\n" + shared + "\n" + prose(2, 100), prose(3, 90) + "\n" + shared, prose(4, 40) + "\n" + " ".join(fuzzy) + "\n" + prose(5, 60),
             prose(6, 300), prose(6, 300), prose(7, 120), "the " * 200, prose(8, 10) + " the" * 120]
    rows = substring_dedup.find_passages(docs_of(spark, texts)).collect()
    got = {(r.doc_id, r.src_doc_id): r for r in rows}
    assert set(got) == {(1, 0), (2, 0), (4, 3), (7, 6)}
    assert (got[1, 0].first, got[1, 0].after, got[1, 0].src_first, got[1, 0].src_after) == (90, 160, 200, 270)
    assert got[2, 0].after - got[2, 0].first >= 50 and 0.8 <= got[2, 0].identity < 1
    assert got[4, 3].n_seeds is None and got[4, 3].after == 300


def test_substring_links_a_passage_whose_seeds_are_scattered_over_other_documents(spark):
    words = [f"w{i}" for i in range(60)]
    piece = lambda i: words[9 * i:9 * i + 14]
    own = lambda d, n: [f"d{d}x{i}" for i in range(n)]
    texts = {}
    for i in range(6):  # every seed has its first holder and the one before the last document among pieces
        texts[i + 1] = own(i + 1, 30) + piece(i) + own(f"{i + 1}b", 30)
        texts[200 + i] = own(200 + i, 30) + piece(i) + own(f"{200 + i}b", 30)
    texts[100] = own(100, 40) + words + own("100b", 40)
    texts[1000] = own(1000, 25) + words + own("1000b", 25)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    got = [(r.doc_id, r.src_doc_id, r.first, r.after, r.src_first, r.src_after) for r in substring_dedup.find_passages(docs).collect()]
    assert got == [(1000, 100, 25, 85, 40, 100)]


def test_substring_query_covers_every_shared_run(spark):
    docs = {r.doc_id: substring_dedup.words_of(r.text.encode()) for r in table(spark, SF, "documents").collect()}
    seen = defaultdict(set)
    for i, w in docs.items():
        for k in range(len(w) - 50):
            seen[tuple(w[k:k + 51])].add(i)
    need = {d for s in seen.values() for d in s - {min(s)}}
    found = queries.op1_substring_dedup(spark, SF).collect()
    assert need <= {r.doc_id for r in found}
    for r in found:  # clean documents stay clean: what is reported is alike
        a, b = Counter(docs[r.doc_id][r.first:r.after]), Counter(docs[r.src_doc_id][r.src_first:r.src_after])
        assert sum((a & b).values()) >= 0.75 * max(sum(a.values()), sum(b.values()))


def test_chains_score_like_the_plain_quadratic_programme():
    r = np.random.default_rng(3)
    for _ in range(30):
        a, b = r.integers(0, 60, 25).tolist(), r.integers(0, 60, 25).tolist()
        order = sorted(range(25), key=lambda i: a[i])
        best = {}
        for i in order:
            best[i] = 5 + max([0.0] + [best[j] - 0.05 * (a[i] - a[j] + b[i] - b[j]) for j in order if j in best and a[j] < a[i] and b[j] < b[i]])
        top = substring_dedup.chains(a, b)[0]
        score = 5.0 * len(top) - 0.05 * sum(a[y] - a[x] + b[y] - b[x] for x, y in zip(top, top[1:]))
        assert score == pytest.approx(max(best.values()))


def test_every_passage_of_a_pair_is_found(spark):
    head, foot = prose(60, 70), prose(61, 60)
    whole = prose(62, 200).split()
    texts = ["\n".join([head, prose(63, 150), foot]), "\n".join([head, prose(64, 120), foot]),
             " ".join(whole), " ".join(whole[:100] + prose(65, 30).split() + whole[100:])]
    got = sorted((r.doc_id, r.src_doc_id, r.first, r.after, r.src_first, r.src_after) for r in substring_dedup.find_passages(docs_of(spark, texts)).collect())
    assert got == [(1, 0, 0, 70, 0, 70), (1, 0, 190, 250, 220, 280), (3, 2, 0, 100, 0, 100), (3, 2, 130, 230, 100, 200)]


def test_fragments_in_earlier_documents_hide_no_source(spark):
    w = prose(80, 60).split()
    texts = [prose(81, 70) + "\n" + " ".join(w[:30]), " ".join(w[30:]) + "\n" + prose(82, 70),
             prose(83, 40) + "\n" + " ".join(w), " ".join(w) + "\n" + prose(84, 50)]
    got = [(r.doc_id, r.src_doc_id, r.first, r.after) for r in substring_dedup.find_passages(docs_of(spark, texts)).collect()]
    assert got == [(3, 2, 0, 60)]


def test_substituted_words_leave_passages_found(spark):
    texts = []
    for n, p in [(51, 6), (51, 7), (100, 6), (100, 8)] * 5:
        k = len(texts)
        w = prose(1000 + k, n).split()
        texts += [prose(2000 + k, 60) + "\n" + " ".join(w),
                  " ".join("changed" if i % p == p - 1 else x for i, x in enumerate(w)) + "\n" + prose(3000 + k, 60)]
    got = {(r.doc_id, r.src_doc_id) for r in substring_dedup.find_passages(docs_of(spark, texts)).collect()}
    assert got == {(k + 1, k) for k in range(0, len(texts), 2)}


def test_blocks_are_those_of_difflib_and_passages_need_enough_common_words():
    r = np.random.default_rng(4)
    for n, m, words in [(0, 5, 3), (40, 60, 4), (80, 80, 30), (120, 90, 500), (300, 280, 60)] * 8:
        x, y = r.integers(0, words, n).tolist(), r.integers(0, words, m).tolist()
        y[m // 3:m // 3 + 20] = x[n // 2:n // 2 + 20]
        want = [tuple(b) for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if b.size]
        assert substring_dedup._blocks(x, y) == want
        if substring_dedup._stretches(want):
            assert substring_dedup._may_fit(x, y) and substring_dedup._may_fit(y, x)
    assert not substring_dedup.passages(list(range(70)), list(range(35)) + list(range(100, 135)))


def test_crowded_seeds_that_follow_each_other_everywhere_meet_as_one_strand(spark, monkeypatch):
    line, written = prose(90, 45), {}
    texts = [prose(500 + i, 30) + "\n" + line + "\n" + prose(600 + i, 30) for i in range(12)]
    keep = substring_dedup.materialise
    monkeypatch.setattr(substring_dedup, "materialise", lambda df, tag: written.setdefault(tag, keep(df, tag)))
    substring_dedup.find_passages(docs_of(spark, texts)).collect()
    opened = written["substring-open"].filter(F.col("extra").isin(substring_dedup.HELD, substring_dedup.ASKS)).collect()
    assert sorted((r.doc, r.low, r.high) for r in opened) == [(i, 30, 41) for i in range(12)]  # one row of 41 seeds
    assert {(r.doc, r.holder) for r in written["substring-pairs"].collect()} == {(i, j) for i in range(3, 12) for j in range(i)}
    late = written["substring-late-chains"].filter("doc = 11 and src = 5").collect()
    assert [(r.first, r.after, r.src_first, r.src_after, r.n_seeds) for r in late] == [(30, 75, 30, 75, 41)]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false"


# 2: toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    hit = sum(1 for y, p in held if y and p)
    assert hit >= 0.85 * sum(y for y, _ in held) and hit >= 0.9 * sum(p for _, p in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())


def test_toxicity_ignores_labels_of_held_out_rows(spark):
    docs = table(spark, SF, "documents").limit(60)
    labels = table(spark, SF, "labels")
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.learnable(toxicity.F.col("doc_id")), toxicity.F.col("toxic")).otherwise(1 - toxicity.F.col("toxic")))
    a = sorted(toxicity.toxicity_report(docs, labels).collect(), key=str)
    assert a == sorted(toxicity.toxicity_report(docs, other).collect(), key=str)


def test_toxicity_features_of_disguised_words():
    lex = toxicity.Lexicon(["idiot"])
    f = dict(zip(toxicity.FEATURES, lex.features("You are an id1ot! an IDIOT")))
    assert f["disguised"] > 0 and f["hits"] > 0 and f["near_you"] > 0
    assert lex.features(None) == lex.features("") == [0.0] * len(toxicity.FEATURES)


# 4: decontamination

def brute_contamination(docs, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in bench:
        w = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k:k + 13])].add(str(i))
    sizes = {len(k) for k in windows}
    for i, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        yield i, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("pass_bytes", [1 << 24, 2000])
def test_decontamination_query(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)  # a benchmark of many blocks too
    got = sorted(map(tuple, queries.op4_decontamination(spark, SF).collect()))
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert got == sorted(brute_contamination(docs, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]))
    assert any(r[5] for r in got)


def test_decontamination_short_items_and_copies(spark):
    bench = [(1, "Two words"), (2, "two WORDS"), (3, None), (None, "alpha"), (4, ""), (5, prose(9, 20)), (10, "x")]
    texts = ["say two words now", "TWO-WORDS", None, "", prose(9, 20) * 3, "x x x", "two\nwords x"] * 3
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination_report(docs_of(spark, texts), items).collect()))
    assert got == sorted(brute_contamination(list(enumerate(texts)), [b for b in bench if b[0] is not None]))
    spans = decontaminate.find_passages(docs_of(spark, texts[:1]), items).first()
    assert [tuple(s) for s in spans.spans] == [(1, 3)] and spans["items"] == ["1", "2"]


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(1)
    for size in (1, 5, 400):
        seq = r.integers(0, 4, size).astype(np.int32)
        seq[-1] = 0
        index = decontaminate.FMIndex(seq, 4)
        for n in (1, 2, 3):
            rows = np.array([[x // 9 % 3 + 1, x // 3 % 3 + 1, x % 3 + 1][3 - n:] for x in range(27)], np.int32)
            k, lo, hi = index.search(rows)
            found = {}
            for a, b, c in zip(k, lo, hi):
                found[tuple(rows[a])] = sorted(index.locate(np.arange(b, c)).tolist())
            want = defaultdict(list)
            for i in range(size - n + 1):
                if (seq[i:i + n] > 0).all():
                    want[tuple(seq[i:i + n])].append(i)
            assert found == dict(want)


# 6: mixing

def test_mixing_meets_its_target_and_budget(spark):
    rows = [(i, prose(i, 30 + i % 40), "en", "big" if i % 4 else f"s{i % 5}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len(r[1].split())
    once = Counter(r.doc_id for r in mixing.mix_report(docs).collect())
    assert set(once) == set(range(600)) and 1 < max(once.values()) <= mixing.MAX_EPOCHS  # nothing lost, small sources repeated
    budget = sum(tokens.values()) // 3
    got = mixing.mix_report(docs, entropy=0.999, max_epochs=50, budget=budget, block_tokens=300).collect()
    per = Counter()
    for r in got:
        per[r.source] += r.n_tokens
    p = np.array(list(per.values()), float) / sum(per.values())
    assert budget - 6 * 80 <= sum(per.values()) <= budget
    assert -(p * np.log(p)).sum() >= 0.995 * np.log(len(p))
    seen = Counter((r.doc_id, r.epoch) for r in got)
    assert max(seen.values()) == 1


def test_mixing_exponent_bounds(spark):
    src = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0)], "source string, tokens long")
    assert mixing.exponent(src, entropy=0.0, max_epochs=1000) == 1.0
    assert mixing.exponent(src, entropy=1.0, max_epochs=1000) == 0.0
    a = mixing.exponent(src, entropy=1.0, max_epochs=5)
    assert 100 ** (1 - a) <= 5 < 100 ** (1 - a + 2 ** -19)


# 7: token counts

def test_token_counts_match_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in queries.op7_token_counts(spark, SF).collect():
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


def test_every_prefix_matches_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = token_prefixes.PrefixCounter(open(MODEL, "rb").read())
    for x in ["", " ", "   ", " a", "a ", "\n\n a", "a  b\tc\r\n", "日本 😀é\ufeff", "▁x ▁▁", "    def f(x):\n        return 1", "<s> </s><0x0A>",
              "aaaaaaaaaaa", " " * 40 + "y", "x" * 200, "antidisestablishmentarianism 12345678", prose(4, 40)]:
        assert c.prefixes(x).tolist() == [len(sp.encode(x[:i])) for i in range(len(x) + 1)], x
        assert c.total(x) == len(sp.encode(x))
    df = token_prefixes.with_prefix_counts(docs_of(spark, ["one two three four", None, ""]), MODEL)
    cut = [r.text for r in token_prefixes.truncate(df, 2).orderBy("doc_id").collect()]
    assert cut[0] and "one two three four".startswith(cut[0]) and len(sp.encode(cut[0])) <= 2 and cut[1] is None and cut[2] == ""


def test_remembered_prefixes_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(token_prefixes, "REMEMBER", 5)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = token_prefixes.PrefixCounter(open(MODEL, "rb").read())
    assert c.total(prose(4, 300)) == len(sp.encode(prose(4, 300)))


# 8 and 9

def test_repeated_words_are_counted_as_defined(spark):
    texts = ["a b c a b c", "a a a a", "a b c d", "x y z x y z x y", "", None, "q w e r q w e"]

    def brute(t):
        w = (t or "").split()
        n = Counter(zip(w, w[1:], w[2:]))
        return len({i + k for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for k in range(3)})

    got = {r.doc_id: r.n_repeat_words for r in quality.with_features(docs_of(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_fences_keep_clean_and_drop_odd_documents(spark):
    clean = [prose(i, 60) for i in range(150)]
    odd = [" | ".join(prose(900 + i, 60).split()) for i in range(8)]
    rows = {r.doc_id: r for r in quality.quality_report(docs_of(spark, clean + odd)).collect()}
    assert all(rows[i].kept for i in range(150)) and not any(rows[i].kept or rows[i].base_failed for i in range(150, 158))
    left = quality.drop_low_quality(docs_of(spark, clean + odd))
    assert sorted(r.doc_id for r in left.collect()) == list(range(150)) and left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_common_lines_go_everywhere(spark):
    texts = [f"Menu \nbody {i}\n MENU\n" for i in range(10)] + ["menu\nonly"] + ["rare\nrare"]
    rows = {r.doc_id: r for r in line_dedup.drop_common_lines(docs_of(spark, texts)).collect()}
    assert rows[0].kept_text == "body 0\n" and (rows[0].n_lines, rows[0].n_dropped) == (4, 2)
    assert rows[10].kept_text == "only" and rows[11].kept_text == "rare\nrare"


# 10: SimHash

def test_fingerprint_is_the_majority_of_hashes():
    for t in ["", "a b", "A b c d", prose(5, 90), "x " * 50]:
        w = t.translate(LOWER).split()
        s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cell", [2048, 3])
def test_links_are_those_of_all_pairs(spark, cell):
    r = np.random.default_rng(2)
    base = r.integers(-2 ** 62, 2 ** 62, 40)
    fps = {int(b) ^ sum(1 << int(k) for k in r.choice(63, r.integers(0, 6), replace=False)) for b in base for _ in range(6)}
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    got = {x.node: x.root for x in connected_components(simhash.links(df, cell=cell)).collect()}
    want = component(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4])
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_query(spark):
    rows = queries.op10_simhash_near_dedup(spark, SF).collect()
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in table(spark, SF, "documents").collect()}
    want = component(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (format(f, "016x"), want[i]) for i, f in fp.items()}


def test_filter_keeps_one_row_of_each_component_not_of_each_id(spark):
    texts = [prose(700 + i, 90) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (4, texts[3]), (5, texts[4]), (None, texts[4]), (6, texts[5]), (6, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = simhash.drop_near_duplicates(docs)
    want = Counter([(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (5, texts[4]), (6, texts[5])])
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want and left.columns == docs.columns


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3), (200, 199)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(40)}, 200: 199, 199: 199}


# odd input for all

def runs(spark, docs):
    bench = spark.createDataFrame([(1, "one line"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    yield "substring", substring_dedup.find_passages(docs), None
    yield "toxicity", toxicity.score_toxicity(docs, labels), {"held_out", "score", "predicted"}
    yield "decontaminate", decontaminate.find_passages(docs, bench), {"n_words", "spans", "items"}
    yield "mixing", mixing.mix(docs), {"n_tokens", "epoch", "block", "block_rank", "place_key"}
    yield "tokens", token_prefixes.with_token_counts(docs, MODEL), {"n_tokens"}
    yield "quality", quality.with_features(docs), {*quality.FEATURES, "n_text_lines"}
    yield "quality report", quality.quality_report(docs), None
    yield "quality filter", quality.drop_low_quality(docs), set()
    yield "lines", line_dedup.drop_common_lines(docs), {"n_lines", "n_dropped", "kept_text"}
    yield "simhash", simhash.near_duplicates(docs), None
    yield "simhash filter", simhash.drop_near_duplicates(docs), set()


def test_odd_rows_and_clashing_names(spark, odd):
    n = odd.count()
    for name, df, added in runs(spark, odd):
        rows = df.collect()
        if added is not None:
            assert {c.lower() for c in df.columns} == {c.lower() for c in odd.columns} | added, name
            assert len(set(df.columns)) == len(df.columns)
        if name not in ("substring", "mixing", "quality filter", "simhash filter"):
            assert len(rows) == n, name
        if name == "substring":
            assert {(r.doc_id, r.src_doc_id) for r in rows} == {(8, 1)}
        if name == "mixing":
            assert len(rows) >= n and {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
        if name == "simhash":
            assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in rows if r.doc_id == 8} == {1}
        if name == "simhash filter":
            assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 5: 1, None: 1, 9: 1}


def test_empty_tables(spark, no_docs):
    for name, df, added in runs(spark, no_docs):
        assert df.count() == 0, name


def test_repeated_windows_when_all_hashes_clash(spark, monkeypatch):
    texts = ["a b c d a b c x", "a b c a b c a b c", "p q r s t u v", "a b a b a", "", None, "x y z w x y q y z w"]
    want = [r.n_repeat_words for r in quality.with_features(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert want == [6, 9, 0, 5, 0, 0, 6]
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: quality.F.lit(1 << 50))
    assert [r.n_repeat_words for r in quality.with_features(docs_of(spark, texts)).orderBy("doc_id").collect()] == want


def test_fences_follow_the_habits_of_a_source(spark):
    def text(seed, symbols, dups, repeats, long_words):
        """60 lines of prose with so many symbols, copied lines, repeated windows and long words."""
        w = prose(seed, 600).split("\n")
        w[0] += " #" * symbols
        w += w[1:1 + dups]
        w[2] += " " + " ".join(f"one two three{seed}" for _ in range(repeats))
        w[3] += " " + " ".join("q" * 60 + str(seed) + str(k) for k in range(long_words))
        return "\n".join(w)

    calm = [("calm", text(k, k % 3, k % 2, 0, k % 2)) for k in range(200)]
    busy = [("busy", text(1000 + k, 20 + k % 40, 5 + k % 10, 5 + k % 10, 5 + k % 10)) for k in range(200)]
    odd = text(5000, 45, 12, 12, 12)
    rows = [(k, t, "en", s, len(t)) for k, (s, t) in enumerate([*calm, *busy, ("calm", odd), ("busy", odd)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    fences = {r.source: r for r in quality.thresholds(quality.materialise(quality.with_features(docs), "features")).collect()}
    for k in quality.MEASURES:
        assert fences["calm"][f"hi_{k}"] < fences["busy"][f"hi_{k}"]
    kept = {r.doc_id: r.kept for r in quality.quality_report(docs).collect()}
    assert not kept[400] and kept[401]
    assert sum(kept[i] for i in range(400)) >= 390


def test_repeated_rows_of_one_id_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(7, "same line\nown", "en", "s", 1)] * 10 + [(8, "other\nSAME line ", "en", "s", 1)], SCHEMA)
    rows = line_dedup.drop_common_lines(df).collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in rows if r.doc_id == 7] == [(2, 2, "")] * 10
    assert [(r.n_dropped, r.kept_text) for r in rows if r.doc_id == 8] == [(1, "other")]
