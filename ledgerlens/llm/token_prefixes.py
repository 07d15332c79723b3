"""Token counts of every prefix by dynamic programming.

A byte-pair encoding is the one sequence of tokens of which each two
neighbours, encoded alone, stay as they are.  So the last token of a prefix is
the one token that ends there and suits the last token of what precedes it, and
the prefix's count is that of what precedes it plus one.  Counts of prefixes
answer truncation and budget questions without encoding again.

No piece of the vocabulary holds a word mark after another character, or a
line end, so encodings never cross such a place: the programme runs over
segments (a word with the marks before it), of which a bounded number is
remembered, as are the prefixes that segments share.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import without

#: Segments, prefixes and pairs that a worker remembers.
REMEMBER = 400_000
MARK = "▁"
LIMIT = 4096


class _Totals(dict):
    """Token count of a word with ``before`` put before it."""

    def __init__(self, counter: PrefixCounter, before: str):
        self.counter, self.before = counter, before

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        out = self[word] = self.counter.last_count(self.before + word)
        return out


class PrefixCounter:
    """Exact counts for a sentencepiece BPE model, as its library gives them."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self.edges: dict[str, tuple] = {}
        self.bytes = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("the vocabulary joins words or lines")
        if sp.encode("a  b", out_type=str) != sp.encode("a  b ", out_type=str)[:-1] or sp.encode(" ", out_type=str) != [MARK * 2]:
            raise ValueError("the model changes white space")
        self.suits: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.known: dict[str, tuple[str, int]] = {}
        ends: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 2:
                ends.setdefault(p[-3:], {2, 1}).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.after_space, self.after_line = _Totals(self, MARK), _Totals(self, "")
        self._runs = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def pieces(self, s: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none merge."""
        parts, get = list(s), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            self._last = parts[at], parts[at + 1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: str) -> tuple:
        """How a token's edges came to be: the symbols at its right edge and at
        its left edge from the whole token back to a character, each with the
        score of the merge that made it; whether the merges of the token went
        by falling score (otherwise only merging itself tells the outcome)."""
        e = self.edges.get(token)
        if e is None:
            if len(self.edges) >= REMEMBER:
                self.edges.clear()
            right, left, plain = [], [], True
            if len(token) > 1:
                if self.pieces(token) != [token]:
                    plain = False
                else:
                    a, b = self._last
                    (ra, la, pa), (rb, lb, pb) = self._edge(a), self._edge(b)
                    own = self.score[token]
                    plain = pa and pb and all(len(x) == 1 or self.score[x] > own for x in (a, b))
                    right, left = [(token, own), *rb], [(token, own), *la]
            if not right:
                right = left = [(token, float("inf"))]
            e = self.edges[token] = right, left, plain
        return e

    def _stay(self, before: str, token: str) -> bool:
        """Whether no merge joins the two: undo the merges at the meeting edges,
        latest first; a joint symbol wins if it scores above the merge that took
        its left part away, and no less than the one that took its right part."""
        right, _, plain = self._edge(before)
        _, left, too = self._edge(token)
        if not (plain and too):
            return self.pieces(before + token) == [before, token]
        get, a, b, out_a, out_b = self.score.get, 0, 0, -float("inf"), -float("inf")
        while True:
            x, sx = right[a]
            y, sy = left[b]
            joint = get(x + y)
            if joint is not None and joint > out_a and joint >= out_b:
                return False
            if sx < sy:
                a, out_a = a + 1, sx
            elif b + 1 < len(left):
                b, out_b = b + 1, sy
            elif a + 1 < len(right):
                a, out_a = a + 1, sx
            else:
                return True

    def _cost(self, token: str) -> int:
        return 1 if token in self.score or not self.bytes else len(token.encode("utf-8", "surrogatepass"))

    def _alone(self, token: str) -> bool:
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self.pieces(token) == [token]
        return ok

    def _node(self, s: str, i: int) -> tuple[str, int]:
        """Last token and count of the prefix of length i, of which all shorter
        ones are remembered.  Only lengths of pieces with the same ending are tried."""
        known, score = self.known, self.score
        lengths = self.lengths.get(s[i - 3:i], (2, 1)) if i > 2 else (2, 1)
        for n in lengths:
            if n > i:
                continue
            token = s[i - n:i]
            if n > 1 and token not in score:
                continue
            if n == i:
                if self._alone(token):
                    return token, self._cost(token)
                continue
            last, count = known[s[:i - n]]
            key = (last, token)
            ok = self.suits.get(key)
            if ok is None:
                if len(self.suits) >= REMEMBER:
                    self.suits.clear()
                ok = self.suits[key] = self._stay(last, token)
            if ok:
                return token, count + self._cost(token)
        raise AssertionError("every prefix has an encoding")

    def _learn(self, segment: str) -> None:
        """Remember every prefix of a segment."""
        known, i = self.known, len(segment)
        if len(known) >= REMEMBER:
            known.clear()
        while i > 0 and segment[:i] not in known:
            i -= 1
        for k in range(i + 1, len(segment) + 1):
            known[segment[:k]] = self._node(segment, k)

    def last_count(self, segment: str) -> int:
        if not segment:
            return 0
        self._learn(segment)
        return self.known[segment][1]

    def total(self, text: str) -> int:
        """Tokens of the whole text: the count at its last prefix."""
        if not text:
            return 0
        lines = text.split("\n")
        n = (len(lines) - 1) * self._cost("\n")
        space, start = self.after_space.__getitem__, self.after_line.__getitem__
        for k, line in enumerate(lines):
            if k and not line:
                continue
            if MARK in line or "  " in line or line[:1] == " " or line[-1:] == " " or not line:
                n += sum(map(start, self._runs.findall(MARK * (k == 0) + line.replace(" ", MARK))))
                continue
            words = line.split(" ")
            if k:
                n += start(words[0])
                del words[0]
            n += sum(map(space, words))
        return n

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ... code points."""
        out, base = [], 0
        for seg in self._runs.findall(MARK + text.replace(" ", MARK)) if text else ():
            self._learn(seg)
            out.extend(base + self.known[seg[:k]][1] for k in range(1, len(seg) + 1))
            base = out[-1]
        # the first count is that of the mark which stands before every text
        return np.array([0, *out[1:]], np.int32)


_COUNTERS: dict[int, PrefixCounter] = {}


def _counter(model) -> PrefixCounter:
    """One counter for each model in a Python worker."""
    if model.id not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model.id] = PrefixCounter(model.value)
    return _COUNTERS[model.id]


class _Model:
    """Bytes of a vocabulary file (under a megabyte), read once by the driver."""

    def __init__(self, path: str):
        import zlib

        with open(path, "rb") as f:
            self.value = f.read()
        self.id = zlib.crc32(self.value)


def with_token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (long); null is an empty text of no tokens."""
    model = _Model(model_path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        c = _counter(model)
        return pd.Series([c.total(t) if t else 0 for t in texts], dtype="int64")

    return without(docs, "n_tokens").withColumn("n_tokens", count(F.col(text)))


def with_prefix_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with prefix_tokens: the exact token count of every prefix, by
    code points, from the empty one to the whole text."""
    model = _Model(model_path)

    @F.pandas_udf("array<int>")
    def count(texts: pd.Series) -> pd.Series:
        c = _counter(model)
        return pd.Series([c.prefixes(t or "") for t in texts])

    return without(docs, "prefix_tokens").withColumn("prefix_tokens", count(F.col(text)))


def truncate(docs: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """``docs`` of ``with_prefix_counts`` with ``text`` cut to its longest
    prefix of at most ``budget`` tokens."""
    fits = F.array_max(F.transform("prefix_tokens", lambda n, i: F.when(n <= budget, i)))
    return docs.withColumn(text, F.substring(F.col(text), F.lit(1), F.coalesce(fits, F.lit(0))))


def token_report(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.  Null and empty texts
    have none; repeated rows are counted alike; an empty table gives no rows."""
    return with_token_counts(docs.select("doc_id", "text"), model_path).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
