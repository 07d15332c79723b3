"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic
regression.

The features are densities of a lexicon learnt from labelled rows (words, and
beginnings of words), nearness to the second person, capitals, punctuation and
disguised spellings.  Labelled rows that may be learnt from are split in three:
one part gives the lexicon, one the trees, one the calibration, so that no
stage sees its own teachers' answers.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, without

#: Most labelled rows that are learnt from (the ones of smallest hash); everything is scored.
TRAIN_ROWS = 24_000
#: Tenths of the learnt rows for the lexicon, for the trees; the rest calibrates.
LEXICON_TENTHS, TREE_TENTHS = 4, 4
#: A lexicon entry: documents of label 1 that hold it, and the log of how much more often it occurs among their words.
MIN_DOCS, STRONG, WEAK = 5, 2.5, 1.2
PREFIXES = (4, 5, 6, 7, 8)
TREES, DEPTH, STEP = 20, 3, 0.3
THRESHOLD = 0.7
NEAR = 5
#: Second-person words of the corpus languages.
SECOND_PERSON = """
you your yours yourself yourselves u ur
du dich dir dein deine deinen deiner deines ihr euch euer eure
tu te toi ton ta tes vous votre vos
tú ti tuyo tuya usted ustedes vosotros vuestro vuestra
""".split()
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
_SPLIT = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_CAPITALS = bytes(range(0x41, 0x5B))
_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
_MARKS = b"!?"
_POINTS = b"!?.,;:-*#_~"
_MIXED = re.compile(r"\b[^\W\d_]+(?:[013457@$!*._-]+[^\W\d_]+)+")
FEATURES = ("hits", "log_hits", "starts", "log_starts", "weak", "near_you", "you", "capitals", "shouts", "marks",
            "points", "mixed", "disguised", "log_words")


def words_of(text: str) -> list[str]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).decode("utf-8", "surrogatepass").split()


def starts_of(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) > n]


class Lexicon:
    """Words, and beginnings of words, that mark label 1."""

    def __init__(self, strong=(), starts=(), weak=()):
        self.strong, self.starts, self.weak = frozenset(strong), frozenset(starts), frozenset(weak)
        self.first = frozenset(s[:PREFIXES[0]] for s in self.starts)

    def features(self, text: str | None) -> list[float]:
        """Dense features of a whole text; zeros for null or empty."""
        if not text:
            return [0.0] * len(FEATURES)
        words = words_of(text)
        n = max(len(words), 1)
        strong = [i for i, w in enumerate(words) if w in self.strong]
        head = PREFIXES[0]
        begun = sum(1 for w in words if w[:head] in self.first and not self.starts.isdisjoint(starts_of(w)))
        weak = sum(map(self.weak.__contains__, words))
        you = [i for i, w in enumerate(words) if w in _YOU]
        near = 0
        if strong and you:
            at, k = np.array(you), np.array(strong)
            j = np.searchsorted(at, k)
            gap = np.minimum(np.abs(at[np.minimum(j, len(at) - 1)] - k), np.abs(at[np.maximum(j - 1, 0)] - k))
            near = int((gap <= NEAR).sum())
        raw = text.encode("utf-8", "surrogatepass")
        size = max(len(raw), 1)
        count = lambda drop: size - len(raw.translate(None, drop))
        letters = max(count(_LETTERS), 1)
        mixed = _MIXED.findall(text)
        plain = [re.sub(r"[*._\-\W]+", "", m.lower().translate(DISGUISE)) for m in mixed]
        hidden = sum(1 for p in plain if p in self.strong)
        caps = count(_CAPITALS)
        shouts = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if caps * 5 > letters else 0
        hits = len(strong) + hidden
        return [hits / n, math.log1p(hits), begun / n, math.log1p(begun), weak / n, near / n, len(you) / n, caps / letters,
                shouts / n, count(_MARKS) / size, count(_POINTS) / size, len(mixed) / n, hidden / n, math.log1p(len(words))]


_YOU = frozenset(SECOND_PERSON)


def learnable(doc_id):
    """Rows that may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, label, part): at most ``limit`` labelled rows, those of smallest
    hash, in ten parts.  Rows without a label or an id teach nothing; of rows
    that share an id all are taken."""
    one = (labels.filter("toxic in (0, 1) and doc_id is not null").filter(learnable(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
           .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(one), "doc_id")  # at most ``limit`` rows
            .select("text", "label", F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(10)).alias("part")))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and beginnings by the log odds of the documents that hold them.
    Counts are combined in each task; only entries that pass come to the
    driver, from the bounded rows."""

    def count(batches):
        seen: dict[str, list[int]] = {}  # occurrences by label, documents of label 1
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                terms = Counter()
                for w, n in Counter(words_of(text)).items():
                    terms[f"={w}"] += n
                    for x in starts_of(w):
                        terms[f"^{x}"] += n
                for t, n in terms.items():
                    c = seen.setdefault(t, [0, 0, 0])
                    c[int(label)] += n
                    c[2] += int(label)
        yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["term", "no", "yes", "docs"])

    size = F.size(F.split("text", r"\s+"))
    whole = rows.agg(F.sum(F.col("label") * size).alias("yes"), F.sum((1 - F.col("label")) * size).alias("no")).first()
    yes, no = (whole.yes or 0.0), (whole.no or 0.0)
    odds = F.log((F.col("yes") + 0.5) / F.lit(yes + 1.0)) - F.log((F.col("no") + 0.5) / F.lit(no + 1.0))
    found = (rows.select("text", "label").mapInPandas(count, "term string, no long, yes long, docs long")
             .groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"), F.sum("docs").alias("docs"))
             .filter(F.col("docs") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= WEAK).select("term", "odds").collect())
    words = {r.term[1:]: r.odds for r in found if r.term[0] == "="}
    return Lexicon([w for w, o in words.items() if o >= STRONG], [r.term[1:] for r in found if r.term[0] == "^" and r.odds >= STRONG],
                   [w for w, o in words.items() if o < STRONG])


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "features") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # entries of a bounded number of rows

    @F.pandas_udf("array<double>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.features(t) for t in texts])

    return docs.withColumn(out, udf(F.col(text)))


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with held_out (the row may not teach), score (0 to 1) and
    predicted (score >= 0.7); input columns of these names are replaced.

    Learns from ``labels`` (doc_id, toxic) on learnable rows only; label,
    language, source and id are never inputs.  Null texts are empty texts;
    equal texts get equal scores; a null id is never learnt from and not held
    out.  Where the learnable rows hold one label only, or too few rows for a
    stage, every score is the share of label 1 (0 without labels).  An empty
    table gives no rows.
    """
    df = without(docs, "held_out", "score", "predicted", "_f", "features", "rawPrediction", "probability", "prediction", "_raw", "_cal")
    keep = [F.col(f"`{c}`") for c in df.columns]
    rows = materialise(training_rows(df, labels, limit).coalesce(8), "toxicity-rows")
    lexicon = learn_lexicon(rows.filter(F.col("part") < LEXICON_TENTHS))
    made = materialise(with_features(rows.filter(F.col("part") >= LEXICON_TENTHS), lexicon).select(
        array_to_vector("features").alias("features"), "label", "part").coalesce(2), "toxicity-features")
    held = ~learnable(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    held = F.when(F.col("doc_id").isNull(), F.lit(False)).otherwise(held)
    trees, rest = made.filter(F.col("part") < LEXICON_TENTHS + TREE_TENTHS), made.filter(F.col("part") >= LEXICON_TENTHS + TREE_TENTHS)
    if trees.select("label").distinct().count() < 2 or rest.isEmpty():
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        out = df.withColumn("_cal", F.lit(float(share)))
    else:
        gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=64).fit(trees)
        raw = lambda d: gbt.transform(d).withColumn("_raw", vector_to_array("probability")[1])
        iso = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_cal").fit(raw(rest).select("_raw", "label"))
        scored = with_features(df, lexicon, out="_f").withColumn("features", array_to_vector("_f"))
        out = iso.transform(raw(scored))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_cal")))
    return out.select(*keep, held.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    return score_toxicity(docs.select("doc_id", "text"), labels, **kw).select("doc_id", "held_out", "score", "predicted")
