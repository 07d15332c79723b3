import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words, no two seeds alike, in lines of 12."""
    import random

    r = random.Random(seed)
    w = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(n)]
    return "\n".join(" ".join(w[i:i + 12]) for i in range(0, n, 12))


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows,
    and columns whose names operators use themselves."""
    long_text = prose(1, 30_000)
    rows = [(1, prose(2, 80), "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, " \n\t ", None, "a"), (5, long_text, "en", "a"),
            (5, long_text, "en", "a"), (None, prose(3, 60), "en", "a"), (None, None, None, None), (8, prose(2, 80), "en", "b"),
            (9, "One Line", "en", "b")]
    return spark.createDataFrame(
        [(i, t, g, s, len(t or ""), 7, "k", -1.0, "z") for i, t, g, s in rows],
        SCHEMA + ", n_words int, h string, score double, kept string")


@pytest.fixture(scope="session")
def odd(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
