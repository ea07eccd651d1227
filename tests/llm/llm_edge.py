"""What the tests of this folder share: fixtures, and rows that every
operator must take (nulls, no words, repeats, long texts)."""
import random

import pytest

SF001 = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "x" * 200_000),
        (6, "lamp " * 40_000), (7, "é中\U0001d49c 'tis \u0085 end"), (8, "a b c d e f g h")]

WORDS = "the of and moon river stone lamp green paper orange window cloud forest table silver quiet north bread candle".split()


@pytest.fixture
def sentence():
    rng = random.Random(5)

    def make(n):
        return " ".join(f"{rng.choice(WORDS)}{rng.randrange(60)}" for _ in range(n))
    return make


@pytest.fixture(scope="session")
def frame(spark):
    """Documents (doc_id, text) with columns whose names clash with results."""
    def make(rows, extra="score double, toxic string, key string, n_tokens string, ids string, component int"):
        n = len(extra.split(","))
        return spark.createDataFrame([(*r, *[None] * n) for r in rows], f"doc_id long, text string, {extra}")
    return make

