"""PF6 rules one by one, first-wins order, and the counts on the driver's
document lines (values from FIXTURES.md)."""

import itertools

from pyspark.sql import functions as F

from convkit.operators import quality as Q
from convkit.sources import adapters as AD

from conftest import SF01


def reasons(spark, rows, **kw):
    df = spark.createDataFrame(rows, "src string, tgt string")
    return [r[0] for r in Q.quality_filter(df, **kw).select("skip_reason").collect()]


def test_each_rule(spark):
    long_word = "x" * 31
    rows = [
        ("ctx", "one"),                                  # emptytarget (one word)
        ("ctx", f"ok {long_word}"),                      # longword
        (" ".join(["w"] * 150), " ".join(["v"] * 51)),   # toolong (201 tokens)
        ("see __url__", "fine reply"),                   # url in src
        ("ctx", "a (b) c"),                              # tags
        ("ctx", "THIS IS LOUD"),                         # no 5-run of capitals -> keep
        ("ctx", "so LOUDER now"),                        # allcaps
        ("ctx", "no no no way"),                         # repetitions
        ("ctx", "a normal reply"),                       # keep
        ("ctx", f"one"),
    ]
    assert reasons(spark, rows) == ["emptytarget", "longword", "toolong", "url", "tags", "keep", "allcaps",
                                    "repetitions", "keep", "emptytarget"]


def test_first_rule_wins(spark):
    # matches url, tags and allcaps: url comes first
    assert reasons(spark, [("ctx", "LOUDER (see) __url__ x")]) == ["url"]
    # offensive precedes everything, and only outside leaves-only mode
    rx = Q.blockword_regex(["bad phrase"])
    assert reasons(spark, [("c", "a bad phrase")], block_regex=rx) == ["offensive"]
    assert reasons(spark, [("c", "a bad phrase")], block_regex=rx, leaves_only=True) == ["keep"]


def test_doc_line_counts(spark):
    p = AD.doc_pairs(spark, SF01)
    got = {r[0]: r[1] for r in Q.quality_filter(p).groupBy("skip_reason").count().collect()}
    assert got == {"keep": 7401, "toolong": 438, "emptytarget": 233, "allcaps": 168, "repetitions": 65,
                   "tags": 30, "longword": 9}


def test_phrases_are_found_by_their_rarest_word(spark):
    texts = [(i, f"the and of w{i} the, v{i % 50}") for i in range(400)] + [(400, None), (401, ""), (402, "*** the ??"), (403, "The\tW7 x"), (404, "a W7 the")]
    phrases = [f"the w{i}" for i in range(0, 400, 2)] + [f"of W{i}" for i in range(0, 400, 4)] + ["the nowhere", "??", "***", "# comment", " ", "a w7"]
    df = spark.createDataFrame(texts, "id long, t string")
    bl = spark.createDataFrame([(p,) for p in phrases * 2], "entry string")
    assert Q.phrase_candidates(df, "id", "t", bl).count() < 320                # 400 x 300 pairs by first words
    got = {r["id"] for r in Q.blockword_hits(df, "id", "t", bl).where("blocked").collect()}
    rx = Q.blockword_regex([p for p in phrases if p.strip() and not p.startswith("#")])
    want = {r["id"] for r in df.where(F.col("t").rlike(rx)).collect()}
    assert got == want == {*range(0, 400, 4), 402, 404}
    assert Q.blockword_hits(df, "id", "t", bl.limit(0)).where("blocked").count() == 0


def test_phrases_of_frequent_words_meet_only_texts_that_hold_them(spark):
    """Every word is in a third of the texts, so none of them tells phrases apart."""
    ws = ["ab", "cd", "ef", "gh", "ij", "kl"]
    combos = list(itertools.permutations(ws, 3))
    texts = [(i, " ".join(c) + ("." if i % 2 else " mn") + " Op") for i, c in enumerate(combos * 3)] + [(1000, None), (1001, "ab, cd ef")]
    phrases = [" ".join(c) for c in combos] + ["ab, cd", "ab cd ef mn op", "AB-CD EF", "cd ef gh ij kl ab", "ef mn op", "mn?"]
    df = spark.createDataFrame(texts, "id long, t string")
    bl = spark.createDataFrame([(p,) for p in phrases], "entry string")
    assert Q.phrase_candidates(df, "id", "t", bl).count() < 2 * len(texts)       # 60 phrases a text by one word
    rx = Q.blockword_regex(phrases)
    got = {r["id"] for r in Q.blockword_hits(df, "id", "t", bl).where("blocked").collect()}
    assert got == {r["id"] for r in df.where(F.col("t").rlike(rx)).collect()}
