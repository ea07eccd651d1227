"""Invariants from the survey's test strategy, plus hand fixtures for
segmentation, batching, sampling and reranking."""

from pyspark.sql import functions as F

from convkit.operators import batching as BA
from convkit.operators import corpus as CO
from convkit.operators import scoring as SC
from convkit.operators import threads as TH
from convkit.sources import adapters as AD
from convkit.sources.tables import table

from conftest import SF01


def test_unrolled_rows_equal_sum_n_minus_1(spark):
    c = table(spark, SF01, "conversations")
    n = c.groupBy("conv_id").count().agg(F.sum(F.col("count") - 1)).first()[0]
    assert CO.unroll_conversation(c).count() == n == 436


def test_skip_reasons_plus_kept_equal_input(spark):
    s = TH.submission_filter(AD.submissions(spark, SF01))
    c = TH.comment_admission(AD.comments(spark, SF01), s)
    inst = TH.conv_instances(c, s, max_len=100, max_depth=5, min_score=1, use_title=False, clean=True,
                             block_subreddits=AD.block_subreddits(spark, SF01))
    assert inst.count() == c.count()
    assert inst.select("cid").distinct().count() == c.count()


def test_segmentation_fixture(spark):
    rows = [(0, 1, "", "pre"), (0, 2, "S", "a1"), (0, 3, "", "a2"), (0, 4, "S", "b1"),
            (1, 1, "", "pre"), (1, 2, "", "pre2"), (1, 3, "S", "c1"), (1, 4, "", "c2")]
    df = spark.createDataFrame(rows, "file_no int, row_no long, marker string, text string")
    got = sorted((r["text"], r["conv_id"]) for r in CO.segment_conversations(df).collect())
    assert got == [("a1", 0), ("a2", 0), ("b1", 1), ("c1", 2), ("c2", 2)]
    splits = [r[0] for r in spark.range(12).select(CO.split_of("id")).collect()]
    assert splits[:3] == ["test", "valid", "train"] and splits[10:] == ["test", "valid"]
    assert [r[0] for r in spark.range(2).select(CO.split_of("id", lines=True)).collect()] == ["valid", "test"]


def test_batches_partition_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("rid"), ((F.col("id") * 37) % 91).alias("len"))
    b = BA.bucket_batches(df, "rid", "len", batch_size=8, bucket_size=100).cache()
    assert b.count() == 1000 and b.select("rid").distinct().count() == 1000
    sizes = [r[0] for r in b.groupBy("bucket", "batch_in_bucket").count().select("count").collect()]
    assert max(sizes) <= 8 and sum(sizes) == 1000
    # inside a bucket, lengths never increase from one batch to the next
    agg = b.groupBy("bucket", "batch_in_bucket").agg(F.min("len").alias("lo"), F.max("len").alias("hi")).collect()
    by = {}
    for r in agg:
        by.setdefault(r["bucket"], []).append((r["batch_in_bucket"], r["lo"], r["hi"]))
    for v in by.values():
        v.sort()
        assert all(v[i][1] >= v[i + 1][2] for i in range(len(v) - 1))
    dl = BA.bucket_batches(df, "rid", "len", batch_size=8, bucket_size=100, droplast=True)
    assert dl.groupBy("bucket", "batch_in_bucket").count().filter("count < 8").count() == 0
    assert BA.batch_count(b, 8, bucket_col="bucket", droplast=True).first()["batches"] == 10 * 12


def test_weighted_sample_counts(spark):
    rows = [(i % 3, i, 1.0 + (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "chunk long, rid long, w double")
    ns = spark.createDataFrame([(0, 50), (1, 70), (2, 10)], "chunk long, num_samples long")
    s = BA.weighted_sample(df, "chunk", "rid", "w", ns)
    got = {r["chunk"]: r["count"] for r in s.groupBy("chunk").count().collect()}
    assert got == {0: 50, 1: 70, 2: 10}
    bad = s.join(df.select("chunk", "rid"), ["chunk", "rid"], "left_anti").count()
    assert bad == 0 and s.filter(F.col("rid").isNull()).count() == 0


def test_class_weights_fixture(spark):
    rows = [(0, 1.0)] * 3 + [(0, -1.0)] * 1 + [(1, 0.0)] * 2
    df = spark.createDataFrame(rows, "chunk long, reward double")
    got = {(r["chunk"], r["reward"]): (r["weight"], r["num_samples"])
           for r in BA.class_weights(df, "chunk", "reward").collect()}
    assert got[(0, 1.0)] == (1 / 3, 6) and got[(0, -1.0)] == (1.0, 6) and got[(1, 0.0)] == (0.5, 2)


def test_rerank_ties_and_formula(spark):
    rows = [(1, 10, 2.0, 2.0, 0.0), (1, 7, 2.0, 2.0, 0.0), (1, 8, 3.0, 1.0, 1.0), (2, 1, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "context_id long, cand_id long, fwd_loss double, rev_loss double, q_value double")
    got = {r["context_id"]: (r["cand_id"], r["score"]) for r in SC.rerank_best(df).collect()}
    assert got[1] == (8, -0.5 * 2.0 + 0.5 * 1.0)       # (beta-1)*mix + beta*q
    assert got[2] == (1, -1.0)                           # no value score: -mix
    t = SC.rerank_best(spark.createDataFrame(rows[:2], df.schema)).first()
    assert t["cand_id"] == 7                              # tie -> lowest candidate id


def test_macro_f1_absent_class(spark):
    df = spark.createDataFrame([(0.9, 0.9), (0.9, -0.9), (0.0, 0.0)], "pred double, truth double")
    r = SC.macro_f1(df).first()
    # classes 2 (tp=1, np=2, nt=1), 1 (np=0, nt=1), 0 (tp=1): F = [2/3, 0, 1]
    assert abs(r["macro_f1"] - (2 / 3 + 0 + 1) / 3) < 1e-12
    assert abs(r["mae"] - 1.8 / 3) < 1e-12


def test_trigram_counts_match_survey_probe(spark):
    """Trigram occurrences / distinct over conversation turns (FIXTURES.md B)."""
    from convkit.operators import ngram_stats as NS
    from conftest import SF001
    for sf, exp in [(SF001, (6289, 6247)), (SF01, (45763, 44777))]:
        c3 = NS.ngram_counts(table(spark, sf, "conversations"), "text", 3).filter("n = 3")
        assert tuple(c3.agg(F.sum("cnt"), F.count(F.lit(1))).first()) == exp


def test_conversation_of_many_turns_keeps_ids(spark):
    from convkit.operators import corpus as CO
    rows = [(c, t, f"w{t % 7}") for c in (1, 2) for t in range(1500 if c == 1 else 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    u = CO.unroll_turns(df, ["text"])
    assert u.count() == u.select("conv_id", "turn").distinct().count() == 1499 + 2
    last = u.filter("conv_id = 1 and turn = 1499").select(F.size("turns").alias("n")).first()
    assert last["n"] == 1500


def test_file_without_marker_uses_up_an_id(spark):
    from convkit.operators import corpus as CO
    rows = [(0, 0, "", "preamble"), (0, 1, "S", "a"), (0, 2, "", "b"), (0, 3, "S", "c"), (1, 0, "", "no marker"), (2, 0, "S", "d")]
    df = spark.createDataFrame(rows, "file_no int, row_no long, marker string, text string")
    got = {r["text"]: r["conv_id"] for r in CO.segment_conversations(df).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 3}


def test_bland_rank_must_exist(spark):
    import pytest

    from convkit.operators import corpus as CO
    sa = spark.createDataFrame([(1, 0, "1.0 a b c d", "1.0 a b c", "1.0 x")], "conv_id long, turn long, source string, target string, next_state string")
    # a b c occurs twice, the count at rank 1 is 1: only the target consists of frequent trigrams
    assert sorted(r["tag"] for r in CO.bland_tag(sa, bland_top=1).collect()) == ["", "", "bland"]
    with pytest.raises(Exception, match="rank"):
        CO.bland_tag(sa, bland_top=5).collect()
    with pytest.raises(Exception, match="fewer than 6"):
        CO.kth_count(CO.trigram_freq(sa), 5).collect()


def test_emotions_with_bad_or_missing_shares(spark):
    from convkit.operators import corpus as CO
    rows = [('{"predict_emotion":[{"description":"HAPPINESS","percentage":"50%"}]}',), ('{"predict_emotion":[{"description":"ANGER","percentage":"x"}]}',)]
    got = [r["reward"] for r in CO.emotion_reward(spark.createDataFrame(rows, "json string")).collect()]
    assert got == [0.5, 0.0]


def test_draws_do_not_depend_on_partitions(spark):
    from convkit.operators import batching as BA
    df = spark.createDataFrame([(0, f"r{i}", float(1 + i % 3)) for i in range(30)], "chunk long, id string, w double")
    ns = spark.createDataFrame([(0, 40)], "chunk long, num_samples long")
    a, b = (sorted(map(tuple, BA.weighted_sample(df.repartition(n), "chunk", "id", "w", ns).collect())) for n in (1, 7))
    assert a == b and len(a) == 40
