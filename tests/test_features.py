"""Featurisation branches (F12-F19, PF9-PF11) on hand-made arrays."""

from pyspark.sql import functions as F

from convkit.operators import features as FE

E = FE.EOS_ID


def ev(spark, expr, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_flatten_and_guard(spark):
    rows = [([[5, 6], [7]],), ([[5] * 4, [6] * 3],)]
    assert ev(spark, FE.flatten_eos("t"), rows, "t array<array<int>>")[0] == [5, 6, E, 7]
    assert ev(spark, FE.feature_len_guard("t", 4), rows, "t array<array<int>>") == [False, True]
    # running length of earlier turns (+1 eos each) over the limit
    assert ev(spark, FE.feature_len_guard("t", 6), [([[5, 5, 5], [6], [7]],)], "t array<array<int>>") == [False]
    assert ev(spark, FE.feature_len_guard("t", 5), [([[5, 5, 5], [6], [7]],)], "t array<array<int>>") == [True]


def test_eval_features_three_branches(spark):
    s = "c array<int>, r array<int>"
    fit = ev(spark, FE.eval_features("c", "r", 10), [([5, 6], [7, 8])], s)[0]
    assert fit["input_ids"] == [5, 6, E, 7, 8, E]
    assert fit["lm_labels"] == [-1, -1, 7, 8, E, -1]
    assert fit["position_ids"] == [0, 1, 2, 3, 4, 5] and fit["token_type_ids"] == [0] * 6
    cut_ctx = ev(spark, FE.eval_features("c", "r", 6), [([1, 2, 3, 4], [7, 8])], s)[0]
    assert cut_ctx["input_ids"] == [3, 4, E, 7, 8, E] and cut_ctx["context_len"] == 2
    cut_resp = ev(spark, FE.eval_features("c", "r", 6), [([1, 2], [7, 8, 9, 10])], s)[0]
    assert cut_resp["input_ids"] == [1, 2, E, 7, 8, E] and cut_resp["response_len"] == 2
    dropped = ev(spark, FE.eval_features("c", "r", 3), [([1, 2], [7])], s)[0]
    assert dropped is None


def test_reverse_turns(spark):
    s = "t array<array<int>>, trail boolean"
    rows = [([[1, 1], [2], [3]], False), ([[1], [2]], True), ([[1, 1]], False), ([[1]], True)]
    got = ev(spark, FE.reverse_turns("t", "trail"), rows, s)
    assert got == [[3, E, 2, E, 1, 1], [2, E, 1, E], [1, 1, E], [1, E]]


def test_last_turn_labels(spark):
    s = "a array<int>"
    got = ev(spark, FE.last_turn_labels("a"), [([5, E, 6, 7, E],), ([5, E, 6, 7],)], s)
    assert got[0]["inputs"] == [5, E, 6, 7] and got[0]["labels"] == [-1, 6, 7, E]
    assert got[1]["labels"] == [-1, 6, 7]
    rv = ev(spark, FE.last_turn_labels("a", reversed_=True), [([7, E, 6, E, 5],)], s)[0]
    assert rv["labels"] == [-1, 6, E, 5]


def test_truncate_pad_strip(spark):
    s = "a array<int>"
    assert ev(spark, FE.left_truncate("a", 2), [([1, 2, 3],), ([1],)], s) == [[2, 3], [1]]
    assert ev(spark, FE.pad_to("a", F.lit(4), 0), [([1, 2],)], s) == [[1, 2, 0, 0]]
    assert ev(spark, FE.pad_to("a", F.lit(4), -1, pad_end=False), [([1, 2],)], s) == [[-1, -1, 1, 2]]
    assert ev(spark, FE.strip_pad("a", E), [([5, 0, 6, 0],)], s) == [[5, 6, E]]


def test_turn_projections(spark):
    s = "t array<string>"
    rows = [(["a", "b", "c", "d"],), (["a"],)]
    assert ev(spark, FE.two_turn("t"), rows, s) == [["c", "d"], ["a"]]
    # the last turn is never part of the prompt
    rows = [(list("abcd"),), (list("abc"),), (list("ab"),), (["a"],), ([],), (list("abcdef"),)]
    assert ev(spark, FE.prompt_prefix("t"), rows, s) == [list("abc"), list("ab"), ["a"], [], [], list("abc")]


def test_encode_and_concat_candidates(spark):
    vocab = spark.createDataFrame([(1, "a"), (2, "b")], "rank long, word string")
    df = spark.createDataFrame([(1, 0, "a b a"), (1, 1, "zz a"), (1, 2, " "), (2, 0, "b")], "c long, t long, text string")
    e = FE.encode_texts(df, ["c", "t"], "text", vocab)
    assert {(r["c"], r["t"]): r["ids"] for r in e.collect()} == {(1, 0): [3, 4, 3], (1, 1): [1, 3], (1, 2): [], (2, 0): [4]}
    ctx = e.filter("t = 0").selectExpr("c", "ids as context_ids")
    cand = e.filter("t > 0").selectExpr("c", "t", "ids as candidate_ids")
    got = {(r["c"], r["t"]): r["input_ids"] for r in FE.concat_candidates(ctx, cand, ["c"]).collect()}
    assert got == {(1, 1): [3, 4, 3, FE.EOS_ID, 1, 3], (1, 2): [3, 4, 3, FE.EOS_ID]}
