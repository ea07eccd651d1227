"""Ancestor chains (J3) and pair assembly on hand-made threads."""

from pyspark.sql import functions as F

from convkit.operators import threads as TH

SUBS = [("a", 1, 5, "x.com", "/r/Sub/comments/", "Title A", "2024-01"),
        ("b", 1, 5, "x.com", "/r/Sub/comments/", "Title B", "2024-01")]
SUB_SCHEMA = "id string, score int, num_comments int, domain string, permalink string, title string, month string"
C_SCHEMA = "id string, author string, parent_id string, link_id string, score int, body string, month string"


def comments(spark, rows):
    return spark.createDataFrame(rows, C_SCHEMA)


def pairs(spark, rows, subs=SUBS, **kw):
    params = dict(max_len=5, max_depth=3, min_depth=2, min_score=0, use_title=False, leaves_only=False, clean=False)
    params.update(kw)
    out = TH.thread_pairs(comments(spark, rows), spark.createDataFrame(subs, SUB_SCHEMA), **params)
    return {r["cid"]: (r["context"], r["response"]) for r in out.collect()}


def thread(month="2024-01", link="t3_a"):
    # c1 <- c2 <- c3 <- c4 (linear), each body two words
    return [("c1", "u", link, link, 1, "one one", month),
            ("c2", "u", "t1_c1", link, 1, "two two", month),
            ("c3", "u", "t1_c2", link, 1, "three three", month),
            ("c4", "u", "t1_c3", link, 1, "four four", month)]


def test_depth_limit(spark):
    p = pairs(spark, thread())
    assert p["t1_c2"] == ("one one", "two two")
    assert p["t1_c3"] == ("one one EOS two two", "three three")
    # depth 3 counts comments: c4 sees c2, c3 only
    assert p["t1_c4"] == ("two two EOS three three", "four four")
    assert "t1_c1" not in p                    # one turn < min_depth


def test_long_middle_ancestor_cuts_chain(spark):
    rows = thread()
    rows[1] = ("c2", "u", "t1_c1", "t3_a", 1, "two " * 6, "2024-01")     # 6 words > max_len
    p = pairs(spark, rows)
    assert "t1_c2" not in p                    # over-long leaf -> no turns
    assert "t1_c3" not in p                    # parent cut -> 1 turn
    assert p["t1_c4"] == ("three three", "four four")


def test_orphan_parent_and_title(spark):
    rows = [("c1", "u", "t1_gone", "t3_a", 1, "one one", "2024-01"),
            ("c2", "u", "t1_c1", "t3_a", 1, "two two", "2024-01"),
            ("r1", "u", "t3_b", "t3_b", 1, "root reply", "2024-01")]
    p = pairs(spark, rows, use_title=True)
    assert p["t1_c2"] == ("one one", "two two")          # orphan: chain starts there, no title
    assert p["t1_r1"] == ("title : Title B", "root reply")  # title prepended (then tokenised) without spending depth


def test_title_depth_exactly_at_limit(spark):
    p = pairs(spark, thread()[:3], use_title=True)
    # c3 -> c2 -> c1 uses the whole depth of 3, c1's parent is the submission: title added
    assert p["t1_c3"] == ("title : Title A EOS one one EOS two two", "three three")


def test_month_scope_and_missing_submission(spark):
    rows = thread()[:2] + [("x1", "u", "t1_c1", "t3_a", 1, "other month", "2024-02")]
    p = pairs(spark, rows)
    assert "t1_x1" not in p                    # no submission in 2024-02: not admitted at all
    s = [("a", 1, 5, "x.com", "/r/Sub/comments/", "Title A", "2024-01"),
         ("a", 1, 5, "x.com", "/r/Sub/comments/", "Title A", "2024-02")]
    p = pairs(spark, rows, subs=s)
    assert "t1_x1" not in p                    # parent is in another month: one turn only


def test_leaves_only_and_weights(spark):
    p = pairs(spark, thread(), leaves_only=True, clean=True)
    assert set(p) == {"t1_c4"}
    ctx, resp = p["t1_c4"]
    assert resp == "1.0 four four" and ctx == "1.0 two two EOS 1.0 three three"


def test_discard_hash_sets_weight_zero(spark):
    disc = spark.createDataFrame([("three three",)], "t string").select(F.sha2("t", 224).alias("hash"))
    p = pairs(spark, thread(), leaves_only=True, clean=True, discard_hashes=disc)
    assert p["t1_c4"][0] == "1.0 two two EOS 0.0 three three"


def test_last_of_repeated_rows_wins(spark):
    """Three repeated comments and a repeated submission: still three pairs, with the last texts."""
    rows = [(*r, n) for n, r in enumerate(thread())]
    again = [("c1", "u", "t3_a", "t3_a", 1, "new one", "2024-01", 10), ("c2", "u", "t1_c1", "t3_a", 1, "new two", "2024-01", 11),
             ("c2", "u", "t1_c1", "t3_a", 1, "newest two", "2024-01", 12), ("c3", "u", "t1_c2", "t3_a", 1, "[deleted]", "2024-01", 13)]
    subs = [(*SUBS[0], 1), (*SUBS[1], 2), ("a", 1, 5, "x.com", "/r/Sub/comments/", "Later title", "2024-01", 3)]
    out = TH.thread_pairs(spark.createDataFrame(again + rows, C_SCHEMA + ", line_no int"),
                          spark.createDataFrame(subs, SUB_SCHEMA + ", line_no int"), order="line_no", max_len=5, max_depth=4, min_depth=2,
                          min_score=0, use_title=True, clean=False)
    got = {r["cid"]: (r["context"], r["response"]) for r in out.collect()}
    title = "title : Later title"
    assert got == {"t1_c1": (title, "new one"), "t1_c2": (f"{title} EOS new one", "newest two"),
                   "t1_c3": (f"{title} EOS new one EOS newest two", "three three"),
                   "t1_c4": (f"{title} EOS new one EOS newest two EOS three three", "four four")}
    # without an order the rows decide, the same way each time
    once = pairs(spark, thread() + thread())
    assert once == pairs(spark, thread())


def test_keys_of_one_stage_only(spark):
    k = spark.createDataFrame([("t3_a", "t1_c4", "keep")], "link_id string, comment_id string, kind string")
    assert set(pairs(spark, thread(), keep_keys=k)) == {"t1_c4"}
    dep = spark.createDataFrame([("t3_a", "t1_c4"), ("t3_a", "t1_c3")], "link_id string, comment_id string")
    assert pairs(spark, thread(), keep_keys=k, dep_keys=dep)["t1_c4"][0] == "three three"


def test_block_words_as_table_and_pattern_agree(spark):
    from convkit.operators import quality as Q
    phrases = ["jump in the lake", "c++", "the, and", "Straße", "!!", "# a comment", "a.b"]
    texts = ["go jump in the lake now", "JUMP IN THE LAKE", "jump in the lakes", "we use c++ here", "c plus", "the, and more", "the and more",
             "auf der strasse", "auf der STRAßE", "stop !!", "stop!!", "a.b", "axb", "", None, "in the lake jump"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    table = spark.createDataFrame([(p,) for p in phrases], "entry string")
    got = {r["k"]: r["blocked"] for r in Q.blockword_hits(df, "k", "body", table).collect()}
    rx = Q.blockword_regex(phrases)
    want = {r["k"]: bool(r["m"]) for r in df.select("k", F.col("body").rlike(rx).alias("m")).collect()}
    assert got == want
    assert [k for k, v in sorted(got.items()) if v] == [0, 1, 3, 5, 8, 9, 11]


def test_block_words_in_the_extraction(spark):
    table = spark.createDataFrame([("four four",), ("three",)], "entry string")
    p = pairs(spark, thread(), clean=True, block_words=table)
    assert "t1_c4" not in p and "t1_c3" not in p and "t1_c2" in p
    p = pairs(spark, thread(), leaves_only=True, clean=True, block_words=table)
    assert p["t1_c4"] == ("1.0 two two EOS 0.0 three three", "0.0 four four")


def test_total_counts_what_was_extracted(spark):
    subs = TH.submission_filter(spark.createDataFrame(SUBS, SUB_SCHEMA))
    c = TH.comment_admission(comments(spark, thread()), subs)
    inst = TH.conv_instances(c, subs, max_len=5, max_depth=3, use_title=False, leaves_only=True)
    got = {r["shard"]: (r["selected"], r["total"], r["avg_len"]) for r in TH.conv_stats(inst, c).collect()}
    assert got == {"0": (1, 4, 2.0), "all": (1, 4, None)}
    none = TH.conv_instances(c, subs, max_len=5, max_depth=3, use_title=False, min_score=9)
    assert {r["shard"]: (r["selected"], r["avg_len"]) for r in TH.conv_stats(none, c).collect()} == {"0": (0, None), "all": (0, None)}


def test_score_and_reason_audit(spark):
    rows = thread()
    rows[3] = ("c4", "u", "t1_c3", "t3_a", None, "four four", "2024-01")   # NULL score counts as 0
    subs = spark.createDataFrame(SUBS, SUB_SCHEMA)
    c = TH.comment_admission(comments(spark, rows), TH.submission_filter(subs))
    inst = TH.conv_instances(c, TH.submission_filter(subs), max_len=5, max_depth=3, min_score=1, use_title=False)
    got = {r["cid"]: r["skip_reason"] for r in inst.collect()}
    assert got == {"t1_c1": "min_depth", "t1_c2": None, "t1_c3": None, "t1_c4": "low_score"}


def test_admission_rules(spark):
    rows = [("d1", "u", "t3_a", "t3_a", 1, "[deleted]", "2024-01"),
            ("d2", "u", "t3_a", "t3_a", 1, "quote > this", "2024-01"),
            ("d3", "u", "t3_a", "t3_a", 1, "quote &gt; this", "2024-01"),
            ("d4", "u", "t3_a", "t3_a", 1, "single", "2024-01"),
            ("d5", "u", "t3_a", "t3_a", 1, "tab\tsplit", "2024-01")]
    subs = TH.submission_filter(spark.createDataFrame(SUBS, SUB_SCHEMA))
    got = [(r["name"], r["body"], r["n_char"]) for r in TH.comment_admission(comments(spark, rows), subs).collect()]
    assert got == [("t1_d5", "tab split", 9)]


def test_chain_counts_match_survey_probe(spark):
    """Chains of >= 2 turns over all adapter comments (before score, leaf,
    key and quality filters, no title, depth 5): FIXTURES.md section B."""
    from conftest import SF001, SF01
    from convkit.functions import text as T
    from convkit.sources import adapters as AD
    expect = {SF001: {30: 6, 100: 34, 200: 54}, SF01: {30: 32, 100: 197, 200: 297}}
    for sf, exp in expect.items():
        c = (AD.comments(spark, sf).withColumn("name", F.concat(F.lit("t1_"), F.col("id")))
             .withColumn("n_char", F.length("body")).withColumn("body", T.minimal_norm("body")))
        for max_len, n in exp.items():
            ch = TH.ancestor_chains(c, c, max_depth=5, max_len=max_len)
            assert ch.filter(F.size("turns") >= 2).count() == n, (sf, max_len)
    c = AD.comments(spark, SF01).withColumn("name", F.concat(F.lit("t1_"), F.col("id")))
    assert c.count() == 536
    assert c.filter(TH.score_of("score") < 1).count() == 139
    assert TH.leaf_comments(c).count() == 243
