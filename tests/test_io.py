"""File sources and sinks on small hand-written files."""

import bz2
import gzip
import os
import tempfile

from convkit.sources import files as IO


def write(path, text, opener=open):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with opener(path, "wt", encoding="utf-8") as f:
        f.write(text)


def test_dump_scan_drops_malformed_and_keyless(spark):
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/RC_2024-05.bz2",
          '{"id": "a", "author": "u", "parent_id": "t3_x", "link_id": "t3_x", "score": null, "body": "hi there"}\n'
          '{"id": "b", "author": "u", "parent_id": "t3_x", "link_id": "t3_x", "score": 3}\n'
          'not json at all\n'
          '{"id": "c", "author": "u", "parent_id": "t1_a", "link_id": "t3_x", "score": 1, "body": "ok ok"}\n',
          bz2.open)
    got = {r["id"]: (r["score"], r["month"]) for r in IO.read_comments(spark, f"{d}/RC_*.bz2").collect()}
    assert got == {"a": (None, "2024-05"), "c": (1, "2024-05")}


def test_keys_blocklist_refs(spark):
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/keys.gz", "t3_x\tt1_a\tdep\nt3_x\tt1_a\tkeep\nt3_x\tt1_b\tkeep\n", gzip.open)
    k = {(r["comment_id"], r["kind"]) for r in IO.read_keys(spark, f"{d}/keys.gz", task="conv").collect()}
    assert k == {("t1_a", "keep"), ("t1_b", "keep")}
    write(f"{d}/bl.txt", "# comment\nBadSub\n\nother\n")
    assert {r[0] for r in IO.read_blocklist(spark, f"{d}/bl.txt", lower=True).collect()} == {"badsub", "other"}
    write(f"{d}/refs.txt", "k1\t1|a\t2|b\nk2\tx\nk1\t3|c\n")
    keys = spark.createDataFrame([("k1",)], "key string")
    got = {r["key"]: r["refs"] for r in IO.read_refs(spark, f"{d}/refs.txt", keys).collect()}
    assert got == {"k1": ["3|c"]}                      # restricted to the key list, last line wins


def test_hypotheses_line_aligned(spark):
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/hyp.txt", "Val loss 3.2\nfirst answer\n\nsecond answer\n")
    write(f"{d}/keys.txt", "k1\nk2\n")
    got = [(r["line_no"], r["key"], r["hyp"]) for r in
           IO.read_hypotheses(spark, f"{d}/hyp.txt", f"{d}/keys.txt", "sys").orderBy("line_no").collect()]
    assert got == [(0, "k1", "first answer"), (1, "k2", "second answer")]


def test_pairs_roundtrip_with_quotes_and_multi_target(spark):
    d = tempfile.mkdtemp(prefix="convkit-io-")
    df = spark.createDataFrame([("t3_x", "t1_a", "t1_b", 'he said "hi"', "ok")],
                               "sid string, pid string, cid string, context string, response string")
    IO.write_pairs(df, f"{d}/pairs")
    back = IO.read_pairs(spark, f"{d}/pairs", ["keys", "context", "response"]).collect()[0]
    assert back["keys"] == "t3_x,t1_a,t1_b" and back["context"] == 'he said "hi"'
    write(f"{d}/mt.txt", " src  a \t t1 \tt2  x\n")
    got = [(r["src"], r["target_idx"], r["tgt"]) for r in
           IO.read_multi_target(spark, f"{d}/mt.txt").orderBy("target_idx").collect()]
    assert got == [("src a", 0, "t1"), ("src a", 1, "t2 x")]


def test_sink_orders(spark):
    import glob
    d = tempfile.mkdtemp(prefix="convkit-io-")
    rows = [(f"t3_{i % 3}", f"t1_{i % 5}", f"t1_{i:03d}", "c", "r") for i in range(40)]
    df = spark.createDataFrame(rows, "sid string, pid string, cid string, context string, response string")
    IO.write_pairs(df.repartition(4), f"{d}/pairs")
    lines = []
    for f in sorted(glob.glob(f"{d}/pairs/part-*")):
        lines += [ln.split("\t")[0] for ln in open(f, encoding="utf-8").read().splitlines()]
    assert lines == sorted(lines, key=lambda k: tuple(k.split(",")))
    IO.write_report(df.select("cid", "sid").repartition(3), f"{d}/rep", order_by=["cid"])
    keys = []
    for f in sorted(glob.glob(f"{d}/rep/part-*")):
        keys += [ln.split("\t")[0] for ln in open(f, encoding="utf-8").read().splitlines()[1:]]
    assert keys == sorted(keys)


def test_sha224_matches_hashlib(spark):
    import hashlib
    from pyspark.sql import functions as F
    vals = ["hello world", "café", ""]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(F.sha2("t", 224)).collect()]
    assert got == [hashlib.sha224(v.encode("utf-8")).hexdigest() for v in vals]


def test_feature_sink_chunks_and_metadata(spark):
    from pyspark.sql import functions as F
    d = tempfile.mkdtemp(prefix="convkit-io-")
    df = spark.range(250).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("v"))
    IO.write_features(df, d, [F.col("row_id")], chunk_size=100)
    meta = spark.read.json(d + "/meta").first()
    assert (meta["n_rows"], meta["n_chunks"], meta["chunk_size"]) == (250, 3, 100)
    back = spark.read.parquet(d + "/chunks")
    got = {r["chunk_id"]: r["count"] for r in back.groupBy("chunk_id").count().collect()}
    assert got == {0: 100, 1: 100, 2: 50}
    assert back.filter((F.col("row_id") / 100).cast("int") != F.col("chunk_id")).count() == 0


def test_loose_types_and_counted_rejects(spark):
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/RS_2024-05.json",
          '{"id": "a", "score": "7", "num_comments": 3, "domain": null, "title": "T"}\n'
          '{"id": "b", "score": {"x": 1}, "num_comments": "2", "permalink": "/r/x/", "title": "T"}\n'
          '{"id": "c", "score": 1}\n'
          '{"id": broken\n')
    rows = {r["id"]: (r["score"], r["num_comments"], r["domain"]) for r in IO.read_submissions(spark, f"{d}/RS_*.json").collect()}
    assert rows == {"a": (7, 3, None), "b": (None, 2, None)}
    # the verdict doesn't depend on the columns that are selected
    assert IO.read_submissions(spark, f"{d}/RS_*.json").select("id").count() == 2
    assert tuple(IO.rejects(spark, f"{d}/RS_*.json", "submissions").first()) == (1, 1, 2)


def test_repeated_dump_lines(spark):
    from convkit.operators import threads as TH
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/RS_2024-05.json", '{"id": "a", "num_comments": 3, "title": "first"}\n' + '{"id": "z", "num_comments": 9, "title": "z"}\n' * 50
          + '{"id": "a", "num_comments": 3, "title": "last"}\n')
    s = TH.submission_filter(IO.read_submissions(spark, f"{d}/RS_*.json"), order="line_no")
    assert {r["id"]: r["title"] for r in s.collect()} == {"a": "last", "z": "z"}


def test_lines_of_several_files(spark):
    """Files of very different sizes: order by name and line, not by size."""
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/refs/part-0", "k\told\n")
    write(f"{d}/refs/part-1", "".join(f"q{i}\tx\n" for i in range(3000)) + "k\tnew\n" + "k\tnewest\n")
    keys = spark.createDataFrame([("k",)], "key string")
    assert [r["refs"] for r in IO.read_refs(spark, f"{d}/refs", keys).collect()] == [["newest"]]
    write(f"{d}/hyp/part-0", "h0\n")
    write(f"{d}/hyp/part-1", "Val x\n" + "".join(f"h{i}\n" for i in range(1, 3000)))
    write(f"{d}/keys.txt", "".join(f"k{i}\n" for i in range(3000)))
    got = IO.read_hypotheses(spark, f"{d}/hyp", f"{d}/keys.txt", "s").collect()
    assert len(got) == 3000 and all(r["hyp"][1:] == r["key"][1:] == str(r["line_no"]) for r in got)
    write(f"{d}/short.txt", "k0\nk1\n")
    import pytest
    with pytest.raises(Exception, match="differ in length"):
        IO.read_hypotheses(spark, f"{d}/hyp", f"{d}/short.txt", "s").collect()


def test_pairs_with_line_breaks_and_short_rows(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/p.tsv", 'k1\t"two\nlines"\tr1\nk2\tc2\nk3\tc3\tr3\n')
    got = {r["keys"]: (r["context"], r["response"]) for r in IO.read_pairs(spark, f"{d}/p.tsv", ["keys", "context", "response"]).collect()}
    assert got == {"k1": ("two\nlines", "r1"), "k2": ("c2", None), "k3": ("c3", "r3")}
    write(f"{d}/q.tsv", "a\tb\tc\td\n")
    with pytest.raises(Exception, match="more cells"):
        IO.read_pairs(spark, f"{d}/q.tsv", ["keys", "context", "response"]).collect()


def test_test_ids_and_multiref(spark):
    """Cell 0 of a line names its kind, the items begin at cell 1."""
    from convkit.operators import corpus as CO
    d = tempfile.mkdtemp(prefix="convkit-io-")
    write(f"{d}/ids.txt", "multiref\t0.5,t3_a,t1_b,t1_c\t0.4,t3_a,t1_b,t1_d\t0.3,gone  \nmultiref\t0.9,gone\t0.8,t3_a,t1_b,t1_c\n"
                          "multiref\nother\t0.7,t3_a,t1_b,t1_c\t0.6,t3_z,x,y\n")
    t = IO.read_test_ids(spark, f"{d}/ids.txt")
    rows = [(r["line_no"], r["known"], r["pos"], r["score"], r["rid"]) for r in t.orderBy("line_no", "pos").collect()]
    assert rows[:3] == [(0, True, 0, "0.5", "t3_a,t1_b,t1_c"), (0, True, 1, "0.4", "t3_a,t1_b,t1_d"), (0, True, 2, "0.3", "gone")]
    assert {r[0] for r in rows} == {0, 1, 3} and {r[0] for r in rows if not r[1]} == {3}
    data = spark.createDataFrame([("t3_a,t1_b,t1_c", "src", "old", 0), ("t3_a,t1_b,t1_c", "src", "“new”", 1), ("t3_a,t1_b,t1_d", "src", "two", 2),
                                  ("t3_z,x,y", "other", "no", 3)], "keys string, src string, tgt string, data_line int")
    got = {r["line_no"]: (r["src"], r["refs"]) for r in CO.multiref(t, data).collect()}
    # the first reference anchors the source: line 1 has none, line 3's second one has another source
    assert got == {0: ("src", '0.5|"new"\t0.4|two'), 3: ("src", '0.7|"new"')}
    items = spark.createDataFrame([(2, [("0.1", "a,b")]), (1, [("0.2", "c"), ("0.3", "d")])], "n int, items array<struct<score:string,rid:string>>")
    IO.write_test_ids(items, f"{d}/back", ["n"])
    assert [(r["line_no"], r["score"], r["rid"]) for r in IO.read_test_ids(spark, f"{d}/back").orderBy("line_no", "pos").collect()] == [
        (0, "0.2", "c"), (0, "0.3", "d"), (1, "0.1", "a,b")]


def test_extract_in_files_of_bounded_size(spark):
    d = tempfile.mkdtemp(prefix="convkit-io-")
    df = spark.range(100).selectExpr("id", "'2024-01' as month").coalesce(1)
    IO.write_extract(df, f"{d}/x", split_size=30)
    assert len([f for f in os.listdir(f"{d}/x/month=2024-01") if f.startswith("part-")]) == 4
    assert IO.read_extract(spark, f"{d}/x").count() == 100
