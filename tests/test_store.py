"""Context state in RocksDB: the batch rule, restarts, silence and time to live."""

import time

from pyspark.sql import functions as F

from convkit.operators import scoring as SC
from convkit.sources import adapters as AD
from convkit.streaming import history as SH
from convkit.streaming import store as ST
from convkit.streaming.runner import run_to_table

from conftest import SF01

MSG = "uid long, ts long, n_tokens long, text string"


def _job(spark, tmp_path, **kw):
    src, job = str(tmp_path / "src"), str(tmp_path / "job")

    def run(rows=None):
        if rows is not None:
            spark.createDataFrame(rows, MSG).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).parquet(src)
        with ST.rocksdb(spark):
            return run_to_table(ST.stored_updates(s, **kw), "update", path=job)
    return run


def _now(out):
    return {r["uid"]: (r["from_ts"], r["n_kept"], r["tokens"]) for r in SH.latest(out).collect()}


def test_equals_batch_in_any_order(spark, tmp_path):
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    for t in range(3):                  # later files carry older turns too
        conv.filter((F.col("turn") % 3) == t).coalesce(1).write.parquet(str(tmp_path / f"src/part{t}"))
    s = (spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "src")))
    with ST.rocksdb(spark):
        out = run_to_table(ST.stored_updates(AD.history_messages_from(s)), "update", tag="test-store")
    assert out.select("_batch").distinct().count() > 1
    got = {tuple(r) for r in SH.latest(out).collect()}
    assert got == {tuple(r) for r in SC.history_final(AD.history_messages_from(conv)).select("uid", "from_ts", "n_kept", "tokens").collect()}
    assert spark.conf.get(ST.PROVIDER, "") != ST.ROCKSDB


def test_restart_goes_on_from_the_state(spark, tmp_path):
    run = _job(spark, tmp_path)
    assert _now(run([(1, 1, 30, "a"), (1, 2, 30, "b"), (2, 5, 99, "c"), (3, 1, 1, "")])) == {1: (1, 2, 60), 2: (5, 1, 99), 3: (None, 0, 1)}
    # a new query on the same folder: the budget drops the first message, an older one than that stays out
    assert _now(run([(1, 3, 30, "d")]))[1] == (2, 2, 60)
    assert _now(run([(1, 0, 1, "late"), (2, 6, 10, "e")])) == {1: (2, 2, 60), 2: (6, 1, 10), 3: (None, 0, 1)}
    assert max(r["seen"] for r in run().filter("uid = 1").collect()) == 4


def test_silent_users_are_forgotten(spark, tmp_path):
    run = _job(spark, tmp_path, silence_ms=1500)
    run([(1, 1, 10, "a"), (2, 1, 10, "a")])
    time.sleep(2)
    # user 2's timer goes off in this batch; user 1 comes back in it and starts anew as well
    out = run([(1, 2, 5, "b"), (3, 1, 1, "x")])
    assert _now(out.filter("_batch >= 1"))[1] == (2, 1, 5)
    out = run([(2, 2, 7, "b")])
    assert {(r["uid"], r["n_kept"], r["seen"]) for r in out.filter("uid = 2").collect()} == {(2, 1, 1)}
    assert {r["from_ts"] for r in out.filter("uid = 2").collect()} == {1, 2}


def test_time_to_live(spark, tmp_path):
    run = _job(spark, tmp_path, ttl_ms=1000)
    run([(1, 1, 10, "a")])
    time.sleep(2)
    out = run([(1, 2, 5, "b")])
    assert {(r["from_ts"], r["n_kept"], r["seen"]) for r in out.collect()} == {(1, 1, 1), (2, 1, 1)}
