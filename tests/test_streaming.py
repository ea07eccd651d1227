"""Batch = stream: the keyed history state over several micro-batches
equals the batch rule, and stateless admission equals its batch job."""

import tempfile

from pyspark.sql import functions as F

from convkit.operators import scoring as SC
from convkit.sources import adapters as AD
from convkit.streaming import history as SH
from convkit.streaming.runner import run_to_table

from conftest import SF01


def test_history_state_across_micro_batches(spark):
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    src = tempfile.mkdtemp(prefix="convkit-stream-src-")
    # five files by turn range: one micro-batch per file, messages arrive in
    # time order as in a live chat
    cuts = [(0, 1), (2, 2), (3, 4), (5, 6), (7, 10 ** 6)]
    for t, (lo, hi) in enumerate(cuts):
        part = conv.filter((F.col("turn") >= lo) & (F.col("turn") <= hi))
        part.coalesce(1).write.mode("overwrite").parquet(f"{src}/part{t}")
    files = [f"{src}/part{t}" for t in range(5)]
    stream = (spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = run_to_table(SH.history_updates(AD.history_messages_from(stream)), "update", tag="test-history")
    assert out.select("_batch").distinct().count() > 1
    got = {tuple(r) for r in SH.latest(out).collect()}
    batch = AD.history_messages_from(spark.read.parquet(*files))
    exp = {tuple(r) for r in SC.history_final(batch).select("uid", "from_ts", "n_kept", "tokens").collect()}
    assert got == exp


def test_history_state_out_of_order(spark):
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    src = tempfile.mkdtemp(prefix="convkit-stream-src-")
    for t in range(4):       # turn % 4 per file: later files carry older turns too
        conv.filter((F.col("turn") % 4) == t).coalesce(1).write.mode("overwrite").parquet(f"{src}/part{t}")
    stream = (spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = run_to_table(SH.history_updates(AD.history_messages_from(stream)), "update", tag="test-history-ooo")
    got = {tuple(r) for r in SH.latest(out).collect()}
    exp = {tuple(r) for r in SC.history_final(AD.history_messages_from(conv))
           .select("uid", "from_ts", "n_kept", "tokens").collect()}
    assert got == exp


def test_trim_rule():
    ts, tok = SH._trim([1, 2, 3, 4], [30, 30, 30, 70], 64)
    assert ts == [4] and tok == [70]                     # newest kept even over budget
    ts, tok = SH._trim([1, 2, 3], [10, 30, 34], 64)
    assert ts == [2, 3]                                  # exact fit 64


def test_restarted_stream_loses_and_repeats_nothing(spark, tmp_path):
    """A second run on the same folder reads only what is new; a batch that runs again replaces itself."""
    src, job = str(tmp_path / "src"), str(tmp_path / "job")
    schema = "id long, v string"

    def put(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part{n}")

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
        return run_to_table(s, "append", path=job)
    put(0, [(i, "a") for i in range(10)])
    assert run().count() == 10
    put(1, [(i, "b") for i in range(10, 25)])
    assert sorted(r["id"] for r in run().collect()) == list(range(25))
    assert run().count() == 25
    # the last batch is replayed: its commit is missing, its folder is there
    commits = tmp_path / "job" / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in commits.iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    assert sorted(r["id"] for r in run().collect()) == list(range(25))


def test_stream_without_rows(spark, tmp_path):
    (tmp_path / "src").mkdir()
    s = spark.readStream.schema("id long").parquet(str(tmp_path / "src"))
    assert run_to_table(s, path=str(tmp_path / "job")).count() == 0


def test_silent_user_starts_anew():
    update = SH._make_update(64, 1000)

    class State:
        exists, hasTimedOut, removed = True, True, False

        def remove(self):
            self.removed = True
    s = State()
    assert list(update((1,), iter([]), s)) == [] and s.removed


def test_last_wins_over_micro_batches(spark, tmp_path):
    """Repeats in other batches, late ones too, and a replayed batch: one row per key, that of the last line."""
    from convkit.operators import threads as TH
    from convkit.streaming import upserts as UP
    schema = "month string, link_id string, name string, body string, line_no int"
    batches = [[("m", "t", "a", "one", 1), ("m", "t", "b", "b1", 2), ("m", "t", "a", "two", 3)],
               [("m", "t", "a", "four", 5), ("m", "t", "b", "late", 1)],
               [("m", "t", "a", "late", 4), ("m", "u", "a", "other", 0)]]
    src, job = str(tmp_path / "src"), str(tmp_path / "job")

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        return UP.upserted(TH.last_wins(s, UP.COMMENT_KEY, "line_no"), job)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part{k}")
        log = run()
    got = {(r["link_id"], r["name"]): r["body"] for r in UP.merged(log, UP.COMMENT_KEY).collect()}
    assert got == {("t", "a"): "four", ("t", "b"): "b1", ("u", "a"): "other"}
    assert UP.merged(log, UP.COMMENT_KEY).columns == ["month", "link_id", "name", "body"]
    before = sorted(map(tuple, UP.merged(log, UP.COMMENT_KEY).collect()))
    commits = tmp_path / "job" / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in commits.iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    assert sorted(map(tuple, UP.merged(run(), UP.COMMENT_KEY).collect())) == before
