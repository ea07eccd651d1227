"""Records of quoted TSV files, read by many tasks.

A line break ends a record unless it stands in a quoted cell, and whether it
does depends on all of the file before it. Spark's own multi-line reader
therefore gives a whole file to one task. Here a file is read in splits, line
by line, and what a line does is a map of two states (outside or inside a
quoted cell) to two. Each split follows both states through its lines; the
maps of a file's splits, a row each, are then composed in order, which tells
every split the state it begins in and the record that is open there. Lines
that are a record by themselves stay where they are; only the lines of longer
records are shuffled to meet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from convkit.session import materialize


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins outside or inside a quoted cell ends inside
    one. A quote opens a cell only at its start, and a doubled one is text."""
    at = 0
    if not inside and line[:1] == '"':
        inside, at = True, 1
    while True:
        while inside:
            at = line.find('"', at)
            if at < 0:
                return True
            inside = line[at + 1:at + 2] == '"'
            at += 2 if inside else 1
        at = line.find("\t", at) + 1
        if not at:
            return False
        if line[at:at + 1] == '"':
            inside, at = True, at + 1


@F.arrow_udf(Ty.StructType([Ty.StructField("outside", Ty.BooleanType()), Ty.StructField("inside", Ty.BooleanType())]))
def _ends(lines: pa.Array) -> pa.Array:
    """What a line makes of either state; only lines with a quote are looked at."""
    out, ins = [], []
    for x in lines.to_pylist():
        plain = not x or '"' not in x
        out.append(False if plain else ends_inside(x, False))
        ins.append(True if plain else ends_inside(x, True))
    return pa.StructArray.from_arrays([pa.array(out, pa.bool_()), pa.array(ins, pa.bool_())], names=["outside", "inside"])


def _followed(t: pa.Table) -> pa.Table:
    """Both states through the lines of a split. Per line and first state: the
    state behind it (after0, after1) and the line its record begins with
    (first0, first1; null if in an earlier split)."""
    t = t.sort_by("line")
    lines, maps = t["line"].to_pylist(), list(zip(t["outside"].to_pylist(), t["inside"].to_pylist()))
    cols = []
    for state in (False, True):
        after, first, begin = [], [], None
        for line, m in zip(lines, maps):
            if not state:
                begin = line
            state = m[state]
            after.append(state)
            first.append(begin)
        cols += [pa.array(after, pa.bool_()), pa.array(first, pa.int64())]
    return pa.table([t["file"], t["block"], t["line"], *cols], names=["file", "block", "line", "after0", "first0", "after1", "first1"])


def _composed(t: pa.Table) -> pa.Table:
    """The state and the open record that each split of a file begins with."""
    rows, state, record = sorted(t.to_pylist(), key=lambda r: r["block"]), False, (0, 0)
    out = []
    for r in rows:
        out.append((r["file"], r["block"], state, *record))
        first = r["first1"] if state else r["first0"]
        state = r["after1"] if state else r["after0"]
        record = record if first is None else (r["block"], first)
    return pa.Table.from_pylist([dict(zip(("file", "block", "state", "open_block", "open_line"), x)) for x in out],
                                schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("state", pa.bool_()),
                                                  ("open_block", pa.int64()), ("open_line", pa.int64())]))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, record: the records of the files, their inner line breaks kept."""
    t = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    # written once: the numbers of the lines must be the same for all that reads them
    t = materialize(t.withColumn("m", _ends("value")).select("value", "file", "block", "line", "m.*"), "tsv-lines")
    lean = t.select("file", "block", "line", "outside", "inside")
    both = materialize(lean.groupBy("file", "block").applyInArrow(
        _followed, "file string, block long, line long, after0 boolean, first0 long, after1 boolean, first1 long"), "tsv-states")
    last = F.max_by(F.struct("after0", "first0", "after1", "first1"), "line").alias("v")
    splits = both.groupBy("file", "block").agg(last).select("file", "block", "v.*")
    starts = materialize(splits.groupBy("file").applyInArrow(_composed, "file string, block long, state boolean, open_block long, open_line long"), "tsv-splits")
    # one row per split: its join side is as small as the list of splits
    s = both.join(starts, ["file", "block"]).select(
        "file", "block", "line", F.when(F.col("state"), F.col("after1")).otherwise(F.col("after0")).alias("after"),
        F.when(F.col("state"), F.col("first1")).otherwise(F.col("first0")).alias("first"), "open_block", "open_line")
    s = s.select("file", "block", "line", ((F.col("first") == F.col("line")) & ~F.col("after")).alias("whole"),
                 F.when(F.col("first").isNull(), F.col("open_block")).otherwise(F.col("block")).alias("rec_block"),
                 F.coalesce("first", "open_line").alias("rec_line"))
    x = t.select("file", "block", "line", "value").join(s, ["file", "block", "line"])
    x = x.withColumn("whole", F.coalesce("whole", F.lit(False)))
    single = x.filter("whole").select("file", F.col("value").alias("record"))
    many = (x.filter("not whole").groupBy("file", "rec_block", "rec_line").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("p"))
             .select("file", F.array_join(F.transform("p", lambda r: r["value"]), "\n").alias("record")))
    out = single.unionByName(many)
    return out.select("file", F.regexp_replace("record", "\r$", "").alias("record")).filter(F.col("record") != "")
