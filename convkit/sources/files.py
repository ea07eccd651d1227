"""File sources and sinks (IO1-IO12).

Readers take explicit schemas (no inference), so column pruning reaches
the scan; compressed inputs (bz2 / gz) are decoded by Spark's codecs.
Sinks are ordinary DataFrame writers: task-level files, no driver gather.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from convkit.functions import text as T
from convkit.operators.batching import chunk_ids
from convkit.operators.ordering import global_index
from convkit.sources import tsv, xz

# Every field is read as text: a dump types its fields loosely, and a value of
# another type must not cost the row.
SUBMISSION_FIELDS = ["id", "score", "num_comments", "domain", "permalink", "title"]
COMMENT_FIELDS = ["id", "author", "parent_id", "link_id", "score", "body"]
MONTH_FROM_NAME = r"R[CS]_(\d{4}-\d{2})"


# Endings of text files: Spark's own codecs, and xz (see :mod:`convkit.sources.xz`).
TEXT_ENDINGS = {"", "txt", "json", "jsonl", "gz", "bz2", "zst", "deflate", "snappy", "lz4"}


def data_files(spark: SparkSession, path: str) -> list[str]:
    """URIs of the files that a path, folder or pattern stands for, without hidden ones."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for top in fs.globStatus(jpath(path)) or []:
        found = fs.listFiles(top.getPath(), True)
        while found.hasNext():
            f = found.next().getPath()
            inside = f.toString()[len(top.getPath().toString()):].split("/") if top.isDirectory() else [f.getName()]
            if not any(part[:1] in ("_", ".") for part in inside):
                out.append(f.toString())
    return sorted(out)


def _text(spark: SparkSession, path: str, partitioned: bool) -> DataFrame:
    """value, file, line_no, and month of ``month=...`` folders if
    ``partitioned``. A file is decoded by its ending; one that nothing here
    decodes would be read as raw bytes, and ends the job instead."""
    by_xz, plain = [], []
    for f in data_files(spark, path):
        name = f.rsplit("/", 1)[1]
        ending = name.rsplit(".", 1)[1] if "." in name else ""
        if ending != "xz" and ending not in TEXT_ENDINGS:
            raise ValueError(f"no decoder for {f}")
        (by_xz if ending == "xz" else plain).append(f)
    month = F.regexp_extract("file", "/month=([^/]+)/", 1).alias("month")
    out = None
    if plain or not by_xz:
        r = spark.read
        if partitioned:                 # the partition column is text
            r = r.schema("value string, month string")
        # with files of both kinds the plain ones are named one by one
        t = r.text(path) if not by_xz else r.option("basePath", path).text(plain) if partitioned else r.text(plain)
        out = t.select("value", F.input_file_name().alias("file"), _line_order().alias("line_no"), *(["month"] if partitioned else []))
    if by_xz:
        t = xz.read_lines(spark, by_xz)
        order = F.struct("file", "block", "line").alias("line_no")
        t = t.select("value", "file", order, *([month] if partitioned else []))
        out = t if out is None else out.unionByName(t)
    return out


def _with_month(df: DataFrame, month: str | None) -> DataFrame:
    if month is not None:
        return df.withColumn("month", F.lit(month)).drop("file")
    if "month" in df.columns:           # month=YYYY-MM folders
        return df.drop("file")
    return df.withColumn("month", F.regexp_extract("file", MONTH_FROM_NAME, 1)).drop("file")


def _lines(spark: SparkSession, path: str, fields: list[str], numbers: list[str], month: str | None, partitioned: bool) -> DataFrame:
    """JSON lines with the given fields; ``line_no`` orders the lines of a
    file, ``rejected`` marks lines without JSON."""
    schema = Ty.StructType([Ty.StructField(f, Ty.StringType()) for f in [*fields, "_bad"]])
    t = _text(spark, path, partitioned)
    kept = ["month"] if partitioned else []
    x = t.select(*kept, F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"), "file", "line_no")
    cols = [F.col(f"j.{f}").try_cast("long").alias(f) if f in numbers else F.col(f"j.{f}").alias(f) for f in fields]
    return _with_month(x.select(*cols, *kept, "file", "line_no", (F.col("j").isNull() | F.col("j._bad").isNotNull()).alias("rejected")), month)


def _line_order() -> Column:
    """Orders the lines of text files: by file, place of the split in it, line of the split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"))


def _keyed(df: DataFrame, required: list[str]) -> Column:
    ok = ~F.col("rejected")
    for f in required:
        ok = ok & F.col(f).isNotNull()
    return ok


SUBMISSION_KEYS = ["id", "num_comments", "title"]
COMMENT_KEYS = ["id", "link_id", "parent_id", "body"]


def read_submissions(spark: SparkSession, path: str, month: str | None = None,
                     partitioned: bool = False) -> DataFrame:
    """IO1: JSON-lines submission dump. Lines that are no JSON and rows
    without a key field are left out (:func:`rejects` counts them); a score
    that is no number, a missing domain or permalink are NULL and cost
    nothing. ``line_no`` orders the lines, for :func:`threads.last_wins`."""
    df = _lines(spark, path, SUBMISSION_FIELDS, ["score", "num_comments"], month, partitioned)
    return df.filter(_keyed(df, SUBMISSION_KEYS)).drop("rejected")


def read_comments(spark: SparkSession, path: str, month: str | None = None, partitioned: bool = False) -> DataFrame:
    """IO2: JSON-lines comment dump (same rules)."""
    df = _lines(spark, path, COMMENT_FIELDS, ["score"], month, partitioned)
    return df.filter(_keyed(df, COMMENT_KEYS)).drop("rejected")


def rejects(spark: SparkSession, path: str, kind: str, partitioned: bool = False) -> DataFrame:
    """Lines that a dump scan leaves out, by reason: one row of ``malformed``,
    ``keyless`` and ``kept`` counts. ``kind``: comments or submissions."""
    fields, keys, numbers = ((COMMENT_FIELDS, COMMENT_KEYS, ["score"]) if kind == "comments" else
                             (SUBMISSION_FIELDS, SUBMISSION_KEYS, ["score", "num_comments"]))
    df = _lines(spark, path, fields, numbers, None, partitioned)
    ok = _keyed(df, keys)
    return df.agg(F.count_if("rejected").alias("malformed"), F.count_if(~F.col("rejected") & ~ok).alias("keyless"), F.count_if(ok).alias("kept"))


def write_extract(df: DataFrame, path: str, split_size: int | None = None, buckets: int | None = None,
                  by: str = "link_id", table: str | None = None) -> None:
    """IO3: extract stage output, partitioned by month; with ``split_size``
    in files of at most so many rows. With ``buckets`` it is the external table
    ``table``, bucketed by ``by`` with one file a bucket and month."""
    if buckets:
        df = df.repartition(buckets, by)        # rows of a bucket meet in one task
    w = df.write.mode("overwrite").partitionBy("month")
    if split_size:
        w = w.option("maxRecordsPerFile", split_size)
    if buckets:
        w.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(table)
    else:
        w.parquet(path)


def read_extract(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path)


def read_months(spark: SparkSession, path: str, months: list[str], schema) -> list[DataFrame]:
    """One frame per month, each from that month's folder of an extract alone."""
    own = Ty.StructType([f for f in schema.fields if f.name != "month"])
    return [spark.read.schema(own).parquet(f"{path}/month={m}").withColumn("month", F.lit(m)) for m in months]


def read_keys(spark: SparkSession, path: str, task: str = "conv") -> DataFrame:
    """IO4: key lines 'link TAB comment TAB kind' (or a hash); the
    conversation stage ignores lines ending in TAB 'dep'."""
    t = spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("key"))
    if task == "conv":
        t = t.filter(~F.col("key").endswith("\tdep"))
    c = F.split("key", "\t")
    return t.select("key", F.get(c, 0).alias("link_id"), F.get(c, 1).alias("comment_id"),
                    F.get(c, 2).alias("kind")).distinct()


def read_blocklist(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """IO5: one entry per line, '#' lines skipped."""
    t = spark.read.text(path).filter(~F.col("value").startswith("#"))
    e = F.regexp_replace("value", r"\s+$", "")
    return t.select((F.lower(e) if lower else e).alias("entry")).filter(F.col("entry") != "").distinct()


def write_pairs(df: DataFrame, path: str, training_projection: bool = False, canonical_order: bool = True) -> None:
    """IO6: 'sid,pid,cid TAB context TAB response' (or the last two cells).

    T3: with ``canonical_order`` rows are written sorted by (sid, pid, cid)
    as strings: a distributed range sort, part files in key order."""
    cols = [] if training_projection else [F.concat_ws(",", "sid", "pid", "cid").alias("keys")]
    if canonical_order:
        df = df.orderBy("sid", "pid", "cid")
    (df.select(*cols, "context", "response").write.mode("overwrite")
       .option("sep", "\t").option("quote", '"').option("escape", '"').csv(path))


def read_pairs(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """IO7: header-less TSV with CSV quoting rules (doubled quotes, quoted
    cells over several lines), a large file by many tasks (see
    :mod:`convkit.sources.tsv`). A row with fewer cells has NULLs at its end;
    a row with more ends the job, since its cells can't be told apart."""
    schema = ", ".join(f"`{n}` string" for n in [*names, "_more"])
    cells = F.from_csv("record", schema, {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    df = tsv.records(spark, path).select(cells.alias("c")).select("c.*")
    extra = F.raise_error(F.concat(F.lit("a row has more cells than named: "), F.coalesce(names[0], F.lit(""))))
    return df.withColumn(names[0], F.when(F.col("_more").isNotNull(), extra.cast("string")).otherwise(F.col(names[0]))).drop("_more")


def read_refs(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """IO8: 'key TAB ref TAB ref ...' restricted to a key list; the last
    line of a duplicated key wins (files by name, lines as they stand)."""
    t = spark.read.text(path).withColumn("_ord", _line_order())
    c = F.split("value", "\t")
    r = t.select(F.get(c, 0).alias("key"), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))).alias("refs"), "_ord")
    r = r.join(keys.select("key").distinct(), "key", "left_semi")
    return r.groupBy("key").agg(F.max_by("refs", "_ord").alias("refs"))


MULTIREF = "multiref"


def read_test_ids(spark: SparkSession, path: str) -> DataFrame:
    """J8 input: lines 'multiref TAB score,id TAB score,id ...'. The first
    cell names the kind of line; lines of other kinds are read as well and
    flagged (``known`` is false). An item is split at its first comma only.
    One row per item: line_no, known, pos (from 0), score, rid. Lines without
    items have no rows but keep their number."""
    t = spark.read.text(path).withColumn("_ord", _line_order())
    x = global_index(t, [F.col("_ord.file"), F.col("_ord.block"), F.col("_ord.line")], "line_no")
    c = F.split(F.regexp_replace("value", r"\s+$", ""), "\t")
    x = x.select("line_no", (F.get(c, 0) == MULTIREF).alias("known"),
                 F.posexplode(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).alias("pos", "item"))
    return x.select("line_no", "known", "pos", F.substring_index("item", ",", 1).alias("score"),
                    F.expr("substr(item, instr(item, ',') + 1)").alias("rid"))


def write_test_ids(items: DataFrame, path: str, order: list[str]) -> None:
    """Lines that :func:`read_test_ids` reads, in the given order: rows with
    ``items``, an array of (score, rid)."""
    cells = F.transform("items", lambda i: F.concat(i["score"], F.lit(","), i["rid"]))
    items.orderBy(*order).select(F.array_join(F.concat(F.array(F.lit(MULTIREF)), cells), "\t").alias("value")).write.mode("overwrite").text(path)


def _numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line_no, line) of text files in the order of their names and lines."""
    t = spark.read.text(path).withColumnRenamed("value", "line").withColumn("_ord", _line_order())
    if keep is not None:
        t = t.filter(keep)
    return global_index(t, [F.col("_ord.file"), F.col("_ord.block"), F.col("_ord.line")], "line_no").drop("_ord")


def read_hypotheses(spark: SparkSession, hyp_path: str, keys_path: str, system: str) -> DataFrame:
    """IO9: line-aligned hypotheses and key list; lines starting 'Val' and
    empty lines are dropped from the hypothesis file first. Files of
    different lengths end the job."""
    h = _numbered_lines(spark, hyp_path, ~F.col("line").startswith("Val") & (F.col("line") != "")).withColumn("_h", F.lit(True))
    k = _numbered_lines(spark, keys_path).select("line_no", F.trim("line").alias("key"))
    j = h.join(k, "line_no", "full")
    short = F.raise_error(F.concat(F.lit("hypotheses and keys differ in length at line "), F.col("line_no").cast("string"))).cast("string")
    return j.select(F.lit(system).alias("system"), "line_no", F.when(F.col("_h").isNull() | F.col("key").isNull(), short).otherwise(F.col("key")).alias("key"),
                    F.col("line").alias("hyp"))


def write_features(df: DataFrame, path: str, order: list, chunk_size: int = 65536) -> DataFrame:
    """IO10: feature rows with chunk_id (row position // chunk_size), ordered
    by chunk in part files, plus a one-row metadata JSON sidecar that is
    counted from what was written."""
    spark = df.sparkSession
    c = chunk_ids(df, order, chunk_size)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    c.repartitionByRange(n, "chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(path + "/chunks")
    back = spark.read.schema(c.schema).parquet(path + "/chunks")
    meta = back.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("chunk_id").alias("n_chunks")).withColumn(
        "chunk_size", F.lit(chunk_size))
    meta.coalesce(1).write.mode("overwrite").json(path + "/meta")
    return back


def write_report(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """IO11: tab-separated report with a header row (T4: sorted by key
    columns at the sink only)."""
    if order_by:
        df = df.orderBy(*order_by)
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def read_multi_target(spark: SparkSession, path: str, norm: bool = True) -> DataFrame:
    """IO12: column 0 = source, columns 1.. = targets; one example per
    target, whitespace stripped (and collapsed when ``norm``)."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    x = t.select(F.get("c", 0).alias("src"), F.posexplode(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))))
                 .alias("target_idx", "tgt"))
    f = (lambda c: T.ws_norm(c, True)) if norm else (lambda c: T.ws_norm(c, False))
    return x.select(f("src").alias("src"), "target_idx", f("tgt").alias("tgt"))
