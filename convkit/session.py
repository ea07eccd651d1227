"""Session helper.

Cluster settings (checkpoint dir, shuffle partitions, executor memory) are
taken from the session when the cluster provides them; local defaults are
only applied when a setting is unset, e.g. in tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the session does not already define them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # text stages are CPU-bound per byte; keep small shuffles spread out
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "convkit", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # static settings can only go in before the context exists
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    for k, v in _DEFAULTS.items():
        if k != "spark.ui.enabled" and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system path set by its operator:
    without one this raises. Only a local session (tests) gets a scratch
    folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="convkit-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediates."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name


_stages: list[str] = []


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a stage boundary that is scanned once by every later consumer
    (instead of re-running the lineage per consumer) and survives executor
    loss. :func:`release_stages` deletes what was written."""
    path = scratch_path(df.sparkSession, f"{tag}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    _stages.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> int:
    """Delete every stage written so far, once nothing reads them any more;
    returns how many there were."""
    n = len(_stages)
    while _stages:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stages.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n
