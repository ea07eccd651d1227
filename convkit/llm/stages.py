"""Written stages in the shared folder, and connected components on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convkit.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read
    back: later reads don't run its lineage again, and lost executors lose
    nothing of it."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a written stage that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table. Texts go to Python in Arrow batches of a few MB from here on
    (Spark's default of 64 MB is held several times over in each task); a
    session that has set a size of its own keeps it."""
    if spark.conf.get(ARROW_BYTES) == "67108864b":
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an undirected edge list; the
    component is the least node of it.

    Every round, each node points to its least neighbour (or itself) and the
    edges are contracted to the nodes pointed at. Nodes are hashes, so about
    a third of them or fewer remain each time and the rounds grow with the
    logarithm of the number of nodes. Each round is a few shuffles of
    two-column rows and is written, so no lineage builds up; sums and minima
    are pre-aggregated before the shuffle, so a node with very many edges
    isn't gathered in one task.
    """
    def both(e):
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    label = None
    while True:
        step = both(e).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # two hops of pointers
        hop = step.alias("x").join(step.select(F.col("u").alias("m"), F.col("m").alias("mm")), "m", "left")
        step = written(hop.select("u", F.coalesce("mm", "m").alias("m")), "pointers")
        if label is None:
            new = step.select(F.col("u").alias("node"), F.col("m").alias("component"))
        else:
            new = (label.join(step.withColumnRenamed("u", "component"), "component", "left")
                        .select("node", F.coalesce("m", "component").alias("component")))
        old, label = label, written(new, "labels")
        nxt = (e.join(step.select("u", F.col("m").alias("u2")), "u").join(step.select(F.col("u").alias("v"), F.col("m").alias("v2")), "v")
                .where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct())
        nxt = written(nxt, "edges")
        for d in (old, step, e):
            if d is not None:
                drop(d)
        e = nxt
        if e.isEmpty():
            drop(e)
            return label
