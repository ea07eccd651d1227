"""The extract stage as bucketed tables (IO3) that the joins of the
conversation stage share.

Admitted comments and submissions are bucketed by thread (``link_id``), so the
metadata join (J2), the leaf test (J5) and every level of the ancestor chain
(J3) find both sides in the same bucket: the chain shuffles nothing, however
large the tables are. A comment and its parent always share a thread.

A bucket is one task, so threads that would overfill one stay out: those with
more comments than an average bucket holds, fewer than there are buckets. They
lie in a part of their own, whose joins go by the unique comment names; only
their submissions are broadcast, at most one a hot thread and month.

Spark shuffles both sides of a join on (month, link_id, name) again unless
``spark.sql.requireAllClusterKeysForCoPartition`` is off. The result therefore
belongs to a session of its own with the settings of the caller's and that one
off, and the caller's session stays as it is.

Defined results: those of :func:`threads.kept_pairs` on the same rows, whatever
the number of buckets; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convkit.operators import threads as TH
from convkit.session import materialize, scratch_path
from convkit.sources import files as IO

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass
class Extract:
    """Bucketed comments and submissions, the hot threads' parts (None where
    there are none), the tables' names and folders, and the parts' folders."""
    comments: DataFrame
    subs: DataFrame
    hot_comments: DataFrame | None
    hot_subs: DataFrame | None
    tables: dict[str, str]
    folders: list[str]


def co_partitioned(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose joins accept buckets of a part of their keys."""
    child = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if child.conf.isModifiable(k):
            child.conf.set(k, v)
    child.conf.set(CO_PARTITION, "false")
    return child


def hot_threads(comments: DataFrame, buckets: int) -> DataFrame:
    """(link_id) of the threads with more than 1 / ``buckets`` of all comments:
    fewer than ``buckets`` rows. Counts are pre-aggregated, and only the thread ids are read."""
    return (comments.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") * buckets > F.lit(comments.count())).select("link_id"))


def write(comments: DataFrame, subs: DataFrame, buckets: int | None = None) -> Extract:
    """Write what the extract stage admitted (both frames already written, as
    they are read more than once) as bucketed tables in the shared folder."""
    spark = comments.sparkSession
    child = co_partitioned(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(hot_threads(comments, buckets), "hot-threads")
    few = F.broadcast(hot)                                  # fewer rows than buckets
    tables, folders = {}, []
    for tag, df, key in [("comments", comments.join(few, "link_id", "left_anti"), "link_id"), ("subs", subs, "sid")]:
        name = f"convkit_{tag}_{uuid.uuid4().hex[:12]}"
        tables[name] = scratch_path(spark, name)
        IO.write_extract(df, tables[name], buckets=buckets, by=key, table=name)
    c, s = [child.table(t) for t in tables]
    if hot.isEmpty():
        return Extract(c, s, None, None, tables, [])
    parts = []
    for tag, df, key in [("comments", comments, "link_id"), ("subs", subs, "sid")]:
        path = scratch_path(spark, f"hot-{tag}-{uuid.uuid4().hex[:12]}")
        df.join(F.broadcast(hot.withColumnRenamed("link_id", key)), key, "left_semi").write.parquet(path)
        parts.append(child.read.schema(df.schema).parquet(path).select(*df.columns))
        folders.append(path)
    return Extract(c, s, *parts, tables, folders)


def kept_pairs(extract: Extract, **kw) -> DataFrame:
    """L1 from bucketed tables: (month, sid, pid, cid, context, response)."""
    out = TH.kept_pairs(extract.comments, extract.subs, **kw)
    if extract.hot_comments is None:
        return out
    return out.unionByName(TH.kept_pairs(extract.hot_comments, F.broadcast(extract.hot_subs), **kw))


def drop(extract: Extract) -> None:
    """Delete what :func:`write` wrote once nothing reads them any more."""
    spark = extract.comments.sparkSession
    sc = spark.sparkContext
    for name in extract.tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in [*extract.tables.values(), *extract.folders]:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
