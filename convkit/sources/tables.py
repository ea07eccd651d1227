"""Parquet table access for the driver-provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Text-heavy tables and a key that spreads them without a hot value: when a
# table lies in fewer files than there are task slots, its row groups would be
# worked on in as few tasks. Only the list of files is looked at; a table of
# many files is read as it lies. Results don't depend on it.
SPREAD_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"],
               "events": ["event_id"], "pages": ["page_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    if name in SPREAD_KEYS and len(df.inputFiles()) < slots:
        return df.repartition(slots, *SPREAD_KEYS[name])
    return df
