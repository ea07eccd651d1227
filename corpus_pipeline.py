"""The corpus pipeline over ``documents``.

Toxic documents go, documents of low quality go, one document of each
near-duplicate class stays, documents that hold a benchmark passage go, and
the rest is encoded with the byte-level BPE vocabulary. Every stage but the
last returns the columns of ``documents``; each result is written as Parquet
in the shared checkpoint folder and reread as the next stage's input.

Defined results: rows pass with all their columns as they are, whatever the
columns are called; null and empty texts are judged as empty (not toxic, no
benchmark passage, the quality that the rules give an empty text) and are exact
copies of one another; of repeated rows and of rows without id one stays, as of
any class; where rows tie, the least doc_id stays (none comes first); an empty
table gives empty stages. Without labels of both classes nothing is rejected
by that label, unless all labels reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convkit.llm import decontaminate, near_dedup, rule_ensemble, toxicity
from convkit.llm.catalog import bpe_round_trip
from convkit.llm.stages import documents, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "labels").where(~rule_ensemble.held_out(F.col("doc_id")))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    toxic = toxicity.rejects(spark, toxicity.train(docs, _labels(spark, sf_dir)))
    return docs.where(~toxic(F.col("text")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.accepted(docs, rule_ensemble.fit(docs, _labels(spark, sf_dir)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_round_trip(docs.select("doc_id", "text"))


#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: The stages learn models and hash texts: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
