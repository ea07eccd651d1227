"""N-gram statistics.

All statistics come from one explode of every n-gram order at once and a
two-level aggregate; partial (map-side) aggregation collapses hot n-grams
before the shuffle. No ``collect_list`` of n-grams anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convkit.functions import text as T
from convkit.functions.ngrams import tagged_ngrams
from convkit.operators.ordering import global_index


def ngram_counts(df: DataFrame, text_col: str = "text", max_n: int = 4, keys=(), tokeniser: T.Tokeniser = T.words) -> DataFrame:
    """A1: (keys..., n, ngram, cnt) over whitespace tokens, or those of ``tokeniser``."""
    t = df.select(*keys, tokeniser(F.col(text_col)).alias("_tok"))
    x = t.select(*keys, F.explode(tagged_ngrams("_tok", max_n)).alias("_x"))
    return (x.groupBy(*keys, F.col("_x.n").alias("n"), F.col("_x.g").alias("ngram"))
             .agg(F.count(F.lit(1)).alias("cnt")))


def ngram_entropy(counts: DataFrame, keys=(), eps: float = 0.0) -> DataFrame:
    """A2: -sum(v/T * (ln v - ln T)) per n, i.e. ln T - sum(v ln v)/T.
    ``eps`` is added to T (the validation variant uses 1e-10)."""
    g = counts.groupBy(*keys, "n").agg(F.sum("cnt").alias("_t"),
                                       F.sum(F.col("cnt") * F.log(F.col("cnt"))).alias("_s"))
    tot = F.col("_t") + F.lit(eps)
    ent = -(F.col("_s") / tot - F.col("_t") / tot * F.log(tot))
    return g.select(*keys, "n", ent.alias("entropy"))


def distinct_n(counts: DataFrame, keys=(), eps: float = 0.0) -> DataFrame:
    """A3: distinct n-grams / n-gram tokens per n."""
    return (counts.groupBy(*keys, "n")
                  .agg((F.count(F.lit(1)) / (F.sum("cnt") + F.lit(eps))).alias("distinct")))


def distinct_sketch(df: DataFrame, text_col: str = "text", max_n: int = 4, keys=(), lg_k: int = 14,
                    tokeniser: T.Tokeniser = T.words) -> DataFrame:
    """A3 without a shuffle of n-grams: (keys..., n, tokens, sketch), one
    HyperLogLog sketch of the distinct n-grams per key and n. Sketches of
    months (or any parts) merge; the relative error is about 0.8 / 2^(lg_k/2)."""
    x = df.select(*keys, tokeniser(F.col(text_col)).alias("_tok")).select(*keys, F.explode(tagged_ngrams("_tok", max_n)).alias("_x"))
    return x.groupBy(*keys, F.col("_x.n").alias("n")).agg(F.count(F.lit(1)).alias("tokens"), F.hll_sketch_agg("_x.g", lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys=()) -> DataFrame:
    """Sketches of parts as those of their union, per remaining key and n."""
    return sketches.groupBy(*keys, "n").agg(F.sum("tokens").alias("tokens"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_of(sketches: DataFrame) -> DataFrame:
    """(..., n, distinct): estimated distinct-n of every sketch."""
    return sketches.withColumn("distinct", F.hll_sketch_estimate("sketch") / F.col("tokens")).drop("sketch", "tokens")


def avg_len(df: DataFrame, text_col: str = "text", keys=()) -> DataFrame:
    """A4: mean whitespace tokens per line."""
    return df.groupBy(*keys).agg(F.avg(F.size(T.words(text_col))).alias("avg_len"))


def vocab(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Words ranked by corpus frequency (ties by word); rank from 1."""
    c = (df.select(F.explode(T.words(text_col)).alias("word"))
           .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))
    r = global_index(c, [-F.col("cnt"), F.col("word")], "_i")
    return r.select((F.col("_i") + 1).alias("rank"), "word", "cnt")
