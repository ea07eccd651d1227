"""Positions and running sums over a total order of all rows.

A window without ``partitionBy`` moves every row into one task. Here Spark
range-partitions the rows (``repartitionByRange``), each range is sorted and
written once to the shared folder with its rows numbered, and the totals of
the earlier ranges are added: a table of one row per range, so its broadcast
is bounded by the number of ranges. The written copy fixes the ranges, so
later reads and retried tasks see the same ones.

Order columns must be unique together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convkit.session import materialize

_RANGE = "shiftright(_mid, 33)"         # monotonically_increasing_id: range, then place in it


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` written range by range, with ``_mid`` numbering each range's rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(d.withColumn("_mid", F.monotonically_increasing_id()), "ranged")


def _with_totals(r: DataFrame, value: Column, exclusive: Column, name: str) -> DataFrame:
    """``exclusive`` plus the sum of ``value`` over all earlier ranges."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)        # one row per range
    off = r.groupBy(F.expr(_RANGE).alias("_p")).agg(F.sum(value).alias("_t"))
    off = off.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    x = r.withColumn("_p", F.expr(_RANGE)).join(F.broadcast(off), "_p")
    return x.withColumn(name, F.col("_off") + exclusive)


def global_cumsum(df: DataFrame, order: list[Column], value: Column, name: str,
                  inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` over the total order ``order``."""
    r = _ranged(df.withColumn("_v", value.cast("long")), order)
    w = Window.partitionBy(F.expr(_RANGE)).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.sum("_v").over(w)
    r = r.withColumn("_loc", local if inclusive else local - F.col("_v"))
    return _with_totals(r, F.col("_v"), F.col("_loc"), name).drop("_p", "_v", "_loc", "_off", "_mid")


def global_index(df: DataFrame, order: list[Column], name: str = "row_idx") -> DataFrame:
    """0-based position of each row in the total order ``order``."""
    r = _ranged(df, order)
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return _with_totals(r, F.lit(1), place, name).drop("_p", "_off", "_mid")


def keyed_index(df: DataFrame, key: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """0-based position inside each key: the global position less that of the
    key's first row, so a key with a third of all rows stays spread over many
    ranges (a window per key would put it in one task)."""
    r = global_index(df, [F.col(k) for k in key] + order, "_place")
    first = r.groupBy(*key).agg(F.min("_place").alias("_first"))
    return r.join(first, key).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")


def keyed_cumsum(df: DataFrame, key: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key. A key may span
    many ranges: its rows are summed range by range, and a range takes over
    the totals of its first key from the ranges before it. That is one row
    per range at most, so the broadcast is bounded; nulls are a key."""
    r = _ranged(df.withColumn("_v", value.cast("long")), [F.col(k) for k in key] + order).withColumn("_p", F.expr(_RANGE))
    w = Window.partitionBy("_p", *key).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = r.withColumn("_loc", F.sum("_v").over(w) - F.col("_v"))
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)      # one row per range of a key
    carry = r.groupBy("_p", *key).agg(F.sum("_v").alias("_t")).withColumn("_off", F.sum("_t").over(before))
    carry = carry.filter(F.col("_off").isNotNull()).select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_off")
    cond = F.col("_p") == F.col("_q")
    for i, k in enumerate(key):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(F.broadcast(carry), cond, "left").withColumn(name, F.col("_loc") + F.coalesce("_off", F.lit(0)))
    return out.drop("_p", "_v", "_loc", "_off", "_mid", "_q", *[f"_k{i}" for i in range(len(key))])
