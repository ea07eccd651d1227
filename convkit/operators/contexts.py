"""Contexts as ranges of token offsets (W3, F12, F13, PF9 without copies).

Unrolled rows hold every earlier turn of a conversation, so they grow with
the square of its length. Features need far less: an evaluation row keeps the
last ``max_len`` tokens of its context, and a training row is rejected once
the turns before its response are longer than that. Here each turn is stored
once, with the number of tokens before it; a context is the range of offsets
before its response, and only the part that features keep is put together.

Turns of a conversation are cut into blocks of offsets. A turn goes to the
block where the next one starts and, where a later response can still reach
back to it, to the one after, so each turn is copied twice at most and a
conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convkit.operators import features as FE
from convkit.operators.ordering import keyed_cumsum


def turn_offsets(turns: DataFrame, key: str = "conv_id", order: str = "turn", ids: str = "ids") -> DataFrame:
    """``turns`` with ``n_tok`` and ``start``: the tokens of the earlier turns
    of its conversation, each with its end of turn. Null ids count as none;
    ``key`` and ``order`` are unique together."""
    t = turns.withColumn(ids, F.coalesce(ids, F.array().cast("array<int>")))
    t = t.withColumn("n_tok", F.size(ids).cast("long"))
    return keyed_cumsum(t, [key], [F.col(order)], F.col("n_tok") + 1, "start")


def context_tails(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", ids: str = "ids",
                  eos: int = FE.EOS_ID, block: int | None = None) -> DataFrame:
    """(key, order, response_ids, context_ids, context_len) of every turn but a
    conversation's first: ``context_len`` tokens stand before it (turns joined
    by ``eos``), ``context_ids`` are the last ``budget`` of them at most."""
    block = max(block or 8 * budget, budget + 1)
    x = turn_offsets(turns, key, order, ids)
    end = F.col("start") + F.col("n_tok") + 1
    part = "array<int>"

    def row(at, k, response, arr):
        return F.struct(F.floor(at / block).alias("block"), k.alias("k"), F.lit(response).alias("response"), arr.cast(part).alias("part"))

    tail = FE.left_truncate(ids, budget)
    rows = F.concat(F.array(row(F.col("start"), F.col("start"), True, F.col(ids))),
                    F.transform(F.array_distinct(F.array(F.floor(end / block), F.floor((end + budget) / block))),
                                lambda b: F.struct(b.alias("block"), end.alias("k"), F.lit(False).alias("response"), tail.cast(part).alias("part"))))
    e = x.select(key, order, F.explode(rows).alias("r")).select(key, order, "r.*")
    # the turns whose end (or end of turn) lies within the last ``budget`` tokens before the response
    w = Window.partitionBy(key, "block").orderBy("k").rangeBetween(-budget, 0)
    e = e.withColumn("_c", F.collect_list(F.when(~F.col("response"), F.struct("k", "part"))).over(w))
    e = e.filter(F.col("response") & (F.col("k") > 0))
    flat = F.flatten(F.transform(F.array_sort("_c"), lambda c: F.concat(c["part"], F.array(F.lit(eos)))))
    e = e.select(key, order, F.col("part").alias("response_ids"), flat.alias("_f"), (F.col("k") - 1).cast("int").alias("context_len"))
    ctx = F.slice("_f", 1, F.size("_f") - 1)
    return e.select(key, order, "response_ids", FE.left_truncate(ctx, budget).alias("context_ids"), "context_len")


def eval_rows(turns: DataFrame, max_len: int, key: str = "conv_id", order: str = "turn", ids: str = "ids") -> DataFrame:
    """F13 of every unrolled row, from context tails: (key, order, e), rows
    without room left out."""
    t = context_tails(turns, max_len, key, order, ids)
    e = FE.eval_features("context_ids", "response_ids", max_len, context_len=F.col("context_len"))
    return t.select(key, order, e.alias("e")).filter(F.col("e").isNotNull())


def guarded_rows(turns: DataFrame, max_len: int, key: str = "conv_id", order: str = "turn", ids: str = "ids",
                 eos: int = FE.EOS_ID) -> DataFrame:
    """F12 of the unrolled rows that PF9 keeps: (key, order, input_ids).

    A row is rejected for good once ``max_len`` tokens stand before its
    response, so at most ``max_len`` + 1 turns of a conversation take part."""
    x = turn_offsets(turns, key, order, ids).filter(F.col("start") <= max_len)
    w = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_longest", F.max("n_tok").over(w))
    short = F.when(F.col("n_tok") <= max_len, F.struct("start", F.col(ids).alias("part")))
    x = x.withColumn("_t", F.collect_list(short).over(w)).filter((F.col("_longest") <= max_len) & (F.col("start") > 0))
    return x.select(key, order, FE.flatten_eos(F.transform(F.array_sort("_t"), lambda c: c["part"]), eos).alias("input_ids"))
