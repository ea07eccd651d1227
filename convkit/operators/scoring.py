"""Scoring tables.

All per-key computations are partial aggregates (hot keys collapse before
the shuffle) or skew-safe keyed prefix sums; history windows are cut into
bounded blocks with a halo instead of one window per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convkit.operators.ordering import keyed_index

# Fixed scoring constants.
ALPHA = 0.5
BETA = 0.5
HISTORY_BUDGET = 64


def rerank_best(c: DataFrame, alpha: float = ALPHA, beta: float = BETA, use_q: bool = True) -> DataFrame:
    """Best candidate per context; ties -> lowest candidate id."""
    mix = F.lit(alpha) * F.col("fwd_loss") + F.lit(1 - alpha) * F.col("rev_loss")
    score = -mix
    if use_q:
        score = F.when(F.col("q_value").isNotNull(), F.lit(beta - 1) * mix + F.lit(beta) * F.col("q_value")).otherwise(-mix)
    s = c.withColumn("score", score)
    best = F.max_by(F.struct("cand_id", "score"), F.struct(F.col("score"), -F.col("cand_id")))
    return s.groupBy("context_id").agg(best.alias("_b")).select(
        "context_id", F.col("_b.cand_id").alias("cand_id"), F.col("_b.score").alias("score"))


def value_class(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v < -1.0 / 3, F.lit(1)).when(v > 1.0 / 3, F.lit(2)).otherwise(F.lit(0))


def macro_f1(df: DataFrame, keys=(), pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Three-way macro F1 over labels present in truth or prediction,
    plus mean absolute error of the raw values."""
    keys = list(keys)
    d = df.select(*keys, value_class(pred).alias("p"), value_class(truth).alias("t"),
                  F.abs(F.col(pred) - F.col(truth)).alias("ae"))
    conf = d.groupBy(*keys, "t", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("ae").alias("sae"))
    tp = conf.filter(F.col("t") == F.col("p")).groupBy(*keys, F.col("t").alias("c")).agg(F.sum("n").alias("tp"))
    pc = conf.groupBy(*keys, F.col("p").alias("c")).agg(F.sum("n").alias("np"), F.sum("sae").alias("_sae"))
    tc = conf.groupBy(*keys, F.col("t").alias("c")).agg(F.sum("n").alias("nt"))
    per = pc.join(tc, [*keys, "c"], "full").join(tp, [*keys, "c"], "left").na.fill(0, ["tp", "np", "nt", "_sae"])
    p = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(F.lit(0.0))
    r = F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    # every row is counted once under its predicted class, so the class
    # rows also carry the absolute-error total: one aggregate, no join
    return per.groupBy(*keys).agg(F.avg(f).alias("macro_f1"), (F.sum("_sae") / F.sum("np")).alias("mae"))


def corpus_ppl(tl: DataFrame, keys=()) -> DataFrame:
    """Token-weighted loss and perplexity = exp(mean over sequences of
    the per-sequence mean loss); labels -1 are ignored."""
    t = tl.filter(F.col("label") != -1)
    seq = t.groupBy(*keys, "batch_id", "seq_id").agg(F.sum("loss").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return seq.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("loss"),
                                  F.exp(F.avg(F.col("_s") / F.col("_n"))).alias("ppl"))


def checkpoint_eval(values: DataFrame, losses: DataFrame) -> DataFrame:
    """Per checkpoint step, macro F1 and MAE of the value predictions
    (step, pred, truth) beside loss and perplexity of the token losses (step,
    batch_id, seq_id, loss, label); a step may lack either half."""
    return macro_f1(values, keys=["step"]).join(corpus_ppl(losses, keys=["step"]), "step", "full")


def checkpoint_step(name_col) -> Column:
    """Integer step from a checkpoint file name."""
    return F.regexp_extract(F.col(name_col), r"step-(\d+)", 1).cast("long")


def history_final(msgs: DataFrame, budget: int = HISTORY_BUDGET) -> DataFrame:
    """W4 (final state): per uid, the longest suffix of non-empty messages
    whose tokens (each + 1 eos) fit the budget; the newest message is kept
    even when it alone exceeds it. Users with empty messages only keep a lone
    EOS (n_kept 0, 1 token).

    Every message costs a token at least, so the newest ``budget`` messages
    decide; that limit is applied before the shuffle, and no task gets more
    than that of a very active user."""
    m = msgs.withColumn("_empty", F.coalesce("text", F.lit("")) == "")
    w = Window.partitionBy("uid").orderBy("_empty", F.col("ts").desc())
    m = m.withColumn("_ri", F.row_number().over(w)).filter(F.col("_ri") <= budget)
    m = m.withColumn("_rs", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    keep = ~F.col("_empty") & ((F.col("_rs") <= budget) | (F.col("_ri") == 1))
    return m.groupBy("uid").agg(F.min(F.when(keep, F.col("ts"))).alias("from_ts"), F.count_if(keep).alias("n_kept"),
                                F.coalesce(F.sum(F.when(keep, F.col("n_tokens"))), F.lit(1)).cast("long").alias("tokens"))


def history_window(msgs: DataFrame, budget: int = HISTORY_BUDGET, block: int = 4096) -> DataFrame:
    """For every message (as newest), how many preceding messages fit
    the budget together with it (at least itself).

    Each message costs >= 1 token, so at most ``budget`` messages fit: the
    per-user sequence is cut into blocks of ``block`` rows and each block
    gets a halo of the previous ``budget`` rows, so windows are bounded and
    one very active user is spread over many tasks."""
    block = max(block, 2 * budget)        # the halo must come from one block
    m = msgs.filter(F.col("text") != "")
    m = keyed_index(m, ["uid"], [F.col("ts")], "_i")
    m = m.withColumn("_blk", F.floor(F.col("_i") / block))
    halo = m.filter(F.col("_i") % block >= block - budget).withColumn("_blk", F.col("_blk") + 1).withColumn("_own", F.lit(False))
    x = m.withColumn("_own", F.lit(True)).unionByName(halo)
    w = Window.partitionBy("uid", "_blk").orderBy("_i").rowsBetween(-budget, 0)
    x = x.withColumn("_prev", F.reverse(F.collect_list("n_tokens").over(w)))
    # running sums from the newest backwards; count how many stay within budget
    fit = F.aggregate(F.slice("_prev", 2, budget), F.struct(F.col("n_tokens").cast("long").alias("s"), F.lit(1).alias("k"),
                                                            F.lit(True).alias("go")),
                      lambda acc, v: F.when(acc["go"] & (acc["s"] + v <= budget),
                                            F.struct((acc["s"] + v).alias("s"), (acc["k"] + 1).alias("k"), F.lit(True).alias("go")))
                                      .otherwise(F.struct(acc["s"].alias("s"), acc["k"].alias("k"), F.lit(False).alias("go"))))
    x = x.filter("_own").withColumn("_fit", fit)
    return x.select("uid", "ts", F.col("_fit.k").alias("n_kept"), F.col("_fit.s").alias("tokens"))
