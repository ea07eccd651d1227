"""Batching (W5-W9, F15, A12, A19, A22, T6).

Orders that the original draws from a random generator are replaced by a
deterministic ``md5(seed || id)`` order, so a run is reproducible and
retried tasks produce the same rows. Windows are only partitioned by
bounded groups (a bucket, a batch, a chunk); global positions come from the
distributed helpers in ``ordering``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convkit.operators import features as FE
from convkit.operators.ordering import global_index


def shuffle_key(id_col, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def chunk_ids(df: DataFrame, order: list[Column], chunk_size: int = 65536) -> DataFrame:
    """chunk_id = row position // chunk_size (distributed numbering)."""
    r = global_index(df, order, "_i")
    return r.withColumn("chunk_id", F.floor(F.col("_i") / chunk_size)).drop("_i")


def bucket_batches(df: DataFrame, id_col: str, len_col: str, batch_size: int, bucket_size: int | None = None,
                   droplast: bool = False, seed: int = 42) -> DataFrame:
    """Shuffled rows cut into buckets of bucket_size (default 100 x
    batch), sorted by length desc inside a bucket, cut into batches;
    optionally short batches dropped; batch order shuffled."""
    bucket_size = bucket_size or 100 * batch_size
    r = global_index(df.withColumn("_h", shuffle_key(id_col, seed)), [F.col("_h"), F.col(id_col)], "_i")
    r = r.withColumn("bucket", F.floor(F.col("_i") / bucket_size))
    w = Window.partitionBy("bucket").orderBy(F.col(len_col).desc(), F.col("_i"))     # <= bucket_size rows
    r = r.withColumn("batch_in_bucket", F.floor((F.row_number().over(w) - 1) / batch_size))
    r = r.withColumn("batch_rows", F.count(F.lit(1)).over(Window.partitionBy("bucket", "batch_in_bucket")))
    if droplast:
        r = r.filter(F.col("batch_rows") == batch_size)
    r = r.withColumn("batch_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("bucket").cast("string"),
                                                   F.col("batch_in_bucket").cast("string"))))
    return r.drop("_h", "_i")


def same_len_batches(df: DataFrame, id_col: str, len_col: str, max_batch: int) -> DataFrame:
    """Rows grouped by length (ascending), each length cut into batches
    of <= max_batch. Position inside a length comes from a global index
    minus the length's first index, so one frequent length stays spread."""
    r = global_index(df, [F.col(len_col), F.col(id_col)], "_i")
    first = r.groupBy(len_col).agg(F.min("_i").alias("_f"))
    r = r.join(first, len_col)
    return (r.withColumn("batch_in_len", F.floor((F.col("_i") - F.col("_f")) / max_batch))
             .drop("_i", "_f"))


def pad_batches(df: DataFrame, batch_col: str, cols_pad: dict[str, int], pad_end: bool = True) -> DataFrame:
    """pad array columns to the longest array of the batch (ids 0,
    labels -1). A batch is bounded, so the window is too."""
    w = Window.partitionBy(batch_col)
    out = df
    for c, v in cols_pad.items():
        out = out.withColumn(c, FE.pad_to(c, F.max(F.size(c)).over(w), v, pad_end))
    return out


def class_weights(df: DataFrame, chunk_col: str, reward_col: str, exponent: float = 1.0) -> DataFrame:
    """Per chunk: weight per class = (1/count)^exponent and
    num_samples = round-half-even(sum of row weights / min class weight)."""
    cc = df.groupBy(chunk_col, reward_col).agg(F.count(F.lit(1)).alias("cnt"))
    cc = cc.withColumn("weight", F.pow(1.0 / F.col("cnt"), F.lit(exponent)))
    per_chunk = cc.groupBy(chunk_col).agg(
        F.bround(F.sum(F.col("cnt") * F.col("weight")) / F.min("weight"), 0).cast("long").alias("num_samples"))
    return cc.join(per_chunk, chunk_col)


def weighted_sample(df: DataFrame, chunk_col: str, id_col: str, weight_col: str, num_samples: DataFrame,
                    seed: int = 42) -> DataFrame:
    """Per chunk, num_samples draws with replacement, probability
    proportional to weight. A draw is a hash of (seed, chunk, draw) scaled to
    [0, 1), so a retried task draws the same rows. Draws and weight intervals
    are merged in one window per chunk (a chunk is bounded), no range join."""
    w = Window.partitionBy(chunk_col).orderBy(id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    iv = (df.withColumn("_hi", F.sum(weight_col).over(w))
            .withColumn("_lo", F.col("_hi") - F.col(weight_col)))
    tot = iv.groupBy(chunk_col).agg(F.max("_hi").alias("_tot"))
    # 52 bits of the digest
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(chunk_col).cast("string"), F.col("draw").cast("string")))
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    draws = (num_samples.select(chunk_col, F.explode(F.sequence(F.lit(1), F.col("num_samples"))).alias("draw"))
             .join(tot, chunk_col)
             .withColumn("_u", u * F.col("_tot")))
    ev = (iv.select(chunk_col, F.col("_lo").alias("_k"), F.lit(0).alias("_t"), F.col(id_col).alias("_id"),
                    F.lit(None).cast("long").alias("draw"))
          .unionByName(draws.select(chunk_col, F.col("_u").alias("_k"), F.lit(1).alias("_t"),
                                    F.lit(None).cast(df.schema[id_col].dataType).alias("_id"), "draw")))
    wf = Window.partitionBy(chunk_col).orderBy("_k", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("_pick", F.last("_id", ignorenulls=True).over(wf))
    return ev.filter(F.col("_t") == 1).select(chunk_col, "draw", F.col("_pick").alias(id_col))


def exponents(epochs: int, decrease: float) -> list[float]:
    """Exponent of each epoch; starts at 1 and falls to 0."""
    out = [1.0]
    while len(out) < epochs:
        out.append(max(out[-1] - decrease, 0.0))
    return out[:epochs]


def weighted_epochs(df: DataFrame, chunk_col: str, id_col: str, class_col: str, len_col: str, epochs: int, decrease: float,
                    batch_size: int, bucket_size: int | None = None, seed: int = 42) -> DataFrame:
    """A12, W8 and W5 over several epochs: (epoch, chunk, draw, id, bucket,
    batch_in_bucket, batch_key).

    Per epoch and chunk, class weights by the epoch's exponent give the number
    of draws; these are cut into buckets in drawn order, sorted by length
    (longest first), cut into batches, and short batches are dropped. Rows of
    a class weigh the same, so a draw is a class and a row number in it: no
    interval per row. A chunk is bounded and shuffled once; everything after
    that keeps its partitioning. Draws are hashes, as in weighted_sample.
    Rows of a null class are a class of their own, the first one."""
    bucket_size = bucket_size or 100 * batch_size
    chunk = F.col(chunk_col)
    member = F.struct(F.col(id_col).alias("id"), F.col(len_col).cast("long").alias("len"))
    cls = df.repartition(chunk).groupBy(chunk_col, class_col).agg(F.sort_array(F.collect_list(member)).alias("rows"),
                                                                   F.count(F.lit(1)).alias("cnt"))
    plan = F.array(*[F.struct(F.lit(i).alias("epoch"), F.lit(x).alias("exponent")) for i, x in enumerate(exponents(epochs, decrease))])
    cls = cls.select(chunk_col, class_col, "rows", "cnt", F.explode(plan).alias("p")).select(
        chunk_col, class_col, "rows", "cnt", "p.epoch", F.pow(1.0 / F.col("cnt"), F.col("p.exponent")).alias("w"))
    upto = Window.partitionBy(chunk_col, "epoch").orderBy(class_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cls = cls.withColumn("hi", F.sum(F.col("cnt") * F.col("w")).over(upto))
    per = cls.groupBy(chunk_col, "epoch").agg(
        F.sort_array(F.collect_list(F.struct("hi", "w", "cnt", "rows"))).alias("classes"), F.max("hi").alias("total"), F.min("w").alias("least"))
    h = lambda d: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), chunk.cast("string"), d.cast("string")))
    point = lambda d: F.conv(F.substring(h(d), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) * F.col("total")
    seq = F.sequence(F.lit(1).cast("long"), F.bround(F.col("total") / F.col("least"), 0).cast("long"))
    at = F.transform(seq, lambda d: F.struct(d.alias("draw"), point(d).alias("x")))
    at = F.transform(at, lambda s: F.struct(
        s["draw"].alias("draw"), s["x"].alias("x"),
        F.coalesce(F.get(F.filter("classes", lambda c: c["hi"] > s["x"]), F.lit(0)), F.element_at("classes", -1)).alias("c")))
    place = lambda s: F.floor((s["x"] - (s["c"]["hi"] - s["c"]["cnt"] * s["c"]["w"])) / s["c"]["w"])
    at = F.transform(at, lambda s: F.struct(s["draw"].alias("draw"), F.get(
        s["c"]["rows"], F.greatest(F.least(place(s), s["c"]["cnt"] - 1), F.lit(0)).cast("int")).alias("row")))
    d = per.select("epoch", chunk_col, F.explode(at).alias("d")).select(
        "epoch", chunk_col, "d.draw", F.col("d.row.id").alias(id_col), F.col("d.row.len").alias("_len"))
    d = d.withColumn("bucket", F.floor((F.col("draw") - 1) / bucket_size))
    w = Window.partitionBy(chunk_col, "epoch", "bucket").orderBy(F.col("_len").desc(), "draw")           # <= bucket_size rows
    d = d.withColumn("batch_in_bucket", F.floor((F.row_number().over(w) - 1) / batch_size))
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(chunk_col, "epoch", "bucket", "batch_in_bucket")))
    d = d.filter(F.col("_n") == batch_size).drop("_n", "_len")
    names = [F.col(c).cast("string") for c in ("epoch", chunk_col, "bucket", "batch_in_bucket")]
    return d.withColumn("batch_key", F.md5(F.concat_ws("|", F.lit(str(seed)), *names)))


def rank_slice(df: DataFrame, chunk_col: str, rank: int, world: int) -> DataFrame:
    """Chunks rank::world."""
    return df.filter(F.pmod(F.col(chunk_col), F.lit(world)) == rank)


def padding_ratio(df: DataFrame, batch_col: str, len_col: str) -> DataFrame:
    """Real tokens vs rows x batch max length, per batch and overall."""
    b = df.groupBy(batch_col).agg(F.sum(len_col).alias("real_tokens"),
                                  (F.count(F.lit(1)) * F.max(len_col)).alias("padded_tokens"))
    return b


def batch_count(df: DataFrame, batch_size: int, bucket_col: str | None = None, droplast: bool = False) -> DataFrame:
    """Rows and batches per epoch (optionally per bucket, with or
    without short batches)."""
    if bucket_col is None:
        return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
            "batches", F.ceil(F.col("rows") / batch_size).cast("long"))
    per = df.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("_n"))
    nb = F.floor(F.col("_n") / batch_size) if droplast else F.ceil(F.col("_n") / batch_size)
    return per.agg(F.sum("_n").alias("rows"), F.sum(nb).cast("long").alias("batches"))


def last_batches(df: DataFrame, batch_cols: list[str], n: int = 30) -> DataFrame:
    """Rows of the last n batches (a top-n over batch ids is the feature)."""
    last = df.select(*batch_cols).distinct().orderBy(*[F.col(c).desc() for c in batch_cols]).limit(n)
    return df.join(F.broadcast(last), batch_cols, "left_semi")
