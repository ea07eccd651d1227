"""Featurisation (F12-F19, F23, PF9-PF11).

Token ids come from a frequency-ranked vocabulary (A21) joined to the
exploded tokens; the join is an equi-join on the word, so vocabulary size
does not matter (AQE broadcasts it at runtime only when it is small).
Everything else is per-row array arithmetic inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convkit.functions import text as T

# Fixed special ids of our vocabulary (word ids start after them).
PAD_ID = 0
UNK_ID = 1
EOS_ID = 2
FIRST_WORD_ID = 3
IGNORE = -1


def vocab_ids(vocab: DataFrame) -> DataFrame:
    """(rank, word) -> (word, id)."""
    return vocab.select("word", (F.col("rank") + FIRST_WORD_ID - 1).cast("int").alias("id"))


def encode_texts(df: DataFrame, key: list[str], text_col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """whitespace tokens of each text -> ``out`` array<int> (unknown ->
    UNK_ID, no tokens -> []). ``key`` identifies a row.

    A text's words are looked up once each, with their places, so a frequent
    word of a text is one row of the join; the join is by word, and Spark
    splits the words that very many texts share."""
    w = df.select(*key, F.posexplode(T.words(text_col)).alias("pos", "word"))
    w = w.groupBy(*key, "word").agg(F.collect_list("pos").alias("at"))          # places in one text
    w = w.join(vocab_ids(vocab), "word", "left").select(*key, F.coalesce("id", F.lit(UNK_ID)).alias("id"), F.explode("at").alias("pos"))
    ids = w.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_p"))
    ids = ids.select(*key, F.transform("_p", lambda x: x["id"]).alias(out))
    return df.join(ids, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<int>")))


def flatten_eos(turn_ids, eos: int = EOS_ID) -> Column:
    """each turn + eos, then drop the last eos."""
    t = T._c(turn_ids)
    flat = F.flatten(F.transform(t, lambda a: F.concat(a, F.array(F.lit(eos)))))
    return F.slice(flat, 1, F.greatest(F.size(flat) - 1, F.lit(0)))


def feature_len_guard(turn_ids, max_len: int) -> Column:
    """PF9: True when a turn is longer than max_len or the running length
    of the earlier turns (each + 1 eos) exceeds it."""
    zero = F.struct(F.lit(0).alias("before"), F.lit(False).alias("over"))

    def step(acc, ids):
        return F.struct((acc["before"] + F.size(ids) + 1).alias("before"),
                        (acc["over"] | (F.size(ids) > max_len) | (acc["before"] > max_len)).alias("over"))

    return F.aggregate(T._c(turn_ids), zero, step, lambda acc: acc["over"])


def eval_features(context_ids, response_ids, max_len: int, eos: int = EOS_ID, context_len: Column | None = None) -> Column:
    """struct(input_ids, position_ids, token_type_ids, lm_labels,
    context_len, response_len) or NULL when there is no room.
    ``context_len``: length of the whole context where ``context_ids`` holds
    only the last tokens of it (``max_len`` of them, or all)."""
    c, r = T._c(context_ids), T._c(response_ids)
    size = F.size(c) if context_len is None else context_len
    n = size + F.size(r) + 2
    over = n > max_len
    cut_ctx = over & (size > n - max_len)
    drop = over & ~cut_ctx & (F.lit(max_len) - size - 2 < 0)
    c2 = F.when(cut_ctx, F.slice(c, F.size(c) - size + n - max_len + 1, F.size(c))).otherwise(c)
    r2 = F.when(over & ~cut_ctx, F.slice(r, 1, F.greatest(F.lit(max_len) - size - 2, F.lit(0)))).otherwise(r)
    ids = F.concat(c2, F.array(F.lit(eos)), r2, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(c2)), r2, F.array(F.lit(eos)), F.array(F.lit(IGNORE)))
    st = F.struct(ids.alias("input_ids"),
                  F.sequence(F.lit(0), F.size(ids) - 1).alias("position_ids"),
                  F.array_repeat(F.lit(0), F.size(ids)).alias("token_type_ids"),
                  labels.alias("lm_labels"), F.size(c2).alias("context_len"), F.size(r2).alias("response_len"))
    return F.when(~drop, st)


def left_truncate(arr, max_len: int) -> Column:
    """keep the last max_len entries."""
    a = T._c(arr)
    return F.when(F.size(a) > max_len, F.slice(a, -max_len, max_len)).otherwise(a)


def pad_to(arr, length, value: int, pad_end: bool = True) -> Column:
    """F15 helper: pad ``arr`` to ``length`` with ``value``."""
    a = T._c(arr)
    pad = F.array_repeat(F.lit(value), F.greatest(length - F.size(a), F.lit(0)))
    return F.concat(a, pad) if pad_end else F.concat(pad, a)


def strip_pad(arr, eos: int | None = None) -> Column:
    """F16: remove pad ids; optionally append eos."""
    a = F.array_remove(T._c(arr), PAD_ID)
    return F.concat(a, F.array(F.lit(eos))) if eos is not None else a


def concat_candidates(contexts: DataFrame, candidates: DataFrame, key: list[str], eos: int = EOS_ID) -> DataFrame:
    """every candidate of a context as ``input_ids``: context ids, eos,
    candidate ids, pads removed from both. ``contexts`` (key, context_ids) has
    one row per key, ``candidates`` (key, candidate_ids, ...) any number."""
    j = candidates.join(contexts, key)
    return j.withColumn("input_ids", F.concat(strip_pad("context_ids"), F.array(F.lit(eos)), strip_pad("candidate_ids"))).drop(
        "context_ids", "candidate_ids")


def reverse_turns(turn_ids, trailing_eos, eos: int = EOS_ID) -> Column:
    """a EOS b EOS c -> c EOS b EOS a; a trailing EOS stays trailing;
    a single turn without EOS gains a trailing one. Works on the turn array."""
    t = T._c(turn_ids)
    rev = F.reverse(t)
    body = flatten_eos(rev, eos)
    trail = F.coalesce(T._c(trailing_eos), F.lit(False)) | (F.size(t) == 1)
    return F.when(trail, F.concat(body, F.array(F.lit(eos)))).otherwise(body)


def last_turn_labels(ids, reversed_: bool = False, eos: int = EOS_ID) -> Column:
    """(inputs, labels) for the value model: inputs = ids[:-1];
    labels = -1 except the tokens of the last turn (or, reversed, all after
    the first EOS), shifted by one."""
    a = T._c(ids)
    n = F.size(a)
    if reversed_:
        start = F.array_position(a, eos)                               # 1-based first EOS
    else:
        ends = F.element_at(a, -1) == eos
        rv = F.reverse(a)
        p1 = F.array_position(rv, eos)                                  # last EOS from the end
        p2 = F.array_position(F.slice(rv, 2, n), eos) + 1               # second last when trailing
        from_end = F.when(ends, F.when(p2 > 1, p2).otherwise(F.lit(0))).otherwise(p1)
        start = F.when(from_end > 0, n - from_end + 1).otherwise(F.lit(0))
    # start = 1-based index of the EOS that opens the labelled span (0 = none)
    start = start.cast("int")
    labels = F.when(start == 0, F.slice(a, 2, F.greatest(n - 1, F.lit(0)))).otherwise(
        F.concat(F.array_repeat(F.lit(IGNORE), F.greatest(start - 1, F.lit(0))),
                 F.slice(a, start + 1, F.greatest(n - start, F.lit(0)))))
    return F.struct(F.slice(a, 1, F.greatest(n - 1, F.lit(0))).alias("inputs"), labels.alias("labels"))


def two_turn(turns) -> Column:
    """PF10: the last two turns."""
    t = T._c(turns)
    return F.when(F.size(t) > 2, F.slice(t, -2, 2)).otherwise(t)


def prompt_prefix(turns) -> Column:
    """PF11: the first three turns, but never the last one (n turns keep
    min(3, n - 1))."""
    t = T._c(turns)
    return F.slice(t, 1, F.least(F.lit(3), F.greatest(F.size(t) - 1, F.lit(0))))
