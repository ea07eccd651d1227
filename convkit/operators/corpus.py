"""Corpus refinement and assembly: W1-W3, A5, A6, A13, J8, J12, S1, S2,
PF12, PF13."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from convkit.functions import text as T
from convkit.functions.ngrams import ngrams
from convkit.operators.ordering import global_cumsum
from convkit.operators.threads import last_wins

# Emotion weights of the reward, and the emotion code table.
EMOTION_REWARD = {"HAPPINESS": 1, "ANGER": -1, "DISGUST": -1, "FEAR": -1,
                  "NEUTRAL": 0, "SADNESS": -1, "SURPRISE": 0}
EMOTION_CODES = {10001: "Happiness", 10002: "Anger", 10003: "Disgust", 10004: "Fear",
                 10005: "Neutral", 10006: "Sadness", 10007: "Surprise"}
BLAND_TOP = 10000
BLAND_RATIO = 0.9


# --- W1 / W2 ---------------------------------------------------------------

def segment_conversations(rows: DataFrame) -> DataFrame:
    """Rows (file_no, row_no, marker, text) -> conversation ids.

    A marker 'S' opens a conversation, rows before a file's first 'S' are
    ignored, a file's end closes its last conversation and ids continue
    across files (file order); a file without any 'S' still uses up an id.
    The running count of markers is a distributed prefix sum, so one huge
    file does not land in one task."""
    r = global_cumsum(rows, [F.col("file_no"), F.col("row_no")],
                      (F.col("marker") == "S").cast("long"), "_seg")
    files = rows.groupBy("file_no").agg(F.count_if(F.col("marker") == "S").alias("_n"),
                                        F.min(F.when(F.col("marker") == "S", F.col("row_no"))).alias("_first"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)       # one row per file
    files = files.withColumn("_skipped", F.coalesce(F.sum((F.col("_n") == 0).cast("long")).over(before), F.lit(0)))
    r = r.join(files, "file_no").filter(F.col("row_no") >= F.col("_first"))
    return r.select("file_no", "row_no", (F.col("_seg") - 1 + F.col("_skipped")).alias("conv_id"), "text")


def split_of(id_col, lines: bool = False):
    """Conversations 0 -> test, 1 -> valid; lines 0 -> valid, 1 -> test."""
    m = F.pmod(T._c(id_col), F.lit(10))
    a, b = ("valid", "test") if lines else ("test", "valid")
    return F.when(m == 0, F.lit(a)).when(m == 1, F.lit(b)).otherwise(F.lit("train"))


# --- W3 --------------------------------------------------------------------

def unroll_turns(turns: DataFrame, cols: list[str], key: str = "conv_id", order: str = "turn", first: int = 2) -> DataFrame:
    """One row per response (the ``first``-th turn on) with the array
    ``turns`` of all turns up to it, each a struct of ``cols``.

    The output holds every earlier turn per row, quadratic in the length of a
    conversation as in the original; the turns of one conversation are
    gathered once, and each response takes its own slice."""
    g = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias("_all"))
    x = g.select(key, "_all", F.posexplode("_all").alias("_i", "_x")).filter(F.col("_i") >= first - 1)
    return x.select(key, F.col(f"_x.{order}").alias(order), F.slice("_all", 1, F.col("_i") + 1).alias("turns"))


def unroll_conversation(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                        text: str = "text") -> DataFrame:
    """T1..Tn -> (T1 -> T2), (T1 EOS T2 -> T3), ..."""
    u = unroll_turns(turns, [text], key, order)
    t = F.transform("turns", lambda x: x[text])
    return u.select(key, order, T.join_turns(F.slice(t, 1, F.size("turns") - 1)).alias("context"), F.element_at(t, -1).alias("response"))


# --- A5 / A6 / T1 -----------------------------------------------------------

def _sentences(sa: DataFrame) -> DataFrame:
    """Each (source turns..., target, next_state) sentence with its position,
    flag (first char) and text (after the 4-char weight prefix)."""
    arr = F.concat(T.split_turns("source"), F.array("target", "next_state"))
    x = sa.select("conv_id", "turn", F.posexplode(arr).alias("pos", "s"))
    return x.select("conv_id", "turn", "pos", F.substring("s", 1, 1).alias("flag"),
                    F.substring("s", 5, 1 << 30).alias("sentence"))


def trigram_freq(sa: DataFrame) -> DataFrame:
    """A5: trigram counts over sentences whose weight flag is not 0."""
    s = _sentences(sa).filter(F.col("flag").cast("int") != 0)
    g = s.select(F.explode(ngrams(T.words("sentence"), 3)).alias("trigram"))
    return g.groupBy("trigram").agg(F.count(F.lit(1)).alias("cnt"))


def kth_count(freq: DataFrame, k: int) -> DataFrame:
    """One-row frame with the count at 0-based rank k (descending).
    A top-(k+1) is the feature here. Fewer than k + 1 trigrams end the job
    (the original stops with an error)."""
    top = freq.orderBy(F.col("cnt").desc(), F.col("trigram")).limit(k + 1)
    return top.agg(F.when(F.count(F.lit(1)) > k, F.min("cnt"))
                    .otherwise(F.raise_error(F.lit(f"fewer than {k + 1} trigrams")).cast("long")).alias("threshold"))


def bland_tag(sa: DataFrame, bland_top: int = BLAND_TOP, ratio: float = BLAND_RATIO) -> DataFrame:
    """Tag per sentence: 'bad' (weight flag 0), 'bland' or ''.

    Bland iff the sentence has >= 1 trigram and the trigrams whose corpus
    count exceeds the threshold make up >= ratio of them. At most
    ``bland_top`` trigrams exceed the count at that rank, so they are
    broadcast and nothing is shuffled by trigram but the count itself. A
    corpus without that rank ends the job, as the original does."""
    freq = trigram_freq(sa)
    top = freq.orderBy(F.col("cnt").desc(), F.col("trigram")).limit(bland_top + 1)
    last = F.min("cnt").over(Window.partitionBy())                      # over at most bland_top + 1 rows
    top = top.select("trigram", "cnt", last.alias("_thr"))
    frequent = F.broadcast(top.where("cnt > _thr").select("trigram", F.lit(1).alias("_hi")))
    enough = top.agg(F.count(F.lit(1))).scalar()
    checked = F.when(enough <= bland_top, F.raise_error(F.lit(f"the corpus has no trigram of rank {bland_top}")))
    s = _sentences(sa).withColumn("_g", ngrams(T.words("sentence"), 3))
    s = s.withColumn("_bad", F.col("flag").cast("int") == 0)
    # each occurrence of a frequent trigram, then back to the sentence: rows
    # of one sentence are summed before they are shuffled
    x = s.select("conv_id", "turn", "pos", "_bad", F.size("_g").alias("_n"), F.explode_outer("_g").alias("trigram"))
    x = x.join(frequent, "trigram", "left")
    out = x.groupBy("conv_id", "turn", "pos").agg(F.first("_bad").alias("_bad"), F.first("_n").alias("_n"),
                                                  F.coalesce(F.sum("_hi"), F.lit(0)).alias("_hi"))
    tag = (F.when(checked.cast("string").isNotNull(), F.lit(None)).when(F.col("_bad"), F.lit("bad"))
            .when((F.col("_n") > 0) & (F.col("_hi") >= F.lit(ratio) * F.col("_n")), F.lit("bland"))
            .otherwise(F.lit("")))
    return out.select("conv_id", "turn", "pos", tag.alias("tag"))


# --- A13 / J12 --------------------------------------------------------------

EMOTION_SCHEMA = Ty.StructType([Ty.StructField("predict_emotion", Ty.ArrayType(Ty.StructType([
    Ty.StructField("description", Ty.StringType()), Ty.StructField("percentage", Ty.StringType())])))])


def emotion_reward(df: DataFrame, json_col: str = "json") -> DataFrame:
    """sum(weight * share), share = percent text without '%' / 100;
    a missing emotion contributes 0."""
    parsed = F.from_json(F.col(json_col), EMOTION_SCHEMA)["predict_emotion"]
    def weight(d):
        w = F.lit(0)
        for name, v in EMOTION_REWARD.items():
            if v:
                w = F.when(d == name, F.lit(v)).otherwise(w)
        return w
    share = lambda e: F.coalesce(F.regexp_replace(e["percentage"], "%$", "").try_cast("double"), F.lit(0.0)) / 100.0
    r = F.aggregate(parsed, F.lit(0.0), lambda acc, e: acc + weight(e["description"]) * share(e))
    return df.withColumn("reward", r)


def refined_rows(sa: DataFrame, emotions: DataFrame, bland_top: int = BLAND_TOP, ratio: float = BLAND_RATIO) -> DataFrame:
    """The refinement flow: state/action rows -> tags (A6) -> weight 0.0 on
    tagged sentences, 1.0 on the others -> reward of the next state (A13).

    ``emotions`` (conv_id, turn, json) is the classifier's answer for the next
    state of each row. Output (conv_id, turn, source, target, next_state, reward)."""
    key = ["conv_id", "turn"]
    s = _sentences(sa).select(*key, "pos", "sentence").join(bland_tag(sa, bland_top, ratio), [*key, "pos"])
    w = F.concat(F.when(F.col("tag") == "", F.lit("1.0 ")).otherwise(F.lit("0.0 ")), F.col("sentence"))
    g = s.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", w.alias("w")))).alias("_s"))     # a row's sentences
    t = F.transform("_s", lambda x: x["w"])
    out = g.select(*key, T.join_turns(F.slice(t, 1, F.size("_s") - 2)).alias("source"), F.element_at(t, -2).alias("target"),
                   F.element_at(t, -1).alias("next_state"))
    return out.join(emotion_reward(emotions).select(*key, "reward"), key)


def emotion_code_table(spark) -> DataFrame:
    """J12 lookup table (7 rows, fixed)."""
    return spark.createDataFrame([(k, v) for k, v in EMOTION_CODES.items()], "code int, label string")


def emotion_label(df: DataFrame, code_col: str, codes: DataFrame) -> DataFrame:
    """code -> label (broadcast of a fixed 7-row table)."""
    return df.join(F.broadcast(codes.withColumnRenamed("code", code_col)), code_col, "left")


def emotion_code(df: DataFrame, label_col: str, codes: DataFrame) -> DataFrame:
    """label -> code; a label without a code is returned as is (as text)."""
    c = F.broadcast(codes.select(F.col("label").alias(label_col), F.col("code").alias("_code")))
    return (df.join(c, label_col, "left")
              .withColumn("emotion_out", F.coalesce(F.col("_code").cast("string"), F.col(label_col)))
              .drop("_code"))


# --- J8 --------------------------------------------------------------------

def multiref(test_items: DataFrame, data: DataFrame) -> DataFrame:
    """test_items (line_no, pos, score, rid); data (keys, src, tgt),
    last duplicate key wins (by ``data_line``). Output (line_no, src, refs)
    with refs = tab-joined 'score|ref' in item order."""
    d = data.select(F.col("keys").alias("rid"), T.straight_quotes("src").alias("src"),
                    T.straight_quotes("tgt").alias("tgt"), "data_line")
    d = last_wins(d, ["rid"], "data_line")
    j = test_items.join(d, "rid", "left")
    anchor = j.filter(F.col("pos") == 0).filter(F.col("src").isNotNull()).select(
        "line_no", F.col("src").alias("_asrc"))
    k = (j.join(anchor, "line_no")
          .filter(F.col("src").isNotNull() & (F.col("src") == F.col("_asrc"))))
    return (k.groupBy("line_no", "_asrc")
             .agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws("|", "score", "tgt").alias("r"))))
                  .alias("_r"))
             .select("line_no", F.col("_asrc").alias("src"),
                     F.array_join(F.transform("_r", lambda s: s["r"]), "\t").alias("refs")))


# --- S1 / S2 / PF12 / PF13 -------------------------------------------------

def union_months(dfs: list[DataFrame]) -> DataFrame:
    """Bag union of monthly outputs."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def dedup_last(df: DataFrame, key: str, order: str, value_cols: list[str]) -> DataFrame:
    """Last-wins de-duplication (dict overwrite) by key (see :func:`threads.last_wins`)."""
    return last_wins(df.select(key, *value_cols, order), [key], order)


def default_weights(df: DataFrame, context: str = "context", response: str = "response") -> DataFrame:
    """PF12: '0.0 ' before the whole context, '1.0 ' before the response."""
    return (df.withColumn(context, F.concat(F.lit("0.0 "), F.col(context)))
              .withColumn(response, F.concat(F.lit("1.0 "), F.col(response))))


def human_baseline(refs_line: DataFrame) -> DataFrame:
    """PF13: second reference cell (cell 2 of key TAB cells), text after the
    first '|' up to the next; rows without it are skipped."""
    cells = F.split(F.col("line"), "\t")
    piece = F.get(F.split(F.get(cells, 2), "\\|"), 1)
    return refs_line.select(F.get(cells, 0).alias("key"), piece.alias("human")).filter(F.col("human").isNotNull())
