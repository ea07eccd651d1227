"""Bindings from the driver's tables to the shapes the pipeline expects.

The original pipeline reads forum dumps, key files, spreadsheets and scorer
outputs that are not shipped. These adapters derive each input shape from
the given tables with a fixed rule, so every job's work grows with the
tables. Each Spark builder has a DuckDB twin in ``SQL`` used by the oracle;
both must implement the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convkit.functions import text as T
from convkit.sources.tables import table

# Fixed adapter parameters (shared by Spark and SQL twins).
MONTHS = 3                    # month = '2024-0' || (1 + conv_id % 3)
MISSING_SUBMISSION_MOD = 17   # conv_id % 17 = 0 has no submission row
SUBREDDITS = 20               # subreddit src{conv_id % 20}
BLOCKED_SUBREDDITS = ["src3", "src7"]
KEEP_KEY_MOD = 5              # comments with conv_id % 5 <> 0 are keyed
REPEAT_MOD = 7                # ids whose last number is a multiple of 7 occur twice in a repeating dump
DISCARD_MOD = 13              # turns with (conv_id + turn) % 13 = 0 are discard targets
EMOTIONS = ["HAPPINESS", "ANGER", "DISGUST", "FEAR", "NEUTRAL", "SADNESS", "SURPRISE"]


def _month(conv_id: Column) -> Column:
    return F.concat(F.lit("2024-0"), (F.lit(1) + conv_id % MONTHS).cast("string"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment rows (one per conversation turn) with branching parents."""
    return comments_from(table(spark, sf_dir, "conversations"))


def comments_from(c: DataFrame) -> DataFrame:
    """Same rule on any conversations frame (batch or stream)."""
    cid, turn = F.col("conv_id"), F.col("turn")
    parent_turn = turn - 1 - F.when(turn % 3 == 2, 1).otherwise(0)
    return c.select(
        F.concat(cid.cast("string"), F.lit("_"), turn.cast("string")).alias("id"),
        F.col("role").alias("author"),
        F.when(turn == 0, F.concat(F.lit("t3_"), cid.cast("string")))
         .otherwise(F.concat(F.lit("t1_"), cid.cast("string"), F.lit("_"), parent_turn.cast("string")))
         .alias("parent_id"),
        F.concat(F.lit("t3_"), cid.cast("string")).alias("link_id"),
        ((cid * 7 + turn * 3) % 11 - 2).cast("int").alias("score"),
        F.col("text").alias("body"),
        _month(cid).alias("month"),
    )


def repeated(df: DataFrame, text_col: str) -> DataFrame:
    """A dump that repeats every 7th id with a changed text, in a later line
    (``line_no``)."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    again = df.filter(n % REPEAT_MOD == 0).withColumn(text_col, F.concat(F.lit("edited "), F.col(text_col)))
    return df.withColumn("line_no", F.lit(1)).unionByName(again.withColumn("line_no", F.lit(2)))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission per conversation, except every 17th (missing)."""
    c = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id")
    g = (c.filter(cid % MISSING_SUBMISSION_MOD != 0)
          .groupBy("conv_id")
          .agg(F.count(F.lit(1)).cast("int").alias("num_comments"),
               F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("first_text")))
    return g.select(
        cid.cast("string").alias("id"),
        (F.lit(1) + cid % 5).cast("int").alias("score"),
        F.col("num_comments"),
        F.concat(F.lit("self.src"), (cid % SUBREDDITS).cast("string")).alias("domain"),
        F.concat(F.lit("/r/src"), (cid % SUBREDDITS).cast("string"), F.lit("/comments/")).alias("permalink"),
        F.array_join(F.slice(T.words("first_text"), 1, 5), " ").alias("title"),
        _month(cid).alias("month"),
    )


def block_subreddits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked subreddits: fixed entries that occur in the derived permalinks."""
    subs = submissions(spark, sf_dir).select(T.subreddit_of("permalink").alias("entry"))
    return subs.filter(F.col("entry").isin(BLOCKED_SUBREDDITS)).distinct()


def keep_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key list rows (link_id, comment_id, kind) for both stages."""
    cm = comments(spark, sf_dir).filter(
        F.regexp_extract("link_id", r"^t3_(\d+)$", 1).cast("long") % KEEP_KEY_MOD != 0)
    base = cm.select("link_id", F.concat(F.lit("t1_"), F.col("id")).alias("comment_id"))
    return (base.withColumn("kind", F.lit("dep"))
                .unionByName(base.withColumn("kind", F.lit("keep"))))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split on newline: (doc_id, line_no, line)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(previous line, line) pairs inside each document."""
    return doc_pairs_from(table(spark, sf_dir, "documents"))


def doc_pairs_from(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.split(F.col("text"), "\n").alias("ls"))
    k = F.greatest(F.size("ls") - 1, F.lit(0))
    z = F.zip_with(F.slice("ls", 1, k), F.slice("ls", 2, k), lambda a, b: F.struct(a.alias("src"), b.alias("tgt")))
    return (d.select("doc_id", F.posexplode(z).alias("i", "p"))
             .select("doc_id", (F.col("i") + 1).alias("line_no"), "p.src", "p.tgt"))


def state_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, next_state) = turns t, t+1, t+2 of a conversation,
    each prefixed with its weight flag ('1.0 ' unless turn % 4 = 3).
    Equi-joins on the unique (conv_id, turn): no per-conversation window."""
    c = table(spark, sf_dir, "conversations")
    flagged = F.concat(F.when(F.col("turn") % 4 == 3, F.lit("0.0 ")).otherwise(F.lit("1.0 ")), F.col("text"))
    t = c.select("conv_id", "turn", flagged.alias("s"))
    n1 = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("s1"))
    n2 = t.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("s").alias("s2"))
    return t.join(n1, ["conv_id", "turn"]).join(n2, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("s").alias("source"), F.col("s1").alias("target"),
        F.col("s2").alias("next_state"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreadsheet-like rows of three files: marker 'S' opens a conversation;
    two preamble rows per file come before the first marker; the second file
    has no marker at all."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select((2 * (F.col("conv_id") % 2)).cast("int").alias("file_no"),
                    (F.col("conv_id") * F.lit(1 << 31) + F.col("turn")).alias("row_no"),
                    F.when(F.col("turn") == 0, F.lit("S")).otherwise(F.lit("")).alias("marker"),
                    F.col("text"))
    files = c.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("file_no")).distinct()
    pre = files.select("file_no", F.explode(F.array(F.lit(-2).cast("long"), F.lit(-1).cast("long"))).alias("row_no"),
                       F.lit("").alias("marker"), F.lit("preamble").alias("text"))
    return rows.unionByName(pre)


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems: 'last' answers with the last turn, 'first' with turn 0.
    A conversation of one turn has no references and so no hypotheses."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.min_by("text", "turn").alias("first"),
                                 F.count(F.lit(1)).alias("n")).filter("n > 1")
    system = lambda name: F.struct(F.lit(name).alias("system"), F.col(name).alias("hyp"))
    return (g.select("conv_id", F.explode(F.array(system("last"), system("first"))).alias("s"))
             .select("s.system", F.col("conv_id").alias("line_no"), F.col("conv_id").cast("string").alias("key"), "s.hyp"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key -> the other turns (all but the last), in turn order, each as
    'score|text' with score = turn % 3 (every fifth turn carries no score)."""
    c = table(spark, sf_dir, "conversations")
    item = F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(
        F.concat((F.col("turn") % 3).cast("string"), F.lit("|"), F.col("text")))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("ref")))).alias("rs")).filter(F.size("rs") > 1)
    return g.select(F.col("conv_id").cast("string").alias("key"),
                    F.transform(F.slice("rs", 1, F.size("rs") - 1), lambda s: s["ref"]).alias("refs"))


def emotions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier-style output per event: JSON with 7 (description, 'NN%')
    entries; every 10th row lacks one emotion."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    eid = F.col("event_id")
    items = [F.struct(F.lit(name).alias("description"),
                      F.concat(((k * (i + 1) + eid) % 100).cast("string"), F.lit("%")).alias("percentage"))
             for i, name in enumerate(EMOTIONS)]
    arr = F.array(*items)
    drop_ix = ((eid / 10).cast("long") % 7).cast("int")
    arr = F.when(eid % 10 == 0, F.filter(arr, lambda x, i: i != drop_ix)).otherwise(arr)
    return e.select(eid.alias("sentence_id"),
                    F.to_json(F.struct(arr.alias("predict_emotion"))).alias("json"))


def next_state_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier-style output for the next state (turn t + 2) of every
    state/action row (conv_id, t)."""
    c = table(spark, sf_dir, "conversations").filter("turn >= 2")
    items = [F.struct(F.lit(name).alias("description"),
                      F.concat(((F.col("conv_id") * (i + 1) + F.col("turn") * 7) % 100).cast("string"), F.lit("%")).alias("percentage"))
             for i, name in enumerate(EMOTIONS)]
    return c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.to_json(F.struct(F.array(*items).alias("predict_emotion"))).alias("json"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("context_id"), F.col("event_id").alias("cand_id"),
                    F.col("event_type").alias("text"), F.col("value").alias("fwd_loss"),
                    F.get_json_object("props", "$.k").cast("double").alias("rev_loss"),
                    ((F.col("event_id") % 100) / 50.0 - 1).alias("q_value"))


def value_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select((F.col("event_id") % 5).cast("int").alias("step"),
                    ((k - 50) / 50.0).alias("pred"),
                    ((F.col("event_id") % 201 - 100) / 100.0).alias("truth"))


def token_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of a turn: batch = conversation, seq = turn."""
    c = table(spark, sf_dir, "conversations")
    return (c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("seq_id"),
                     F.posexplode(T.words("text")).alias("pos", "word"))
             .select("batch_id", "seq_id", "pos",
                     (F.length("word") / 10.0).alias("loss"),
                     F.when(F.col("seq_id") % 2 == 0, F.lit(-1)).otherwise(F.lit(1)).alias("label")))


def history_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat stream: uid = conversation, ts = turn, tokens = words + 1."""
    return history_messages_from(table(spark, sf_dir, "conversations"))


def history_messages_from(c: DataFrame) -> DataFrame:
    return c.select(F.col("conv_id").alias("uid"), F.col("turn").alias("ts"),
                    (F.size(T.words("text")) + 1).alias("n_tokens"), F.col("text"))


# ---------------------------------------------------------------------------
# DuckDB twins. Every name is a CTE body over the driver's views.
# ---------------------------------------------------------------------------
_WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def sql_words(x: str) -> str:
    return _WORDS.format(x=x)


def sql_repeated(name: str, text_col: str) -> str:
    return f"""
      SELECT * , 1 AS line_no FROM ({SQL[name]})
      UNION ALL
      SELECT * REPLACE ('edited ' || {text_col} AS {text_col}), 2 FROM ({SQL[name]})
      WHERE CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) % {REPEAT_MOD} = 0"""


SQL = {
    "comments": """
      SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
             role AS author,
             CASE WHEN turn = 0 THEN 't3_' || CAST(conv_id AS VARCHAR)
                  ELSE 't1_' || CAST(conv_id AS VARCHAR) || '_' ||
                       CAST(turn - 1 - CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS VARCHAR) END AS parent_id,
             't3_' || CAST(conv_id AS VARCHAR) AS link_id,
             CAST((conv_id * 7 + turn * 3) % 11 - 2 AS INTEGER) AS score,
             text AS body,
             '2024-0' || CAST(1 + conv_id % 3 AS VARCHAR) AS month
      FROM conversations""",
    "submissions": f"""
      SELECT CAST(conv_id AS VARCHAR) AS id,
             CAST(1 + conv_id % 5 AS INTEGER) AS score,
             CAST(count(*) AS INTEGER) AS num_comments,
             'self.src' || CAST(conv_id % 20 AS VARCHAR) AS domain,
             '/r/src' || CAST(conv_id % 20 AS VARCHAR) || '/comments/' AS permalink,
             array_to_string({sql_words("max(CASE WHEN turn = 0 THEN text END)")}[1:5], ' ') AS title,
             '2024-0' || CAST(1 + conv_id % 3 AS VARCHAR) AS month
      FROM conversations WHERE conv_id % 17 <> 0 GROUP BY conv_id""",
    "doc_pairs": """
      SELECT doc_id, CAST(i AS INTEGER) AS line_no, ls[i] AS src, ls[i + 1] AS tgt
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d,
           LATERAL (SELECT unnest(range(1, len(d.ls))) AS i)""",
    "state_action": """
      SELECT a.conv_id, a.turn, a.s AS source, b.s AS target, c.s AS next_state
      FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '0.0 ' ELSE '1.0 ' END || text AS s
            FROM conversations) a
      JOIN (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '0.0 ' ELSE '1.0 ' END || text AS s
            FROM conversations) b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
      JOIN (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '0.0 ' ELSE '1.0 ' END || text AS s
            FROM conversations) c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2""",
    "hypotheses": """
      SELECT 'last' AS system, conv_id AS line_no, CAST(conv_id AS VARCHAR) AS key,
             arg_max(text, turn) AS hyp FROM conversations GROUP BY conv_id HAVING count(*) > 1
      UNION ALL
      SELECT 'first', conv_id, CAST(conv_id AS VARCHAR), arg_min(text, turn)
      FROM conversations GROUP BY conv_id HAVING count(*) > 1""",
    "references": """
      SELECT CAST(c.conv_id AS VARCHAR) AS key,
             list(CASE WHEN turn % 5 = 4 THEN text
                       ELSE CAST(turn % 3 AS VARCHAR) || '|' || text END ORDER BY turn) AS refs
      FROM conversations c JOIN (SELECT conv_id, max(turn) AS mx FROM conversations GROUP BY conv_id) m
        ON c.conv_id = m.conv_id
      WHERE turn < mx GROUP BY c.conv_id""",
    "candidates": """
      SELECT user_id AS context_id, event_id AS cand_id, event_type AS text, value AS fwd_loss,
             CAST(json_extract_string(props, '$.k') AS BIGINT)::DOUBLE AS rev_loss,
             (event_id % 100) / 50.0 - 1 AS q_value
      FROM events""",
    "value_predictions": """
      SELECT CAST(event_id % 5 AS INTEGER) AS step,
             (CAST(json_extract_string(props, '$.k') AS BIGINT) - 50) / 50.0 AS pred,
             (event_id % 201 - 100) / 100.0 AS truth
      FROM events""",
    "token_losses": f"""
      SELECT conv_id AS batch_id, turn AS seq_id, CAST(p - 1 AS INTEGER) AS pos,
             length(ws[p]) / 10.0 AS loss, CASE WHEN turn % 2 = 0 THEN -1 ELSE 1 END AS label
      FROM (SELECT conv_id, turn, {sql_words("text")} AS ws FROM conversations) c,
           LATERAL (SELECT unnest(range(1, len(c.ws) + 1)) AS p)""",
}
