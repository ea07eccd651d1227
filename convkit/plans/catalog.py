"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
computed from the driver's tables. Oracle SQL twins live in
``convkit.plans.oracle``.

Result columns are scalars (arrays are rendered as space- or
' EOS '-joined strings, the sink encoding) and floats are rounded to 6
decimals, so engine-independent hashing is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convkit.functions import text as T
from convkit.operators import quality as Q
from convkit.operators import threads as TH
from convkit.session import materialize as MAT
from convkit.session import scratch_path
from convkit.sources import adapters as AD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# Shared parameters of the registered extraction queries (test recipe).
THREAD_PARAMS = dict(max_len=100, max_depth=5, min_depth=2, min_score=1, use_title=False,
                     leaves_only=False, clean=True)


@query("thread_pairs")
def q_thread_pairs(spark, sf):
    return TH.thread_pairs(AD.comments(spark, sf), AD.submissions(spark, sf), **THREAD_PARAMS)


@query("quality_filter")
def q_quality_filter(spark, sf):
    p = AD.doc_pairs(spark, sf)
    return Q.quality_filter(p).select("doc_id", "line_no", "skip_reason")


# --- scalar text functions (F1-F9) over every conversation turn -------------
from convkit.functions import ngrams as NG  # noqa: E402
from convkit.operators import corpus as CO  # noqa: E402
from convkit.operators import ngram_stats as NS  # noqa: E402
from convkit.sources.tables import table  # noqa: E402


def _turn_fn(fn):
    def run(spark, sf):
        c = table(spark, sf, "conversations")
        return c.select("conv_id", "turn", fn(F.col("text")).alias("out"))
    return run


QUERIES["minimal_norm"] = _turn_fn(T.minimal_norm)
QUERIES["gpt_norm"] = _turn_fn(T.gpt_norm)
QUERIES["eval_clean"] = _turn_fn(T.eval_clean)
QUERIES["unescape_line"] = _turn_fn(T.unescape_line)
QUERIES["ws_norm"] = _turn_fn(T.ws_norm)
QUERIES["detokenise"] = _turn_fn(lambda c: T.detokenise(
    F.concat(F.array(F.lit("<s>")), F.transform(T.words(c), lambda w: F.concat(F.lit("▁"), w)),
             F.array(F.lit("</s>")))))
QUERIES["strip_punct"] = _turn_fn(lambda c: F.array_join(T.strip_punct(T.words(T.eval_clean(c))), " "))


# --- extraction operators ---------------------------------------------------

def _admitted(spark, sf, materialize=False):
    s = TH.submission_filter(AD.submissions(spark, sf))
    c = TH.comment_admission(AD.comments(spark, sf), s)
    if materialize:
        s, c = MAT(s, "extract-subs"), MAT(c, "extract-comments")
    return s, c


@query("submission_filter")
def q_submission_filter(spark, sf):
    s = TH.submission_filter(AD.submissions(spark, sf))
    return s.select("month", "sid", "num_comments", "title")


@query("comment_admission")
def q_comment_admission(spark, sf):
    _, c = _admitted(spark, sf)
    return c.select("month", "name", "n_char", "body")


@query("comment_meta")
def q_comment_meta(spark, sf):
    s, c = _admitted(spark, sf)
    # every comment, including those whose submission is missing
    allc = AD.comments(spark, sf).withColumn("name", F.concat(F.lit("t1_"), F.col("id")))
    return TH.comment_meta(allc, s).select("month", "name", "subreddit", "domain",
                                           F.coalesce("title", F.lit("")).alias("title"))


@query("score_filter")
def q_score_filter(spark, sf):
    _, c = _admitted(spark, sf)
    return c.filter(TH.score_of("score") >= 1).select("month", "name", TH.score_of("score").alias("score"))


@query("subreddit_block")
def q_subreddit_block(spark, sf):
    s = TH.submission_filter(AD.submissions(spark, sf))
    allc = AD.comments(spark, sf).withColumn("name", F.concat(F.lit("t1_"), F.col("id")))
    m = TH.comment_meta(allc, s)
    bl = AD.block_subreddits(spark, sf).withColumnRenamed("entry", "subreddit").withColumn("_bad", F.lit(True))
    m = m.join(bl, "subreddit", "left")
    reason = (F.when(F.col("subreddit") == "", F.lit("missing"))
               .when(F.coalesce("_bad", F.lit(False)), F.lit("bad_subreddit")).otherwise(F.lit("ok")))
    return m.select("month", "name", "subreddit", reason.alias("reason"))


@query("keep_keys")
def q_keep_keys(spark, sf):
    k = AD.keep_keys(spark, sf)
    return TH.thread_pairs(AD.comments(spark, sf), AD.submissions(spark, sf), dep_keys=k.filter("kind = 'dep'"),
                           keep_keys=k.filter("kind = 'keep'"), **THREAD_PARAMS)


@query("thread_pairs_repeats")
def q_thread_pairs_repeats(spark, sf):
    """Dumps that repeat comments and submissions: the last line of an id wins."""
    return TH.thread_pairs(AD.repeated(AD.comments(spark, sf), "body"), AD.repeated(AD.submissions(spark, sf), "title"),
                           order="line_no", **THREAD_PARAMS)


@query("thread_pairs_bucketed")
def q_thread_pairs_bucketed(spark, sf):
    """The extract as tables bucketed by thread: no shuffle at any level of the chain."""
    from convkit.operators import buckets as BK
    s, c = _admitted(spark, sf, materialize=True)
    return BK.kept_pairs(BK.write(c, s), **THREAD_PARAMS)


@query("thread_pairs_blocked")
def q_thread_pairs_blocked(spark, sf):
    """Block phrases as a table in the extraction itself."""
    return TH.thread_pairs(AD.comments(spark, sf), AD.submissions(spark, sf), block_words=_block_words(spark), **THREAD_PARAMS)


@query("leaf_comments")
def q_leaf_comments(spark, sf):
    _, c = _admitted(spark, sf)
    return TH.leaf_comments(c).select("month", "name")


TRAIN_PARAMS = dict(THREAD_PARAMS, leaves_only=True)


def _discard_hashes(spark, sf, bits):
    c = table(spark, sf, "conversations")
    d = c.filter((F.col("conv_id") + F.col("turn")) % AD.DISCARD_MOD == 0)
    return d.select(F.sha2(T.gpt_norm(T.minimal_norm("text")), bits).alias("hash"))


@query("turn_weights")
def q_turn_weights(spark, sf):
    """Train recipe: leaves only, clean, discard targets (SHA-256 variant so
    the oracle can compute it), blocked subreddits."""
    return TH.thread_pairs(AD.comments(spark, sf), AD.submissions(spark, sf),
                           discard_hashes=_discard_hashes(spark, sf, 256), hash_bits=256,
                           block_subreddits=AD.block_subreddits(spark, sf), **TRAIN_PARAMS)


# Fixed phrase list for J7: one word, two words, more than three words, punctuation.
BLOCK_WORDS = ["und der", "the and", "que la", "of the and in", "on, the", "thonsh"]


def _block_words(spark):
    return spark.createDataFrame([(w,) for w in BLOCK_WORDS], "entry string")


@query("blockword_hits")
def q_blockword_hits(spark, sf):
    _, c = _admitted(spark, sf)
    return Q.blockword_hits(c.select("name", "body"), "name", "body", _block_words(spark)).select(
        "name", F.col("blocked").cast("int").alias("blocked"))


def _phrase_list(spark, sf):
    """A list that grows with the table: words two to four of every conversation's first turn."""
    c = table(spark, sf, "conversations").where("turn = 0").select(T.words("text").alias("w")).where(F.size("w") >= 4)
    return c.select(F.array_join(F.slice("w", 2, 3), " ").alias("entry")).distinct()


@query("blockword_list")
def q_blockword_list(spark, sf):
    """J7 by a long list of phrases, many of which begin with a frequent word."""
    _, c = _admitted(spark, sf)
    return Q.blockword_hits(c.select("name", "body"), "name", "body", _phrase_list(spark, sf)).select(
        "name", F.col("blocked").cast("int").alias("blocked"))


@query("skip_audit")
def q_skip_audit(spark, sf):
    s, c = _admitted(spark, sf, materialize=True)
    inst = TH.conv_instances(c, s, block_subreddits=AD.block_subreddits(spark, sf), **THREAD_PARAMS)
    return Q.skip_audit(inst.filter(F.col("skip_reason").isNotNull()), ["skip_reason", "subreddit"])


@query("extract_stats")
def q_extract_stats(spark, sf):
    return TH.extract_stats(AD.comments(spark, sf), AD.submissions(spark, sf))


@query("conv_stats")
def q_conv_stats(spark, sf):
    s, c = _admitted(spark, sf, materialize=True)
    return TH.conv_stats(TH.conv_instances(c, s, **THREAD_PARAMS), c, _shard)


def _shard(link):
    return F.substring(link, 4, 100).cast("long") % 2


@query("conv_stats_leaves")
def q_conv_stats_leaves(spark, sf):
    """The train recipe: leaves only; ``total`` still counts every extracted comment."""
    s, c = _admitted(spark, sf, materialize=True)
    return TH.conv_stats(TH.conv_instances(c, s, **TRAIN_PARAMS), c, _shard)


@query("leaf_ratio")
def q_leaf_ratio(spark, sf):
    _, c = _admitted(spark, sf)
    return TH.leaf_ratio(c).select("month", F.round("leaf_ratio", 6).alias("leaf_ratio"))


# --- n-gram statistics --------------------------------------------------------

@query("ngram_counts")
def q_ngram_counts(spark, sf):
    return NS.ngram_counts(table(spark, sf, "conversations"), "text", 4)


@query("ngram_entropy")
def q_ngram_entropy(spark, sf):
    c = NS.ngram_counts(table(spark, sf, "conversations"), "text", 4)
    return NS.ngram_entropy(c).select("n", F.round("entropy", 6).alias("entropy"))


@query("distinct_n")
def q_distinct_n(spark, sf):
    c = NS.ngram_counts(table(spark, sf, "conversations"), "text", 4)
    return NS.distinct_n(c).select("n", F.round("distinct", 6).alias("distinct"))


# a tokeniser of one's own: runs of letters, single digits, single other signs
OWN_TOKENS = r"[a-z]+|[0-9]|[^\sa-z0-9]"


@query("ngram_counts_tokeniser")
def q_ngram_counts_tokeniser(spark, sf):
    """F3 and A1 with a tokeniser given by the caller."""
    own = lambda c: T.tokenise(c, OWN_TOKENS)
    c = table(spark, sf, "conversations").select(T.eval_clean("text", own).alias("text"))
    return NS.ngram_counts(c, "text", 4, tokeniser=own)


@query("distinct_sketch")
def q_distinct_sketch(spark, sf):
    """A3 from sketches of three parts, merged; ``close``: within 3 % of the exact count."""
    c = table(spark, sf, "conversations").withColumn("part", F.col("conv_id") % 3)
    est = NS.distinct_of(NS.merge_sketches(NS.distinct_sketch(c, keys=["part"])))
    exact = NS.ngram_counts(c).groupBy("n").agg(F.count(F.lit(1)).alias("exact"), F.sum("cnt").alias("tokens"))
    near = F.abs(F.col("distinct") * F.col("tokens") / F.col("exact") - 1) <= 0.03
    return est.join(exact, "n").select("n", "tokens", near.cast("int").alias("close"))


@query("avg_len")
def q_avg_len(spark, sf):
    return NS.avg_len(table(spark, sf, "conversations"), "text").select(F.round("avg_len", 6).alias("avg_len"))


@query("vocab")
def q_vocab(spark, sf):
    return NS.vocab(table(spark, sf, "conversations"), "text")


@query("trigram_freq")
def q_trigram_freq(spark, sf):
    return CO.trigram_freq(AD.state_action(spark, sf))


@query("bland_tag")
def q_bland_tag(spark, sf):
    return CO.bland_tag(MAT(AD.state_action(spark, sf), "state-action"), bland_top=100)


@query("unroll_context")
def q_unroll_context(spark, sf):
    return CO.unroll_conversation(table(spark, sf, "conversations"))


@query("union_months")
def q_union_months(spark, sf):
    """The months' folders of an extract, each read by itself, as one bag."""
    path = scratch_path(spark, f"months-{uuid.uuid4().hex[:12]}")
    _, c = _admitted(spark, sf)
    c = c.select("month", "name")
    IO.write_extract(c, path)
    months = [f"2024-0{i}" for i in range(1, AD.MONTHS + 1)]
    there = {m for m in months if IO.data_files(spark, f"{path}/month={m}")}
    return CO.union_months(IO.read_months(spark, path, sorted(there), c.schema) or [c])


@query("dedup_last")
def q_dedup_last(spark, sf):
    c = table(spark, sf, "conversations")
    return CO.dedup_last(c, "conv_id", "turn", ["text", "role"])


@query("default_weights")
def q_default_weights(spark, sf):
    u = CO.unroll_conversation(table(spark, sf, "conversations"))
    return CO.default_weights(u)


def _ref_lines(spark, sf):
    r = AD.references(spark, sf)
    return r.select("key", F.concat_ws("\t", "key", F.array_join("refs", "\t")).alias("line"))


@query("human_baseline")
def q_human_baseline(spark, sf):
    return CO.human_baseline(_ref_lines(spark, sf))


@query("segment_conversations")
def q_segment_conversations(spark, sf):
    return CO.segment_conversations(AD.sheet_rows(spark, sf))


@query("split_conversations")
def q_split_conversations(spark, sf):
    seg = CO.segment_conversations(AD.sheet_rows(spark, sf))
    return seg.select("conv_id", "row_no", CO.split_of("conv_id").alias("split"))


@query("split_lines")
def q_split_lines(spark, sf):
    # line number = position of the turn in (conv_id, turn) order
    from convkit.operators.ordering import global_index
    c = table(spark, sf, "conversations")
    r = global_index(c, [F.col("conv_id"), F.col("turn")], "line_no")
    return r.select("line_no", T.unescape_line("text").alias("line"), CO.split_of("line_no", lines=True).alias("split"))


@query("emotion_reward")
def q_emotion_reward(spark, sf):
    e = CO.emotion_reward(AD.emotions_json(spark, sf))
    return e.select("sentence_id", F.round("reward", 6).alias("reward"))


@query("emotion_codes")
def q_emotion_codes(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.lit(10001) + F.col("event_id") % 8).cast("int").alias("code"))
    codes = CO.emotion_code_table(spark)
    lab = CO.emotion_label(e, "code", codes)
    lab = lab.withColumn("label", F.coalesce("label", F.col("code").cast("string")))
    return CO.emotion_code(lab, "label", codes).select("event_id", "label", "emotion_out")


def _pair_key(conv, t):
    """'sid,pid,cid' of the comment for turn t of a conversation (adapter rule)."""
    cs = conv.cast("string")
    parent = F.when(t == 0, F.concat(F.lit("t3_"), cs)).otherwise(
        F.concat(F.lit("t1_"), cs, F.lit("_"), (t - 1 - F.when(t % 3 == 2, 1).otherwise(0)).cast("string")))
    return F.concat_ws(",", F.concat(F.lit("t3_"), cs), parent, F.concat(F.lit("t1_"), cs, F.lit("_"), t.cast("string")))


def _multiref_inputs(spark, sf):
    pairs = TH.thread_pairs(AD.comments(spark, sf), AD.submissions(spark, sf), **THREAD_PARAMS)
    data = pairs.select(F.concat_ws(",", "sid", "pid", "cid").alias("keys"), F.col("context").alias("src"),
                        F.col("response").alias("tgt"), F.lit(0).alias("data_line"))
    # test ids: one line per turn; items = its own pair, the previous turn's
    # pair (a sibling shares the source, otherwise a mismatch) and a missing id
    c = table(spark, sf, "conversations")
    cv, t = F.col("conv_id"), F.col("turn")
    items = F.array(F.struct(F.lit(0).alias("pos"), F.lit("0.5").alias("score"), _pair_key(cv, t).alias("rid")),
                    F.struct(F.lit(1).alias("pos"), F.lit("0.4").alias("score"), _pair_key(cv, t - 1).alias("rid")),
                    F.struct(F.lit(2).alias("pos"), F.lit("0.3").alias("score"), F.concat(F.lit("none,"), _pair_key(cv, t)).alias("rid")))
    tt = c.select(_row_id().alias("line_no"), F.explode(items).alias("it")).select(
        "line_no", "it.pos", "it.score", "it.rid")
    return tt, data


@query("multiref")
def q_multiref(spark, sf):
    t, data = _multiref_inputs(spark, sf)
    return CO.multiref(t, data)


@query("multiref_file")
def q_multiref_file(spark, sf):
    """J8 from a test-id file and a data file in which every fourth key comes
    twice; the later line counts."""
    items, data = _multiref_inputs(spark, sf)
    base = scratch_path(spark, f"test-ids-{uuid.uuid4().hex[:12]}")
    lines = items.groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("pos", "score", "rid"))).alias("items"))
    IO.write_test_ids(lines, base + "/ids", ["line_no"])
    stale = data.filter(F.length("tgt") % 4 == 0).withColumn("tgt", F.concat(F.lit("stale "), F.col("tgt")))
    data = stale.unionByName(data.withColumn("data_line", F.lit(1)))
    return CO.multiref(IO.read_test_ids(spark, base + "/ids").filter("known"), data)


# --- metrics (J9, A7-A11, A20) -------------------------------------------------
from convkit.operators import metrics as ME  # noqa: E402

EVAL_PARAMS = dict(n_refs=6, vshuman=1, clean=True)


def _texts(spark, sf, **kw):
    return ME.hyp_refs(AD.hypotheses(spark, sf), AD.references(spark, sf), **EVAL_PARAMS, **kw)


def _grams(spark, sf, **kw):
    """The n-gram table, written once for the several sums over it."""
    return MAT(ME.ngram_table(_texts(spark, sf, **kw)), "ngrams")


@query("hyp_refs")
def q_hyp_refs(spark, sf):
    seg = _texts(spark, sf).groupBy("key").agg(
        F.collect_list(F.when(F.col("system").isNotNull(), F.struct("system", F.col("text").alias("hyp")))).alias("h"),
        F.collect_list(F.when(F.col("system").isNull(), F.struct("ri", F.col("text").alias("ref")))).alias("r"))
    return seg.select("key", "r", F.inline("h")).select("system", "key", "hyp", F.inline("r")).select("system", "key", "ri", "hyp", "ref")


def _r6(df, keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


QUERIES["bleu_corpus"] = lambda spark, sf: _r6(ME.bleu_corpus(_grams(spark, sf)), ["system"])
QUERIES["bleu_sentence"] = lambda spark, sf: _r6(ME.bleu_sentence(_grams(spark, sf)), ["system", "key"])
@query("bleu_corpus_lengths")
def q_bleu_corpus_lengths(spark, sf):
    """A7 by the other effective reference lengths."""
    g = _grams(spark, sf)
    a, b = (_r6(ME.bleu_corpus(g, e).withColumn("effective", F.lit(e)), ["system", "effective"]) for e in ("shortest", "average"))
    return a.unionByName(b)


@query("bleu_pool_mean")
def q_bleu_pool_mean(spark, sf):
    """Mean BLEU per system, every line against the pool of all reference lines."""
    t = MAT(_texts(spark, sf), "texts")
    pool = t.filter(F.col("system").isNull()).select(F.struct("key", "ri").alias("rid"), "text")
    s = ME.bleu_pool(t.filter(F.col("system").isNotNull()), pool)
    return s.groupBy("system").agg(*[F.round(F.avg(f"bleu{k}"), 6).alias(f"bleu{k}") for k in range(1, 5)])


QUERIES["nist"] = lambda spark, sf: _r6(ME.nist(_grams(spark, sf)), ["system"])
QUERIES["rouge_l"] = lambda spark, sf: _r6(ME.rouge_l(_texts(spark, sf)), ["system", "key"])
QUERIES["cider"] = lambda spark, sf: _r6(ME.cider(_grams(spark, sf)), ["system", "key"])


@query("system_report")
def q_system_report(spark, sf):
    return _r6(ME.system_report(_grams(spark, sf)), ["system", "n_lines"])


N_LINES = 50


@query("system_report_head")
def q_system_report_head(spark, sf):
    """T5: the report, entropy and mean length over the first lines of every system."""
    t = _texts(spark, sf)
    return _r6(ME.system_report(MAT(ME.ngram_table(t), "ngrams"), ME.first_lines(t, N_LINES)), ["system", "n_lines"])


# --- features, batching, scoring ---------------------------------------------
from convkit.operators import contexts as CX  # noqa: E402
from convkit.operators import batching as BA  # noqa: E402
from convkit.operators import features as FE  # noqa: E402
from convkit.operators import scoring as SC  # noqa: E402

FEATURE_MAX_LEN = 128


def _ints(c):
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"), " ")


def _row_id(cid="conv_id", turn="turn"):
    return F.concat_ws("_", F.col(cid).cast("string"), F.col(turn).cast("string"))


def _vocab(spark, sf):
    """Vocabulary of the training split (W2); words of the other splits may be unknown."""
    c = table(spark, sf, "conversations").filter(CO.split_of("conv_id") == "train")
    return NS.vocab(c, "text")


def _turn_rows(spark, sf, encoded: bool = False):
    """Unrolled rows: row_id, turn, turns (and turn_ids) and a reward class.
    Each turn is encoded once, before the unrolling."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    cols = ["text"]
    if encoded:
        c, cols = FE.encode_texts(c, ["conv_id", "turn"], "text", _vocab(spark, sf)), ["text", "ids"]
    u = CO.unroll_turns(c, cols)
    more = [F.transform("turns", lambda x: x["ids"]).alias("turn_ids")] if encoded else []
    return u.select(_row_id().alias("row_id"), "conv_id", "turn", F.transform("turns", lambda x: x["text"]).alias("turns"), *more,
                    (((F.col("conv_id") + F.col("turn")) % 3) - 1).cast("double").alias("reward"))


def _feature_rows(spark, sf):
    return _turn_rows(spark, sf, encoded=True)


@query("encode_features")
def q_encode_features(spark, sf):
    f = _feature_rows(spark, sf)
    return f.select("row_id", _ints(FE.flatten_eos("turn_ids")).alias("input_ids"), "reward")


@query("feature_len_guard")
def q_feature_len_guard(spark, sf):
    f = _feature_rows(spark, sf)
    return f.select("row_id", FE.feature_len_guard("turn_ids", FEATURE_MAX_LEN).cast("int").alias("rejected"))


def _eval_feats(spark, sf):
    f = _feature_rows(spark, sf)
    ctx = FE.flatten_eos(F.slice("turn_ids", 1, F.size("turn_ids") - 1))
    return f.select("row_id", FE.eval_features(ctx, F.element_at("turn_ids", -1), FEATURE_MAX_LEN).alias("e")) \
            .filter(F.col("e").isNotNull())


@query("eval_features")
def q_eval_features(spark, sf):
    e = _eval_feats(spark, sf)
    return e.select("row_id", _ints("e.input_ids").alias("input_ids"), _ints("e.position_ids").alias("position_ids"),
                    _ints("e.token_type_ids").alias("token_type_ids"), _ints("e.lm_labels").alias("lm_labels"),
                    F.col("e.context_len").alias("context_len"), F.col("e.response_len").alias("response_len"))


def _encoded_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return FE.encode_texts(c, ["conv_id", "turn"], "text", _vocab(spark, sf)).select("conv_id", "turn", "ids")


@query("eval_features_windowed")
def q_eval_features_windowed(spark, sf):
    """F13 from context tails: no conversation is gathered in a row."""
    e = CX.eval_rows(_encoded_turns(spark, sf), FEATURE_MAX_LEN)
    return e.select(_row_id().alias("row_id"), _ints("e.input_ids").alias("input_ids"), _ints("e.position_ids").alias("position_ids"),
                    _ints("e.token_type_ids").alias("token_type_ids"), _ints("e.lm_labels").alias("lm_labels"),
                    F.col("e.context_len").alias("context_len"), F.col("e.response_len").alias("response_len"))


@query("guarded_features")
def q_guarded_features(spark, sf):
    """F12 of the rows that PF9 keeps, from offsets."""
    g = CX.guarded_rows(_encoded_turns(spark, sf), FEATURE_MAX_LEN)
    return g.select(_row_id().alias("row_id"), _ints("input_ids").alias("input_ids"))


@query("left_truncate")
def q_left_truncate(spark, sf):
    e = _eval_feats(spark, sf)
    return e.select("row_id", _ints(FE.left_truncate("e.input_ids", 64)).alias("input_ids"),
                    _ints(FE.left_truncate("e.lm_labels", 64)).alias("lm_labels"))


@query("two_turn")
def q_two_turn(spark, sf):
    f = _turn_rows(spark, sf)
    return f.select("row_id", T.join_turns(FE.two_turn("turns")).alias("turns"))


@query("prompt_prefix")
def q_prompt_prefix(spark, sf):
    f = _turn_rows(spark, sf)
    return f.select("row_id", T.join_turns(FE.prompt_prefix("turns")).alias("prompt"))


@query("reverse_turns")
def q_reverse_turns(spark, sf):
    f = _feature_rows(spark, sf)
    return f.select("row_id", _ints(FE.reverse_turns("turn_ids", F.col("turn") % 2 == 0)).alias("reversed"))


def _labels(spark, sf, rev):
    f = _feature_rows(spark, sf)
    seq = FE.flatten_eos("turn_ids")
    seq = F.when(F.col("turn") % 2 == 0, F.concat(seq, F.array(F.lit(FE.EOS_ID)))).otherwise(seq)
    x = f.select("row_id", FE.last_turn_labels(seq, reversed_=rev).alias("x"))
    return x.select("row_id", _ints("x.inputs").alias("inputs"), _ints("x.labels").alias("labels"))


QUERIES["last_turn_labels"] = lambda spark, sf: _labels(spark, sf, False)
QUERIES["last_turn_labels_rev"] = lambda spark, sf: _labels(spark, sf, True)

BATCH = 8


def _batched(spark, sf):
    f = _feature_rows(spark, sf).withColumn("input_ids", FE.flatten_eos("turn_ids"))
    f = f.withColumn("len", F.size("input_ids"))
    b = BA.bucket_batches(f, "row_id", "len", BATCH)
    return b.withColumn("batch_id", _row_id("bucket", "batch_in_bucket"))


@query("bucket_batches")
def q_bucket_batches(spark, sf):
    b = _batched(spark, sf)
    return b.select("row_id", "bucket", "batch_in_bucket", "batch_rows", "batch_key")


@query("pad_batches")
def q_pad_batches(spark, sf):
    b = _batched(spark, sf).withColumn("labels", F.transform("input_ids", lambda x: x))
    p = BA.pad_batches(b, "batch_id", {"input_ids": FE.PAD_ID, "labels": FE.IGNORE})
    return p.select("row_id", "batch_id", _ints("input_ids").alias("input_ids"), _ints("labels").alias("labels"))


@query("strip_pad")
def q_strip_pad(spark, sf):
    b = _batched(spark, sf)
    p = BA.pad_batches(b, "batch_id", {"input_ids": FE.PAD_ID})
    return p.select("row_id", _ints(FE.strip_pad("input_ids", FE.EOS_ID)).alias("input_ids"))


@query("padding_ratio")
def q_padding_ratio(spark, sf):
    return BA.padding_ratio(_batched(spark, sf), "batch_id", "len")


@query("batch_count")
def q_batch_count(spark, sf):
    return BA.batch_count(_batched(spark, sf), BATCH, bucket_col="bucket", droplast=True)


@query("last_batches")
def q_last_batches(spark, sf):
    return BA.last_batches(_batched(spark, sf), ["bucket", "batch_in_bucket"], 30).select("row_id", "batch_id")


@query("same_len_batches")
def q_same_len_batches(spark, sf):
    f = _feature_rows(spark, sf)
    f = f.withColumn("ctx_len", F.size(FE.flatten_eos(F.slice("turn_ids", 1, F.size("turn_ids") - 1))))
    return BA.same_len_batches(f, "row_id", "ctx_len", 4).select("row_id", "ctx_len", "batch_in_len")


def _chunked(spark, sf):
    return BA.chunk_ids(_turn_rows(spark, sf), [F.col("row_id")], chunk_size=100)


@query("chunk_ids")
def q_chunk_ids(spark, sf):
    return _chunked(spark, sf).select("row_id", "chunk_id")


@query("rank_slice")
def q_rank_slice(spark, sf):
    return BA.rank_slice(_chunked(spark, sf), "chunk_id", rank=1, world=4).select("row_id", "chunk_id")


@query("class_weights")
def q_class_weights(spark, sf):
    cw = BA.class_weights(_chunked(spark, sf), "chunk_id", "reward", exponent=1.0)
    return cw.select("chunk_id", "reward", "cnt", F.round("weight", 6).alias("weight"), "num_samples")


@query("weighted_sample")
def q_weighted_sample(spark, sf):
    ch = _chunked(spark, sf)
    cw = BA.class_weights(ch, "chunk_id", "reward")
    rows = ch.join(cw.select("chunk_id", "reward", "weight"), ["chunk_id", "reward"])
    ns = cw.select("chunk_id", "num_samples").distinct()
    return BA.weighted_sample(rows, "chunk_id", "row_id", "weight", ns)


WEIGHTED = dict(epochs=4, decrease=0.4, batch_size=8, bucket_size=40)


@query("weighted_epochs")
def q_weighted_epochs(spark, sf):
    """Batches of four epochs, exponents 1 to 0; the length is that of the response in characters."""
    x = _turn_rows(spark, sf).select("row_id", "reward", F.length(F.element_at("turns", -1)).alias("len"))
    x = BA.chunk_ids(x, [F.col("row_id")], chunk_size=100)
    return BA.weighted_epochs(x, "chunk_id", "row_id", "reward", "len", **WEIGHTED)


@query("concat_candidates")
def q_concat_candidates(spark, sf):
    """Context: the first turn; candidates: the other turns of the conversation."""
    e = FE.encode_texts(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", _vocab(spark, sf))
    ctx = e.filter(F.col("turn") == 0).select("conv_id", F.col("ids").alias("context_ids"))
    cand = e.filter(F.col("turn") > 0).select("conv_id", "turn", F.col("ids").alias("candidate_ids"))
    return FE.concat_candidates(ctx, cand, ["conv_id"]).select("conv_id", "turn", _ints("input_ids").alias("input_ids"))


@query("rerank_best")
def q_rerank_best(spark, sf):
    r = SC.rerank_best(AD.candidates(spark, sf))
    return r.select("context_id", "cand_id", F.round("score", 6).alias("score"))


@query("macro_f1")
def q_macro_f1(spark, sf):
    m = SC.macro_f1(AD.value_predictions(spark, sf))
    return m.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("mae", 6).alias("mae"))


@query("corpus_ppl")
def q_corpus_ppl(spark, sf):
    p = SC.corpus_ppl(AD.token_losses(spark, sf))
    return p.select(F.round("loss", 6).alias("loss"), F.round("ppl", 6).alias("ppl"))


@query("checkpoint_eval")
def q_checkpoint_eval(spark, sf):
    v = AD.value_predictions(spark, sf).withColumn(
        "ckpt", F.concat(F.lit("GP2-pretrain-step-"), (F.col("step") * 1000).cast("string"), F.lit(".pkl")))
    v = v.withColumn("step", SC.checkpoint_step("ckpt"))
    m = SC.macro_f1(v, keys=["step"])
    return m.select("step", F.round("macro_f1", 6).alias("macro_f1"), F.round("mae", 6).alias("mae"))


@query("checkpoint_report")
def q_checkpoint_report(spark, sf):
    """Both halves per checkpoint: F1 and MAE, loss and perplexity."""
    step = lambda c: F.concat(F.lit("GP2-pretrain-step-"), (c * 1000).cast("string"), F.lit(".pkl"))
    v = AD.value_predictions(spark, sf).withColumn("ckpt", step(F.col("step"))).withColumn("step", SC.checkpoint_step("ckpt"))
    t = AD.token_losses(spark, sf).withColumn("ckpt", step(F.col("batch_id") % 5)).withColumn("step", SC.checkpoint_step("ckpt"))
    r = SC.checkpoint_eval(v, t)
    return r.select("step", *[F.round(c, 6).alias(c) for c in ("macro_f1", "mae", "loss", "ppl")])


@query("refined_rows")
def q_refined_rows(spark, sf):
    """Refinement flow end to end: tags, weights and rewards of state/action rows."""
    r = CO.refined_rows(MAT(AD.state_action(spark, sf), "state-action"), AD.next_state_emotions(spark, sf), bland_top=100)
    return r.select("conv_id", "turn", "source", "target", "next_state", F.round("reward", 6).alias("reward"))


@query("history_final")
def q_history_final(spark, sf):
    return SC.history_final(AD.history_messages(spark, sf))


@query("history_window")
def q_history_window(spark, sf):
    return SC.history_window(AD.history_messages(spark, sf))


# --- streaming (ST1, ST2): run to completion, read the written result ---------
from convkit.streaming import admission as SA  # noqa: E402
from convkit.streaming import history as SH  # noqa: E402
from convkit.streaming import store as ST  # noqa: E402
from convkit.streaming import upserts as UP  # noqa: E402
from convkit.streaming.runner import run_to_table, stream_source  # noqa: E402


@query("history_stream")
def q_history_stream(spark, sf):
    msgs = AD.history_messages_from(stream_source(spark, sf, "conversations"))
    out = run_to_table(SH.history_updates(msgs), "update", tag="history")
    return SH.latest(out)


@query("history_store")
def q_history_store(spark, sf):
    """ST1 with its state in RocksDB."""
    msgs = AD.history_messages_from(stream_source(spark, sf, "conversations"))
    with ST.rocksdb(spark):
        out = run_to_table(ST.stored_updates(msgs), "update", tag="history-store")
    return SH.latest(out)


@query("thread_pairs_stream")
def q_thread_pairs_stream(spark, sf):
    """S2 on streams: the repeated lines come after the first run of each job,
    which then goes on from its state."""
    base = scratch_path(spark, f"thread-stream-{uuid.uuid4().hex[:12]}")
    rows = {"subs": AD.repeated(AD.submissions(spark, sf), "title"), "comments": AD.repeated(AD.comments(spark, sf), "body")}

    def stream(name):
        return spark.readStream.schema(rows[name].schema).parquet(f"{base}/{name}-in")
    for line in (1, 2):
        for name, df in rows.items():
            df.filter(F.col("line_no") == line).write.mode("append").parquet(f"{base}/{name}-in")
        subs = MAT(UP.submission_upserts(stream("subs"), "line_no", f"{base}/subs"), "stream-subs")
        comments = UP.comment_upserts(stream("comments"), subs, "line_no", f"{base}/comments")
    return TH.kept_pairs(MAT(comments, "stream-comments"), subs, **THREAD_PARAMS)


@query("stream_admission")
def q_stream_admission(spark, sf):
    s = SA.admitted_stream(stream_source(spark, sf, "conversations"), AD.submissions(spark, sf))
    out = run_to_table(s.select("month", "name", "n_char", "body"), "append", tag="admission")
    return out.drop("_batch")


@query("stream_quality")
def q_stream_quality(spark, sf):
    s = SA.quality_stream(stream_source(spark, sf, "documents"))
    out = run_to_table(s.select("doc_id", "line_no", "skip_reason"), "append", tag="quality")
    return out.drop("_batch")


# --- file sources and sinks: write table-derived data, read it back ------------
from convkit.sources import files as IO  # noqa: E402
from convkit.sources import xz as XZ  # noqa: E402


def _scratch(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex[:12]}")


@query("dump_scan")
def q_dump_scan(spark, sf):
    base = _scratch(spark, "dumps")
    AD.comments(spark, sf).write.partitionBy("month").option("compression", "bzip2").json(base + "/RC")
    AD.submissions(spark, sf).write.partitionBy("month").option("compression", "bzip2").json(base + "/RS")
    c = IO.read_comments(spark, base + "/RC", partitioned=True)
    s = IO.read_submissions(spark, base + "/RS", partitioned=True)
    adm = TH.comment_admission(c, TH.submission_filter(s))
    return adm.select("month", "name", "n_char", "body")


@query("dump_scan_xz")
def q_dump_scan_xz(spark, sf):
    """IO1, IO2 over xz dumps: month folders of files of several blocks."""
    base = _scratch(spark, "dumps-xz")
    for name, df in (("RC", AD.comments(spark, sf)), ("RS", AD.submissions(spark, sf))):
        body = F.to_json(F.struct(*[c for c in df.columns if c != "month"]))
        XZ.write_lines(df.select("month", body.alias("value")), f"{base}/{name}", block_bytes=1 << 16)
    c = IO.read_comments(spark, base + "/RC", partitioned=True)
    s = IO.read_submissions(spark, base + "/RS", partitioned=True)
    return TH.comment_admission(c, TH.submission_filter(s)).select("month", "name", "n_char", "body")


@query("extract_roundtrip")
def q_extract_roundtrip(spark, sf):
    path = _scratch(spark, "extract")
    _, c = _admitted(spark, sf)
    c = c.select("month", "name", "link_id", "parent_id", "score", "n_char", "body")
    IO.write_extract(c, path)
    back = IO.read_extract(spark, path, c.schema)
    return back.select("month", "name", "n_char", "body")


@query("pair_sink_scan")
def q_pair_sink_scan(spark, sf):
    path = _scratch(spark, "pairs")
    IO.write_pairs(q_thread_pairs(spark, sf), path)
    p = IO.read_pairs(spark, path, ["keys", "context", "response"])
    k = F.split("keys", ",")
    return p.select(F.get(k, 0).alias("sid"), F.get(k, 1).alias("pid"), F.get(k, 2).alias("cid"),
                    F.coalesce("context", F.lit("")).alias("context"), "response")


@query("pairs_multiline")
def q_pairs_multiline(spark, sf):
    """IO7: quoted cells over several lines, as the turns' texts are."""
    path = _scratch(spark, "turns-tsv")
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "role", "text")
    (c.write.option("sep", "\t").option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
      .option("ignoreTrailingWhiteSpace", False).csv(path))
    return IO.read_pairs(spark, path, ["key", "role", "text"]).withColumn("text", F.coalesce("text", F.lit("")))


@query("key_scan")
def q_key_scan(spark, sf):
    path = _scratch(spark, "keys")
    kk = AD.keep_keys(spark, sf)
    kk.select(F.concat_ws("\t", "link_id", "comment_id", "kind").alias("value")).write.option(
        "compression", "gzip").text(path)
    return IO.read_keys(spark, path, task="conv").select("link_id", "comment_id", "kind")


@query("blocklist_scan")
def q_blocklist_scan(spark, sf):
    path = _scratch(spark, "blocklist")
    b = AD.block_subreddits(spark, sf).select(F.upper("entry").alias("value"))
    header = spark.createDataFrame([("# blocked subreddits",)], "value string")
    header.unionByName(b).write.text(path)
    return IO.read_blocklist(spark, path, lower=True)


@query("refs_scan")
def q_refs_scan(spark, sf):
    path = _scratch(spark, "refs")
    r = AD.references(spark, sf)
    # one record per line: texts get the minimal norm (no newline / tab inside)
    r.select(F.concat_ws("\t", "key", F.array_join(F.transform("refs", T.minimal_norm), "\t")).alias("value")) \
     .write.text(path)
    back = IO.read_refs(spark, path, AD.hypotheses(spark, sf))
    return back.select("key", F.array_join("refs", "\t").alias("refs"))


@query("multi_target_scan")
def q_multi_target_scan(spark, sf):
    path = _scratch(spark, "multitarget")
    r = AD.references(spark, sf)
    # one record per line: texts get the minimal norm (no newline / tab inside)
    r.select(F.concat_ws("\t", "key", F.array_join(F.transform("refs", T.minimal_norm), "\t")).alias("value")) \
     .write.text(path)
    return IO.read_multi_target(spark, path, norm=True)


@query("feature_sink")
def q_feature_sink(spark, sf):
    path = _scratch(spark, "features")
    f = _feature_rows(spark, sf).select("row_id", _ints(FE.flatten_eos("turn_ids")).alias("input_ids"))
    IO.write_features(f, path, [F.col("row_id")], chunk_size=100)
    back = spark.read.parquet(path + "/chunks")
    return back.select("row_id", F.col("chunk_id").cast("long").alias("chunk_id"), "input_ids")


@query("report_sink")
def q_report_sink(spark, sf):
    path = _scratch(spark, "report")
    rep = q_system_report(spark, sf)
    IO.write_report(rep, path)
    return IO.read_report(spark, path, rep.schema)


# --- remaining inventory items -------------------------------------------------------

@query("thread_pairs_title")
def q_thread_pairs_title(spark, sf):
    """PF8: the submission title as first turn (default extraction option)."""
    return TH.thread_pairs(AD.comments(spark, sf), AD.submissions(spark, sf), **dict(THREAD_PARAMS, use_title=True))


@query("bleu_sentence_mean")
def q_bleu_sentence_mean(spark, sf):
    """Mean sentence BLEU per system."""
    s = ME.bleu_sentence(_grams(spark, sf))
    return s.groupBy("system").agg(*[F.round(F.avg(f"bleu{k}"), 6).alias(f"bleu{k}") for k in range(1, 5)])


@query("kth_count")
def q_kth_count(spark, sf):
    """Trigram count at 0-based rank 100 (the bland threshold)."""
    return CO.kth_count(CO.trigram_freq(AD.state_action(spark, sf)), 100)


@query("ngram_entropy_head")
def q_ngram_entropy_head(spark, sf):
    """T5: entropy and mean length per system over its first n_lines cleaned
    hypotheses, in key order."""
    hy = ME.first_lines(_texts(spark, sf), N_LINES)
    ent = NS.ngram_entropy(NS.ngram_counts(hy, "text", 4, keys=["system"]), keys=["system"])
    return (ent.join(NS.avg_len(hy, "text", keys=["system"]), "system")
               .select("system", "n", F.round("entropy", 6).alias("entropy"), F.round("avg_len", 6).alias("avg_len")))


@query("digest_targets")
def q_digest_targets(spark, sf):
    """SHA-2 of the normalised turns, by which discard targets are named
    (256 bits here; the bits are a parameter)."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.sha2(T.gpt_norm(T.minimal_norm("text")), 256).alias("hash"))


@query("hyp_scan")
def q_hyp_scan(spark, sf):
    """IO9: a line-aligned hypothesis file per system and its key file (one
    record per line, written as ordered part files by a distributed sort), read
    back by line number."""
    base = _scratch(spark, "hyps")
    out = None
    for system in ("last", "first"):
        h = AD.hypotheses(spark, sf).filter(F.col("system") == system).orderBy("line_no")
        h.select(T.minimal_norm("hyp").alias("value")).write.text(f"{base}/{system}/hyp")
        h.select(F.col("key").alias("value")).write.text(f"{base}/{system}/keys")
        one = IO.read_hypotheses(spark, f"{base}/{system}/hyp", f"{base}/{system}/keys", system)
        out = one if out is None else out.unionByName(one)
    return out
