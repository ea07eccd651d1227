"""Thread extraction: admission (PF1-PF4), joins J1-J5, ancestor chains
(J3), pair assembly and extraction statistics (A17, A18).

Every join carries ``month``: a month is the unit of work, so a comment
never sees a parent or submission from another month. All keys include the
unique comment name, so a hot thread does not make a hot join key; the one
per-thread join (submission metadata) is a lookup against one row per key,
which AQE splits when the probe side is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convkit.functions import text as T
from convkit.operators import quality as Q

TAG_COMMENT = "t1_"
TAG_SUBMISSION = "t3_"


def last_wins(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key, as a dictionary filled in file order keeps it: the
    row with the greatest ``order`` (a line number, say). Rows without order,
    or with the same, are put in order of their contents, so that a retried
    task keeps the same one. Partial aggregation keeps a repeated key to one
    row per task before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    place = F.struct(*([order] if order else []), *rest)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_v"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_v.{k}").alias(k) for k in df.columns if k != order])


def submission_filter(subs: DataFrame, min_comments: int = 2, order: str | None = None) -> DataFrame:
    """PF1: keep submissions with >= 2 comments; title gets the minimal norm.
    Of repeated submissions the last one that passes is kept."""
    kept = last_wins(subs.filter(F.col("num_comments") >= min_comments), ["month", "id"], order)
    return (kept.withColumn("title", T.minimal_norm("title"))
                .withColumn("sid", F.concat(F.lit(TAG_SUBMISSION), F.col("id"))))


def comment_admission(comments: DataFrame, subs: DataFrame, dep_keys: DataFrame | None = None,
                      order: str | None = None, once: bool = True) -> DataFrame:
    """PF2 + J1: extract-stage comment filter.

    ``subs`` must already be filtered by :func:`submission_filter`. Adds
    ``name`` ('t1_' + id) and ``n_char`` (raw body length). Of repeated
    comments the last one that passes is kept, unless ``once`` is false (a
    stream decides row by row; :func:`last_wins` then goes over its table).
    ``dep_keys`` (link_id, comment_id) are the extract stage's keys."""
    c = comments.filter(F.col("id").isNotNull() & F.col("link_id").isNotNull()
                        & F.col("parent_id").isNotNull() & F.col("body").isNotNull())
    c = c.withColumn("name", F.concat(F.lit(TAG_COMMENT), F.col("id")))
    if dep_keys is not None:
        k = dep_keys.select("link_id", F.col("comment_id").alias("name")).distinct()
        c = c.join(k, ["link_id", "name"], "left_semi")
    c = c.filter((F.col("body") != "[deleted]") & ~F.col("body").contains(">") & ~F.col("body").contains("&gt;"))
    s = subs.select("month", F.col("sid").alias("link_id"))
    c = c.join(s, ["month", "link_id"], "left_semi")
    c = c.withColumn("n_char", F.length("body")).withColumn("body", T.minimal_norm("body"))
    c = c.filter(T.n_words("body") >= 2)
    return last_wins(c, ["month", "link_id", "name"], order) if once else c


def leaf_comments(comments: DataFrame) -> DataFrame:
    """Comments that are nobody's parent (within month and thread)."""
    parents = comments.select("month", "link_id", F.col("parent_id").alias("name")).distinct()
    return comments.join(parents, ["month", "link_id", "name"], "left_anti")


def comment_meta(comments: DataFrame, subs: DataFrame) -> DataFrame:
    """Subreddit / domain / title of each comment's submission ('' if missing)."""
    s = subs.select("month", F.col("sid").alias("link_id"),
                    T.subreddit_of("permalink").alias("subreddit"),
                    F.lower(F.col("domain")).alias("domain"),
                    F.col("title"), F.lit(True).alias("has_submission"))
    return (comments.join(s, ["month", "link_id"], "left")
                    .withColumn("subreddit", F.coalesce("subreddit", F.lit("")))
                    .withColumn("domain", F.coalesce("domain", F.lit("")))
                    .withColumn("has_submission", F.coalesce("has_submission", F.lit(False))))


def score_of(col="score") -> Column:
    """PF3: NULL / unparsable score counts as 0."""
    return F.coalesce(T._c(col).cast("string").try_cast("long"), F.lit(0).cast("long"))


def _len_ok(max_len: int, max_len_type: str) -> Column:
    if max_len_type == "c":
        return F.col("n_char") <= max_len
    return T.n_words("body") <= max_len


def ancestor_chains(cands: DataFrame, comments: DataFrame, max_depth: int = 10, max_len: int = 30,
                    max_len_type: str = "w", live: Column | None = None) -> DataFrame:
    """Bounded ancestor chain of each candidate comment.

    Unrolled left joins child -> parent on (month, link_id, name). A comment
    longer than ``max_len`` cuts the chain (itself included); a parent that
    is not an admitted comment ends it. Adds ``turns`` (root first) and
    ``top_parent`` (parent of the topmost kept comment; a submission id when
    the chain reached the thread root). Candidates that are not ``live`` get
    no chain. ``comments`` hold each name once (see :func:`last_wins`).
    """
    ok = _len_ok(max_len, max_len_type)
    edges = comments.select("month", "link_id", F.col("name").alias("_pn"),
                            F.col("parent_id").alias("_pp"), F.col("body").alias("_pb"), ok.alias("_pok"))
    f = (cands.withColumn("_ok", ok if live is None else ok & live)
              .withColumn("turns", F.when(F.col("_ok"), F.array("body")).otherwise(F.array().cast("array<string>")))
              .withColumn("top_parent", F.when(F.col("_ok"), F.col("parent_id")))
              .withColumn("_open", F.col("_ok"))
              .drop("_ok"))
    for _ in range(2, max_depth + 1):
        nxt = F.when(F.col("_open") & F.col("top_parent").startswith(TAG_COMMENT), F.col("top_parent"))
        f = f.withColumn("_pn", nxt).join(edges, ["month", "link_id", "_pn"], "left")
        ext = F.col("_pp").isNotNull() & F.coalesce(F.col("_pok"), F.lit(False))
        f = (f.withColumn("turns", F.when(ext, F.concat(F.array("_pb"), F.col("turns"))).otherwise(F.col("turns")))
              .withColumn("top_parent", F.when(ext, F.col("_pp")).otherwise(F.col("top_parent")))
              .withColumn("_open", ext)
              .drop("_pn", "_pp", "_pb", "_pok"))
    return f.drop("_open")


def conv_instances(comments: DataFrame, subs: DataFrame, *, max_len: int = 30, max_len_type: str = "w",
                   min_depth: int = 2, max_depth: int = 10, min_score: int = 0, use_title: bool = True,
                   leaves_only: bool = False, clean: bool = False, keep_keys: DataFrame | None = None,
                   block_subreddits: DataFrame | None = None, block_regex: str | None = None,
                   block_words: DataFrame | None = None,
                   discard_hashes: DataFrame | None = None, hash_bits: int = 224) -> DataFrame:
    """Conversation stage for admitted comments: every candidate with the
    first ``skip_reason`` that rejected it (NULL = kept).

    Columns: month, sid, pid, cid, subreddit, domain, skip_reason, turns,
    context (array), response. ``block_regex`` serves a short phrase list,
    ``block_words`` (entry) a list of any length.

    One pass: a candidate that is rejected before its chain is built keeps
    its reason and has a chain that never opens.
    """
    c = comments
    if keep_keys is not None:
        k = keep_keys.select("link_id", F.col("comment_id").alias("name")).distinct()
        c = c.join(k, ["link_id", "name"], "left_semi")
    if leaves_only:
        c = leaf_comments_from(c, comments)
    c = comment_meta(c, subs)
    reason = F.lit(None).cast("string")
    if block_subreddits is not None:
        bl = block_subreddits.select(F.lower("entry").alias("subreddit")).distinct().withColumn("_bad", F.lit(True))
        c = c.join(bl, "subreddit", "left")
        reason = (F.when(F.col("subreddit") == "", F.lit("missing"))
                   .when(F.coalesce(F.col("_bad"), F.lit(False)), F.lit("bad_subreddit")))
    reason = F.coalesce(reason, F.when(score_of("score") < min_score, F.lit("low_score")))
    c = c.withColumn("_early", reason)
    ch = ancestor_chains(c, comments, max_depth=max_depth, max_len=max_len, max_len_type=max_len_type,
                         live=F.col("_early").isNull()).withColumn("skip_reason", F.col("_early"))
    if use_title:
        root = F.coalesce(F.col("top_parent").startswith(TAG_SUBMISSION), F.lit(False))
        ch = (ch.withColumn("skip_reason", F.coalesce("skip_reason", F.when(root & ~F.col("has_submission"), F.lit("exception"))))
                .withColumn("turns", F.when(root & F.col("has_submission"),
                                            F.concat(F.array(F.concat(F.lit("title: "), F.col("title"))), F.col("turns")))
                                      .otherwise(F.col("turns"))))
    ch = ch.withColumn("skip_reason", F.coalesce("skip_reason",
                                                 F.when(F.size("turns") < min_depth, F.lit("min_depth"))))
    ch = ch.withColumn("turns", F.transform("turns", lambda t: T.gpt_norm(t))).withColumn("cid", F.col("name"))
    if leaves_only and clean:
        if block_words is not None:
            ch = _weigh_by_list(ch, discard_hashes, block_words, hash_bits)
        else:
            ch = Q.turn_weights(ch, discard_hashes, block_regex, bits=hash_bits)
    ch = (ch.withColumn("context", F.slice("turns", 1, F.greatest(F.size("turns") - 1, F.lit(0))))
            .withColumn("response", F.try_element_at("turns", F.lit(-1))))
    if clean:
        src, tgt = T.join_turns("context"), F.coalesce("response", F.lit(""))
        rule = Q.skip_reason(src, tgt, block_regex, leaves_only)
        if block_words is not None and not leaves_only:
            # the list's verdict comes first, as the pattern's does
            ch = Q.blockword_hits(ch, "cid", "response", block_words)
            rule = F.coalesce(F.when(F.col("blocked"), F.lit("offensive")), rule)
        ch = ch.withColumn("skip_reason", F.coalesce("skip_reason", rule))
    # what was rejected before the chain has no turns
    empty, early = F.array().cast("array<string>"), F.col("_early").isNotNull()
    return ch.select("month", F.col("link_id").alias("sid"), F.col("parent_id").alias("pid"), "cid", "subreddit", "domain",
                     "skip_reason", F.when(early, empty).otherwise(F.col("turns")).alias("turns"),
                     F.when(early, empty).otherwise(F.col("context")).alias("context"),
                     F.when(~early, F.col("response")).alias("response"))


def _weigh_by_list(ch: DataFrame, discard_hashes: DataFrame | None, block_words: DataFrame, bits: int) -> DataFrame:
    """turn_weights with the block list as a table: its phrases are looked up
    in each turn, and a hit lowers the weight that the hashes gave."""
    ch = Q.turn_weights(ch, discard_hashes, None, bits=bits)
    ex = ch.select("cid", F.posexplode("turns").alias("pos", "t")).withColumn("k", F.struct("cid", "pos"))
    bad = (Q.blockword_hits(ex.withColumn("body", F.substring("t", 5, 1 << 30)), "k", "body", block_words).where("blocked")
             .groupBy("cid").agg(F.collect_set("pos").alias("_bad")))          # positions of one chain
    flag = lambda t, i: F.when(F.array_contains("_bad", i), F.concat(F.lit("0.0 "), F.substring(t, 5, 1 << 30))).otherwise(t)
    return ch.join(bad, "cid", "left").withColumn(
        "turns", F.when(F.col("_bad").isNull(), F.col("turns")).otherwise(F.transform("turns", flag))).drop("_bad")


def leaf_comments_from(cands: DataFrame, all_comments: DataFrame) -> DataFrame:
    """Leaf test against the parents of *all* extracted comments."""
    parents = all_comments.select("month", "link_id", F.col("parent_id").alias("name")).distinct()
    return cands.join(parents, ["month", "link_id", "name"], "left_anti")


def thread_pairs(comments: DataFrame, subs: DataFrame, **kw) -> DataFrame:
    """L1 end to end: admitted comments -> kept (context, response) pairs.

    ``comments`` and ``subs`` are raw rows; admission is applied here.
    ``dep_keys`` limit the extract stage and ``keep_keys`` the conversation
    stage; ``order`` names a column that says which of repeated rows is last.
    Output: month, sid, pid, cid, context (' EOS '-joined), response.
    """
    materialize_extract = kw.pop("materialize_extract", True)
    order = kw.pop("order", None)
    s = submission_filter(subs, order=order)
    c = comment_admission(comments, s, kw.pop("dep_keys", None), order)
    if materialize_extract:
        # extract-stage boundary: the admitted comments are read by the leaf
        # test, the metadata join and every level of the chain; write them
        # once (compact, normalised) instead of re-scanning the dumps per use
        from convkit.session import materialize
        s, c = materialize(s, "extract-subs"), materialize(c, "extract-comments")
    return kept_pairs(c, s, **kw)


def kept_pairs(comments: DataFrame, subs: DataFrame, **kw) -> DataFrame:
    """L1 from what the extract stage admitted."""
    inst = conv_instances(comments, subs, **kw)
    return (inst.filter(F.col("skip_reason").isNull())
                .select("month", "sid", "pid", "cid", T.join_turns("context").alias("context"), "response"))


def extract_stats(comments: DataFrame, subs: DataFrame) -> DataFrame:
    """Extract-stage statistics per month: comments kept / read and
    submissions kept / read."""
    s_kept = submission_filter(subs)
    c_kept = comment_admission(comments, s_kept)
    def cnt(df, name):
        return df.groupBy("month").agg(F.count(F.lit(1)).alias(name))
    return (cnt(c_kept, "comments_kept").join(cnt(comments, "comments_read"), "month", "full")
            .join(cnt(s_kept, "subs_kept"), "month", "full").join(cnt(subs, "subs_read"), "month", "full")
            .na.fill(0))


def conv_stats(instances: DataFrame, extracted: DataFrame, shard=lambda link: F.lit("0")) -> DataFrame:
    """Per (month, shard) selected / total / avg response tokens, plus a
    rollup row per month with shard 'all' (sums, blank average).

    ``total`` counts the comments that the extract stage wrote
    (``extracted``: month, link_id), whatever leaf or key filter the
    instances went through; ``shard`` maps a thread id to its shard."""
    kept = F.col("skip_reason").isNull()
    sel = instances.select("month", shard(F.col("sid")).cast("string").alias("shard"), kept.cast("long").alias("_sel"),
                           F.when(kept, F.size(T.words(F.coalesce("response", F.lit(""))))).alias("_rlen"), F.lit(0).alias("_tot"))
    tot = extracted.select("month", shard(F.col("link_id")).cast("string").alias("shard"), F.lit(0).cast("long").alias("_sel"),
                           F.lit(None).cast("int").alias("_rlen"), F.lit(1).alias("_tot"))
    r = sel.unionByName(tot).rollup("month", "shard").agg(
        F.sum("_sel").alias("selected"), F.sum("_tot").cast("long").alias("total"), F.sum("_rlen").alias("_sum_len"),
        F.grouping("shard").alias("_g"))
    r = r.filter(F.col("month").isNotNull())
    return r.select("month", F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("shard")).alias("shard"),
                    "selected", "total",
                    F.when(F.col("_g") == 1, F.lit(None).cast("double"))
                     .otherwise(F.round(F.col("_sum_len") / F.nullif(F.col("selected"), F.lit(0)), 6)).alias("avg_len"))


def leaf_ratio(comments: DataFrame) -> DataFrame:
    """Distinct parent ids / comments, per month."""
    return comments.groupBy("month").agg(
        (F.countDistinct("parent_id") / F.count(F.lit(1))).alias("leaf_ratio"))
