"""Instance quality rules (PF6), skip audit (PF7), block words (J7) and
turn weights (J6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convkit.functions import text as T
from convkit.functions.ngrams import ngrams
from convkit.session import materialize

# Fixed rule limits (must equal the original filter).
MAX_WORD_CHARS = 30
MAX_SRC_TGT_TOKENS = 200
ALLCAPS_PATTERN = "[A-Z]{5,}"
TAGS_PATTERN = "[\\[\\]\\(\\)]"
SKIP_REASONS = ["offensive", "emptytarget", "longword", "toolong", "url", "tags", "allcaps", "repetitions"]


# A block phrase stands alone: no letter, digit or underscore next to it.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _entries(words: list[str]) -> list[str]:
    return sorted({w.strip() for w in words if w.strip() and not w.startswith("#")}, key=lambda w: (-len(w), w))


def blockword_regex(words: list[str]) -> str | None:
    """Whole-phrase, any-case alternation for a small phrase list. Phrases are
    literal, punctuation included."""
    ws = _entries(words)
    if not ws:
        return None
    quoted = "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in ws)
    return f"(?iu){_BEFORE}(?:{quoted}){_AFTER}"


def has_repetition(tokens: Column) -> Column:
    """Three equal consecutive tokens somewhere in the array."""
    k = F.greatest(F.size(tokens) - 2, F.lit(0))
    a, b, c = F.slice(tokens, 1, k), F.slice(tokens, 2, k), F.slice(tokens, 3, k)
    e1 = F.zip_with(a, c, lambda x, y: x == y)
    e2 = F.zip_with(b, c, lambda x, y: x == y)
    return F.exists(F.zip_with(e1, e2, lambda x, y: x & y), lambda x: x)


def skip_reason(src, tgt, block_regex: str | None = None, leaves_only: bool = False) -> Column:
    """PF6: first matching rule wins; NULL means the instance is kept."""
    src, tgt = T._c(src), T._c(tgt)
    tt = T.words(tgt)
    n_src = T.n_words(src)
    srctgt = F.concat(src, F.lit(" "), tgt)
    rules: list[tuple[str, Column]] = []
    if block_regex and not leaves_only:
        rules.append(("offensive", tgt.rlike(block_regex)))
    rules += [
        ("emptytarget", F.size(tt) <= 1),
        ("longword", F.exists(tt, lambda w: F.length(w) > MAX_WORD_CHARS)),
        ("toolong", (n_src + F.size(tt)) > MAX_SRC_TGT_TOKENS),
        ("url", srctgt.contains(T.URL_TOKEN)),
        ("tags", srctgt.rlike(TAGS_PATTERN)),
        ("allcaps", srctgt.rlike(ALLCAPS_PATTERN)),
        ("repetitions", has_repetition(tt)),
    ]
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, cond in rules[1:]:
        out = out.when(cond, F.lit(name))
    return out


def quality_filter(pairs: DataFrame, src: str = "src", tgt: str = "tgt",
                   block_regex: str | None = None, leaves_only: bool = False) -> DataFrame:
    """Adds ``skip_reason`` ('keep' when no rule fires)."""
    return pairs.withColumn("skip_reason", F.coalesce(skip_reason(src, tgt, block_regex, leaves_only), F.lit("keep")))


def skip_audit(rejected: DataFrame, by=("skip_reason",)) -> DataFrame:
    """PF7: rejected instances are data; count them by reason (and more keys)."""
    return rejected.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# What stands between words.
_GAP = r"[^\p{L}\p{N}_]+"


def _signs(low) -> Column:
    """The distinct characters of a lower-cased text but words and white space."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(low, r"(?U)[\p{L}\p{N}_\s]+", ""), ""), lambda w: w != ""))


# Words of a phrase that find it together; longer phrases have several such runs.
ANCHOR_WORDS = 4


def phrase_candidates(df: DataFrame, key: str, text_col: str, block_words: DataFrame) -> DataFrame:
    """(key, phrase) of texts that hold all words of a phrase in a row.

    A phrase stands between characters of no word, so its words are whole
    words of the text, one after the other. Up to ``ANCHOR_WORDS`` of them are
    looked up as one run: a text meets as many phrases as it has such runs, not
    every phrase that shares a word with it. A longer phrase is found by its
    run in the fewest texts, a phrase without words by its rarest character."""
    bl = block_words.select(F.trim("entry").alias("phrase")).where("phrase <> '' and phrase not like '#%'").distinct()
    word = F.filter(F.split(F.lower("phrase"), _GAP), lambda w: w != "")
    bl = bl.withColumn("_w", word).withColumn("n", F.least(F.size("_w"), F.lit(ANCHOR_WORDS)))
    runs = F.lit(None).cast("array<string>")
    for n in range(1, ANCHOR_WORDS + 1):
        runs = F.when(F.col("n") == n, ngrams("_w", n)).otherwise(runs)
    parts = bl.select("phrase", "n", F.explode(F.when(F.col("n") > 0, F.array_distinct(runs)).otherwise(_signs(F.lower("phrase")))).alias("g"))
    # texts are cut into runs of the lengths that the list has: a single value of a few numbers
    lengths = bl.agg(F.collect_set("n")).scalar()
    tok = df.select(F.col(key).alias("_k"), F.lower(text_col).alias("_t"), lengths.alias("_n")).where(F.size("_n") > 0)
    tok = tok.withColumn("_w", F.filter(F.split("_t", _GAP), lambda w: w != ""))
    cut = lambda n, g: F.when(F.array_contains("_n", n), F.transform(F.array_distinct(g), lambda x: F.struct(F.lit(n).alias("n"), x.alias("g")))) \
                        .otherwise(F.array().cast("array<struct<n:int,g:string>>"))
    near = tok.select("_k", F.explode(F.concat(cut(0, _signs(F.col("_t"))), *[cut(n, ngrams("_w", n)) for n in range(1, ANCHOR_WORDS + 1)])).alias("x"))
    near = near.select("_k", "x.n", "x.g")
    # a phrase of one run needs no choice; runs that no other phrase has go before the count
    several = parts.withColumn("_one", F.count(F.lit(1)).over(Window.partitionBy("phrase")) == 1)
    one, more = several.where("_one").drop("_one"), several.where("not _one").drop("_one")
    freq = near.join(more.select("n", "g").distinct(), ["n", "g"], "left_semi").groupBy("n", "g").agg(F.count(F.lit(1)).alias("df"))
    rarest = more.join(freq, ["n", "g"], "left").groupBy("phrase", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("x"))
    rarest = one.unionByName(rarest.where("x.df > 0").select("phrase", "n", F.col("x.g").alias("g")))
    return near.join(rarest, ["n", "g"]).select(F.col("_k").alias(key), "phrase")


def blockword_hits(df: DataFrame, key: str, text_col: str, block_words: DataFrame) -> DataFrame:
    """J7 for large lists: the rule of :func:`blockword_regex` as a join.

    Texts meet phrases on the phrase's words in a row (:func:`phrase_candidates`),
    then the whole phrase is confirmed in the text. ``key`` must identify a
    row. ``df`` is written once, so what made it runs once. Returns it with a
    boolean ``blocked`` column."""
    df = materialize(df, "texts")
    cand = phrase_candidates(df, key, text_col, block_words).withColumnRenamed(key, "_k")
    texts = df.select(F.col(key).alias("_k"), F.col(text_col).alias("_t"))
    quoted = F.concat(F.lit(f"(?iu){_BEFORE}\\Q"), F.replace(F.col("phrase"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E{_AFTER}"))
    hits = texts.join(cand, "_k").where(F.rlike("_t", quoted)).select("_k").distinct().withColumn("blocked", F.lit(True))
    return (df.join(hits, df[key] == hits["_k"], "left").drop("_k")
              .withColumn("blocked", F.coalesce(F.col("blocked"), F.lit(False))))


def turn_weights(pairs: DataFrame, discard_hashes: DataFrame | None, block_regex: str | None = None,
                 bits: int = 224, turns_col: str = "turns") -> DataFrame:
    """Each turn gets weight 0.0 when its SHA-2 digest is a discard
    target or a block word occurs in it, else 1.0; the turn text becomes
    ``'<w> <text>'``. ``pairs`` must have a unique ``cid``.

    Without a hash list this is a projection. With one, the turns are
    exploded once, each with its row, and regrouped after the lookup, so the
    lineage of ``pairs`` runs once."""
    def weighted(t, hit):
        bad = hit if block_regex is None else hit | t.rlike(block_regex)
        return F.concat(F.when(bad, "0.0 ").otherwise("1.0 "), t)
    if discard_hashes is None:
        return pairs.withColumn(turns_col, F.transform(turns_col, lambda t: weighted(t, F.lit(False))))
    rest = [c for c in pairs.columns if c != turns_col]
    ex = pairs.select("cid", F.struct(*rest).alias("_row"), F.posexplode_outer(turns_col).alias("pos", "t"))
    dh = discard_hashes.select(F.col("hash").alias("h")).distinct().withColumn("hit", F.lit(True))
    ex = ex.withColumn("h", F.sha2("t", bits)).join(dh, "h", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", weighted(F.col("t"), F.coalesce("hit", F.lit(False))).alias("t")))
    w = ex.groupBy("cid").agg(F.first("_row").alias("_row"), F.sort_array(F.collect_list(item)).alias("_w"))
    return w.select("_row.*", F.transform("_w", lambda x: x["t"]).alias(turns_col)).select(*pairs.columns)
