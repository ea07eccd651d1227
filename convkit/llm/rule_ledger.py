"""Quality rules as a bitmask ledger, native.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule. A policy is a version and a mask: a document is
kept under it if it fails no rule of the mask, so other policies and
ablations (what a policy would keep without one of its rules) are bit
operations on the ledger, never another pass over the texts.

Words are runs without ASCII white space. Repeated three-word windows are
found per document by sorting (window hash, position), so no row leaves its
text's partition.

Defined results: null counts as the empty text, which has no words and fails
``few_words``; rows are judged one by one, so repeats, ties and null ids each
get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# The rules, in bit order, as conditions under which a document fails.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "n_words > 0 and word_chars > 20 * n_words"),
]
# Policies as (version, rules).
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "many_symbols"],
    "v2": [name for name, _ in RULES],
}
POLICY = "v2"


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measurements of every row.

    Windows are compared in two steps: positions whose 36-bit window hashes
    meet, found by one sort of (hash, position) packed in a long, and among
    these the positions whose hashes under another seed meet as well.
    """
    twin = "flatten(filter(zip_with({0}, slice({0}, 2, greatest(size({0}), 1)), (a, b) -> if(a >> 28 = b >> 28, " \
           "array(a & 268435455, b & 268435455), null)), x -> x is not null))"
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select("doc_id", t.alias("_t"))
    d = d.select("doc_id", "_t", F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("_w"),
                 F.expr(r"filter(split(_t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_l"))
    d = d.select("doc_id", F.size("_w").cast("long").alias("n_words"),
                 F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.expr("transform(_w, w -> xxhash64(w))").alias("_h"))
    plain = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    d = d.select(*plain, "_h", F.expr(
        "sort_array(transform(if(n_words < 3, array(), sequence(0L, n_words - 3)), "
        "i -> shiftleft(xxhash64(_h[int(i)], _h[int(i) + 1], _h[int(i) + 2]), 28) | i))").alias("_s"))
    d = d.select(*plain, "_h", F.expr(f"array_distinct({twin.format('_s')})").alias("_p"))
    d = d.select(*plain, F.expr(
        "sort_array(transform(_p, i -> shiftleft(xxhash64(17, _h[int(i)], _h[int(i) + 1], _h[int(i) + 2]), 28) | i))").alias("_s"))
    d = d.select(*plain, F.expr(f"sort_array(array_distinct({twin.format('_s')}))").alias("_p"))
    gaps = "zip_with(_p, slice(_p, 2, greatest(size(_p), 1)), (a, b) -> coalesce(least(b - a, 3L), 3L))"
    return d.select(*plain, F.expr(f"aggregate({gaps}, 0L, (s, x) -> s + x)").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, measurements, and ``failed``: the bits of the rules that fail."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(bit(name)).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, text).withColumn("failed", bits)


def kept(policy: str = POLICY) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """Per policy and rule of it: documents kept by the policy, kept without
    the rule, and failing the rule. One pass of sums over the ledger's bits."""
    rows = []
    for version, rules in (policies or POLICIES).items():
        m = sum(bit(r) for r in rules)
        for r in rules:
            rows.append((version, r, m, bit(r)))
    # all sums in one aggregate: a column per (policy, rule)
    sums = []
    for i, (_, _, m, b) in enumerate(rows):
        f = F.col("failed")
        sums += [F.sum((f.bitwiseAND(F.lit(m)) == 0).cast("long")).alias(f"k{i}"),
                 F.sum((f.bitwiseAND(F.lit(m & ~b)) == 0).cast("long")).alias(f"w{i}"),
                 F.sum((f.bitwiseAND(F.lit(b)) != 0).cast("long")).alias(f"f{i}")]
    cells = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.coalesce(f"k{i}", F.lit(0)).alias("kept"),
                               F.coalesce(f"w{i}", F.lit(0)).alias("kept_without"), F.coalesce(f"f{i}", F.lit(0)).alias("failing"))
                      for i, (v, r, _, _) in enumerate(rows)])
    return led.agg(*sums).select(F.inline(cells))
