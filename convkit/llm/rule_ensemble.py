"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

1. Statistics of each whole text (shares of upper case, symbols, repeated
   words, ...) in one Arrow pass.
2. A small random forest on a bounded labelled sample; every path from a
   root to a node is a conjunctive rule over the statistics.
3. A lasso logistic model over the rules keeps a few of them.
4. The kept rules become one Spark column: sigmoid(bias + sum of weights).

Defined results: null and empty texts have all statistics 0 and get the
score that the rules give those; rows are scored one by one, so repeats,
ties and null ids each get a row; an empty table gives no rows; without
labels of both classes the model has no rule and scores the share of
label 1 (1.0 if there are no labels at all, so nothing is rejected).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convkit.llm import wordhash as H
from convkit.llm.stages import drop, fresh, written

STATS = ["n_words", "word_bytes", "upper_share", "digit_share", "bang_rate", "pipe_rate", "symbol_rate",
         "stop_rate", "next_word_equal", "word_variety", "gram_repeat", "line_repeat", "words_per_line"]
MAX_ROWS = 20_000        # bound of the labelled sample
TREES, DEPTH = 24, 3
REG = 2e-4               # lasso penalty
ACCEPT = 0.3             # predicted 1 from this score on


@dataclass
class Rule:
    """Conjunction of (statistic, is it at most, threshold) and its weight."""
    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, of: str = "") -> Column:
        """``of``: prefix of the statistics' names, such as that of a struct."""
        c = F.lit(True)
        for name, at_most, v in self.terms:
            c = c & ((F.col(of + name) <= v) if at_most else (F.col(of + name) > v))
        return c


@dataclass
class Ensemble:
    rules: list[Rule]
    bias: float

    def score_column(self, of: str = "") -> Column:
        z = F.lit(float(self.bias))
        for r in self.rules:
            z = z + F.when(r.column(of), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return (c[off[1:]] - c[off[:-1]]).astype(float)


def _later_copies(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per row: how many hashes equal an earlier one of the same row."""
    key = H.mix(hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E37_79B9_7F4A_7C15)))
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    return np.bincount(owner[order[again]], minlength=n)[:n].astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """Matrix [row, statistic] of a batch of texts."""
    raw, off = H.text_buffer(column)
    n = len(off) - 1
    starts, ends, rows = H.word_spans(raw, off, "space")
    words = H.hash_bytes(raw, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(rows))
    n_words = np.diff(rows).astype(float)
    per_word = np.maximum(n_words, 1)

    table = np.zeros(256, dtype=np.uint8)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#*$%&<>", b".,;:?"), 1):
        table[list(chars)] = i
    kind = table[raw]
    upper, digit, bang, pipe, symbol, stop = (_per_row(kind == i, off) for i in range(1, 7))
    size = np.maximum(_per_row(H.byte_table("space")[raw], off), 1)
    equal = np.zeros(len(words), dtype=bool)
    equal[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    grams, g_owner, _ = H.gram_hashes(words, rows, 3)

    # lines that hold a word
    line_off = np.unique(np.concatenate([off[:-1], np.flatnonzero(raw == 10) + 1, off[-1:]]))
    line_off = line_off[line_off <= len(raw)]
    first = np.searchsorted(starts, line_off)
    full = np.flatnonzero(np.diff(first) > 0)
    l_owner = owner[first[:-1][full]] if len(full) else np.empty(0, np.int64)
    l_hash = H.hash_bytes(raw, starts[first[:-1][full]], ends[first[1:][full] - 1]) if len(full) else np.empty(0, np.uint64)
    n_lines = np.bincount(l_owner, minlength=n)[:n].astype(float)

    return np.column_stack([
        n_words, size * (n_words > 0) / per_word, upper / size, digit / size, bang / per_word, pipe / per_word,
        symbol / per_word, stop / per_word, np.bincount(owner[equal], minlength=n)[:n] / per_word,
        1 - _later_copies(words, owner, n) / per_word,
        _later_copies(grams, g_owner, n) / np.maximum(np.bincount(g_owner, minlength=n)[:n], 1),
        _later_copies(l_hash, l_owner, n) / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1),
    ]) if n else np.empty((0, len(STATS)))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus one double column per statistic, named ``_q_<statistic>``."""
    kept = [c for c in docs.columns if not c.startswith("_q_")]
    base = docs.select(*kept)
    names = [f"_q_{s}" for s in STATS]

    def run(batches):
        for batch in batches:
            for part in H.slices(batch, text):
                x = statistics(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x[:, i]) for i in range(len(STATS))]],
                                                 names=[*kept, *names])

    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    return base.mapInArrow(run, schema)


_STRUCT = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])


@F.arrow_udf(_STRUCT)
def statistics_of(texts: pa.Array) -> pa.Array:
    """The statistics of a text column as a struct; no other column goes to Python."""
    parts = [statistics(p.column(0)) for p in H.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20)]
    H.give_back()
    x = np.concatenate(parts) if parts else np.empty((0, len(STATS)))
    return pa.StructArray.from_arrays([pa.array(x[:, i]) for i in range(len(STATS))], names=STATS)


def accepted(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ACCEPT or more, with their own columns only."""
    q = fresh(docs, "_q")
    # the marked function is evaluated once, below the rules
    s = docs.withColumn(q, statistics_of.asNondeterministic()(F.col(text)))
    return s.where(model.score_column(f"{q}.") >= ACCEPT).select(*docs.columns)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Statistics and label of at most ``max_rows`` labelled rows that are not
    held out, in the order of a hash of the id."""
    y = (labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
               .select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
               .dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    # max_rows ids of 16 bytes: a bounded broadcast
    return with_statistics(docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(y), "_id"))


def _paths(node, terms=()) -> list[tuple]:
    """All root-to-node paths of a Spark ML tree as conjunctions."""
    out = [terms] if terms else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, v = STATS[split.featureIndex()], float(split.threshold())
        out += _paths(node.leftChild(), (*terms, (name, True, v))) + _paths(node.rightChild(), (*terms, (name, False, v)))
    return out


def _tightest(terms: tuple) -> tuple:
    """One bound per statistic and side."""
    best: dict[tuple[str, bool], float] = {}
    for name, at_most, v in terms:
        k = (name, at_most)
        best[k] = v if k not in best else (min if at_most else max)(best[k], v)
    return tuple(sorted((n, a, v) for (n, a), v in best.items()))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ensemble:
    """Rule ensemble from a bounded labelled sample."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    # the bounded sample in one sorted file: the same rows give the same model
    rows = written(training_rows(docs, labels, max_rows).select("_id", F.col("_y").alias("label"), *[F.col(f"_q_{s}").alias(s) for s in STATS])
                   .repartition(1).sortWithinPartitions("_id"), "rule-sample")
    share = rows.agg(F.avg("label")).first()[0]
    share = 1.0 if share is None else share
    if not 0 < share < 1:
        return Ensemble([], 30.0 if share else -30.0)

    def vectors(columns):
        return rows.select("label", array_to_vector(F.array(*columns)).alias("features")).cache()
    train = vectors([F.col(s) for s in STATS])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=64, subsamplingRate=0.7,
                                    featureSubsetStrategy="onethird").fit(train)
    train.unpersist()
    rules = [Rule(t) for t in sorted({_tightest(p) for t in forest.trees for p in _paths(t._java_obj.rootNode())})]
    train = vectors([r.column().cast("double") for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=REG, maxIter=60, standardization=False).fit(train)
    train.unpersist()
    drop(rows)
    for r, w in zip(rules, lasso.coefficients.toArray()):
        r.weight = float(w)
    return Ensemble([r for r in rules if r.weight != 0.0], float(lasso.intercept))


def score(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ACCEPT on).
    Columns of these names in the input are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted") and not c.startswith("_q_")]
    s = with_statistics(docs.select(*kept), text)
    # the rules name the statistics bare: rename inside a struct-free projection
    bare = s.select(F.struct(*[F.col(c) for c in kept]).alias("_doc"), *[F.col(f"_q_{n}").alias(n) for n in STATS])
    return (bare.select("_doc", model.score_column().alias("score"))
                .select("_doc.*", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")))
