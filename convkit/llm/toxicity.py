"""Toxicity by a classifier chain.

Categories are predicted one after another. The linear model of a category
sees the text's features and the probabilities of all earlier categories.
While training, those probabilities are out-of-fold: each fold is predicted
by models that did not see it, so later models learn from the same kind of
probability that they get when scoring.

Features: presence of each lower-cased word and of each word's first four
bytes (inflected forms share it). Whole texts are read; presence does not
dilute with length, so one insult in a long text weighs what it does in a
short one.

Defined results: null and empty texts have no features and score the
intercepts; repeated rows each get a row; an empty table gives no rows;
columns of the input other than id and text are kept only where asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convkit.llm import wordhash as H

# Seed words that name the category of a row labelled toxic.
# A toxic row without any of them belongs to "coded".
CATEGORY_SEEDS = {
    "insult": ["clown", "idiot", "loser", "moron", "stupid"],
    "contempt": ["disgusting", "pathetic", "scum", "trash", "worthless"],
}
CATEGORIES = ["insult", "contempt", "coded", "toxic"]

MAX_ROWS_PER_CLASS = 4000    # bound of the labelled sample, toxic and clean rows each
MAX_FEATURES = 4_000         # bound of the model: features with the highest log-odds z-score
MIN_ROWS = 3                 # a feature is seen in so many sample rows at least
FOLDS = 3
THRESHOLD = 0.65
PREFIX_BYTES = 4


@dataclass
class Chain:
    """Feature hashes (sorted), weights [category, feature], intercepts and
    chain weights [category, earlier category]."""
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray

    def predict(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Probabilities [n, category] from the (row, feature index) pairs of n rows."""
        out = np.zeros((n, len(CATEGORIES)))
        for c in range(len(CATEGORIES)):
            z = self.bias[c] + np.bincount(row, self.weights[c][col], n) + out[:, :c] @ self.links[c, :c]
            out[:, c] = _sigmoid(z)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def row_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every word and word prefix of a batch, with repeats."""
    import pyarrow.compute as pc
    raw, off = H.text_buffer(pc.utf8_lower(column))
    starts, ends, rows = H.word_spans(raw, off, "letter")
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = H.hash_bytes(raw, starts, ends)
    head = H.mix(H.hash_bytes(raw, starts, np.minimum(ends, starts + PREFIX_BYTES)) ^ H.seeded(1))
    return np.concatenate([row, row]), np.concatenate([whole, head])


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _known(keys: np.ndarray, row: np.ndarray, hashed: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature index) once per row, of the hashes among ``keys``. ``seen``
    is a bitmap over the top 20 bits: it drops most words before the search."""
    near = seen[hashed >> np.uint64(44)]
    row, hashed = row[near], hashed[near]
    at = np.minimum(np.searchsorted(keys, hashed), max(len(keys) - 1, 0))
    hit = keys[at] == hashed if len(keys) else np.zeros(len(hashed), dtype=bool)
    return _distinct(row[hit], at[hit])


def _bitmap(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, dtype=bool)
    seen[keys >> np.uint64(44)] = True
    return seen


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = MAX_ROWS_PER_CLASS) -> DataFrame:
    """At most ``per_class`` toxic and as many clean labelled rows (text, y),
    in the order of a hash of the id. The ids are chosen from the labels
    alone; only the chosen texts are moved."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1)")
    y = y.withColumn("_o", F.xxhash64("_id"))
    chosen = None
    for v in (0, 1):
        part = y.where(F.col("y") == v).orderBy("_o", "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.dropDuplicates(["_id"]).select("_id", "y")
    # at most 2 * per_class ids of 12 bytes: a bounded broadcast
    return docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").select("_id", "text", "y")


def _fit_logistic(row, col, n, n_col, dense, y, use, steps=(120, 160), l1=3e-3):
    """Relaxed lasso: L1 logistic regression over sparse 0/1 features and a
    few dense ones, then a fit without the penalty on the features it keeps.
    ``use`` marks the training rows. The lasso leaves words without signal at
    weight 0, so that the thousands of common words of a long text don't add
    up to a verdict; the second fit undoes the shrinkage of the others, so
    that one such word is enough."""
    w, b, v = np.zeros(n_col), 0.0, np.zeros(dense.shape[1])
    keep = use[row]
    r, c = row[keep], col[keep]
    m = max(int(use.sum()), 1)
    pos = max(float(y[use].sum()), 1.0)
    weight = np.where(y > 0, 0.5 * m / pos, 0.5 * m / max(m - pos, 1.0)) * use
    for penalty, n_steps in zip((l1, 0.0), steps):
        # proximal Adagrad: features seen in few rows still move
        gw, gb, gv = np.full(n_col, 1e-4), 1e-4, np.full(dense.shape[1], 1e-4)
        for _ in range(n_steps):
            z = b + np.bincount(r, w[c], n) + dense @ v
            g = weight * (_sigmoid(z) - y) / m
            dw, db, dv = np.bincount(c, g[r], n_col), g.sum(), dense.T @ g
            gw += dw * dw
            gb += db * db
            gv += dv * dv
            rate = 0.5 / np.sqrt(gw)
            w -= rate * dw
            w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
            b -= 0.5 * db / np.sqrt(gb)
            v -= 0.5 * dv / np.sqrt(gv)
        # the features that go on to the second fit: clear ones only
        kept = np.abs(w) > 0.1 * np.abs(w).max(initial=0)
        w = np.where(kept, w, 0.0)
        some = kept[c]
        r, c = r[some], c[some]
    return w, b, v


def _strongest(df: np.ndarray, df1: np.ndarray, n: int, n1: float, most: int) -> np.ndarray:
    """Features of MIN_ROWS rows or more with the highest z-scores of their log
    odds; df and df1 count all rows and toxic rows."""
    seen = np.flatnonzero(df >= MIN_ROWS)
    a, b = df1[seen] + 0.5, df[seen] - df1[seen] + 0.5
    c, d = n1 - df1[seen] + 0.5, (n - n1) - (df[seen] - df1[seen]) + 0.5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return seen[np.argsort(-z, kind="stable")[:most]]


def fit_chain(texts: list[str | None], toxic: np.ndarray, max_features: int = MAX_FEATURES) -> Chain:
    """Train the chain on a bounded sample."""
    n = len(texts)
    toxic = np.asarray(toxic, dtype=float).reshape(-1)

    def blocks():       # (first row, rows, feature hashes) of some rows at a time
        for i in range(0, n, 256):
            r, k = _distinct(*row_features(pa.array(texts[i:i + 256], pa.large_string())))
            yield r + i, k

    # hashed counts first: only rows and features of promising buckets are held
    shift = np.uint64(64 - 22)
    in_all, in_toxic = np.zeros(1 << 22), np.zeros(1 << 22)
    for r, k in blocks():
        np.add.at(in_all, k >> shift, 1)
        np.add.at(in_toxic, k >> shift, toxic[r])
    near = np.zeros(1 << 22, dtype=bool)
    near[_strongest(in_all, in_toxic, n, toxic.sum(), 4 * max_features)] = True
    del in_all, in_toxic
    parts = [(r[at], k[at]) for r, k in blocks() for at in [near[k >> shift]]]
    row = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    key = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint64)
    keys, at = np.unique(key, return_inverse=True)
    df, df1 = np.bincount(at, minlength=len(keys)), np.bincount(at, toxic[row], len(keys))
    good = np.sort(_strongest(df, df1, n, toxic.sum(), max_features))
    index = np.full(len(keys), -1)
    index[good] = np.arange(len(good))
    col = index[at] if len(at) else np.empty(0, np.int64)
    row, col = row[col >= 0], col[col >= 0]
    keys = keys[good]

    seeds = {k: _word_hashes(v) for k, v in CATEGORY_SEEDS.items()}
    has = {}
    for k, hs in seeds.items():
        idx = np.flatnonzero(np.isin(keys, hs))
        has[k] = np.bincount(row[np.isin(col, idx)], minlength=n)[:n] > 0
    target = {k: toxic * has[k] for k in CATEGORY_SEEDS}
    target["coded"] = toxic * ~np.logical_or.reduce(list(has.values()))
    target["toxic"] = toxic

    fold = np.zeros(n, dtype=np.int64)
    for v in (0, 1):            # every fold has its share of either class
        fold[toxic == v] = np.arange(int((toxic == v).sum())) % FOLDS
    k = len(CATEGORIES)
    weights, bias, links = np.zeros((k, len(keys))), np.zeros(k), np.zeros((k, k))
    oof = np.zeros((n, k))
    for c, name in enumerate(CATEGORIES):
        y, dense = target[name], oof[:, :c]
        for f in range(FOLDS):
            w, b0, v = _fit_logistic(row, col, n, len(keys), dense, y, fold != f)
            p = _sigmoid(b0 + np.bincount(row, w[col], n) + dense @ v)
            oof[fold == f, c] = p[fold == f]
        weights[c], bias[c], links[c, :c] = _fit_logistic(row, col, n, len(keys), dense, y, np.ones(n, dtype=bool))
    return Chain(keys, weights.astype(np.float32), bias, links)


def _word_hashes(words: list[str]) -> np.ndarray:
    return H.word_hashes(pa.array(words), "letter")[0]


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with one probability column per category (``p_<category>``)
    and ``toxic`` (boolean). Map-only: every text is scored where it is read.
    Columns of these names in the input are replaced."""
    out = [f"p_{c}" for c in CATEGORIES]
    kept = [c for c in docs.columns if c not in {*out, "toxic"}]
    base = docs.select(*kept)
    model = docs.sparkSession.sparkContext.broadcast(chain)     # MAX_FEATURES rows at most

    def run(batches):
        m = model.value
        seen = _bitmap(m.keys)
        for batch in batches:
            for part in H.slices(batch, text):
                row, hashed = row_features(part.column(part.schema.get_field_index(text)))
                p = m.predict(*_known(m.keys, row, hashed, seen), part.num_rows)
                cols = [*part.columns, *[pa.array(p[:, i]) for i in range(len(out))], pa.array(p[:, -1] >= THRESHOLD)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *out, "toxic"])

    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.DoubleType()) for c in out],
                           T.StructField("toxic", T.BooleanType())])
    return base.mapInArrow(run, schema)


def rejects(spark, chain: Chain):
    """Function of a text column: true where the last link finds it toxic.
    Only the text goes to Python and only the verdict comes back; the other
    columns stay where they are, whatever their names."""
    model = spark.sparkContext.broadcast(chain)     # MAX_FEATURES rows at most

    @F.arrow_udf(T.BooleanType())
    def verdict(texts: pa.Array) -> pa.Array:
        m = model.value
        seen, out = _bitmap(m.keys), []
        for part in H.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
            row, hashed = row_features(part.column(0))
            out.append(m.predict(*_known(m.keys, row, hashed, seen), part.num_rows)[:, -1] >= THRESHOLD)
        H.give_back()
        return pa.array(np.concatenate(out) if out else np.empty(0, dtype=bool))

    return verdict


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_ROWS_PER_CLASS) -> Chain:
    """Chain from a bounded labelled sample (the only rows that reach the driver)."""
    sample = sorted(labelled_sample(docs, labels, per_class).collect(), key=lambda r: (r["_id"], r["text"] or ""))
    return fit_chain([r["text"] for r in sample], np.array([r["y"] for r in sample], dtype=float))
