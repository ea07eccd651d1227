"""Near-duplicate classes with DartMinHash signatures.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles (words: runs without ASCII white space, case kept) is at least 0.8.
That is the weighted similarity of DartMinHash with weight 1 per distinct
shingle; ``dart.sketch`` takes any weights.

1. Sketch: 160 coordinates in 32 bands of 5, one pass over the texts. A pair
   at 0.8 shares a band with probability 1 - 4e-6.
2. Candidate clusters: each band bucket is a star around its least text
   hash (no pairs are made), and stars that share texts are joined.
3. Exact links inside a cluster: its texts are dealt into blocks of bounded
   size, which intersect shingle sets exactly. A block tests every pair of
   texts that isn't connected yet and reports a spanning set of links, never
   all pairs. Larger clusters have several blocks; every block also gets a
   few common leaders, so the bulk of a large group of copies becomes one
   component in a linear pass, and then the texts outside that component are
   tested against all texts of the cluster, block by block.
4. Classes: connected components of the exact links. Exact copies have the
   same key (md5 of the text) from the start and stand for one text.

Defined results: null counts as the empty text; texts without words are in
a class with their exact copies only; texts of 1 to 4 words have one shingle,
all their words; a class id is the least doc_id of the class (nulls come
first), rows without doc_id included; repeated rows are exact copies; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convkit.llm import dart
from convkit.llm import wordhash as H
from convkit.llm.stages import components, drop, fresh, written

WORDS = 5
SIMILARITY = 0.8
COORDINATES, ROWS_PER_BAND = 160, 5
BLOCK = 256          # texts of a block
LEADERS = 8          # texts that every block of a large cluster has


def bands(docs: DataFrame, words: int = WORDS, k: int = COORDINATES, per_band: int = ROWS_PER_BAND) -> DataFrame:
    """(rid, band): the band hashes of every text with words; rid is the
    text's 64-bit hash. A chance collision of two rids only widens a
    candidate cluster."""
    def run(batches):
        for batch in batches:
            for part in H.slices(batch, "text", 1 << 20):
                h, rows = H.word_hashes(part.column(1))
                g, owner, _ = H.gram_hashes(h, rows, words)
                has = np.flatnonzero(np.diff(rows) > 0)
                sig = dart.sketch(owner, g, None, part.num_rows, k)[has]
                b = dart.band_hashes(sig, per_band)
                b = H.mix(b + np.arange(b.shape[1], dtype=np.uint64))
                rid = part.column(0).to_numpy()[has]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rid, b.shape[1])), pa.array(b.reshape(-1).view(np.int64))], names=["rid", "band"])
            H.give_back()

    return docs.select(F.xxhash64("text").alias("rid"), "text").mapInArrow(run, "rid long, band long")


def candidate_clusters(docs: DataFrame) -> DataFrame:
    """(node, component): text hashes that share a band bucket, by cluster."""
    rows = written(bands(docs), "bands")
    buckets = rows.groupBy("band").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi")
    stars = rows.join(buckets.select("band", "lo"), "band").where("rid <> lo").select("rid", "lo")
    out = components(stars, "rid", "lo")
    drop(rows)
    return out


class _Sets:
    """Shingle sets of the texts of a block, with an inverted index."""

    def __init__(self, texts: pa.Array, words: int):
        h, rows = H.word_hashes(texts)
        g, owner, _ = H.gram_hashes(h, rows, words)
        order = np.lexsort((owner, g))
        g, owner = g[order], owner[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, self.post = g[new], owner[new]
        first = np.ones(len(g), dtype=bool)
        first[1:] = g[1:] != g[:-1]
        self.start = np.append(np.flatnonzero(first), len(g))
        gid = np.cumsum(first) - 1
        by_row = np.argsort(self.post, kind="stable")
        self.gram = gid[by_row]
        self.n = len(texts)
        self.size = np.bincount(self.post, minlength=self.n)[:self.n]
        self.row = np.concatenate([[0], np.cumsum(self.size)])

    def similarity(self, i: int) -> np.ndarray:
        """Jaccard similarity of text i with every text."""
        g = self.gram[self.row[i]:self.row[i + 1]]
        lo, ln = self.start[g], self.start[g + 1] - self.start[g]
        at = np.repeat(lo - (np.cumsum(ln) - ln), ln) + np.arange(ln.sum())
        common = np.bincount(self.post[at], minlength=self.n)[:self.n]
        return common / np.maximum(self.size + self.size[i] - common, 1)


def _block_links(table: pa.Table, words: int, least: float) -> pa.Table:
    """Spanning links between the connected texts of a block. With a column
    ``outlier``, only texts marked so are tested (against all)."""
    table = table.combine_chunks()
    keys = table.column("key").to_pylist()
    sets = _Sets(table.column("text"), words)
    n = len(keys)
    known = table.column("component").to_pylist() if "component" in table.column_names else list(range(n))
    ids = {c: i for i, c in enumerate(dict.fromkeys(known))}
    comp = np.array([ids[c] for c in known], dtype=np.int64)
    todo = np.array(table.column("outlier").to_pylist()) if "outlier" in table.column_names else np.ones(n, dtype=bool)
    all_tested = "outlier" in table.column_names
    a, b = [], []
    while True:
        open_ = np.flatnonzero(todo)
        if not len(open_):
            break
        if not all_tested:      # one component may stay untested: the others reach it
            rest = open_[comp[open_] != np.bincount(comp[open_]).argmax()]
            if not len(rest):
                break
            i = int(rest[0])
        else:
            i = int(open_[0])
        todo[i] = False
        for j in np.flatnonzero((sets.similarity(i) >= least) & (comp != comp[i])):
            if comp[j] != comp[i]:
                a.append(keys[i])
                b.append(keys[j])
                comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def exact_links(docs: DataFrame, clusters: DataFrame, words: int = WORDS, least: float = SIMILARITY,
                block: int = BLOCK) -> DataFrame:
    """(node, component) over text keys that are linked to another text."""
    # a sort-merge join at every size: clusters grow with the corpus
    texts = (docs.select(F.xxhash64("text").alias("node"), F.md5("text").alias("key"), "text").join(clusters.hint("merge"), "node")
                 .groupBy("key").agg(F.first("component").alias("cluster"), F.first("text").alias("text")))
    texts = written(texts, "cluster-texts")
    sizes = texts.groupBy("cluster").agg(
        F.count("*").alias("n"), F.array(*[F.min_by("key", F.xxhash64(F.lit(j), "key")) for j in range(LEADERS)]).alias("leaders"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    total = texts.count()
    groups = max(1, -(-total // block))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # small clusters share a block; large ones have blocks of their own
    dealt = texts.join(sizes, "cluster").select(
        "key", "text", F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.col("cluster")).alias("g"),
        F.explode(F.when(F.col("blocks") == 1, F.array(F.pmod(F.xxhash64("cluster"), F.lit(groups)).cast("int")))
                  .when(F.array_contains("leaders", F.col("key")), F.sequence(F.lit(0), F.col("blocks") - 1))
                  .otherwise(F.array(own))).alias("block"))
    links = written(dealt.groupBy("g", "block").applyInArrow(lambda t: _block_links(t, words, least), "a string, b string"), "links")

    large = written(sizes.where("blocks > 1"), "large")
    if large.isEmpty():
        out = components(links, "a", "b")
    else:
        comp = components(links, "a", "b")
        rows = texts.join(large.select("cluster", "blocks"), "cluster").join(
            comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        count = rows.groupBy("cluster", "component").agg(F.count("*").alias("c"))
        main = count.groupBy("cluster").agg(F.max_by("component", F.struct("c", "component")).alias("main"),
                                            (F.sum("c") - F.max("c")).alias("out")).where("out > 0")
        main = main.withColumn("out_blocks", F.ceil(F.col("out") / block).cast("int"))
        rows = rows.join(main, "cluster")
        outlier = F.col("component") != F.col("main")
        spread = F.sequence(F.lit(0), F.col("blocks") - 1)
        # an outlier is tested in every block; the texts of a block meet every block of outliers
        tested = rows.where(outlier).select("cluster", "key", "text", "component", F.lit(True).alias("outlier"),
                                            F.pmod(F.xxhash64("key"), F.col("out_blocks")).cast("int").alias("o"), F.explode(spread).alias("block"))
        against = rows.select("cluster", "key", "text", "component", F.lit(False).alias("outlier"),
                              F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("o"), own.alias("block"))
        more = tested.unionByName(against).groupBy("cluster", "o", "block").applyInArrow(
            lambda t: _block_links(t, words, least), "a string, b string")
        out = components(links.unionByName(more), "a", "b")
        drop(comp)
    for d in (texts, links, large):
        drop(d)
    return out


def near_dup_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of the text), class_id and
    class_size (rows), keep (true for one row's doc_id and key per class)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    clusters = candidate_clusters(docs)
    linked = exact_links(docs, clusters)
    rows = docs.select("doc_id", F.md5("text").alias("key"))
    # small rows from here on; minima and counts are summed before they are shuffled
    named = rows.join(linked.withColumnRenamed("node", "key"), "key", "left").select(
        "doc_id", "key", F.coalesce("component", "key").alias("component"))
    best = named.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.count("*").alias("class_size"))
    return named.join(best, "component").select(
        "doc_id", "key", F.col("best.doc_id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("keep"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the least doc_id
    (one row only, if that row is repeated)."""
    kept = near_dup_classes(docs).where("keep").select(F.col("doc_id").alias("_id"), F.col("key").alias("_md5")).distinct()
    key = fresh(docs, "_key")
    named = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    cond = named[key].eqNullSafe(kept["_md5"]) & named["doc_id"].eqNullSafe(kept["_id"])
    return named.join(kept, cond, "left_semi").dropDuplicates([key, "doc_id"]).select(*docs.columns)
