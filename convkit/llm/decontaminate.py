"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

1. The distinct three-word grams of every benchmark text are its seeds (a
   shorter text is one gram of all its words), ranked by the corpus passages
   that hold them. Seeds in no passage find nothing and go.
2. Rare seeds, in at most ``RARE`` passages or ``FEW`` item texts, join passages
   to items at once. So the pairs grow with passages and with seeds, not with
   their product.
3. A common seed (a phrase that many items and many documents use) joins
   together with words: a copy of similarity s holds t = s x n of its item's n
   words, so at least ``NEED`` of the item's rarest words, those that leave
   t - NEED over, stand around the seed. That bound loses no copy.
4. Passages carry a window of word hashes around their seeds, wide enough for
   the item with gaps. A pair is aligned if window and item have t words in
   common; Smith-Waterman goes word by word (match 2, mismatch and gap -1).
   Similarity is the best score over twice the item's words; a document is
   contaminated from ``SIMILARITY`` on.

The pass over the corpus looks words up in a sorted array of benchmark
gram hashes. The array goes to the executors in blocks of at most
``BLOCK_GRAMS`` hashes (32 MB), one after another: a block's passages are
written before the next one is built. Joins by seed or item are salted, so a
seed or item that a third of the passages share is no single task's. Words
are lower-cased runs of letters and digits.

Defined results: null and empty texts and items match nothing; items of
fewer than three words are found wherever all their words stand in a row, in
documents of any length; repeated documents each get their rows,
items with equal ids are one item of several texts, also those without id: each text
is looked for by itself, repeated ones once; rows without doc_id are judged as well (null id); empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convkit.llm import wordhash as H
from convkit.llm.stages import drop, fresh, written

GRAM = 3
SIMILARITY = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
SLACK = 1.5                     # window words to either side, times the item's words
BLOCK_GRAMS = 4_000_000
RARE, FEW = 32, 4               # a seed in more passages than RARE and more item texts than FEW is common
NEED = 4                        # rare words that a common seed must come with
SALT = 16


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return H.word_hashes(column, "alnum", lower=True)


def item_texts(benchmark: DataFrame) -> DataFrame:
    """(item_id, tid, text): the benchmark's distinct rows; ``tid`` is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("tid"), text.alias("text")).distinct()


def item_grams(texts: DataFrame, n: int = GRAM) -> DataFrame:
    """(tid, gram, n_words, words): the distinct grams of every text, and
    the text's word hashes (32 bits each, little-endian)."""
    def run(batches):
        for batch in batches:
            for part in H.slices(batch, "text"):
                h, rows = _words(part.column(1))
                g, owner, _ = H.gram_hashes(h, rows, n)
                key = np.lexsort((g, owner))
                g, owner = g[key], owner[key]
                new = np.ones(len(g), dtype=bool)
                new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
                g, owner = g[new], owner[new]
                low = h.astype(np.uint32)
                packed = [low[a:b].tobytes() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(owner)), pa.array(g.view(np.int64)),
                    pa.array(np.diff(rows)[owner].astype(np.int32)), pa.array([packed[o] for o in owner.tolist()], pa.binary())],
                    names=["tid", "gram", "n_words", "words"])

    return texts.select("tid", "text").dropDuplicates(["tid"]).mapInArrow(run, "tid long, gram long, n_words int, words binary")


def _member(grams: np.ndarray, g: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Positions of ``g`` whose hash is among the sorted ``grams``."""
    near = np.flatnonzero(seen[g >> np.uint64(40)])
    at = np.minimum(np.searchsorted(grams, g[near]), len(grams) - 1)
    return near[grams[at] == g[near]]


def _bitmap(grams: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 24, dtype=bool)
    seen[grams >> np.uint64(40)] = True
    return seen


def _blocks(grams: DataFrame, block: int, most: str):
    """Broadcast blocks of distinct sorted gram hashes and maxima of the column
    ``most``, each at most about ``block`` long."""
    distinct = grams.groupBy("gram").agg(F.max(most).cast("int").alias("most"))
    total = distinct.count()
    n = -(-total // block)
    for i in range(n):
        part = (distinct.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == i) if n > 1 else distinct).toArrow()
        hashes, value = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
        order = np.argsort(hashes)
        held = grams.sparkSession.sparkContext.broadcast((hashes[order], value[order]))
        yield held
        held.unpersist()


def seeds(texts: DataFrame, n: int = GRAM) -> DataFrame:
    """item_grams of all texts, written once."""
    return written(item_grams(texts, n), "seeds")


def passages(docs: DataFrame, seed: DataFrame, n: int = GRAM, block: int = BLOCK_GRAMS) -> DataFrame | None:
    """(doc_id, rid, lo, window, grams, at): stretches of documents around
    seeds, written block by block; None without seeds.

    Seeds of a document whose reaches meet share a stretch. ``window`` holds
    its 32-bit word hashes, ``lo`` is its first word, ``grams`` its seeds in
    order and ``at`` their places in the window; ``rid`` is a hash of doc_id
    and text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    sizes = sorted(r[0] for r in seed.select(F.least("n_words", F.lit(n))).distinct().collect())       # at most n
    out, parts = None, []
    for held in _blocks(seed, block, "n_words"):
        def run(batches, held=held):
            grams, words = held.value
            reach = np.ceil(words * SLACK).astype(np.int64)
            seen = _bitmap(grams)
            for batch in batches:
                for part in H.slices(batch, "text"):
                    h, off = _words(part.column(2))
                    g, owner, first, size = _hits(h, off, sizes, grams, seen)
                    wide = reach[np.searchsorted(grams, g)] if len(g) else np.empty(0, np.int64)
                    lo, hi = np.maximum(first - wide, off[owner]), np.minimum(first + size + wide, off[owner + 1])
                    # a new stretch where a window starts after all earlier ones of the row have ended
                    far = np.maximum.accumulate(hi) if len(hi) else hi
                    new = np.ones(len(g), dtype=bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (lo[1:] > far[:-1])
                    start = np.flatnonzero(new)
                    if not len(start):
                        continue
                    a, b = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
                    place = (first - np.repeat(a, np.diff(np.append(start, len(g))))).astype(np.int32)
                    cuts = pa.array(np.append(start, len(g)).astype(np.int32))
                    low = h.astype(np.uint32)
                    rows_ = pa.array(owner[start])
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(rows_), part.column(1).take(rows_), pa.array(a - off[owner[start]]),
                        pa.array([low[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
                        pa.ListArray.from_arrays(cuts, pa.array(g.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(place))],
                        names=["doc_id", "rid", "lo", "window", "grams", "at"])
        part = written(rows.mapInArrow(run, "doc_id long, rid long, lo long, window binary, grams array<long>, at array<int>"), "passages")
        parts.append(part)
        out = part if out is None else out.unionByName(part)
    if out is not None:
        out._stages = parts
    return out


def _hits(h: np.ndarray, off: np.ndarray, sizes: list[int], grams: np.ndarray, seen: np.ndarray):
    """Hash, row, first word and number of words of every seed in the rows, in order."""
    found = []
    for n in sizes:
        g, owner, first = H.gram_hashes(h, off, n)
        whole = first + n <= off[owner + 1]         # a row of fewer words has a shorter gram, another size's
        g, owner, first = g[whole], owner[whole], first[whole]
        hit = _member(grams, g, seen)
        found.append((g[hit], owner[hit], first[hit], np.full(len(hit), n)))
    g, owner, first, size = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(first, kind="stable")
    return g[order], owner[order], first[order], size[order]


def _salted(df: DataFrame) -> DataFrame:
    """The small side of a salted join: every row once per salt."""
    return df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))


def _salt():
    return F.pmod(F.xxhash64("rid", "lo"), F.lit(SALT)).cast("int").alias("salt")


def _item_words(items: DataFrame) -> DataFrame:
    """(tid, n_words, word, times) of every distinct word of the packed items."""
    def run(batches):
        for batch in batches:
            for tid, words in zip(batch.column(0), batch.column(1)):
                w, times = np.unique(np.frombuffer(words.as_py(), dtype=np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([tid.as_py()] * len(w), pa.int64()), pa.array(np.full(len(w), times.sum(), dtype=np.int32)),
                    pa.array(w.view(np.int32)), pa.array(times.astype(np.int32))], names=["tid", "n_words", "word", "times"])

    return items.select("tid", "words").mapInArrow(run, "tid long, n_words int, word int, times int")


def _around(hot: DataFrame) -> DataFrame:
    """(rid, lo, gram, word): the distinct words within reach of each common
    seed of a passage. On either side of a seed a copy takes at most its other
    words and as many gaps, twice the item's words."""
    def run(batches):
        for batch in batches:
            for rid, lo, window, at, grams, far in zip(*(batch.column(i) for i in range(6))):
                w = np.frombuffer(window.as_py(), dtype=np.int32)
                near: dict[int, list] = {}
                for p, g, r in zip(at.as_py(), grams.as_py(), far.as_py()):
                    near.setdefault(g, []).append((max(p - r, 0), p + r))
                for g, spans in near.items():
                    ends, pieces = 0, []
                    for x, y in sorted(spans):          # each word once, however many spans hold it
                        pieces.append(w[max(x, ends):y])
                        ends = max(ends, y)
                    words = np.unique(np.concatenate(pieces))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rid.as_py()] * len(words), pa.int64()), pa.array([lo.as_py()] * len(words), pa.int64()),
                        pa.array([g] * len(words), pa.int64()), pa.array(words)], names=["rid", "lo", "gram", "word"])

    return hot.mapInArrow(run, "rid long, lo long, gram long, word int")


def _once(found: DataFrame) -> DataFrame:
    """(rid, lo, doc_id, window): repeated rows once, with the widest window of all blocks."""
    return found.groupBy("rid", "lo").agg(F.max("doc_id").alias("doc_id"), F.max_by("window", F.length("window")).alias("window"))


def candidates(found: DataFrame, seed: DataFrame, similarity: float = SIMILARITY, n: int = GRAM) -> tuple[DataFrame, list[DataFrame]]:
    """(rid, lo, tid) of passages and items that may align well enough, and
    the written tables it reads."""
    hits = found.select("rid", "lo", F.explode(F.array_distinct("grams")).alias("gram"), _salt())
    rank = (hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
                .join(seed.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"), F.max("n_words").alias("longest")), "gram"))
    rank = rank.select("gram", "longest", ((F.col("df") > RARE) & (F.col("texts") > FEW)).alias("common"))
    ranked = written(seed.select("tid", "gram", "n_words", "words").join(rank, "gram"), "ranked")
    rare = _salted(ranked.where(~F.col("common")).select("gram", "tid"))
    near = hits.join(rare, ["gram", "salt"]).select("rid", "lo", "tid", "salt").distinct()

    common = ranked.where("common")
    each = found.select("rid", "lo", F.explode(F.arrays_zip("grams", "at")).alias("x"), _salt())
    spots = _salted(common.select("gram", (2 * F.col("longest") + n).alias("far")).distinct())
    hot = (each.select("rid", "lo", "salt", F.col("x.grams").alias("gram"), F.col("x.at").alias("at")).join(spots, ["gram", "salt"])
               .groupBy("rid", "lo").agg(F.collect_list(F.struct("at", "gram", "far")).alias("x")))        # within one passage
    hot = found.select("rid", "lo", "window").distinct().join(hot, ["rid", "lo"]).select("rid", "lo", "window", "x.at", "x.gram", "x.far")
    around = written(_around(hot), "around")

    words = _item_words(common.select("tid", "words").distinct())
    words = words.join(around.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word", "left")
    rest = Window.partitionBy("tid").orderBy(F.coalesce("df", F.lit(0)).desc(), F.desc("word")).rowsBetween(Window.unboundedPreceding, 0)
    t = F.ceil(F.col("n_words") * similarity - 1e-9)
    need = F.least(F.lit(NEED), F.greatest(t, F.lit(1)))
    # a word belongs to the rarest ones as long as it and the more frequent ones are over t - need
    rarest = words.withColumn("left", F.sum("times").over(rest)).where(F.col("left") > t - need).select("tid", "word", "times", need.alias("need"))
    keys = _salted(common.select("tid", "gram").join(rarest, "tid"))
    both = (around.select("rid", "lo", "gram", "word", _salt()).join(keys, ["gram", "word", "salt"])
                  .groupBy("rid", "lo", "tid", "gram", "salt", "need").agg(F.sum("times").alias("got")).where("got >= need"))
    return near.unionByName(both.select("rid", "lo", "tid", "salt")).distinct(), [ranked, around]


def in_reach(window: list[bytes], item: list[bytes], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of packed words have as many words in common as a copy needs."""
    out = np.zeros(len(window), dtype=bool)
    for k, (x, y) in enumerate(zip(window, item)):
        u, c = np.unique(np.frombuffer(x, dtype=np.uint32), return_counts=True)
        v, d = np.unique(np.frombuffer(y, dtype=np.uint32), return_counts=True)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        out[k] = np.minimum(c[i], d[j]).sum() >= similarity * d.sum() - 1e-9
    return out


def align(window: list[bytes], item: list[bytes], cells: int = 1 << 20) -> np.ndarray:
    """Best local alignment score of each (window, item) pair of packed words."""
    w = [np.frombuffer(x, dtype=np.uint32) for x in window]
    t = [np.frombuffer(x, dtype=np.uint32) for x in item]
    out = np.zeros(len(w), dtype=np.int64)
    # pairs of similar sizes share a padded array
    order = sorted(range(len(w)), key=lambda i: (len(w[i]), len(t[i])))
    i = 0
    while i < len(order):
        width, j = len(w[order[i]]), i + 1
        while j < len(order) and (len(w[order[j]]) <= width * 1.25 + 8) and (j - i + 1) * len(w[order[j]]) <= cells:
            j += 1
        some = order[i:j]
        out[some] = _align([w[x] for x in some], [t[x] for x in some])
        i = j
    return out


def _align(w: list[np.ndarray], t: list[np.ndarray]) -> np.ndarray:
    width, length = max(map(len, w)), max(map(len, t))
    # paddings that match nothing: 2**33 in windows, 2**34 in items
    a = np.full((len(w), width), 1 << 33, dtype=np.int64)
    b = np.full((len(t), length), 1 << 34, dtype=np.int64)
    for i, (x, y) in enumerate(zip(w, t)):
        a[i, :len(x)], b[i, :len(y)] = x, y
    step = np.arange(width, dtype=np.int32) * -GAP
    row = np.zeros((len(w), width + 1), dtype=np.int32)
    best = np.zeros(len(w), dtype=np.int32)
    for k in range(length):
        score = np.where(a == b[:, k:k + 1], np.int32(MATCH), np.int32(MISMATCH))
        new = np.maximum(np.maximum(row[:, :-1] + score, row[:, 1:] + GAP), 0)
        # gaps along the window: the best start to the left, less the way
        row[:, 1:] = np.maximum.accumulate(new + step, axis=1) - step
        np.maximum(best, row.max(axis=1), out=best)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, n: int = GRAM, block: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, rid, item_id, similarity) of every document row and item that
    align well enough."""
    empty = docs.sparkSession.createDataFrame([], "doc_id long, rid long, item_id long, similarity double")
    texts = item_texts(benchmark)
    seed = seeds(texts, n)
    found = passages(docs, seed, n, block)
    if found is None:
        drop(seed)
        return empty
    near, stages = candidates(found, seed, similarity, n)
    items = _salted(seed.select("tid", "n_words", "words").distinct())
    pairs = _once(found).join(near, ["rid", "lo"]).join(items, ["tid", "salt"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                window, item = part.column(4).to_pylist(), part.column(5).to_pylist()
                at = np.flatnonzero(in_reach(window, item, similarity))
                score = align([window[x] for x in at], [item[x] for x in at])
                got = score / (MATCH * np.maximum(part.column(3).to_numpy()[at], 1))
                ok = got >= similarity
                keep = pa.array(at[ok])
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), part.column(2).take(keep), pa.array(got[ok])],
                                                 names=["doc_id", "rid", "tid", "similarity"])

    scored = pairs.select("doc_id", "rid", "tid", "n_words", "window", "words").mapInArrow(
        run, "doc_id long, rid long, tid long, similarity double")
    best = scored.join(texts.select("item_id", "tid"), "tid").groupBy("doc_id", "rid", "item_id").agg(F.max("similarity").alias("similarity"))
    out = written(best, "leaks")
    for stage in (seed, *stages):
        drop(stage)
    for path in found._stages:
        drop(path)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid")).distinct()
    row = fresh(docs, "_row")
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    cond = (named[row] == bad["_rid"]) & named["doc_id"].cast("long").eqNullSafe(bad["_id"])
    return named.join(bad, cond, "left_anti").select(*docs.columns)
