"""Corpus metrics for many systems in one job.

Hypotheses and reference lines of a key (a segment) are brought together
once, hash-partitioned by key, as one row with their texts; both lists are
short (systems; ``n_refs``). What is counted per segment is counted within that
row, so no n-gram of BLEU is sorted, shuffled or written. Corpus statistics
(document frequencies, NIST information) are sums over n-grams that were summed
over many segments before they are sent, in one exchange. Nothing is cached,
and only names of systems and totals are collected.

BLEU, ROUGE-L and CIDEr follow their papers with the smoothing constants of
the common caption-evaluation implementation; NIST follows the published
definition (information weights from reference n-gram statistics).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from convkit.functions import text as T
from convkit.functions.ngrams import count_grams, lcs_len
from convkit.operators import ngram_stats as NS
from convkit.session import materialize

# Fixed constants of the metrics.
BLEU_TINY = 1e-15
BLEU_SMALL = 1e-9
ROUGE_BETA = 1.2
CIDER_SIGMA = 6.0
NIST_BETA = math.log(0.5) / math.log(1.5) ** 2
MAX_N = 4
# N-grams that a worker sums before it sends them on, and words of a bucket of segments.
FLUSH_GRAMS = 1 << 19
BUCKET_WORDS = 1 << 19


def first_lines(texts: DataFrame, n_lines: int) -> DataFrame:
    """T5: the first hypotheses of each system in the order of their keys, for
    entropy and mean length (the other metrics take all lines)."""
    w = Window.partitionBy("system").orderBy("key")
    hyps = texts.filter(F.col("system").isNotNull())
    return hyps.withColumn("_l", F.row_number().over(w)).filter(F.col("_l") <= n_lines).drop("_l")


def hyp_refs(hyps: DataFrame, refs: DataFrame, n_refs: int = 6, vshuman: int = -1, clean: bool = False) -> DataFrame:
    """(system, key, hyp) x (key, refs array) -> one row per hypothesis
    (system, key, text) and per reference line (key, ri, text), partitioned
    by key; ``system`` is NULL for a reference and ``ri`` for a hypothesis.

    Reference line i is refs[i % len], skipping the ``vshuman`` index; of a
    text with bars, what is between the first and the second. A hypothesis
    whose key has no references ends the job."""
    # one row per key; a key's hypotheses are as many as there are systems
    h = hyps.groupBy("key").agg(F.collect_list(F.struct("system", F.lit(None).cast("int").alias("ri"), F.col("hyp").alias("text"))).alias("hyps"))
    missing = F.raise_error(F.concat(F.lit("no references for key "), F.col("key"))).cast("array<string>")
    s = h.join(refs.select("key", "refs"), "key", "left").withColumn("refs", F.coalesce("refs", missing))
    L = F.size("refs")

    def pick(i):
        idx = i % L
        idx = F.when(idx == vshuman, (idx + 1) % L).otherwise(idx)
        item = F.get(F.col("refs"), idx)
        txt = F.when(item.contains("|"), F.get(F.split(item, "\\|"), 1)).otherwise(item)
        return F.struct(F.lit(None).cast("string").alias("system"), i.alias("ri"), txt.alias("text"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(n_refs - 1)), pick)
    x = s.select("key", F.explode(F.concat(F.col("hyps"), lines)).alias("x")).select("key", "x.system", "x.ri", "x.text")
    return x.withColumn("text", T.eval_clean("text")) if clean else x


def _counts(texts: list[dict], name: str) -> dict:
    """Per system (or reference line): n-gram counts of its text, by n. Equal
    texts are counted once; a name that occurs again adds to its counts."""
    seen, out = {}, {}
    for t in texts:
        text = t["text"]
        if text not in seen:
            seen[text] = count_grams(text, MAX_N)
        out[t[name]] = [a + b for a, b in zip(out[t[name]], seen[text])] if t[name] in out else seen[text]
    return out


def _most(refs: dict) -> list[dict]:
    """The largest count of each n-gram in any reference line, by n."""
    most = [{} for _ in range(MAX_N)]
    for line in {id(c): c for c in refs.values()}.values():
        for best, c in zip(most, line):
            for g, k in c.items():
                if k > best.get(g, 0):
                    best[g] = k
    return most


@F.arrow_udf(Ty.ArrayType(Ty.ArrayType(Ty.LongType())))
def clipped_matches(hyps: pa.Array, refs: pa.Array) -> pa.Array:
    """Per segment and system, in order of first occurrence: n-grams that are
    in the references too, each as often as in one of them, n = 1..4."""
    out = []
    for h, r in zip(hyps.to_pylist(), refs.to_pylist()):
        most = _most(_counts(r, "ri"))
        out.append([[sum(min(k, best.get(g, 0)) for g, k in c.items()) for c, best in zip(counts, most)]
                    for counts in _counts(h, "system").values()])
    return pa.array(out, pa.list_(pa.list_(pa.int64())))


def ngram_table(texts: DataFrame) -> DataFrame:
    """One row per key: ``hyps`` array of (system, text) and ``refs`` array of
    (ri, text), the words of each text with one space between them, and
    ``stats`` array of (system, len, match) with the number of words and the
    clipped matches by n; ``lens`` has the numbers of words of the reference
    lines. Texts that are NULL don't count."""
    tok = texts.select("key", "system", "ri", T.words("text").alias("_tok")).where(F.col("_tok").isNotNull())
    tok = tok.select("key", "system", "ri", F.size("_tok").cast("long").alias("len"), F.array_join("_tok", " ").alias("text"))
    ref = F.col("system").isNull()
    s = tok.groupBy("key").agg(F.collect_list(F.when(~ref, F.struct("system", "len", "text"))).alias("_h"),
                               F.collect_list(F.when(ref, F.struct("ri", "len", "text"))).alias("_r"))
    # of a system or line that occurs again the first length
    first = lambda a, name: F.transform(F.array_distinct(F.transform(a, lambda x: x[name])),
                                        lambda k: F.struct(k.alias(name), F.filter(a, lambda x: x[name] == k)[0]["len"].alias("len")))
    s = s.withColumn("_m", clipped_matches("_h", "_r"))
    stats = F.zip_with(first("_h", "system"), "_m", lambda h, m: F.struct(h["system"].alias("system"), h["len"].alias("len"), m.alias("match")))
    plain = lambda a, name: F.transform(a, lambda x: F.struct(x[name].alias(name), x["text"].alias("text")))
    return s.select("key", plain("_h", "system").alias("hyps"), plain("_r", "ri").alias("refs"), stats.alias("stats"),
                    F.transform(first("_r", "ri"), lambda r: r["len"]).alias("lens"))


def segment_stats(grams: DataFrame) -> DataFrame:
    """Per (system, key): testlen, the effective reference lengths reflen
    (closest, ties to the shorter), shortest and mean_reflen, guess_k and
    correct_k (clipped by the largest reference count)."""
    x = grams.select("key", "lens", F.inline("stats")).withColumnRenamed("len", "testlen")
    closest = F.array_min(F.transform("lens", lambda r: F.struct(F.abs(r - F.col("testlen")).alias("d"), r.alias("l"))))["l"]
    mean = F.aggregate("lens", F.lit(0).cast("long"), lambda a, r: a + r) / F.size("lens")
    return x.select("system", "key", "testlen", closest.alias("reflen"), F.array_min("lens").alias("shortest"), mean.alias("mean_reflen"),
                    *[F.greatest(F.col("testlen") - k + 1, F.lit(0)).alias(f"guess{k}") for k in range(1, MAX_N + 1)],
                    *[F.get("match", F.lit(k - 1)).alias(f"correct{k}") for k in range(1, MAX_N + 1)])


def _bleu(agg, reflen: Column | None = None) -> list[Column]:
    cols, prod = [], F.lit(1.0)
    reflen = agg("reflen") if reflen is None else reflen
    ratio = (agg("testlen") + F.lit(BLEU_TINY)) / (reflen + F.lit(BLEU_SMALL))
    bp = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(F.lit(1.0))
    for k in range(1, MAX_N + 1):
        prod = prod * (agg(f"correct{k}") + F.lit(BLEU_TINY)) / (agg(f"guess{k}") + F.lit(BLEU_SMALL))
        cols.append((F.pow(prod, 1.0 / k) * bp).alias(f"bleu{k}"))
    return cols


# Effective reference length of a segment, by name of the option.
REFLENS = {"closest": "reflen", "shortest": "shortest", "average": "mean_reflen"}


def bleu_corpus(grams: DataFrame, effective: str | None = "closest") -> DataFrame:
    """Corpus BLEU-1..4 per system. ``effective``: which reference length
    a segment counts with (closest, shortest, average); without one it is the
    average for a system of a single segment, else the closest."""
    if effective is None:
        reflen = F.when(F.count(F.lit(1)) == 1, F.sum("mean_reflen")).otherwise(F.sum("reflen").cast("double"))
    else:
        reflen = F.sum(REFLENS[effective])
    return segment_stats(grams).groupBy("system").agg(*_bleu(F.sum, reflen))


def bleu_sentence(grams: DataFrame) -> DataFrame:
    """Sentence BLEU-1..4 per segment (and its mean via ``avg``)."""
    return segment_stats(grams).select("system", "key", *_bleu(F.col))


def _nearest(sorted_lengths: Column, length: Column) -> Column:
    """The element of an ascending array nearest to a length, ties to the
    shorter, by bisection (its steps are those that an array of 2 ** 31 needs)."""
    size = F.size(sorted_lengths)

    def halve(at, _):
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        less = (at["lo"] < at["hi"]) & (F.get(sorted_lengths, middle) < length)
        return F.struct(F.when(less, middle + 1).otherwise(at["lo"]).alias("lo"),
                        F.when(less | (at["lo"] >= at["hi"]), at["hi"]).otherwise(middle).alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))
    i = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve)["lo"]     # the first that isn't less
    below, above = F.get(sorted_lengths, i - 1), F.get(sorted_lengths, i)
    return F.when(below.isNull() | (above - length < length - below), above).otherwise(below)


@F.arrow_udf(Ty.ArrayType(Ty.StructType([Ty.StructField("n", Ty.IntegerType()), Ty.StructField("g", Ty.StringType()), Ty.StructField("c", Ty.LongType())])))
def gram_rows(texts: pa.Array) -> pa.Array:
    """The distinct n-grams of a row's texts with their counts, n = 1..4, behind a row of n = 0."""
    at, n, g, c = [0], [], [], []
    for row in texts.to_pylist():
        counts = [a[0] if len(a) == 1 else sum(a, Counter()) for a in zip(*[count_grams(t, MAX_N) for t in row])]
        n.append(0), g.append(""), c.append(1)
        for k, d in enumerate(counts, 1):
            n.extend([k] * len(d)), g.extend(d), c.extend(d.values())
        at.append(len(n))
    rows = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(g, pa.string()), pa.array(c, pa.int64())], ["n", "g", "c"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)


def bleu_pool(hyps: DataFrame, pool: DataFrame) -> DataFrame:
    """A8 against one pool: sentence BLEU-1..4 of every hypothesis (system,
    key, text), each with all texts of ``pool`` (rid, text; rid unique) as its
    references.

    No hypothesis meets a text of the pool: n-grams are counted within a text's
    row, the pool becomes a table of them with their largest count in any text, which the hypotheses' n-grams
    are joined with, and a sorted array of its distinct lengths (as many as
    its longest text has words at most), in which each distinct hypothesis
    length is looked up once. An empty pool gives NULL scores."""
    row = lambda df: df.select("*", F.explode(gram_rows("_texts")).alias("x")).select("*", "x.*")
    line, size = F.array_join(T.words("text"), " "), F.size(T.words("text"))
    p = pool.select(line.alias("_text"), size.alias("_len")).where(F.col("_text").isNotNull())
    most = row(p.select(F.array("_text").alias("_texts"))).where("n > 0").groupBy("n", "g").agg(F.max("c").alias("rmax"))
    lengths = p.select("_len").distinct().agg(F.sort_array(F.collect_list("_len"))).scalar()
    # counted within a row: a hypothesis' n-grams are not brought together again
    h = hyps.select("system", "key", line.alias("_text"), size.alias("_len")).where(F.col("_text").isNotNull())
    h = row(h.groupBy("system", "key").agg(F.collect_list("_text").alias("_texts"), F.first("_len").alias("_len"))).select("system", "key", "_len", "n", "g", "c")
    # the frequent n-grams' side is split by skew; the sums are taken after another exchange
    c = h.join(most, ["n", "g"], "left").withColumn("m", F.least("c", F.coalesce("rmax", F.lit(0))))
    seg = c.groupBy("system", "key").agg(F.first("_len").alias("testlen"), *[
        F.coalesce(F.sum(F.when(F.col("n") == k, F.col("m"))), F.lit(0)).alias(f"correct{k}") for k in range(1, MAX_N + 1)])
    seg = materialize(seg, "pool-segments")
    near = seg.select("testlen").distinct().withColumn("_all", lengths).select("testlen", _nearest(F.col("_all"), F.col("testlen")).alias("reflen"))
    guess = {f"guess{k}": F.greatest(F.col("testlen") - k + 1, F.lit(0)) for k in range(1, MAX_N + 1)}
    return seg.join(near, "testlen").withColumns(guess).select("system", "key", *[
        F.when(F.col("reflen").isNotNull(), c).alias(f"bleu{k}") for k, c in enumerate(_bleu(F.col), 1)])


def _systems(grams: DataFrame) -> list[str]:
    return sorted(r[0] for r in grams.select(F.explode("stats.system")).distinct().collect())


def _corpus_counts(grams: DataFrame) -> DataFrame:
    """(n, g, rc, by): count in the reference lines and, per system, (system,
    c, m, x): count in its hypotheses, clipped matches, and those of the longer
    n-grams that begin with this one, each taken within its segment."""
    systems = _systems(grams)
    at = {s: 1 + 3 * i for i, s in enumerate(systems)}
    width = 1 + 3 * len(systems)
    limit = FLUSH_GRAMS
    names = ["rc", *[f"{v}{i}" for i in range(len(systems)) for v in "cmx"]]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [{} for _ in range(MAX_N)]

        def flush():
            for n, d in enumerate(sums, 1):
                gs = sorted(d)
                v = np.array([d[g] for g in gs], dtype=np.int64).reshape(len(gs), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gs), n, np.int32)), pa.array(gs, pa.string()),
                                                  *[pa.array(v[:, j]) for j in range(width)]], ["n", "g", *names])
                d.clear()
        for b in batches:
            for h, r in zip(b.column("hyps"), b.column("refs")):
                refs = _counts(r.as_py(), "ri")
                most = _most(refs)
                lines, times = {id(c): c for c in refs.values()}, Counter(id(c) for c in refs.values())
                for i, line in lines.items():
                    for d, c in zip(sums, line):
                        for g, k in c.items():
                            if g not in d:
                                d[g] = [0] * width
                            d[g][0] += k * times[i]
                for s, counts in _counts(h.as_py(), "system").items():
                    j = at[s]
                    for n, c in enumerate(counts):
                        d, best = sums[n], most[n]
                        for g, k in c.items():
                            if g not in d:
                                d[g] = [0] * width
                            d[g][j] += k
                            m = min(k, best.get(g, 0))
                            if m:
                                d[g][j + 1] += m
                                if n:
                                    sums[n - 1][g.rpartition(" ")[0]][j + 2] += m
                if sum(map(len, sums)) >= limit:
                    yield from flush()
        yield from flush()
    rows = grams.select("hyps", "refs").mapInArrow(summed, "n int, g string, " + ", ".join(f"{v} long" for v in names))
    # summed by the workers already; n-grams that begin alike lie together
    rows = rows.withColumn("_b", F.substring_index("g", " ", 3)).repartition("_b")
    c = rows.groupBy("_b", "n", "g").agg(*[F.sum(v).alias(v) for v in names])
    by = F.array(*[F.struct(F.lit(s).alias("system"), *[F.col(f"{v}{i}").alias(v) for v in "cmx"]) for i, s in enumerate(systems)])
    return c.select("n", "g", "rc", by.cast("array<struct<system:string,c:long,m:long,x:long>>").alias("by"))


def _nist_sums(counts: DataFrame) -> DataFrame:
    """Per system: number and information of its n-grams, by n; also the sums
    of the entropy and diversity statistics.

    The information of an n-gram is log2(count(prefix) / count(n-gram)), the
    prefix of a unigram all words. A match's two logarithms are summed apart:
    that of the prefix with the prefix's own row, so nothing is looked up."""
    own = counts.select("n", "rc", F.inline("by"))
    at = lambda k, v: F.when(F.col("n") == k, v)
    has = lambda k, v: at(k, F.when(F.col("c") > 0, v))
    log_rc = F.log2(F.when(F.col("rc") > 0, F.col("rc")))
    s = own.groupBy("system").agg(F.sum(at(1, F.col("rc"))).alias("_all"), F.sum(at(1, F.col("m"))).alias("_m1"), *[a for k in range(1, MAX_N + 1) for a in (
        F.sum(has(k, F.col("c"))).alias(f"_t{k}"), F.sum(has(k, F.col("c") * F.log("c"))).alias(f"_e{k}"), F.count(has(k, F.lit(1))).alias(f"_d{k}"),
        F.sum(at(k, F.when(F.col("m") > 0, F.col("m") * log_rc))).alias(f"_g{k}"), F.sum(at(k, F.when(F.col("x") > 0, F.col("x") * log_rc))).alias(f"_p{k}"))])
    prefix = [F.when(F.col("_m1") > 0, F.col("_m1") * F.log2("_all")), *[F.col(f"_p{k}") for k in range(1, MAX_N)]]
    info = {f"_i{k}": F.coalesce(prefix[k - 1] - F.col(f"_g{k}"), F.lit(0.0)) for k in range(1, MAX_N + 1)}
    return s.where("_t1 > 0").withColumns(info)


def _nist_cols() -> list[Column]:
    ratio = F.least(F.col("_len") / F.col("_ref"), F.lit(1.0))
    bp = F.when(ratio > 0, F.exp(F.lit(NIST_BETA) * F.pow(F.log(ratio), 2))).otherwise(F.lit(0.0))
    cols, acc = [], F.lit(0.0)
    for k in range(1, MAX_N + 1):
        acc = acc + F.coalesce(F.col(f"_i{k}") / F.col(f"_t{k}"), F.lit(0.0))
        cols.append((acc * bp).alias(f"nist{k}"))
    return cols


def _lengths(grams: DataFrame, *more: Column) -> DataFrame:
    return segment_stats(grams).groupBy("system").agg(F.sum("testlen").alias("_len"), F.sum("mean_reflen").alias("_ref"), *more)


def nist(grams: DataFrame) -> DataFrame:
    """Cumulative NIST-1..4 per system."""
    return _nist_sums(_corpus_counts(grams)).join(_lengths(grams), "system").select("system", *_nist_cols())


def rouge_l(texts: DataFrame, beta: float = ROUGE_BETA) -> DataFrame:
    """A10: per-segment ROUGE-L (single-space tokens; max precision and max
    recall over references taken independently)."""
    tok = texts.withColumn("t", F.split("text", " "))
    seg = tok.groupBy("key").agg(F.collect_list(F.when(F.col("system").isNotNull(), F.struct("system", "t"))).alias("hyps"),
                                 F.collect_list(F.when(F.col("system").isNull(), F.col("t"))).alias("refs"))
    j = seg.select("key", "refs", F.inline("hyps")).select("key", "system", F.col("t").alias("ht"), F.explode("refs").alias("rt"))
    j = j.select("key", "system", F.size("ht").alias("hn"), F.size("rt").alias("rn"), lcs_len("ht", "rt").alias("lcs"))
    g = j.groupBy("key", "system").agg(F.max(F.col("lcs") / F.col("hn")).alias("p"), F.max(F.col("lcs") / F.col("rn")).alias("r"))
    f = F.when((F.col("p") != 0) & (F.col("r") != 0),
               (1 + beta ** 2) * F.col("p") * F.col("r") / (F.col("r") + beta ** 2 * F.col("p"))).otherwise(F.lit(0.0))
    return g.select("system", "key", f.alias("rouge_l"))


def _segment_cider(hyps: dict, refs: dict, df: list[dict], log_n: float, sigma: float) -> Iterator[tuple[str, float]]:
    def vector(counts):
        v = [{g: k * (log_n - math.log(d.get(g) or 1)) for g, k in c.items()} for c, d in zip(counts, df)]
        return v, [math.sqrt(sum(x * x for x in w.values())) for w in v], sum(counts[1].values())
    vectors = {id(c): vector(c) for c in refs.values()}
    lines = Counter(id(c) for c in refs.values())
    for system, counts in hyps.items():
        h, nh, bigrams = vector(counts)
        total = 0.0
        for i, times in lines.items():
            r, nr, b = vectors[i]
            for n in range(MAX_N):
                rn = r[n]
                val = sum(min(x, rn[g]) * rn[g] for g, x in h[n].items() if g in rn)
                if nh[n] and nr[n]:
                    val /= nh[n] * nr[n]
                total += times * val * math.exp(-float(bigrams - b) ** 2 / (2 * sigma ** 2))
        yield system, total / MAX_N / len(refs) * 10.0


def cider(grams: DataFrame, sigma: float = CIDER_SIGMA) -> DataFrame:
    """Per-segment CIDEr (tf-idf cosine with clipping and a Gaussian
    length penalty on bigram counts), mean over n, / refs, x 10.

    Segments lie in buckets of about ``BUCKET_WORDS`` words. A bucket sends
    each of its n-grams once, with the number of its own segments that have it in
    their references, and gets back those that other buckets have as well, with
    the number of all; the others it counts again from its texts."""
    size = grams.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x) + F.aggregate("stats.len", F.lit(0).cast("long"), lambda a, x: a + x)),
                     F.count(F.when(F.size("lens") > 0, F.lit(1)))).first()
    log_n = math.log(max(size[1], 1))
    seg = grams.select("key", "hyps", "refs", F.pmod(F.xxhash64("key"), F.lit((size[0] or 0) // BUCKET_WORDS + 1)).cast("int").alias("p"))

    def own(table: pa.Table) -> list[dict]:
        df = [{} for _ in range(MAX_N)]
        for h, r in zip(table.column("hyps"), table.column("refs")):
            for d, *cs in zip(df, *_counts(h.as_py(), "system").values()):
                for c in cs:
                    for g in c:
                        d.setdefault(g, 0)
            for n, best in enumerate(_most(_counts(r.as_py(), "ri"))):
                for g in best:
                    df[n][g] = df[n].get(g, 0) + 1
        return df

    def sent(table: pa.Table) -> pa.Table:
        df, p = own(table), table.column("p")[0].as_py()
        n = np.repeat(np.arange(1, MAX_N + 1, dtype=np.int32), [len(d) for d in df])
        gs = [sorted(d) for d in df]
        return pa.table({"p": np.full(len(n), p, np.int32), "n": n, "g": pa.array([g for x in gs for g in x], pa.string()),
                         "df": pa.array([d[g] for d, x in zip(df, gs) for g in x], pa.int64())})
    found = seg.groupBy("p").applyInArrow(sent, "p int, n int, g string, df long")
    # a row per bucket at most, so an n-gram of every segment makes no large group
    every = found.withColumn("all", F.sum("df").over(Window.partitionBy("n", "g"))).where(F.col("all") != F.col("df")).select("p", "n", "g", "all")

    def scored(table: pa.Table, more: pa.Table) -> pa.Table:
        out = {"key": [], "system": [], "cider": []}
        if table.num_rows:
            df = own(table)
            for n, g, k in zip(more.column("n").to_pylist(), more.column("g").to_pylist(), more.column("all").to_pylist()):
                df[n - 1][g] = k
            for key, h, r in zip(table.column("key"), table.column("hyps"), table.column("refs")):
                refs = _counts(r.as_py(), "ri")
                for system, v in _segment_cider(_counts(h.as_py(), "system"), refs, df, log_n, sigma) if refs else ():
                    out["key"].append(key.as_py()), out["system"].append(system), out["cider"].append(v)
        return pa.table({"system": pa.array(out["system"], pa.string()), "key": pa.array(out["key"], table.column("key").type), "cider": pa.array(out["cider"], pa.float64())})
    return seg.groupBy("p").cogroup(every.groupBy("p")).applyInArrow(
        scored, Ty.StructType([Ty.StructField("system", Ty.StringType()), grams.schema["key"], Ty.StructField("cider", Ty.DoubleType())]))


def system_report(grams: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """One row per system: n_lines, nist1-4, bleu1-4, meteor (NULL: the
    external scorer is not rebuilt), entropy1-4, div1, div2, avg_len. With
    ``head`` (:func:`first_lines`, T5) entropy and avg_len are taken over those
    lines; NIST, BLEU and diversity always take all."""
    per = _lengths(grams, F.count(F.lit(1)).alias("n_lines"), *_bleu(F.sum), F.avg("testlen").alias("avg_len"))
    j = _nist_sums(_corpus_counts(grams)).join(per, "system")
    ent = [(F.log(f"_t{k}") - F.col(f"_e{k}") / F.col(f"_t{k}")).alias(f"entropy{k}") for k in range(1, MAX_N + 1)]
    if head is not None:
        e = NS.ngram_entropy(NS.ngram_counts(head, "text", MAX_N, keys=["system"]), keys=["system"])
        e = e.groupBy("system").agg(*[F.max(F.when(F.col("n") == k, F.col("entropy"))).alias(f"entropy{k}") for k in range(1, MAX_N + 1)])
        j = j.drop("avg_len").join(e, "system", "left").join(NS.avg_len(head, "text", keys=["system"]), "system", "left")
        ent = [f"entropy{k}" for k in range(1, MAX_N + 1)]
    div = [(F.col(f"_d{k}") / F.col(f"_t{k}")).alias(f"div{k}") for k in (1, 2)]
    return j.select("system", "n_lines", *_nist_cols(), *[f"bleu{k}" for k in range(1, MAX_N + 1)], F.lit(None).cast("double").alias("meteor"),
                    *ent, *div, "avg_len")
