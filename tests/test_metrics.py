"""Metrics against brute-force Python on a small fixture, plus invariants."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convkit.functions import text as T
from convkit.operators import metrics as ME
from convkit.operators import ngram_stats as NS

HYPS = [("s", "k1", "the cat sat on the mat"), ("s", "k2", "a dog"), ("s", "k3", ""),
        ("t", "k1", "the cat the cat"), ("t", "k2", "a dog barks loudly today"), ("t", "k3", "hello  world")]
REFS = {"k1": ["the cat is on the mat", "there is a cat on the mat"],
        "k2": ["a dog barks", "the dog"],
        "k3": ["hello world", "hello there world"]}


def texts(spark):
    h = spark.createDataFrame(HYPS, "system string, key string, hyp string")
    r = spark.createDataFrame(list(REFS.items()), "key string, refs array<string>")
    return ME.hyp_refs(h, r, n_refs=2)


def prep(spark):
    return ME.ngram_table(texts(spark))


def grams(ws, n):
    return Counter(" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1))


def py_bleu(system):
    corr, guess, tl, rl = [0] * 4, [0] * 4, 0, 0
    for s, k, h in HYPS:
        if s != system:
            continue
        hw = h.split()
        refs = [r.split() for r in REFS[k]]
        tl += len(hw)
        rl += min((abs(len(r) - len(hw)), len(r)) for r in refs)[1]
        for n in range(1, 5):
            hc = grams(hw, n)
            mx = Counter()
            for r in refs:
                for g, c in grams(r, n).items():
                    mx[g] = max(mx[g], c)
            corr[n - 1] += sum(min(c, mx[g]) for g, c in hc.items())
            guess[n - 1] += max(0, len(hw) - n + 1)
    out, prod = [], 1.0
    ratio = (tl + 1e-15) / (rl + 1e-9)
    for n in range(4):
        prod *= (corr[n] + 1e-15) / (guess[n] + 1e-9)
        v = prod ** (1 / (n + 1))
        out.append(v * math.exp(1 - 1 / ratio) if ratio < 1 else v)
    return out


def py_rouge(h, refs, beta=1.2):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
        return t[-1][-1]
    hc = h.split(" ")
    ps, rs = [], []
    for r in refs:
        rt = r.split(" ")
        m = lcs(rt, hc)
        ps.append(m / len(hc))
        rs.append(m / len(rt))
    p, r = max(ps), max(rs)
    return (1 + beta ** 2) * p * r / (r + beta ** 2 * p) if p and r else 0.0


def py_cider(system, sigma=6.0):
    keys = sorted(REFS)
    df = Counter()
    for k in keys:
        seen = set()
        for r in REFS[k]:
            for n in range(1, 5):
                seen |= {(n, g) for g in grams(r.split(), n)}
        df.update(seen)
    N = math.log(len(keys))

    def vec(ws):
        v = {}
        for n in range(1, 5):
            for g, c in grams(ws, n).items():
                v[(n, g)] = c * (N - math.log(max(1.0, df[(n, g)])))
        return v

    def norm(v, n):
        return math.sqrt(sum(x * x for (m, _), x in v.items() if m == n))
    out = {}
    for s, k, h in HYPS:
        if s != system:
            continue
        hv, hw = vec(h.split()), h.split()
        total = [0.0] * 4
        for r in REFS[k]:
            rw = r.split()
            rv = vec(rw)
            delta = max(0, len(hw) - 1) - max(0, len(rw) - 1)
            for n in range(1, 5):
                val = sum(min(x, rv.get(key, 0.0)) * rv.get(key, 0.0) for key, x in hv.items() if key[0] == n)
                nh, nr = norm(hv, n), norm(rv, n)
                if nh and nr:
                    val /= nh * nr
                total[n - 1] += val * math.exp(-(delta ** 2) / (2 * sigma ** 2))
        out[k] = sum(total) / 4 / len(REFS[k]) * 10.0
    return out


@pytest.mark.parametrize("system", ["s", "t"])
def test_bleu_matches_bruteforce(spark, system):
    got = {r["system"]: r for r in ME.bleu_corpus(prep(spark)).collect()}[system]
    exp = py_bleu(system)
    for n in range(4):
        assert got[f"bleu{n + 1}"] == pytest.approx(exp[n], rel=1e-9, abs=1e-12)


def test_bleu_identity_is_one(spark):
    h = spark.createDataFrame([("s", "k", "a b c d e f")], "system string, key string, hyp string")
    refs = spark.createDataFrame([("k", ["a b c d e f"])], "key string, refs array<string>")
    r = ME.bleu_corpus(ME.ngram_table(ME.hyp_refs(h, refs, n_refs=1))).collect()[0]
    assert r["bleu4"] == pytest.approx(1.0, abs=1e-6)


def test_rouge_matches_bruteforce(spark):
    got = {(r["system"], r["key"]): r["rouge_l"] for r in ME.rouge_l(texts(spark)).collect()}
    for s, k, hyp in HYPS:
        assert got[(s, k)] == pytest.approx(py_rouge(hyp, REFS[k]), abs=1e-12)


@pytest.mark.parametrize("system", ["s", "t"])
def test_cider_matches_bruteforce(spark, system):
    got = {r["key"]: r["cider"] for r in ME.cider(prep(spark)).collect() if r["system"] == system}
    for k, v in py_cider(system).items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_hyp_refs_cycle_and_vshuman(spark):
    hy = spark.createDataFrame([("s", "k", "x")], "system string, key string, hyp string")
    rf = spark.createDataFrame([("k", ["1|r0", "2|r1|tail", "r2"])], "key string, refs array<string>")
    t = ME.hyp_refs(hy, rf, n_refs=6, vshuman=1)
    got = [r["text"] for r in t.filter("system is null").orderBy("ri").collect()]
    # i % 3, index 1 skipped to 2; text between first and second '|'
    assert got == ["r0", "r2", "r2", "r0", "r2", "r2"]


def test_hypothesis_without_references_ends_the_job(spark):
    hy = spark.createDataFrame([("s", "k", "x"), ("s", "q", "y")], "system string, key string, hyp string")
    rf = spark.createDataFrame([("k", ["a"])], "key string, refs array<string>")
    with pytest.raises(Exception, match="no references for key q"):
        ME.hyp_refs(hy, rf).collect()


def test_first_lines_in_key_order(spark):
    hy = spark.createDataFrame([(s, k, k) for s in "ab" for k in ("k3", "k1", "k2", "k10")], "system string, key string, hyp string")
    rf = spark.createDataFrame([(k, ["a"]) for k in ("k1", "k2", "k3", "k10")], "key string, refs array<string>")
    got = ME.first_lines(ME.hyp_refs(hy, rf), 2).collect()
    assert sorted((r["system"], r["key"]) for r in got) == [("a", "k1"), ("a", "k10"), ("b", "k1"), ("b", "k10")]
    # only entropy and mean length take the first lines
    t = ME.hyp_refs(hy, rf)
    whole, cut = (ME.system_report(ME.ngram_table(t), h).collect() for h in (None, ME.first_lines(t, 3)))
    words = {r["system"]: [x["hyp"].split() for x in sorted(hy.filter(hy.system == r["system"]).collect(), key=lambda x: x["key"])] for r in whole}
    for a, b in zip(sorted(whole, key=lambda r: r["system"]), sorted(cut, key=lambda r: r["system"])):
        assert all(a[c] == pytest.approx(b[c], nan_ok=True) for c in a.asDict() if c not in ("system", "meteor", "avg_len") and "entropy" not in c)
        assert b["avg_len"] == pytest.approx(sum(map(len, words[b["system"]][:3])) / 3)


def test_lcs_of_batches():
    import random

    from convkit.functions.ngrams import _lcs
    rng = random.Random(1)
    a = [[rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(200)]
    b = [[rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(200)]

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    assert _lcs(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)] and _lcs([], []).tolist() == []


def test_distinct_and_entropy_invariants(spark):
    from convkit.operators import ngram_stats as NS
    df = spark.createDataFrame([("a b a b",), ("c",), ("",)], "text string")
    c = NS.ngram_counts(df, "text", 4)
    d = {r["n"]: r["distinct"] for r in NS.distinct_n(c).collect()}
    assert d[1] == pytest.approx(3 / 5) and d[2] == pytest.approx(2 / 3) and all(v <= 1 for v in d.values())
    e = {r["n"]: r["entropy"] for r in NS.ngram_entropy(c).collect()}
    p = [2 / 5, 2 / 5, 1 / 5]
    assert e[1] == pytest.approx(-sum(x * math.log(x) for x in p))
    assert 4 not in e or e[4] == pytest.approx(0.0)


def _pool_bleu(hyp, pool):
    """One line against all texts of the pool, by the definition."""
    hw, refs = hyp.split(), [r.split() for r in pool]
    closest = min((abs(len(r) - len(hw)), len(r)) for r in refs)[1]
    ratio, prod, out = (len(hw) + 1e-15) / (closest + 1e-9), 1.0, []
    for n in range(1, 5):
        most = Counter()
        for r in refs:
            for g, c in grams(r, n).items():
                most[g] = max(most[g], c)
        right = sum(min(c, most[g]) for g, c in grams(hw, n).items())
        prod *= (right + 1e-15) / (max(0, len(hw) - n + 1) + 1e-9)
        out.append(prod ** (1 / n) * (math.exp(1 - 1 / ratio) if ratio < 1 else 1))
    return out


def test_bleu_against_a_pool(spark):
    import random
    rng = random.Random(2)
    word = "a b c d e f".split()
    pool = [" ".join(rng.choice(word) for _ in range(rng.choice([0, 1, 2, 4, 7, 12, 30]))) for _ in range(40)] + ["a a a a b", "a a a a b"]
    hyps = [("s", str(i), " ".join(rng.choice(word + ["zz"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    h = spark.createDataFrame(hyps, "system string, key string, text string")
    p = spark.createDataFrame(list(enumerate(pool)), "rid int, text string")
    got = {r["key"]: [r[f"bleu{k}"] for k in range(1, 5)] for r in ME.bleu_pool(h, p).collect()}
    assert set(got) == {k for _, k, _ in hyps}
    for _, k, text in hyps:
        assert got[k] == pytest.approx(_pool_bleu(text, pool), rel=1e-9, abs=1e-12)
    assert {r["bleu1"] for r in ME.bleu_pool(h, p.limit(0)).collect()} == {None}


def test_effective_reference_lengths(spark):
    g = prep(spark)
    for effective, pick in (("shortest", min), ("average", lambda x: sum(x) / len(x)), ("closest", None)):
        got = {r["system"]: r["bleu1"] for r in ME.bleu_corpus(g, effective).collect()}
        for system in "st":
            mine = [(h.split(), [r.split() for r in REFS[k]]) for s, k, h in HYPS if s == system]
            length = sum(len(h) for h, _ in mine)
            target = sum(pick([len(r) for r in rs]) if pick else min((abs(len(r) - len(h)), len(r)) for r in rs)[1] for h, rs in mine)
            right = sum(min(c, max(grams(r, 1)[w] for r in rs)) for h, rs in mine for w, c in grams(h, 1).items())
            ratio = (length + 1e-15) / (target + 1e-9)
            assert got[system] == pytest.approx((right + 1e-15) / (length + 1e-9) * (math.exp(1 - 1 / ratio) if ratio < 1 else 1))
    # without an option: the average for a single segment, else the closest
    several = ME.bleu_corpus(g, None).orderBy("system").collect()
    assert several == ME.bleu_corpus(g).orderBy("system").collect()
    one = g.filter("key = 'k1'")
    assert ME.bleu_corpus(one, None).orderBy("system").collect() == ME.bleu_corpus(one, "average").orderBy("system").collect()


def test_merged_sketches_against_exact_counts(spark):
    rng = random.Random(2)
    rows = [(i % 5, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60)))) for i in range(800)] + [(0, None), (1, "")]
    df = spark.createDataFrame(rows, "month int, text string")
    parts = NS.distinct_sketch(df, keys=["month"])
    exact = {r["n"]: r["distinct"] for r in NS.distinct_n(NS.ngram_counts(df)).collect()}
    got = {r["n"]: r["distinct"] for r in NS.distinct_of(NS.merge_sketches(parts)).collect()}
    assert set(got) == set(exact) and all(abs(got[n] / exact[n] - 1) < 0.03 for n in exact)
    assert NS.merge_sketches(parts.limit(0)).count() == 0


def test_tokeniser_as_a_parameter(spark):
    df = spark.createDataFrame([("Ab12 cd e",)], "text string")
    signs = lambda c: F.split(F.regexp_replace(c, r"\s+", ""), "")
    assert df.select(T.eval_clean("text", signs).alias("x")).first()["x"] == "a b 1 2 c d e"
    assert df.select(T.gpt_norm("text", signs).alias("x")).first()["x"] == "A b 1 2 c d e"
    got = {r["ngram"]: r["cnt"] for r in NS.ngram_counts(df, max_n=1, tokeniser=lambda c: F.split(F.lower(c), "[^a-z]+")).collect()}
    assert got == {"ab": 1, "cd": 1, "e": 1}


def test_buckets_and_flushes_change_nothing(spark, monkeypatch):
    """Corpus statistics summed in many small parts, for systems of repeated texts."""
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(9)))
    h = spark.createDataFrame([(s, f"k{i}", line()) for s in "st" for i in range(40)], "system string, key string, hyp string")
    r = spark.createDataFrame([(f"k{i}", [line() for _ in range(1 + i % 3)]) for i in range(40)], "key string, refs array<string>")
    g = ME.ngram_table(ME.hyp_refs(h, r, n_refs=4)).repartition(2).persist()
    assert g.count() == 40                                      # a row per segment, none per n-gram
    def values():
        rows = ME.cider(g).collect() + ME.system_report(g).collect()
        return {tuple(str(v) for v in x[:2]): [v for v in x[2:] if v is not None] for x in rows}
    whole = values()
    monkeypatch.setattr(ME, "BUCKET_WORDS", 40), monkeypatch.setattr(ME, "FLUSH_GRAMS", 10)
    parts = values()
    assert whole.keys() == parts.keys() and len(whole) == 82
    assert all(parts[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in whole.items())
    g.unpersist()


def test_pool_writes_a_row_per_hypothesis_only(spark, monkeypatch):
    """No n-gram is written; a hypothesis that comes twice counts once with both, one without text doesn't."""
    written, real = [], ME.materialize

    def counted(df, tag="stage"):
        out = real(df, tag)
        written.append(out.count())
        return out
    monkeypatch.setattr(ME, "materialize", counted)
    h = spark.createDataFrame([("s", "k", "a b a"), ("s", "k", "a b a"), ("s", "m", "a b"), ("s", "n", None)], "system string, key string, text string")
    p = spark.createDataFrame([(i, "a b a c") for i in range(30)], "rid int, text string")
    assert {r["key"] for r in ME.bleu_pool(h, p).collect()} == {"k", "m"}
    assert sum(written) == 2
