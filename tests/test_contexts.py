"""Context ranges against rows that hold whole conversations, and weighted
epochs against a plain simulation."""

import hashlib
import random

from pyspark.sql import functions as F

from convkit.operators import batching as BA
from convkit.operators import contexts as CX
from convkit.operators import corpus as CO
from convkit.operators import features as FE
from convkit.operators import ordering as O


def talk(spark, seed=3, convs=25, longest=40):
    rng = random.Random(seed)
    rows = [(c, 2 * t + c % 3, [rng.randrange(3, 50) for _ in range(rng.choice([0, 1, 3, 8, 45]))])
            for c in range(convs) for t in range(rng.randrange(1, longest))]
    rows += [(None, t, [5, 6]) for t in range(9)] + [(99, 0, None), (99, 1, [7]), (98, 4, [1])]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, ids array<int>"), rows


def whole(rows):
    """(conv, turn) -> (context, response) of every turn but the first."""
    by, out = {}, {}
    for c, t, ids in rows:
        by.setdefault(c, []).append((t, ids or []))
    for c, turns in by.items():
        turns.sort()
        for i in range(1, len(turns)):
            ctx = [x for _, ids in turns[:i] for x in [*ids, FE.EOS_ID]][:-1]
            out[c, turns[i][0]] = (ctx, turns[i][1])
    return out


def test_context_tails_equal_whole_contexts(spark):
    df, rows = talk(spark)
    want = whole(rows)
    for budget, block in ((1, None), (16, 17), (16, None), (64, 100)):
        got = {(r["conv_id"], r["turn"]): (r["context_ids"], r["response_ids"], r["context_len"])
               for r in CX.context_tails(df, budget, block=block).collect()}
        assert got == {k: (c[-budget:], r, len(c)) for k, (c, r) in want.items()}
    assert CX.context_tails(df.limit(0), 8).count() == 0


def test_features_equal_those_of_unrolled_rows(spark):
    df, _ = talk(spark, seed=4)
    df = df.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).filter("conv_id IS NOT NULL")
    u = CO.unroll_turns(df, ["ids"]).withColumn("turn_ids", F.transform("turns", lambda x: x["ids"]))
    ctx = FE.flatten_eos(F.slice("turn_ids", 1, F.size("turn_ids") - 1))
    for max_len in (8, 40, 64):
        e = u.select("conv_id", "turn", FE.eval_features(ctx, F.element_at("turn_ids", -1), max_len).alias("e")).filter("e IS NOT NULL")
        assert sorted(map(tuple, CX.eval_rows(df, max_len).collect())) == sorted(map(tuple, e.collect()))
        g = u.filter(~FE.feature_len_guard("turn_ids", max_len)).select("conv_id", "turn", FE.flatten_eos("turn_ids").alias("input_ids"))
        assert sorted(map(tuple, CX.guarded_rows(df, max_len).collect())) == sorted(map(tuple, g.collect()))


def test_length_guard_by_hand(spark):
    rows = [([[1] * 4, [1] * 4], False), ([[1] * 5, [1]], True), ([[1] * 3, [], [1]], True), ([[1] * 3, [1]], False), ([], False), ([[1], [1], [1] * 4], False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t array<array<int>>")
    got = {r["i"]: r["x"] for r in df.select("i", FE.feature_len_guard("t", 4).alias("x")).collect()}
    want = {}
    for i, (t, _) in enumerate(rows):
        before, bad = 0, False
        for a in t:
            bad |= len(a) > 4 or before > 4
            before += len(a) + 1
        want[i] = bad
    assert got == want


def test_conversation_of_100000_turns(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                               F.array_repeat((F.col("id") % 97).cast("int") + 3, (F.col("id") % 3).cast("int")).alias("ids"))
    t = CX.context_tails(df, 16)
    r = t.agg(F.count(F.lit(1)).alias("n"), F.max("context_len").alias("len"), F.max(F.size("context_ids")).alias("most")).first()
    assert (r["n"], r["len"], r["most"]) == (n - 1, sum(i % 3 + 1 for i in range(n - 1)) - 1, 16)
    assert CX.guarded_rows(df, 16).count() == len([1 for i in range(1, 40) if sum(j % 3 + 1 for j in range(i)) <= 16])


def test_keyed_cumsum_of_keys_over_many_ranges(spark):
    rows = [(0 if i % 3 else (None if i % 2 else 1 + i % 7), i, (i * 7) % 11 + 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    want, run = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        want[t] = run.get(k, 0)
        run[k] = run.get(k, 0) + v
    assert {r["t"]: r["s"] for r in O.keyed_cumsum(df, ["k"], [F.col("t")], F.col("v"), "s").collect()} == want
    assert O.keyed_cumsum(df.limit(0), ["k"], [F.col("t")], F.col("v"), "s").count() == 0


def plain_epochs(rows, epochs, decrease, batch, bucket):
    out, e = set(), 1.0
    for epoch in range(epochs):
        for chunk in {r[0] for r in rows}:
            cls = {}
            for _, i, c, n in sorted(r for r in rows if r[0] == chunk):
                cls.setdefault(c, []).append((i, n))
            w = {c: (1 / len(m)) ** e for c, m in cls.items()}
            total = sum(len(cls[c]) * w[c] for c in sorted(cls))
            draws = []
            for d in range(1, round(total / min(w.values())) + 1):
                x = int(hashlib.md5(f"42|{epoch}|{chunk}|{d}".encode()).hexdigest()[:13], 16) / 2 ** 52 * total
                lo = 0.0
                for c in sorted(cls):
                    if lo + len(cls[c]) * w[c] > x:
                        break
                    lo += len(cls[c]) * w[c]
                draws.append((d, *cls[c][min(int((x - lo) / w[c]), len(cls[c]) - 1)]))
            for b in range(0, len(draws), bucket):
                some = sorted(draws[b:b + bucket], key=lambda r: (-r[2], r[0]))
                for k in range(0, len(some) - batch + 1, batch):
                    out |= {(epoch, chunk, d, i, b // bucket, k // batch) for d, i, _ in some[k:k + batch]}
        e = max(e - decrease, 0.0)
    return out


def test_weighted_epochs_equal_a_plain_simulation(spark):
    rng = random.Random(8)
    rows = [(i // 150, i, rng.choice([-1.0, 0.0, 0.0, 0.0, 0.0, 1.0]), rng.randrange(5, 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "chunk long, id long, reward double, len int")
    got = BA.weighted_epochs(df, "chunk", "id", "reward", "len", epochs=4, decrease=0.4, batch_size=8, bucket_size=40)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1      # before it runs
    want = plain_epochs(rows, 4, 0.4, 8, 40)
    assert {tuple(r)[:6] for r in got.collect()} == want and got.count() == len(want) > 1000
    # exponent 1: every class is drawn about as often; 0: as often as it occurs
    by = got.join(df.select("id", "reward"), "id").groupBy("epoch", "reward").count().collect()
    n = {(r["epoch"], r["reward"]): r["count"] for r in by}
    assert n[0, -1.0] > 0.25 * sum(v for (e, _), v in n.items() if e == 0)
    assert n[3, -1.0] < 0.25 * sum(v for (e, _), v in n.items() if e == 3)
    assert BA.weighted_epochs(df.limit(0), "chunk", "id", "reward", "len", 2, 0.5, 8).count() == 0
