"""Distributed prefix sums and keyed windows against pandas, with one key
holding most rows (skew)."""

import pandas as pd
from pyspark.sql import functions as F

from convkit.operators import ordering as O
from convkit.operators import scoring as SC


def skewed(spark, n=3000):
    rows = [(0 if i % 3 else 1 + i % 7, i, (i * 7) % 11 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t long, v long")


def test_global_and_keyed_cumsum(spark):
    df = skewed(spark)
    pdf = df.toPandas().sort_values(["k", "t"])
    g = O.global_cumsum(df, [F.col("k"), F.col("t")], F.col("v"), "cs").toPandas().sort_values(["k", "t"])
    assert list(g["cs"]) == list(pdf["v"].cumsum())
    g = O.global_cumsum(df, [F.col("k"), F.col("t")], F.col("v"), "cs", inclusive=False).toPandas().sort_values(["k", "t"])
    assert list(g["cs"]) == list(pdf["v"].cumsum() - pdf["v"])
    assert O.global_index(df.limit(0), [F.col("k")]).count() == 0
    ki = O.keyed_index(df, ["k"], [-F.col("t")], "i").toPandas().sort_values(["k", "t"], ascending=[True, False])
    assert list(ki["i"]) == list(pdf.sort_values(["k", "t"], ascending=[True, False]).groupby("k").cumcount())


def brute_history(rows, budget):
    out = {}
    by = {}
    for uid, ts, n, text in rows:
        if text != "":
            by.setdefault(uid, []).append((ts, n))
    win = {}
    for uid, msgs in by.items():
        msgs.sort()
        for j in range(len(msgs)):
            tot, k = msgs[j][1], 1
            for i in range(j - 1, -1, -1):
                if tot + msgs[i][1] > budget:
                    break
                tot += msgs[i][1]
                k += 1
            win[(uid, msgs[j][0])] = (k, tot)
        last = len(msgs) - 1
        k, tot = win[(uid, msgs[last][0])]
        out[uid] = (msgs[last - k + 1][0], k, tot)
    return out, win


def test_history_final_and_window(spark):
    rows = [(u, t, 1 + (u * 5 + t * 3) % 40, "" if (u + t) % 9 == 0 else "x") for u in range(4) for t in range(60)]
    rows += [(9, t, 70 if t == 5 else 3, "x") for t in range(10)]     # newest-over-budget case
    rows += [(10, t, 1, "") for t in range(3)] + [(11, 1, 1, None)]     # nothing but empty messages
    df = spark.createDataFrame(rows, "uid long, ts long, n_tokens long, text string")
    final, win = brute_history([r for r in rows if r[3] is not None], 64)
    final |= {10: (None, 0, 1), 11: (None, 0, 1)}
    got = {r["uid"]: (r["from_ts"], r["n_kept"], r["tokens"]) for r in SC.history_final(df).collect()}
    assert got == final
    gw = {(r["uid"], r["ts"]): (r["n_kept"], r["tokens"]) for r in SC.history_window(df, block=16).collect()}
    assert gw == win
