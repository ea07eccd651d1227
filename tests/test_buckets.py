"""The bucketed extract: same pairs, no shuffle below the chain, hot threads apart."""
import random
import re

import pytest
from pyspark.sql import functions as F

from convkit.operators import buckets as BK
from convkit.operators import threads as TH
from convkit.session import materialize

PARAMS = dict(max_len=20, max_depth=3, min_depth=2, min_score=0, use_title=True, leaves_only=False, clean=False)


def _extract(spark, sizes, months=("2024-01", "2024-02")):
    rng = random.Random(3)
    rows, subs = [], []
    for k, n in enumerate(sizes):
        month, link = months[k % len(months)], f"t3_s{k}"
        subs.append((f"s{k}", 1, 5, "x.com", f"/r/S{k % 3}/comments/", f"Title {k}", month))
        for i in range(n):
            up = link if i == 0 or rng.random() < 0.2 else f"t1_c{k}_{rng.randrange(i)}"
            rows.append((f"c{k}_{i}", "u", up, link, rng.randrange(3), f"word{k} body {i}", month))
    c = spark.createDataFrame(rows, "id string, author string, parent_id string, link_id string, score int, body string, month string")
    s = TH.submission_filter(spark.createDataFrame(subs, "id string, score int, num_comments int, domain string, permalink string, title string, month string"))
    return materialize(TH.comment_admission(c, s), "test-comments"), materialize(s, "test-subs")


def _rows(df):
    return sorted(map(tuple, df.select("month", "sid", "pid", "cid", "context", "response").collect()))


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # the plan before any run
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kw", [{}, {"leaves_only": True}, {"min_score": 1, "clean": True}])
def test_no_exchange_and_equal_pairs(spark, no_broadcast, kw):
    c, s = _extract(spark, [9] * 40)
    e = BK.write(c, s, buckets=4)
    assert e.hot_comments is None
    got = BK.kept_pairs(e, **{**PARAMS, **kw})
    plan = _plan(got)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    plain = TH.kept_pairs(c, s, **{**PARAMS, **kw})
    assert "Exchange" in _plan(plain)
    assert _rows(got) == _rows(plain) != []
    assert spark.conf.get(BK.CO_PARTITION) == "true"            # the caller's session is as it was
    BK.drop(e)
    assert not [t for t in spark.catalog.listTables() if t.name in e.tables]


def test_hot_threads_join_by_unique_names(spark, no_broadcast):
    c, s = _extract(spark, [400, 350] + [5] * 60)
    e = BK.write(c, s, buckets=4)
    assert e.hot_comments.select("link_id").distinct().count() == 2
    assert e.comments.where(F.col("link_id").isin("t3_s0", "t3_s1")).count() == 0
    assert e.comments.count() + e.hot_comments.count() == c.count()
    for kw in ({}, {"leaves_only": True}):
        got = BK.kept_pairs(e, **{**PARAMS, **kw})
        shuffled = re.findall(r"hashpartitioning\(([^)]*)\)", _plan(got))
        # every shuffle of the hot part spreads a thread over the tasks
        assert shuffled and all(re.search(r"\b(name|_pn|top_parent|parent_id|_p\w+)#", x) for x in shuffled), shuffled
        assert _rows(got) == _rows(TH.kept_pairs(c, s, **{**PARAMS, **kw})) != []
    BK.drop(e)


def test_files_and_edges(spark):
    c, s = _extract(spark, [6] * 30)
    e = BK.write(c, s, buckets=3)
    for month in ("2024-01", "2024-02"):
        files = [f for f in e.comments.inputFiles() if f"month={month}" in f]
        assert 0 < len(files) <= 3                              # one file a bucket and month
    BK.drop(e)
    e = BK.write(c.limit(0), s.limit(0), buckets=3)
    assert BK.kept_pairs(e, **PARAMS).count() == 0
    BK.drop(e)
    one, sub = _extract(spark, [7])                             # a single thread is all there is
    e = BK.write(one, sub, buckets=3)
    assert _rows(BK.kept_pairs(e, **PARAMS)) == _rows(TH.kept_pairs(one, sub, **PARAMS)) != []
    BK.drop(e)
