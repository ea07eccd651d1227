"""DartMinHash against weighted Jaccard; classes against all pairs."""
import random

import numpy as np
import pyarrow as pa
import pytest

from convkit.llm import dart
from convkit.llm import near_dedup as N
from convkit.llm import stages
from convkit.llm import wordhash as H
from llm_edge import EDGE, frame, sentence  # noqa: F401


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agreement_is_weighted_jaccard(seed):
    rng = np.random.default_rng(seed)
    e = H.mix(np.arange(60, dtype=np.uint64))
    a = rng.uniform(.05, 9, 60) * (rng.random(60) < .8)
    b = np.where(rng.random(60) < .6, a, rng.uniform(.05, 9, 60) * (rng.random(60) < .8))
    j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    s = dart.sketch(row, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 3, 4000)
    assert abs((s[0] == s[1]).mean() - j) < 4 * (j * (1 - j) / 4000) ** .5
    assert (s[0] != dart.EMPTY).all() and (s[2] == dart.EMPTY).all()


def test_signature_does_not_depend_on_neighbours():
    e = H.mix(np.arange(40, dtype=np.uint64))
    alone = dart.sketch(np.zeros(30, int), e[:30], None, 1, 64)
    both = dart.sketch(np.repeat([0, 1], 30), np.concatenate([e[10:], e[:30]]), None, 2, 64)
    assert (alone[0] == both[1]).all()


def _shingles(t):
    w = (t or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(texts):
    """Class of each text by all pairs."""
    s, cls = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= N.SIMILARITY):
                a, b = cls[i], cls[j]
                cls = [a if c == b else c for c in cls]
    groups = {}
    for i, c in enumerate(cls):
        groups.setdefault(c, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def _edited(rng, text, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def _classes(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["class_id"], set()).add(r["doc_id"])
    return {frozenset(g) for g in groups.values()}


def test_classes_equal_all_pairs(spark, frame, sentence, monkeypatch):
    rng = random.Random(4)
    texts = [sentence(rng.randrange(3, 90)) for _ in range(40)]
    texts += [_edited(rng, t, s) for t in texts[:30] for s in (0.005, 0.02, 0.06)]
    base = sentence(80)
    texts += [_edited(rng, base, 0.025) for _ in range(60)] + [base] * 5 + ["", None, "  "]
    rng.shuffle(texts)
    want = _brute(texts)
    docs = frame(list(enumerate(texts)))
    assert _classes(N.near_dup_classes(docs)) == want
    # the same with many blocks per cluster
    monkeypatch.setattr(N, "BLOCK", 8)
    clean = docs.selectExpr("doc_id", "coalesce(text, '') as text")
    linked = N.exact_links(clean, N.candidate_clusters(clean), block=8)
    sizes = sorted(r["count"] for r in linked.groupBy("component").count().collect())
    keys = {}
    for i, t in enumerate(texts):
        keys.setdefault(t or "", i)
    reps = [{t for t in ((texts[i] or "") for i in g)} for g in want]
    assert sizes == sorted(len(g) for g in reps if len(g) > 1)


def test_edge_rows(spark, frame):
    got = N.near_dup_classes(frame(EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["class_id"] == by[2][0]["class_id"] == 1 and by[3][0]["class_id"] == 3
    assert [r["class_size"] for r in by[4]] == [2, 2] and by[None][0]["class_id"] is None
    kept = N.deduplicated(frame(EDGE)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert N.near_dup_classes(frame([])).count() == 0 and N.deduplicated(frame([])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)]
    e = spark.createDataFrame(chain + star + [(500, 500), (300, 301), (301, 300)], "a long, b long")
    got = {}
    for r in stages.components(e, "a", "b").collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert got == {100: set(range(100, 161)), 1: set(range(1, 60)), 300: {300, 301}}
    assert stages.components(e.where("a < 0"), "a", "b").count() == 0
