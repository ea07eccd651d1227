import math

import numpy as np
import pyarrow as pa

from convkit.llm import rule_ensemble as R
from llm_edge import EDGE, frame, sentence  # noqa: F401


def test_statistics_by_hand():
    x = R.statistics(pa.array(["THE the the!\nb | c #1\nb | c #1", None, " \n "]))
    s = dict(zip(R.STATS, x[0]))
    assert s["n_words"] == 11 and s["upper_share"] == 3 / 20 and s["bang_rate"] == 1 / 11 and s["pipe_rate"] == 2 / 11
    assert s["symbol_rate"] == 2 / 11 and s["next_word_equal"] == 0 and s["line_repeat"] == 1 / 3
    assert s["word_variety"] == 1 - 4 / 11 and abs(s["words_per_line"] - 11 / 3) < 1e-12
    assert s["gram_repeat"] == 2 / 9
    assert x[1].tolist()[0] == 0 and np.isfinite(x).all()


def _corpus(frame, sentence, n=160):
    rows = [(i, sentence(40) if i % 2 else "buy now!! " * 20) for i in range(n)]
    return frame(rows)


def test_fit_score_and_rules(spark, frame, sentence):
    docs = _corpus(frame, sentence)
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    model = R.fit(docs, labels)
    got = R.score(docs, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 and 0 <= r["score"] <= 1 for r in got)
    # the compiled column equals the rules by hand
    x = R.statistics(pa.array([r["text"] for r in got]))
    for r, row in zip(got[:20], x):
        s = dict(zip(R.STATS, row))
        z = model.bias + sum(w.weight for w in model.rules if all((s[n] <= v) == a for n, a, v in w.terms))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    edge = R.score(frame(EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(r["score"] is not None for r in edge)
    assert R.score(frame([]), model).count() == 0


def test_only_rows_that_are_not_held_out(spark, frame, sentence):
    docs = _corpus(frame, sentence, 40)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    import zlib
    used = {r["_id"] for r in R.training_rows(docs, labels).collect()}
    assert used == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert R.training_rows(docs, labels, 7).count() == 7


def test_without_labels(spark, frame):
    docs = frame([(1, "a"), (2, None)])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["predicted"] for r in R.score(docs, R.fit(docs, empty)).collect()} == {1}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")
    assert {r["predicted"] for r in R.score(docs, R.fit(docs, one)).collect()} == {0}
