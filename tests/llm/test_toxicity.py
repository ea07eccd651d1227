import random

import numpy as np

from convkit.llm import toxicity as X
from llm_edge import EDGE, frame, sentence  # noqa: F401


def _sample(sentence, n=240):
    rng = random.Random(1)
    texts, y = [], []
    for i in range(n):
        bad = i % 3 == 0
        word = rng.choice(X.CATEGORY_SEEDS["insult"] + X.CATEGORY_SEEDS["contempt"] + ["zorblax", "zorbine"])
        texts.append(sentence(rng.randrange(5, 120)) + (f" {word}, " + sentence(5) if bad else ""))
        y.append(int(bad))
    return texts, np.array(y, dtype=float)


def _predict(chain, texts):
    import pyarrow as pa
    row, h = X.row_features(pa.array(texts))
    return chain.predict(*X._known(chain.keys, row, h, X._bitmap(chain.keys)), len(texts))


def test_chain_finds_categories_and_leaves_clean(sentence):
    texts, y = _sample(sentence)
    chain = X.fit_chain(texts, y)
    p = _predict(chain, [sentence(300), sentence(300) + " You IDIOT!", "scum " + sentence(20), sentence(30) + " zorbane " + sentence(30)])
    assert (p[:, -1] >= X.THRESHOLD).tolist() == [False, True, True, True]
    assert p[1, 0] > 0.4 > p[0, 0] and p[2, 1] > 0.4
    assert np.any(chain.links != 0)             # later models use earlier probabilities


def test_edge_rows(spark, frame, sentence):
    chain = X.fit_chain(*_sample(sentence, 60))
    rows = X.score(frame(EDGE), chain).collect()
    assert len(rows) == len(EDGE) and not any(r["toxic"] for r in rows)
    assert all(0 <= r["p_toxic"] <= 1 for r in rows)
    assert X.score(frame([]), chain).count() == 0


def test_no_labels():
    chain = X.fit_chain([], np.array([]))
    assert not (_predict(chain, ["an idiot", None])[:, -1] >= 0.99).any()


def test_training_from_tables(spark, frame):
    docs = frame([(i, "plain text here" if i % 2 else "what a moron") for i in range(40)])
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(0, 40)] + [(None, 1), (99, 1), (3, None)], "doc_id long, toxic int")
    chain = X.train(docs, labels, per_class=10)
    got = {r["doc_id"]: r["toxic"] for r in X.score(docs, chain).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(40))
