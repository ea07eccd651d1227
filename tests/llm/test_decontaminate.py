import random

import numpy as np

from convkit.llm import decontaminate as D
from llm_edge import EDGE, frame, sentence  # noqa: F401


def _sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


def test_align_equals_dynamic_programme():
    rng = random.Random(1)
    w, t, want = [], [], []
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(40))]
        b = [rng.randrange(6) for _ in range(rng.randrange(12))]
        w.append(np.array(a, np.uint32).tobytes())
        t.append(np.array(b, np.uint32).tobytes())
        want.append(_sw(a, b))
    assert D.align(w, t, cells=500).tolist() == want and D.align([], []).tolist() == []


def _edit(rng, text, share):
    out = []
    for w in text.split():
        x = rng.random()
        out += [f"other{rng.randrange(999)}"] if x < share / 2 else [] if x < 0.75 * share else [w, "extra"] if x < share else [w]
    return " ".join(out)


def _found(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_equals_alignment_of_all_pairs(spark, frame, sentence):
    rng = random.Random(3)
    items = [(i, sentence(rng.randrange(15, 50))) for i in range(12)]
    docs, n = [], 0
    for i, text in items:
        for share in (0, 0.05, 0.1, 0.2, 0.6):
            docs.append((n, sentence(30) + " " + _edit(rng, text, share).upper() + ", " + sentence(rng.randrange(200))))
            n += 1
    docs += [(n + k, sentence(120)) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    import re
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    want = {(d, i) for d, x in docs for i, y in items if _sw(words(x), words(y)) / (2 * len(words(y))) >= D.SIMILARITY}
    got = _found(D.leaks(frame(docs), bench))
    assert got == want and len(want) >= 45
    assert _found(D.leaks(frame(docs), bench, block=50)) == got       # in many blocks
    kept = {r["doc_id"] for r in D.decontaminated(frame(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_hot_item_keeps_seeds(spark, frame, sentence):
    item = sentence(30)
    bench = spark.createDataFrame([(1, item), (2, sentence(30))], "item_id long, text string")
    assert _found(D.leaks(frame([(i, f"{sentence(5)} {item}") for i in range(60)]), bench)) == {(i, 1) for i in range(60)}


def test_edge_rows(spark, frame):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "a b c d e f g h"), (5, "a b c d e f g h")], "item_id long, text string")
    got = _found(D.leaks(frame(EDGE), bench))
    assert got == {(4, 3), (8, 5), (8, None)}
    kept = [r["doc_id"] for r in D.decontaminated(frame(EDGE), bench).collect()]
    assert sorted(x or 0 for x in kept) == [0, 1, 2, 3, 5, 6, 7]
    empty = bench.limit(0)
    assert D.leaks(frame(EDGE), empty).count() == 0 and D.decontaminated(frame(EDGE), empty).count() == len(EDGE)
    assert D.leaks(frame([]), bench).count() == 0


def test_texts_of_one_id_are_sought_one_by_one(spark, frame, sentence):
    for item in (1, None):
        a, b = sentence(30), sentence(30)
        bench = spark.createDataFrame([(item, a), (item, b)], "item_id long, text string")
        assert _found(D.leaks(frame([(1, a), (2, sentence(60)), (3, b)]), bench)) == {(1, item), (3, item)}
        assert _found(D.leaks(frame([(1, f"{sentence(9)} {a}"), (2, sentence(60))]), bench)) == {(1, item)}


def test_repeated_benchmark_rows_and_grams(spark, frame, sentence):
    rows = [(i, sentence(30)) for i in range(20)] + [(20, " ".join([sentence(10)] * 3))]
    rng = random.Random(5)
    docs = [(i, f"{sentence(20)} {_edit(rng, text, 0.2)} {sentence(20)}") for i, text in rows]
    once = spark.createDataFrame(rows, "item_id long, text string")
    many = spark.createDataFrame(rows * 4, "item_id long, text string")
    got = D.leaks(frame(docs), many).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, D.leaks(frame(docs), once).collect())) and len(got) >= 18
    grams = D.item_grams(D.item_texts(many))
    assert grams.count() == grams.select("tid", "gram").distinct().count()


def test_much_edited_copies_beside_exact_ones(spark, frame, sentence):
    """Copies of which few grams survive, also where every gram of the item stands in other documents."""
    import re
    rng = random.Random(7)
    items = [(i, sentence(30)) for i in range(24)]
    docs, n = [], 0
    for i, text in items:
        few = " ".join("other" if k > 4 and k % 3 == 2 else w for k, w in enumerate(text.split()))
        edits = [_edit(rng, text, share) for share in (0.25, 0.3, 0.35, 0.35)]
        for d in ([few], [few, text], edits, [*edits, text])[i % 4]:
            docs.append((n, f"{sentence(20)} {d} {sentence(20)}"))
            n += 1
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    want = {(d, i) for d, x in docs for i, y in items
            if grams(words(x)) & grams(words(y)) and _sw(words(x), words(y)) / (2 * len(words(y))) >= D.SIMILARITY}
    assert _found(D.leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string"))) == want and len(want) >= 50


def test_items_that_share_a_phrase_are_not_all_aligned(spark, frame):
    """A phrase of all items and documents: few pairs pass the bound, none of the copies among them is lost."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    phrase = "which of the following is true"
    items = [(i, " ".join([phrase, *(word() for _ in range(24))])) for i in range(100)]
    docs = [(i, " ".join([*(word() for _ in range(40)), phrase, *(word() for _ in range(40))])) for i in range(100)]
    kept = [(1000 + i, " ".join([*(word() for _ in range(40)), phrase, *(w for k, w in enumerate(t.split()[6:]) if k % 5 != 2), word()]))
            for i, t in items[:30]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    seed = D.seeds(D.item_texts(bench))
    found = D.passages(frame(docs + kept), seed)
    near, _ = D.candidates(found, seed)
    item = {r["tid"]: r["words"] for r in seed.collect()}
    window = {(r["rid"], r["lo"]): r["window"] for r in found.collect()}
    pairs = [(window[r["rid"], r["lo"]], item[r["tid"]]) for r in near.collect()]
    assert len(pairs) < 0.05 * 130 * 100
    assert D.in_reach(*zip(*pairs)).sum() < 0.01 * 130 * 100
    assert _found(D.leaks(frame(docs + kept), bench)) == {(1000 + i, i) for i in range(30)}


def test_common_seeds_equal_all_pairs(spark, frame, sentence, monkeypatch):
    """Every seed treated as common, edits up to a third of the words."""
    import re
    monkeypatch.setattr(D, "RARE", 0)
    monkeypatch.setattr(D, "FEW", 0)
    rng = random.Random(13)
    items = [(i, f"{sentence(rng.randrange(8, 24))} as shown in the table {sentence(8)}") for i in range(12)]
    docs = [(10 * i + k, f"{sentence(20)} {_edit(rng, t, share)} {sentence(30)}")
            for i, t in items for k, share in enumerate((0, 0.1, 0.2, 0.25, 0.3, 0.35))]
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    want = {(d, i) for d, x in docs for i, y in items
            if grams(words(x)) & grams(words(y)) and _sw(words(x), words(y)) / (2 * len(words(y))) >= D.SIMILARITY}
    assert _found(D.leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string"))) == want and len(want) >= 50


def test_short_items_within_long_documents(spark, frame, sentence):
    bench = spark.createDataFrame([(1, "zebra"), (2, "blue Zebra"), (3, "a blue zebra")], "item_id long, text string")
    docs = [(1, f"{sentence(30)} a blue, zebra {sentence(9)}"), (2, f"{sentence(9)} zebra blue"), (3, sentence(40)), (4, "blue")]
    assert _found(D.leaks(frame(docs), bench)) == {(1, 1), (1, 2), (1, 3), (2, 1)}
    assert _found(D.leaks(frame(docs), bench, block=2)) == {(1, 1), (1, 2), (1, 3), (2, 1)}


def test_repeated_rows_without_id_beside_a_common_phrase(spark, frame, sentence):
    phrase = "all of the above are right"
    items = [(i, f"{phrase} {sentence(14)}") for i in range(8)]
    docs = [(None, f"{sentence(9)} {items[0][1]}")] * 50 + [(i, f"{sentence(30)} {phrase}") for i in range(40)]
    rows = D.leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(None, 0)}
    assert D.decontaminated(frame(docs), spark.createDataFrame(items, "item_id long, text string")).count() == 40
