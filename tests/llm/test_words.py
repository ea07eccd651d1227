"""Word hashing and the BPE split against regular expressions."""
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex

from convkit.llm import pretokens as Q
from convkit.llm import wordhash as H


def test_word_hashes_name_words(monkeypatch):
    texts = ["a b  c\tdog\n x é", None, "", "  ", "the cat", "cat the dog", "y" * 5000 + " z"]
    for block in (1 << 20, 16):
        monkeypatch.setattr(H, "BLOCK", block)
        h, rows = H.word_hashes(pa.array(texts))
        words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        assert np.diff(rows).tolist() == [len(w) for w in words]
        name = {}
        for w, x in zip(sum(words, []), h.tolist()):
            assert name.setdefault(w, x) == x
        assert len(set(name.values())) == len(name)
        if block == 16:
            assert h.tolist() == first
        first = h.tolist()


def test_grams_of_short_rows():
    h, rows = H.word_hashes(pa.array(["a b c d e f", "a b", None, "a b c d e"]))
    g, owner, at = H.gram_hashes(h, rows, 5)
    assert sorted(owner.tolist()) == [0, 0, 1, 3]
    assert g[owner == 0][0] == g[owner == 3][0]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 50, 3, 3)])], names=["text"])
    got = [p.column(0).to_pylist() for p in H.slices(batch, "text", 10)]
    assert sum(got, []) == batch.column(0).to_pylist() and max(map(len, got)) > 1


def test_split_equals_pattern():
    rx = regex.compile(P.PATTERN)
    assert Q.PATTERN == P.PATTERN
    rng = random.Random(2)
    signs = "'''srtvemld a1 \n\t é!-²\u0085　"
    for _ in range(300):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(20))) for _ in range(10)]
        joined, b, rows, _ = Q.spans(texts)
        got = [[joined[b[k]:b[k + 1]] for k in range(rows[i], rows[i + 1])] for i in range(len(texts))]
        assert got == [rx.findall(t) for t in texts]
