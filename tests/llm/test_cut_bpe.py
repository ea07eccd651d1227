"""Forced-boundary BPE against the tokenizers library."""
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from convkit.llm import catalog, cut_bpe
from llm_edge import EDGE, SF001, frame  # noqa: F401

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    with open(FILE, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)        # special strings of a text keep their default treatment


@pytest.fixture(scope="module")
def vocabulary(spec):
    return cut_bpe.Vocabulary(spec)


def _texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["the", " moon", "'ll", "'T", " ", "  ", "\n", " ", "é", "中文", "\U0001d49c", "<|endoftext|>", "<|end", "123", "qzx", "!?", "́",
             "\u0000", "ß", "http://", "_", "Ġ", "ك", "�", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_equals_library(vocabulary, library):
    texts = [*_texts(3000), "", "<|endoftext|>", "<|endoftext|><|endoftext|>", " a <|endoftext|>  b ", "a" * 5000, "the " * 3000,
             "".join(random.Random(1).choice("etaoinshr") for _ in range(20_000))]
    encoder = cut_bpe.Encoder(vocabulary)
    for i in range(0, len(texts), 500):
        some = texts[i:i + 500]
        ids, off = encoder.batch(some)
        for t, a, b in zip(some, off[:-1], off[1:]):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_scan_and_heap_agree(vocabulary):
    rng = random.Random(9)
    for _ in range(300):
        data = "".join(rng.choice("aehilnorst ") for _ in range(rng.randrange(1, 60))).encode()
        ids = [vocabulary.byte_id[b] for b in data]
        assert vocabulary._scan(list(ids)) == vocabulary._heap(list(ids))


def test_cuts_are_certain(vocabulary):
    """No token holds a cut pair, and cuts beyond the pattern's do occur."""
    pairs = {(a, b) for t in vocabulary.bytes_of.values() for a, b in zip(t, t[1:])}
    special = {(a, b) for s in vocabulary.special for a, b in zip(s.encode(), s.encode()[1:])}
    never = {tuple(p) for p in np.argwhere(~vocabulary.inside).tolist()}
    assert not never & (pairs - special) and len(never) > 30_000
    text = "中文中文qzxj"
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    first = np.arange(len(code)) == 0
    assert len(cut_bpe.Encoder(vocabulary).cuts(raw, code, first)) > 1


def test_fragments_are_kept_within_bounds(vocabulary, library):
    encoder = cut_bpe.Encoder(vocabulary, kept=20)
    for t in _texts(200, 8):
        ids, _ = encoder.batch([t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder.number) <= 20 + 6 * 40           # the bound and the fragments of one text more


def test_rows_and_decoding(spark, frame, spec, library):
    rows = [*EDGE, (9, "x<|endoftext|> y"), (10, "<|endoftext|>")]
    for packed in (False, True):
        got = cut_bpe.decode(cut_bpe.encode(frame(rows, "ids string, decoded string, key string"), spec, packed=packed), spec).collect()
        assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "key", "ids", "decoded"}
        have = sorted((str(r["doc_id"]), r["decoded"], bytes(r["ids"]) if packed else tuple(r["ids"])) for r in got)
        want = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
        want = sorted((str(i), library.decode(x, skip_special_tokens=False), np.array(x, "<u4").tobytes() if packed else tuple(x))
                      for (i, _), x in zip(rows, want))
        assert have == want
    assert cut_bpe.encode(frame([]), spec).count() == 0


def test_decoding_of_odd_ids(spark, spec, library):
    rng = random.Random(4)
    cells = [[], None, [50256], [999_999, 64], *[[rng.randrange(50257) for _ in range(rng.randrange(1, 6))] for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(cells)), "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in cut_bpe.decode(rows, spec).collect()}
    assert got == {k: None if x is None else library.decode(x, skip_special_tokens=False) for k, x in enumerate(cells)}


def test_other_tokenizers_are_refused():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        cut_bpe.Vocabulary(f.read())


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = catalog.QUERIES["op13_cut_bpe"](spark, SF001).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
