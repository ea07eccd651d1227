"""Token counts, token files and BPE against the libraries and round trips."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from convkit.llm import bpe, catalog, token_count, token_file
from convkit.llm.pretokens import PieceCache
from llm_edge import EDGE, SF001, frame  # noqa: F401

CHARS = "ab é▁ \U0001d4b3\n<s>0x41 thean'll've  "


def _texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) for _ in range(rng.randrange(60))) for _ in range(n)]


# --- op 6 ---------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["model", "ties"])
def test_counts_equal_library(kind):
    if kind == "model":
        vocab, fallback = token_count.unigram_vocabulary(P.path("piece_bpe_32k.model")), True
    else:
        fallback = False
        vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("ab", -1.0), ("b", -3.0), ("aab", -2.0), ("▁a", -2.0)]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(vocab)
    for x in _texts(2000) + ["", " ", "▁", "a" * 5000, "aab" * 900]:
        assert counter.text(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_count_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_WORDS", 5)
    c = token_count.Counter([("a", -1.0), ("aa", -1.5)])
    assert [c.text("a" * n) for n in range(1, 40)] == [2 + (n - 1) // 2 if n % 2 else 1 + n // 2 for n in range(1, 40)]
    assert len(c) <= 5


def test_count_edge_rows(spark, frame):
    vocab = token_count.unigram_vocabulary(P.path("piece_bpe_32k.model"))
    got = token_count.token_counts(frame(EDGE), vocab).collect()
    assert len(got) == len(EDGE) and "component" in got[0].asDict()
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1: 0, 2: 0}
    assert token_count.token_counts(frame([]), vocab).count() == 0


# --- op 7 ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def _ids(cache, texts):
    number, rows = cache.lookup(texts)
    ids, off = cache.gather(number)
    off = off[rows]
    return [ids[off[i]:off[i + 1]].tolist() for i in range(len(texts))]


def test_bpe_equals_library(tokens, library):
    cache = PieceCache(bpe.Bpe(tokens).encode_pieces, limit=200)        # starts anew often
    rng = random.Random(3)
    for alphabet in ("a", "ab", "abc", "the an'é \n", "!?*# ", "x\u0085　  "):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(60)]
        assert _ids(cache, texts) == [library.encode_ordinary(t) for t in texts]
    assert _ids(cache, _texts(500)) == [library.encode_ordinary(t) for t in _texts(500)]


def test_long_piece(tokens, library):
    cache = PieceCache(bpe.Bpe(tokens).encode_pieces)
    x = "ab" * 6000 + "a" * 6001
    assert _ids(cache, [x]) == [library.encode_ordinary(x)]
    y = "qz" * 500_000          # one piece of a million letters
    assert b"".join(tokens[i] for i in _ids(cache, [y])[0]) == y.encode()


def test_ranks_that_fall():
    """A merge may make a pair of lower rank, which then goes first."""
    tokens = [bytes([b]) for b in range(256)] + [b"cd", b"abc", b"ab", b"abcd", b"bc"]
    order = {t: i for i, t in enumerate(tokens)}

    def slow(x):
        parts = [bytes([b]) for b in x]
        while True:
            ranked = [(order.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == 1 << 30:
                return [order[p] for p in parts]
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    b = bpe.Bpe(tokens)
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    flat, n = b.encode_pieces(pieces)
    at = 0
    for p, k in zip(pieces, n.tolist()):
        want = [order[p.encode()]] if p.encode() in order else slow(p.encode())
        assert flat[at:at + k].tolist() == want
        at += k


def test_rank_queue_order():
    q = bpe.RankQueue(300_000)
    rng = random.Random(2)
    ranks = [rng.randrange(300_000) for _ in range(2000)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    got = []
    while (x := q.pop()) is not None:
        got += [(x[0], i) for i in sorted(x[1])]
    assert got == sorted((r, i) for i, r in enumerate(ranks))


def test_bpe_edge_rows(spark, frame, library):
    got = catalog.bpe_digests(frame(EDGE)).collect()
    assert len(got) == len(EDGE)
    want = sorted((len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in EDGE)
    assert sorted((r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    assert catalog.bpe_digests(frame([])).count() == 0


# --- op 5 ---------------------------------------------------------------------

@pytest.mark.parametrize("widths", [(9, 3, 4), (16,), (1, 15), (8, 8, 8, 8)])
def test_file_random_access(widths):
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 5000), 50_256).astype(np.uint32)
    f = token_file.TokenFile(b"".join(token_file.build([7, None], np.array([0, 10, 5000]), ids, widths)))
    for a, b in [(0, 5000), (0, 0), (5000, 5000), *[sorted(rng.integers(0, 5001, 2).tolist()) for _ in range(200)]]:
        assert f.tokens(a, b).tolist() == ids[a:b].tolist()
    assert [f.token(i) for i in (0, 511, 512, 513, 4999)] == ids[[0, 511, 512, 513, 4999]].tolist()
    assert [(d, a, len(x)) for d, a, x in f.documents()] == [(7, 0, 10), (None, 10, 4990)]
    with pytest.raises(ValueError):
        token_file.build([1], np.array([0, 1]), np.array([1 << sum(widths)], dtype=np.uint64), widths)
    with pytest.raises(ValueError):
        token_file.TokenFile(b"something else")


@pytest.fixture(scope="module")
def tokenizer():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_pieces_equal_whole_texts(tokenizer):
    t = Tokenizer.from_str(tokenizer)
    texts = _texts(800) + ["", "\n\n a", "a\n", "<|endoftext|> x", "a <|endoftext|>  b", "<|endoftext|>", "\n"]
    ids, off = token_file.piece_encoder(tokenizer)(texts)
    assert [ids[off[i]:off[i + 1]].tolist() for i in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_tokenizers():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    t = Tokenizer.from_str(spec)
    ids, off = token_file.piece_encoder(spec)(["Hello there", "", "x y"])
    assert [ids[off[i]:off[i + 1]].tolist() for i in range(3)] == [t.encode(x, add_special_tokens=False).ids for x in ["Hello there", "", "x y"]]


@pytest.mark.parametrize("file_tokens", [token_file.FILE_TOKENS, 300])
def test_files_round_trip(spark, frame, tokenizer, tmp_path, file_tokens, monkeypatch):
    t = Tokenizer.from_str(tokenizer)
    rows = EDGE + [(11, "a <|endoftext|> b"), (12, "<|endoftext|>")] + [(i, x) for i, x in enumerate(_texts(200), 100)]
    want, at = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder = str(tmp_path / "files")
    files = spark.createDataFrame(token_file.write_files(frame(rows), folder, tokenizer, file_tokens=file_tokens).collect())
    got = token_file.read_files(files, folder, files.count()).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert not [p for p in (tmp_path / "files").iterdir() if p.name.startswith(".") and p.suffix == ".tmp"]


def test_no_documents(spark, frame, tokenizer, tmp_path):
    files = token_file.write_files(frame([]), str(tmp_path), tokenizer)
    assert files.count() == 0 and token_file.read_files(files, str(tmp_path), 0).count() == 0


def test_queries_equal_libraries(spark, tokenizer, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    t = Tokenizer.from_str(tokenizer)
    at, five, seven = 0, {}, {}
    for i, x in sorted(docs):
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        five[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        ids = library.encode_ordinary(x)
        seven[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in catalog.op5(spark, SF001).collect()} == five
    assert {r[0]: tuple(r)[1:] for r in catalog.op7(spark, SF001).collect()} == seven
