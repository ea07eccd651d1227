"""Token-id files of directly addressable codes (DAC).

An id is split into chunks of fixed widths, low bits first. Level 0 has a
chunk of every token; a continuation bitmap says which tokens go on, and
those have a chunk in level 1, and so on. A directory counts the set bits
before every 512th position, so the place of a token's next chunk is a
directory entry plus a few words of the bitmap: any token, or any range, is
read without decoding what lies before it.

File layout (little-endian): 8 bytes magic; int64 number of levels, of
documents, of tokens, then per level width and number of chunks; then, each
padded to 8 bytes: document ids int64, a byte per document (1: the id is
null), document starts int64 (one more than documents), and per level the
chunks (bit-packed), the bitmap (not for the last level) and its directory
(int64).

``write_files`` sorts the corpus by doc_id over range partitions; every task
writes files of bounded size into a shared folder under names of its own and
renames them when complete, so a repeated task leaves nothing half-written
and only files that its result names are read.

Defined results: null counts as the empty text, which has just the end id;
null doc_ids come first; rows with equal doc_ids are put in order of their
texts; an empty table makes no file; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convkit.llm import wordhash as H
from convkit.llm.pretokens import PATTERN, PieceCache, per_process

MAGIC = b"DACTOK01"
WIDTHS = (9, 3, 4)              # chunk widths; the sum bounds the ids
FILE_TOKENS = 16_000_000        # a task starts a new file from so many tokens on
EVERY = 512                     # bits per directory entry
_BLOCK = 1 << 20                # tokens packed at a time (a multiple of 8)


# --- packing ---------------------------------------------------------------

def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits, low bits first. Eight of them fill ``width``
    bytes, so a column of every eighth value is shifted at a time."""
    out = []
    for i in range(0, len(values), _BLOCK):
        part = values[i:i + _BLOCK]
        v = np.zeros(-(-len(part) // 8) * 8, dtype=np.uint64)
        v[:len(part)] = part
        v = v.reshape(-1, 8)
        packed = np.zeros((len(v), width), dtype=np.uint8)
        for j in range(8):
            byte, shift = j * width >> 3, j * width & 7
            x = v[:, j] << np.uint64(shift)
            for k in range((shift + width + 7) >> 3):
                packed[:, byte + k] |= (x >> np.uint64(8 * k)).astype(np.uint8)
        out.append(packed.reshape(-1)[:(len(part) * width + 7) >> 3].tobytes())
    return b"".join(out)


def _unpack(buf, start: int, stop: int, width: int) -> np.ndarray:
    """Values start..stop of packed ones, reading only the bytes of their
    groups of eight."""
    if stop <= start:
        return np.empty(0, dtype=np.uint32)
    first, last = start // 8, -(-stop // 8)
    raw = np.frombuffer(buf[first * width:last * width], dtype=np.uint8)
    if len(raw) < (last - first) * width:
        raw = np.concatenate([raw, np.zeros((last - first) * width - len(raw), dtype=np.uint8)])
    raw = raw.reshape(-1, width)
    out = np.empty((last - first, 8), dtype=np.uint32)
    for j in range(8):
        byte, shift = j * width >> 3, j * width & 7
        x = raw[:, byte].astype(np.uint64)
        for k in range(1, (shift + width + 7) >> 3):
            x |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[start - 8 * first:stop - 8 * first]


def _padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def build(doc_ids: list, starts: np.ndarray, ids: np.ndarray, widths=WIDTHS) -> list[bytes]:
    """The file's parts."""
    if len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError(f"an id needs more than {sum(widths)} bits")
    levels, rest = [], ids.astype(np.uint32)
    for k, w in enumerate(widths):
        chunk, more = rest & np.uint32((1 << w) - 1), rest >> np.uint32(w)
        last = k == len(widths) - 1
        part = [_padded(_pack(chunk, w))]
        if not last:
            on = more > 0
            part.append(_padded(np.packbits(on, bitorder="little").tobytes()))
            ones = np.add.reduceat(on, np.arange(0, len(on), EVERY)) if len(on) else np.empty(0, np.int64)
            part.append(np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes())
            rest = more[on]
        levels.append((w, len(chunk), part))
    head = np.array([len(widths), len(doc_ids), len(ids), *[x for w, n, _ in levels for x in (w, n)]], dtype="<i8").tobytes()
    null = np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    index = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    return [MAGIC, head, index, _padded(null), starts.astype("<i8").tobytes(), *[b for _, _, part in levels for b in part]]


class TokenFile:
    """Random access to the tokens of one file (any bytes-like object)."""

    def __init__(self, buf):
        self.buf = memoryview(buf)
        if bytes(self.buf[:8]) != MAGIC:
            raise ValueError("not a token file")
        n_levels, self.n_docs, self.n_tokens = self._ints(8, 3)
        at = 32
        shape = self._ints(at, 2 * n_levels).reshape(-1, 2)
        at += 16 * n_levels
        self.ids = self._ints(at, self.n_docs)
        at += 8 * self.n_docs
        self.null = np.frombuffer(self.buf[at:at + self.n_docs], dtype=np.uint8)
        at += -(-self.n_docs // 8) * 8
        self.starts = self._ints(at, self.n_docs + 1)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for k, (w, n) in enumerate(shape.tolist()):
            chunks, at = self.buf[at:], at + -(-(-(-w * n // 8)) // 8) * 8
            bitmap = directory = None
            if k < n_levels - 1:
                bitmap, at = self.buf[at:], at + -(-(-(-n // 8)) // 8) * 8
                m = -(-n // EVERY) + 1
                directory, at = self._ints(at, m), at + 8 * m
            self.levels.append((w, chunks, bitmap, directory))

    def _ints(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.buf[at:at + 8 * n], dtype="<i8")

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop."""
        return self._level(0, start, stop)

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def _level(self, k: int, start: int, stop: int) -> np.ndarray:
        width, chunks, bitmap, directory = self.levels[k]
        out = _unpack(chunks, start, stop, width)
        if bitmap is None or stop <= start:
            return out
        on = _unpack(bitmap, start, stop, 1).astype(bool)
        n = int(on.sum())
        if n:
            base = start - start % EVERY
            rank = int(directory[start // EVERY]) + int(_unpack(bitmap, base, start, 1).sum())
            out[on] |= self._level(k + 1, rank, rank + n) << np.uint32(width)
        return out

    def documents(self):
        """(doc_id, start, ids) in file order; documents of about a million
        tokens are read at a time."""
        d = 0
        while d < self.n_docs:
            end = max(d + 1, int(np.searchsorted(self.starts, self.starts[d] + _BLOCK, side="right")) - 1)
            base = int(self.starts[d])
            ids, at = self.tokens(base, int(self.starts[end])), (self.starts[d:end + 1] - base).tolist()
            for i in range(end - d):
                yield (None if self.null[d + i] else int(self.ids[d + i])), base + at[i], ids[at[i]:at[i + 1]]
            d = end


# --- encoding with the tokenizers library ------------------------------------

def piece_encoder(tokenizer_json: str):
    """Function of a list of texts: flat ids and the n + 1 row offsets.

    A byte-level tokenizer with the usual split pattern is called once per
    distinct piece of its split; any other one for whole texts. A text that
    holds the string of a special token is encoded whole, as the library does
    by default: the string is that token.
    """
    import json

    from tokenizers import Tokenizer
    t = Tokenizer.from_str(tokenizer_json)
    spec = json.loads(tokenizer_json)
    special = [a["content"] for a in spec.get("added_tokens", []) if a["content"]]
    pre = spec.get("pre_tokenizer") or {}

    def whole(texts):
        ids = [np.array(e.ids, dtype=np.int64) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(ids) if ids else np.empty(0, np.int64)), np.array([len(x) for x in ids], dtype=np.int64)

    if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or [a for a in spec.get("added_tokens", []) if not a.get("special")]):
        def run(texts):
            ids, n = whole(texts)
            return ids, np.concatenate([[0], np.cumsum(n)])
        return run

    newline = t.encode("\n", add_special_tokens=False).ids

    def pieces(new):
        """Pieces of one split are cut the same way on lines of their own, and
        a line break is one id that no piece without one has."""
        plain = [len(newline) == 1 and not p[1:].isspace() and not p.isspace() and "\n" not in p for p in new]
        lines = [p for p, ok in zip(new, plain) if ok]
        packed, _ = whole(["\n".join(lines[i:i + 4000]) + "\n" for i in range(0, len(lines), 4000)])
        ends = np.flatnonzero(packed == newline[0]) if lines else np.empty(0, np.int64)
        if len(ends) != len(lines):
            return whole(new)
        rest_ids, rest_n = whole([p for p, ok in zip(new, plain) if not ok])
        plain = np.array(plain, dtype=bool)
        n = np.empty(len(new), dtype=np.int64)
        n[plain], n[~plain] = np.diff(np.concatenate([[-1], ends])) - 1, rest_n
        owner = np.repeat(plain, n)
        flat = np.empty(len(owner), dtype=np.int64)
        flat[owner], flat[~owner] = packed[packed != newline[0]] if lines else packed, rest_ids
        return flat, n

    cache = PieceCache(pieces)

    def by_pieces(texts):
        number, rows = cache.lookup(texts, PATTERN)
        ids, off = cache.gather(number)
        return ids, off[rows]

    def run(texts):
        marked = np.array([any(s in x for s in special) for x in texts], dtype=bool)
        if not marked.any():
            return by_pieces(texts)
        ids, off = by_pieces(["" if m else x for x, m in zip(texts, marked)])
        own, n = whole([x for x, m in zip(texts, marked) if m])
        # marked rows are empty in ``off``: their ids go in where they stand
        size = np.diff(off)
        size[marked] = n
        return np.insert(ids, np.repeat(off[:-1][marked], n), own), np.concatenate([[0], np.cumsum(size)])
    return run


# --- Spark side ----------------------------------------------------------------

def _filesystem(path: str):
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int = 0, widths=WIDTHS,
                file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files of ``folder`` (shared), in
    ascending doc_id order. One row per file: part, seq, file, n_docs, n_tokens."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # equal ids meet in one range, where the text puts them in order
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    vocab = spark.sparkContext.broadcast(tokenizer_json)        # the tokenizer's file, of fixed size

    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        encode = per_process(("tokenizers", zlib.crc32(vocab.value.encode())), lambda: piece_encoder(vocab.value))
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        seq, ids, sizes, names, held = 0, [], [], [], 0

        def flush():
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"part-{ctx.partitionId():05d}-{seq:04d}-{uuid.uuid4().hex[:8]}.dac"
            with fs.open_output_stream(f"{base}/.{name}.tmp") as f:
                for b in build(names, starts, np.concatenate(ids), widths):
                    f.write(b)
            fs.move(f"{base}/.{name}.tmp", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "seq": [seq], "file": [name], "n_docs": [len(names)],
                                               "n_tokens": [held]}, schema=_FILES)
        for batch in batches:
            for part in H.slices(batch, "text", 2 << 20):
                flat, off = encode(part.column(1).to_pylist())
                closed = np.insert(flat, off[1:], end_id).astype(np.uint32)
                ids.append(closed)
                sizes.append(np.diff(off) + 1)
                names += part.column(0).to_pylist()
                held += len(closed)
                if held >= file_tokens:
                    yield flush()
                    seq, ids, sizes, names, held = seq + 1, [], [], [], 0
        if names:
            yield flush()

    return rows.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long")


_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_files(files: DataFrame, folder: str, n_files: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files
    that ``files`` (one row per file) names."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "seq", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    dealt = base.select("file", "base").repartition(max(n_files, 1), "file")

    def run(batches):
        fs, at = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{at}/{name}") as f:
                    tokens = TokenFile(f.readall())
                out = [(d, first + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, a, ids in tokens.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
