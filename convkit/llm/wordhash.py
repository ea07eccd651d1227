"""Words of Arrow text batches as 64-bit hashes, without a Python loop per word.

A word's hash is a polynomial over its bytes taken from prefix sums, so a
batch costs a few NumPy passes. The constants are fixed: every executor and
every retry gives the same hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20        # bytes hashed at a time: bounds the 8-byte work arrays
_BASE = np.uint64(0x9E6C_63D0_876A_9A63)            # odd, so it has an inverse mod 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8_FEB8_6659_FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8_FEB8_6659_FD93)
    x ^= x >> np.uint64(32)
    return x


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed + 0x51ED_2701], dtype=np.uint64))[0]


@lru_cache(maxsize=None)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E37_79B9_7F4A_7C15))


_pow_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if "p" not in _pow_cache or len(_pow_cache["p"]) < n:
        for k, b in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(max(n, BLOCK + 1), b, dtype=np.uint64)
            a[0] = 1
            _pow_cache[k] = np.multiply.accumulate(a)
    return _pow_cache["p"], _pow_cache["q"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] (uint64 symbols) for ascending disjoint spans."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        p, q = powers(hi - lo + 1)
        c = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[lo:hi] * p[:hi - lo], out=c[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        # the span's length goes in as well: a trailing symbol of value 0 would else be lost
        out[i:j] = (c[e] - c[s]) * q[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]] if len(off) else raw[:0], off - (off[0] if len(off) else 0)


@lru_cache(maxsize=None)
def byte_table(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``space``: all but ASCII white space.
    ``letter``: A-Z, a-z and every byte of a non-ASCII character.
    ``alnum``: the same with digits."""
    t = np.zeros(256, dtype=bool)
    if kind == "space":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
        return t
    t[ord("a"):ord("z") + 1] = t[ord("A"):ord("Z") + 1] = t[128:] = True
    if kind == "alnum":
        t[ord("0"):ord("9") + 1] = True
    return t


def word_spans(raw: np.ndarray, off: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the rows."""
    n = len(raw)
    inside = byte_table(kind)[raw]
    edge = np.zeros(n + 1, dtype=bool)          # a row starts here
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(column: pa.Array, kind: str = "space", lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch and the n + 1 word offsets of its rows."""
    raw, off = text_buffer(pc.utf8_lower(column) if lower else column)
    starts, ends, rows = word_spans(raw, off, kind)
    return hash_bytes(raw, starts, ends), rows


def hash_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes over bytes, in blocks, so that 8-byte symbols exist for one block only."""
    out = np.empty(len(starts), dtype=np.uint64)
    table, i = _byte_values(), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = span_hashes(table[raw[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word (index in ``words``) of every n-word gram.

    A row with 1 to n - 1 words has one gram of all its words; a row
    without words has none.
    """
    size = np.diff(rows)
    row_of = np.repeat(np.arange(len(size)), size)
    if len(words) >= n:
        g = words[:len(words) - n + 1].copy()
        for k in range(1, n):
            g = g * _BASE + words[k:len(words) - n + 1 + k]
        whole = row_of[:len(g)] == row_of[n - 1:]
        at = np.flatnonzero(whole)
        g, owner = g[at], row_of[at]
    else:
        g, owner, at = words[:0].copy(), row_of[:0], np.empty(0, dtype=np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.array([_fold(words[rows[r]:rows[r + 1]]) for r in short], dtype=np.uint64)
        g, owner, at = np.concatenate([g, extra]), np.concatenate([owner, short]), np.concatenate([at, rows[short]])
    return mix(g), owner, at


def _fold(words: np.ndarray) -> int:
    h = 0
    for w in words.tolist():
        h = (h * int(_BASE) + w) & 0xFFFF_FFFF_FFFF_FFFF
    return h


@lru_cache(maxsize=None)
def _trim():
    import ctypes
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):       # another C library
        return None


def give_back() -> None:
    """Return freed memory of Arrow and NumPy to the system: a worker lives on
    between tasks, beside the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Row slices of a batch with at most ``limit`` bytes of text each (one row at least)."""
    _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
