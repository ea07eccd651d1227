"""The split of byte-level BPE before its merges, for whole batches at once.

The pattern  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
cuts a text into runs of letters, digits, other signs and white space, except
that
- a white-space run before a sign gives up its last character; a blank then
  joins what follows, any other white space stands alone;
- an apostrophe where a match begins takes one of the seven endings with it.
Both are decided on arrays of code points. Other patterns go through
``regex`` (see ``spans``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from convkit.llm.wordhash import mix, span_hashes

# Fixed value: the split pattern that ``starts`` stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The endings that an apostrophe takes.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@lru_cache(maxsize=None)
def _classes() -> np.ndarray:
    import regex
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, dtype=np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a:b + 1] = kind
    return table


@lru_cache(maxsize=None)
def _symbols() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xA24B_AED4_963E_E407))


def starts(code: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Positions where a piece starts; ``row_start`` marks first characters of rows."""
    n = len(code)
    kind = _classes()[code]
    cut = np.ones(n, dtype=bool)
    cut[1:] = (kind[1:] != kind[:-1]) | row_start[1:]
    # a run of white space before something of the same row
    after = np.flatnonzero(cut[1:] & (kind[:-1] == SPACE) & ~row_start[1:]) + 1
    cut[after - 1] = True
    cut[after[code[after - 1] == 0x20]] = False
    # apostrophes at which a match begins
    quote = np.flatnonzero((code == 0x27) & cut)
    taken = np.zeros(len(quote), dtype=bool)
    for ending in ENDINGS:
        m = len(ending)
        fits = ~taken & (quote + m < n)
        for i, ch in enumerate(ending, 1):
            at = np.minimum(quote + i, n - 1)
            fits &= (code[at] == ord(ch)) & ~row_start[at]
        at = quote[fits]
        cut[at + 1] = False
        later = at + 1 + m
        cut[later[later < n]] = True
        taken |= fits
    return np.flatnonzero(cut)


def spans(texts: list[str], pattern: str = PATTERN) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All rows as one string, the piece bounds in it (n + 1), the row offsets
    in pieces, and a 64-bit hash per piece."""
    joined = "".join(texts)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    off = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    if pattern == PATTERN:
        first = np.zeros(len(code) + 1, dtype=bool)
        first[off] = True
        begin = starts(code, first[:-1]) if len(code) else np.empty(0, np.int64)
    else:
        import regex
        rx = regex.compile(pattern)
        begin = np.array([o + m.start() for t, o in zip(texts, off.tolist()) for m in rx.finditer(t)], dtype=np.int64)
    bounds = np.append(begin, len(code))
    h = span_blocks(code, bounds)
    return joined, bounds, np.searchsorted(begin, off), h


def span_blocks(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of the pieces, a block of pieces at a time."""
    out = np.empty(len(bounds) - 1, dtype=np.uint64)
    i, last = 0, len(bounds) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 19), side="right")) - 1)
        lo, hi = int(bounds[i]), int(bounds[j])
        out[i:j] = span_hashes(_symbols()[code[lo:hi]], bounds[i:j] - lo, bounds[i + 1:j + 1] - lo)
        i = j
    return out


_kept: dict = {}


def per_process(key: tuple, make):
    """``make()``, kept for later tasks of the same Python worker (one value
    per kind, ``key[0]``)."""
    if key[0] not in _kept or _kept[key[0]][0] != key:
        _kept[key[0]] = (key, make())
    return _kept[key[0]][1]


class PieceCache:
    """Distinct pieces of a worker, by hash, with the ids of each in one flat array.

    ``encode`` gets the list of new pieces and returns their ids, flat, and
    the count of each. Beyond ``limit`` pieces (or four times as many ids)
    only those met again since the last time are kept, half of the limit at
    most, which bounds the memory; results don't depend on it.
    """

    def __init__(self, encode, limit: int = 350_000):
        self.encode, self.limit = encode, limit
        self.index: dict[int, int] = {}
        self.hash = np.empty(0, dtype=np.uint64)
        self.again = np.empty(0, dtype=bool)
        self.ids = np.empty(0, dtype=np.int32)
        self.begin = np.zeros(1, dtype=np.int64)

    def _shrink(self):
        kept = np.flatnonzero(self.again)
        size = np.diff(self.begin)[kept]
        kept = kept[(np.cumsum(size) <= 2 * self.limit) & (np.arange(len(kept)) < self.limit // 2)]
        self.ids, off = self.gather(kept)
        self.begin, self.hash = off, self.hash[kept]
        self.again = np.zeros(len(kept), dtype=bool)
        self.index = dict(zip(self.hash.tolist(), range(len(kept))))

    def lookup(self, texts: list[str], pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
        """Per piece its number in the cache, and the row offsets in pieces.
        The numbers hold until the next call."""
        joined, bounds, rows, h = spans(texts, pattern)
        if len(self.index) > self.limit or len(self.ids) > 4 * self.limit:
            self._shrink()
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        first = np.flatnonzero(new)
        distinct, example = sorted_h[first], order[first]
        get = self.index.get
        number = np.array([get(x, -1) for x in distinct.tolist()], dtype=np.int64)
        self.again[number[number >= 0]] = True
        miss = np.flatnonzero(number < 0)
        if len(miss):
            at = example[miss]
            pieces = [joined[a:b] for a, b in zip(bounds[at].tolist(), bounds[at + 1].tolist())]
            flat, count = self.encode(pieces)
            base = len(self.begin) - 1
            number[miss] = base + np.arange(len(miss))
            self.index.update(zip(distinct[miss].tolist(), range(base, base + len(miss))))
            self.hash = np.concatenate([self.hash, distinct[miss]])
            # a piece that is frequent at once needn't prove itself
            often = np.diff(np.append(first, len(h)))[miss] > 1
            self.again = np.concatenate([self.again, often])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])
            self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        per_piece = np.empty(len(h), dtype=np.int64)
        per_piece[order] = number[np.cumsum(new) - 1] if len(h) else number
        return per_piece, rows

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of pieces, and the n + 1 offsets of the pieces in them."""
        lo = self.begin[number]
        size = self.begin[number + 1] - lo
        off = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(lo - off[:-1], size) + np.arange(off[-1])], off
