"""Byte-level BPE: encoding with a rank queue, and decoding.

The distinct pieces of a batch lie in one linked list of bytes with gaps
between pieces. A bucket per merge rank holds the list positions whose pair
has that rank; a hierarchical bitmap over the ranks gives the next rank by
find-first-set on a few words. Positions of a bucket merge from left to
right; entries whose pair has changed since are stale and skipped; if a merge
makes a pair of lower rank, that one goes first. Every merge costs the same
whatever the length of its piece, so a piece of a million letters is no
special case. Pieces that are tokens as they are need no merge.

Defined results: null counts as the empty text, which has no ids and decodes
to no bytes; rows are encoded one by one, so ties, repeats and null ids each
get a row; an empty table gives no rows; a column of the input that is named
like an output is replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convkit.llm import wordhash as H
from convkit.llm.pretokens import PATTERN, PieceCache, per_process

NO_RANK = 1 << 30
SLICE = 2 << 20         # bytes of text encoded at a time


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order of a rank file (lines: base64 token, rank)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class RankQueue:
    """Buckets of positions by rank under a bitmap of 64-bit words per level."""

    def __init__(self, n: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels = []
        while True:
            n = -(-n // 64)
            self.levels.append([0] * n)
            if n == 1:
                break

    def fill(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        for level in self.levels:
            word, bit = rank >> 6, rank & 63
            full = level[word]
            level[word] = full | (1 << bit)
            if full:
                return
            rank = word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [position])
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions; None if there is none."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1
        rank = at
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, self.buckets.pop(rank)


class Bpe:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        # rank of the token that two neighbours make, by left * n + right
        n = self.n = len(tokens)
        self.pair: dict[int, int] = {}
        get = self.rank.get
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                left, right = get(t[:k]), get(t[k:])
                if left is not None and right is not None:
                    self.pair[left * n + right] = r
        pairs = np.full((256, 256), NO_RANK, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                pairs[a, b] = get(bytes((a, b)), NO_RANK)
        self.first = pairs.reshape(-1)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, flat, and how many each has."""
        raw = [p.encode() for p in pieces]
        whole = [self.rank.get(b, -1) for b in raw]
        todo = [b for b, w in zip(raw, whole) if w < 0]
        count = np.ones(len(raw), dtype=np.int64)
        whole = np.array(whole, dtype=np.int64)
        if not todo:
            return whole, count
        ids, n = self._merge(todo)
        split = whole < 0
        count[split] = n
        off = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(off[-1], dtype=np.int64)
        flat[off[:-1][~split]] = whole[~split]
        mine = np.ones(len(flat), dtype=bool)
        mine[off[:-1][~split]] = False
        flat[mine] = ids
        return flat, count

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        n = len(data)
        end = np.cumsum(size) - 1                   # last byte of each piece
        after = np.arange(1, n + 1)
        after[end] = -1
        before = np.arange(-1, n - 1)
        before[end[:-1] + 1] = -1
        ranks = np.full(n, NO_RANK, dtype=np.int64)
        ranks[:-1] = self.first[(data[:-1] << 8) | data[1:]]
        ranks[end] = NO_RANK

        queue = RankQueue(self.n)
        at = np.flatnonzero(ranks < NO_RANK)
        at = at[np.argsort(ranks[at], kind="stable")]
        r = ranks[at]
        cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
        at = at.tolist()
        for a, b, rank in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], r[cut].tolist()):
            queue.fill(rank, at[a:b])

        token, nxt, prev, rank_of = self.byte[data].tolist(), after.tolist(), before.tolist(), ranks.tolist()
        pair, base, buckets = self.pair, self.n, queue.buckets
        while (got := queue.pop()) is not None:
            rank, positions = got
            positions.sort()
            for k, p in enumerate(positions):
                if rank_of[p] != rank:              # stale
                    continue
                gone = nxt[p]
                token[p] = rank
                rank_of[gone] = -1
                token[gone] = -1
                right = nxt[gone]
                nxt[p] = right
                lower = False
                if right >= 0:
                    prev[right] = p
                    new = pair.get(rank * base + token[right], NO_RANK)
                    rank_of[p] = new
                    if new != NO_RANK:
                        if new in buckets:
                            buckets[new].append(p)
                        else:
                            queue.fill(new, [p])
                        lower = new < rank
                else:
                    rank_of[p] = NO_RANK
                left = prev[p]
                if left >= 0:
                    new = pair.get(token[left] * base + rank, NO_RANK)
                    rank_of[left] = new
                    if new != NO_RANK:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            queue.fill(new, [left])
                        lower = lower or new < rank
                if lower:
                    for q in positions[k + 1:]:
                        queue.push(rank, q)
                    break
        token = np.array(token, dtype=np.int64)
        keep = token >= 0
        count = np.add.reduceat(keep.astype(np.int64), end - size + 1)
        return token[keep], count


def encode(docs: DataFrame, tokens: list[bytes], pattern: str = PATTERN, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without its text, plus ``out`` (array<int>). Map-only; the
    broadcast is the vocabulary, whose size doesn't depend on the corpus."""
    kept = [c for c in docs.columns if c not in (text, out)]
    fields = [docs.schema[c] for c in kept]
    vocab = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        cache = per_process(("bpe", pattern, hash(tuple(vocab.value))), lambda: PieceCache(Bpe(vocab.value).encode_pieces))
        for batch in batches:
            for part in H.slices(batch, text, SLICE):
                texts = [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                number, rows = cache.lookup(texts, pattern)
                ids, off = cache.gather(number)
                ids = pa.ListArray.from_arrays(pa.array(off[rows], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], ids], names=[*kept, out])

    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.select(*kept, text).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``ids`` and ``decoded`` as encode and
    decode give them, in one pass: one worker per task instead of two."""
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    vocab = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        cache = per_process(("bpe", pattern, hash(tuple(vocab.value))), lambda: PieceCache(Bpe(vocab.value).encode_pieces))
        token = vocab.value.__getitem__
        for batch in batches:
            for part in H.slices(batch, text, 1 << 20):
                number, rows = cache.lookup([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()], pattern)
                ids, off = cache.gather(number)
                off = off[rows]
                texts = pa.array([b"".join(map(token, ids[a:b].tolist())) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
                cells = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], cells, texts],
                                                 names=[*kept, "ids", "decoded"])
            H.give_back()

    return docs.select(*kept, text).mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField("ids", T.ArrayType(T.IntegerType())),
                                                                  T.StructField("decoded", T.BinaryType())]))


def decode(rows: DataFrame, tokens: list[bytes], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` plus ``out`` (binary): the bytes of each row's ids, joined."""
    kept = [c for c in rows.columns if c != out]
    vocab = rows.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        token = vocab.value.__getitem__
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cells = part.column(part.schema.get_field_index(ids))
                texts = pa.array([b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None
                                  for x in cells], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], texts], names=[*kept, out])

    return rows.select(*kept).mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.BinaryType())]))
