"""Byte-level BPE by forced boundaries: encoding, and decoding.

A merge only ever joins bytes that stand side by side in some token. Two
neighbouring bytes that do so in no token of the vocabulary are therefore a
certain cut: no merge crosses it, whatever stands around. A text is cut at
the borders of its split pattern and at all certain cuts (one look-up in a
256 x 256 table per byte, for a whole batch at once); the fragments are
encoded independently, each distinct one once, and their ids concatenated.

A fragment is merged by its lowest rank, leftmost first. Short fragments scan
for it; long ones (a run of letters without any certain cut) take it from a
heap over a linked list, so their cost stays n log n.

Special tokens in a text are cut out first and become their ids, as the
``tokenizers`` library does by default; on either side of one the split
pattern starts afresh.

Defined results: null counts as the empty text, which has no ids and decodes
to the empty text; rows are encoded one by one, so ties, repeats and null ids
each get a row; an empty table gives no rows; a column of the input that is
named like an output is replaced. Ids that are no token decode to nothing;
bytes that are no UTF-8 decode to U+FFFD, one for each maximal broken part.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convkit.llm import wordhash as H
from convkit.llm.pretokens import per_process, starts

SLICE = 2 << 20         # bytes of text encoded at a time
SHORT = 24              # fragments of at most so many bytes are scanned
KEPT = 300_000          # fragments that a worker keeps; results don't depend on it


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: the
    byte's own where it is printable, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


class Vocabulary:
    """Tokens, merges and certain cuts of a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if (odd or model["type"] != "BPE" or spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
            raise ValueError("not a plain byte-level BPE tokenizer")
        chars = byte_chars()
        byte_of = {c: i for i, c in enumerate(chars)}
        added = spec.get("added_tokens", [])
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take their surroundings into account")

        def to_bytes(token: str) -> bytes:
            return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        vocab = model["vocab"]
        self.bytes_of = {i: to_bytes(t) for t, i in vocab.items()} | {a["id"]: to_bytes(a["content"]) for a in added}
        self.special = {a["content"]: a["id"] for a in added if a["content"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.byte_id = [vocab[c] for c in chars]
        self.n = max(vocab.values()) + 1
        # (left, right) -> rank and new id in one number, so that the least number is the least rank
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[left] * self.n + vocab[right]] = rank * self.n + vocab[left + right]
        self.inside = np.zeros((256, 256), dtype=bool)
        for t in vocab:
            b = np.frombuffer(to_bytes(t), dtype=np.uint8)
            self.inside[b[:-1], b[1:]] = True

    def fragment(self, data: bytes) -> list[int]:
        """Ids of one fragment."""
        ids = [self.byte_id[b] for b in data]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        n, get, none = self.n, self.merge.get, len(self.merge) * self.n
        found = [get(a * n + b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i:i + 2] = [best % n]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] * n + ids[i], none)
            if i < len(found):
                found[i] = get(ids[i] * n + ids[i + 1], none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n, get, end = self.n, self.merge.get, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(m, i) for i in range(end - 1) if (m := get(ids[i] * n + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else end
            if j == end or get(ids[i] * n + ids[j]) != m:
                continue                                    # one of the two has merged meanwhile
            ids[i], ids[j] = m % n, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (m := get(ids[i] * n + ids[k])) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := get(ids[h] * n + ids[i])) is not None:
                heapq.heappush(heap, (m, h))
        return [x for x in ids if x >= 0]


class Encoder:
    """Encodes batches; keeps the ids of distinct fragments, by hash, in one flat array."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT):
        self.vocabulary, self.kept = vocabulary, kept
        self._clear()

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.begin = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def cuts(self, raw: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte positions where fragments start: at the pattern's pieces and at certain cuts."""
        at = np.zeros(len(raw), dtype=bool)
        at[np.flatnonzero((raw & 0xC0) != 0x80)[starts(code, first)]] = True
        at[1:] |= ~self.vocabulary.inside[raw[:-1], raw[1:]]
        return np.flatnonzero(at)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the n + 1 offsets of the texts in them."""
        v = self.vocabulary
        # parts between special tokens; ``closing`` is the special id after a part, -1 at a text's end
        parts, closing = texts, None
        if v.special_pattern and any(s in t for t in texts for s in v.special):
            parts, closing = [], []
            for t in texts:
                at = 0
                for m in v.special_pattern.finditer(t):
                    parts.append(t[at:m.start()])
                    closing.append(v.special[m[0]])
                    at = m.end()
                parts.append(t[at:])
                closing.append(-1)
        ids, off = self._parts(parts)
        if closing is None:
            return ids, off
        closing = np.array(closing)
        follows = closing >= 0
        ids = np.insert(ids, off[1:][follows], closing[follows].astype(np.uint32))
        off = off + np.concatenate([[0], np.cumsum(follows)])
        return ids, np.concatenate([[0], off[1:][~follows]])

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(parts)
        if not joined:
            return np.empty(0, dtype=np.uint32), np.zeros(len(parts) + 1, dtype=np.int64)
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        off = np.concatenate([[0], np.cumsum(size)])
        first = np.zeros(len(code) + 1, dtype=bool)
        first[off] = True
        data = joined.encode()
        raw = np.frombuffer(data, dtype=np.uint8)
        begin = self.cuts(raw, code, first[:-1])
        end = np.append(begin[1:], len(raw))
        number = self._numbers(data, begin, end)
        lo = self.begin[number]
        n = self.begin[number + 1] - lo
        at = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(lo - at[:-1], n) + np.arange(at[-1])]
        part_byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[off]
        return ids, at[np.searchsorted(begin, part_byte)]

    def _numbers(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The kept fragment that each fragment of the batch is."""
        if len(self.number) > self.kept or len(self.ids) > 4 * self.kept:
            self._clear()
        h = H.hash_bytes(np.frombuffer(data, dtype=np.uint8), begin, end)
        distinct, example, each = np.unique(h, return_index=True, return_inverse=True)
        known = self.number.get
        number = np.array([known(x, -1) for x in distinct.tolist()], dtype=np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            fragment = self.vocabulary.fragment
            ids = [fragment(data[a:b]) for a, b in zip(begin[example[new]].tolist(), end[example[new]].tolist())]
            number[new] = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(new))
            self.number.update(zip(distinct[new].tolist(), number[new].tolist()))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in ids])])
            self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], dtype=np.uint32)])
        return number[each.reshape(-1)]


def _packed(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary cells: each row's ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((4 * off).astype(np.int32).tobytes()),
                                                             pa.py_buffer(ids.astype("<u4").tobytes())])


def encode(docs: DataFrame, tokenizer_json: str, text: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` without its text, plus ``out``: array<int>, or, if ``packed``,
    binary (little-endian unsigned 32-bit integers). Map-only; the broadcast
    is the tokenizer's file, whose size doesn't depend on the corpus."""
    kept = [c for c in docs.columns if c not in (text, out)]
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        encoder = per_process(("cut_bpe", zlib.crc32(held.value.encode())), lambda: Encoder(Vocabulary(held.value)))
        for batch in batches:
            for part in H.slices(batch, text, SLICE):
                ids, off = encoder.batch([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()])
                cells = _packed(ids, off) if packed else pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], cells], names=[*kept, out])

    return docs.select(*kept, text).mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, kind)]))


def decode(rows: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` plus ``out``: the text of each row's ids (array or packed), special tokens included."""
    kept = [c for c in rows.columns if c != out]
    held = rows.sparkSession.sparkContext.broadcast(tokenizer_json)
    packed = isinstance(rows.schema[ids].dataType, T.BinaryType)

    def run(batches):
        token = per_process(("cut_bpe_tokens", zlib.crc32(held.value.encode())), lambda: Vocabulary(held.value).bytes_of).get
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cells = [None if x is None else np.frombuffer(x, dtype="<u4").tolist() if packed else x
                         for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                texts = [None if x is None else b"".join(token(y, b"") for y in x).decode("utf-8", "replace") for x in cells]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.string())],
                                                 names=[*kept, out])

    return rows.select(*kept).mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.StringType())]))
