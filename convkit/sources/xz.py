"""Text lines of ``.xz`` files, read block by block, and a sink for them.

Spark has no codec for xz. An xz file ends in an index of its blocks, and a
block can be decoded by itself, so a Python data source gives each run of
blocks a partition of its own: the driver reads only the indexes, a task only
its blocks and the end of its last line. A file that was written as a single
block (``xz`` without ``-T``) is one partition, decoded as a stream.

Lines are cut at block borders by one rule: the line that a partition begins
in belongs to the one before, also if it begins exactly there. So a partition
drops what stands up to its first line break (the first of a file doesn't)
and reads on to the end of the line that begins at or before its end.

Lines end in ``\\n`` or ``\\r\\n``; bytes that are no UTF-8 become U+FFFD.
Files may have several streams and padding between them, as ``cat`` makes
them; a broken index or block ends the job.
"""

from __future__ import annotations

import json
import lzma
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES = 64 << 20      # a partition's blocks, decoded
BLOCK_BYTES = 24 << 20          # the sink's blocks, decoded
CHUNK = 1 << 20
# Fixed values of the format.
MAGIC, TAIL, CRC64 = b"\xfd7zXZ\x00", b"YZ", b"\x00\x04"

SCHEMA = "value string, file string, block long, line long"
_ARROW = pa.schema([("value", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64())])


@dataclass(frozen=True)
class Block:
    offset: int         # of the block in the file
    size: int           # in the file, padding included
    start: int          # of its text in the file's text
    length: int         # of its text
    flags: bytes        # of its stream


# --- the format --------------------------------------------------------------

def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, low bits first, and the place behind it."""
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def _numbered(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _whole(n: int) -> int:
    return -(-n // 4) * 4


def blocks(read: Callable[[int, int], bytes], size: int) -> list[Block]:
    """The blocks of a file in their order, from the indexes of its streams,
    the last one first. ``read``: bytes at a place."""
    streams, end = [], size
    while end > 0:
        while end >= 4 and read(end - 4, 4) == bytes(4):
            end -= 4
        if not end:
            break
        footer = read(end - 12, 12) if end >= 32 else b""
        if footer[10:] != TAIL or zlib.crc32(footer[4:10]) != struct.unpack("<I", footer[:4])[0]:
            raise ValueError(f"no end of an xz stream at byte {end}")
        n = 4 * (struct.unpack("<I", footer[4:8])[0] + 1)
        index = read(end - 12 - n, n)
        if index[0] or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise ValueError(f"broken index of an xz stream that ends at byte {end}")
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            packed, at = _number(index, at)
            length, at = _number(index, at)
            sizes.append((packed, length))
        first = end - 12 - n - sum(_whole(p) for p, _ in sizes)
        if first < 12 or read(first - 12, 8) != MAGIC + footer[8:10]:
            raise ValueError(f"no start of an xz stream at byte {first - 12}")
        streams.append((first, sizes, footer[8:10]))
        end = first - 12
    out, start = [], 0
    for offset, sizes, flags in reversed(streams):
        for packed, length in sizes:
            out.append(Block(offset, _whole(packed), start, length, flags))
            offset, start = offset + _whole(packed), start + length
    return [b for b in out if b.length]


def text_of(read: Callable[[int, int], bytes], block: Block) -> Iterator[bytes]:
    """A block's text in chunks of bounded size."""
    d = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    d.decompress(MAGIC + block.flags + struct.pack("<I", zlib.crc32(block.flags)))
    got = 0
    for at in range(block.offset, block.offset + block.size, CHUNK):
        data = read(at, min(CHUNK, block.offset + block.size - at))
        while True:
            text = d.decompress(data, max_length=CHUNK)
            if text:
                got += len(text)
                yield text
            if d.needs_input or not text:
                break
            data = b""
    if got != block.length:
        raise ValueError(f"block at byte {block.offset} has {got} bytes of text, its index says {block.length}")


def lines_of(read: Callable[[int, int], bytes], all_blocks: list[Block], first: int, end: int) -> Iterator[bytes]:
    """The lines that belong to the blocks first..end of a file."""
    last = end == len(all_blocks)
    size = sum(b.length for b in all_blocks[first:end])
    skip, at, rest = first > 0, 0, b""              # ``at``: where ``rest`` starts
    for chunk in (c for b in all_blocks[first:] for c in text_of(read, b)):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            start, at = at, at + len(line) + 1
            if skip:
                skip = False
            elif start > size and not last:
                return
            else:
                yield line
        # what follows begins behind the blocks, or is another partition's
        if not last and (at > size or skip and len(rest) >= size):
            return
    if rest and not skip:
        yield rest


def stream(parts: list[bytes]) -> bytes:
    """One xz stream with a block for each part."""
    body, records = [], []
    for part in parts:
        one = lzma.compress(part, lzma.FORMAT_XZ, check=lzma.CHECK_CRC64)
        found = blocks(lambda at, n: one[at:at + n], len(one))
        for b in found:
            n = 4 * (struct.unpack("<I", one[-8:-4])[0] + 1)
            packed, _ = _number(one[-12 - n:-12], 2)
            body.append(one[b.offset:b.offset + b.size])
            records.append(_numbered(packed) + _numbered(b.length))
    index = b"\x00" + _numbered(len(records)) + b"".join(records)
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + CRC64
    return MAGIC + CRC64 + struct.pack("<I", zlib.crc32(CRC64)) + b"".join(body) + index + struct.pack("<I", zlib.crc32(tail)) + tail + TAIL


# --- files -------------------------------------------------------------------

def _filesystem(uri: str):
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _File:
    """Bytes at a place of a file of any store that Arrow reads."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


@dataclass
class Run(InputPartition):
    file: str
    first: int
    end: int


class XzLines(DataSource):
    """``spark.read.format("xz_lines")``; options: files (JSON list of URIs), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "xz_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), int(self.options.get("partitionBytes", PARTITION_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], partition_bytes: int):
        self.files, self.partition_bytes = files, partition_bytes

    def partitions(self) -> list[Run]:
        out = []
        for file in self.files:
            with _File(file) as f:
                found = blocks(f, f.size)
            first = held = 0
            for i, b in enumerate(found):
                if held and held + b.length > self.partition_bytes:
                    out.append(Run(file, first, i))
                    first, held = i, 0
                held += b.length
            if held:
                out.append(Run(file, first, len(found)))
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        with _File(partition.file) as f:
            found = blocks(f, f.size)
            texts, size, n = [], 0, 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([partition.file] * len(texts), pa.string()),
                                                   pa.array([found[partition.first].start] * len(texts), pa.int64()),
                                                   pa.array(range(n - len(texts), n), pa.int64())], schema=_ARROW)
            for line in lines_of(f, found, partition.first, partition.end):
                texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                size, n = size + len(line), n + 1
                if size > CHUNK or len(texts) == 10_000:
                    yield batch()
                    texts, size = [], 0
            if texts:
                yield batch()


def read_lines(spark: SparkSession, files: list[str], partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """value, file, block, line: the lines of the files; (file, block, line) is their order."""
    spark.dataSource.register(XzLines)
    return spark.read.format("xz_lines").option("files", json.dumps(files)).option("partitionBytes", partition_bytes).load()


def write_lines(lines: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Write the column ``value`` as xz files into ``folder`` (shared), a file
    per task, and per month (folders ``month=...``) if there is a column
    ``month``; returns the number of files. Tasks write under names of their
    own; only the files that a finished task names are moved into place."""
    spark, hidden = lines.sparkSession, f"_writing-{uuid.uuid4().hex[:8]}"
    monthly = "month" in lines.columns
    rows = lines.select(*(["month"] if monthly else []), "value")
    if monthly:
        rows = rows.sortWithinPartitions("month")

    def run(batches):
        fs, base = _filesystem(f"{folder}/{hidden}")
        fs.create_dir(base, recursive=True)
        held, size, parts, month = [], 0, [], None

        def close():
            if held:
                parts.append(b"\n".join(held) + b"\n")
            name = f"part-{uuid.uuid4().hex}.xz"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(stream(parts))
            return pa.RecordBatch.from_pydict({"month": [month], "file": [name]}, schema=pa.schema([("month", pa.string()), ("file", pa.string())]))
        for batch in batches:
            months = batch.column(0).to_pylist() if monthly else [None] * batch.num_rows
            for m, value in zip(months, batch.column(batch.num_columns - 1).to_pylist()):
                if m != month and (held or parts):
                    yield close()
                    held, size, parts = [], 0, []
                month = m
                held.append((value or "").encode())
                size += len(held[-1]) + 1
                if size >= block_bytes:
                    parts.append(b"\n".join(held) + b"\n")
                    held, size = [], 0
        if held or parts:
            yield close()

    files = rows.mapInArrow(run, "month string, file string").collect()         # one row per task and month
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in files:
        to = f"{folder}/month={r['month']}" if monthly else folder
        fs.mkdirs(path(to))
        if not fs.rename(path(f"{folder}/{hidden}/{r['file']}"), path(f"{to}/{r['file']}")):
            raise OSError(f"can't move {r['file']} to {to}")
    fs.delete(path(f"{folder}/{hidden}"), True)
    return len(files)
