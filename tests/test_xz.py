"""xz dumps: the index, lines at block borders, partitions, and the sink."""

import lzma
import random

import pytest

from convkit.sources import files as IO
from convkit.sources import xz


def _reader(data):
    return lambda at, n: data[at:at + n]


def _cut(text, rng, n):
    at = sorted(rng.randrange(len(text) + 1) for _ in range(n))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


@pytest.mark.parametrize("seed", range(6))
def test_every_line_is_read_once(seed):
    """Any cut into blocks and any split of the blocks gives the lines of the text, in order."""
    rng = random.Random(seed)
    text = b"".join(rng.choice([b"", b"a", b"line %d" % i, b"x" * rng.randrange(300)]) + b"\n" for i in range(120))
    text = text if seed % 2 else text + b"no break at the end"
    data = xz.stream([p for p in _cut(text, rng, 14)])
    assert lzma.decompress(data) == text
    found = xz.blocks(_reader(data), len(data))
    assert sum(b.length for b in found) == len(text) and len(found) > 8
    want = text.split(b"\n")[:-1] + ([b"no break at the end"] if not seed % 2 else [])
    for _ in range(20):
        ends = sorted({*[rng.randrange(1, len(found)) for _ in range(rng.randrange(6))], len(found)})
        got = [line for a, b in zip([0, *ends], ends) for line in xz.lines_of(_reader(data), found, a, b)]
        assert got == want


def test_streams_and_padding():
    a, b = b"one\ntwo\nth", b"ree\nfour\n"
    data = lzma.compress(a) + bytes(8) + lzma.compress(b"") + xz.stream([b]) + bytes(4)
    found = xz.blocks(_reader(data), len(data))
    assert [x.length for x in found] == [len(a), len(b)] and [x.start for x in found] == [0, len(a)]
    assert [list(xz.lines_of(_reader(data), found, i, i + 1)) for i in range(2)] == [[b"one", b"two", b"three"], [b"four"]]
    assert xz.blocks(_reader(b""), 0) == [] and lzma.decompress(xz.stream([])) == b""


def test_broken_files():
    data = xz.stream([b"some text\n" * 50])
    for bad in (data[:-1], data[:-6] + bytes(6) + b"YZ", b"no xz at all, but long enough to hold a footer", data[:40] + b"\xff" + data[41:]):
        with pytest.raises((ValueError, lzma.LZMAError)):
            found = xz.blocks(_reader(bad), len(bad))
            list(xz.lines_of(_reader(bad), found, 0, len(found)))


def test_two_blocks_are_two_tasks(spark, tmp_path):
    lines = [f"line {i} é" for i in range(2000)]
    text = "\r\n".join(lines).encode() + b"\r\n"
    (tmp_path / "a.xz").write_bytes(xz.stream([text[:9001], text[9001:]]))
    df = xz.read_lines(spark, [f"file:{tmp_path}/a.xz"], partition_bytes=10_000)
    assert df.rdd.getNumPartitions() == 2
    got = df.orderBy("file", "block", "line").collect()
    assert [r["value"] for r in got] == lines and len({r["block"] for r in got}) == 2
    assert xz.read_lines(spark, [f"file:{tmp_path}/a.xz"]).rdd.getNumPartitions() == 1


def test_dumps_of_several_kinds(spark, tmp_path):
    row = '{"id": "%s", "parent_id": "t3_x", "link_id": "t3_x", "score": 1, "body": "hi there"}\n'
    (tmp_path / "RC_2024-05.xz").write_bytes(lzma.compress((row % "a" + "no json\n" + row % "b").encode()))
    (tmp_path / "RC_2024-06.json").write_text(row % "c")
    got = {(r["id"], r["month"]) for r in IO.read_comments(spark, f"{tmp_path}/RC_*").collect()}
    assert got == {("a", "2024-05"), ("b", "2024-05"), ("c", "2024-06")}
    assert tuple(IO.rejects(spark, str(tmp_path), "comments").first()) == (1, 0, 3)
    (tmp_path / "RC_2024-07.7z").write_bytes(b"7z")
    with pytest.raises(ValueError, match="no decoder"):
        IO.read_comments(spark, str(tmp_path))


def test_sink_and_months(spark, tmp_path):
    rows = [(f"2024-0{1 + i % 3}", f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "month string, value string").repartition(3)
    n = xz.write_lines(df, str(tmp_path / "out"), block_bytes=200)
    files = IO.data_files(spark, str(tmp_path / "out"))
    assert len(files) == n == 9 and all(f.endswith(".xz") for f in files)
    got = IO._text(spark, str(tmp_path / "out"), partitioned=True).collect()
    assert sorted((r["month"], r["value"]) for r in got) == sorted(rows)
    assert xz.write_lines(df.limit(0), str(tmp_path / "none")) == 0
