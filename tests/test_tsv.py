"""Quoted TSV over several splits of a file."""

import csv
import io
import random

import pytest

from convkit.sources import files as IO
from convkit.sources import tsv


def _by_hand(text):
    """Whether the end of a text lies in a quoted cell, character by character."""
    inside, start, i = False, True, 0
    while i < len(text):
        c = text[i]
        if inside and c == '"':
            if text[i + 1:i + 2] == '"':
                i += 1
            else:
                inside = False
        elif not inside:
            inside = start and c == '"'
            start = c in "\t\n"
            i += 1
            continue
        start = False
        i += 1
    return inside


def test_states_of_lines():
    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('""a\tb') for _ in range(rng.randrange(9)))
        assert tsv.ends_inside(line, False) == _by_hand(line), line
        assert tsv.ends_inside(line, True) == _by_hand('"\n' + line), line


@pytest.mark.parametrize("size", [None, 700, 64])
def test_records_of_many_splits(spark, tmp_path, size):
    rng = random.Random(3)
    cells = ["plain", 'say "hi"', "two\nlines", "\n\n", "tab\there", 'end"', '"', "x" * 90, "mid\n\"quoted\"\ndle", "é中"]
    rows = [(f"k{i}", rng.choice(cells), rng.choice(cells)) for i in range(150)]
    for name, part in (("a.tsv", rows[:100]), ("b.tsv", rows[100:])):
        out = io.StringIO()
        csv.writer(out, delimiter="\t", lineterminator="\n").writerows(part)
        (tmp_path / name).write_text(out.getvalue() + 'stray\tno "quotes" here\tz\n', encoding="utf-8")
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = sorted(tuple(r) for r in IO.read_pairs(spark, str(tmp_path), ["k", "a", "b"]).collect())
        if size:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([*rows, *[("stray", 'no "quotes" here', "z")] * 2])
