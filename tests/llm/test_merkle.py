"""The Merkle manifest against a plain recursive version."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from convkit.llm import merkle as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def _levels(nodes, fanout=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _brute(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        rs = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])))
        trees[s] = rs, _levels([_leaf(r, r["text"]) for r in rs], fanout)
    top = _levels([trees[s][1][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        rs, tree = trees[s]
        for i, r in enumerate(rs):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            text = r["text"].translate(LOWER) if hit and r["text"] is not None else r["text"]
            own, proof = _leaf(r, text), []
            for levels, at in ((tree, i), (top, k)):
                for nodes in levels[:-1]:
                    lo = at // fanout * fanout
                    run = nodes[lo:lo + fanout]
                    left, right = run[:at - lo], run[at - lo + 1:]
                    own, at = _h(*left, own, *right), at // fanout
                    proof += left + right
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], _h(*proof), own, own == top[-1][0]))
    return out


def _audit(spark, rows, **shape):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos string, tree string, leaf string")
    m = M.manifest(docs, keep={"doc_id": F.col("doc_id"), "changed": M.tampered(docs)}, **shape)
    ways = M.proofs(m).withColumn("shown", F.coalesce("changed", "leaf"))
    ways = ways.withColumn("proof", F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256))
    got = M.fold(ways, "shown").select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof", "folded_root")
    return m, [(*r, r["folded_root"] == r["root"]) for r in got.collect()]


def _rows(n, sources, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(sources[:1] if rng.random() < 0.4 else sources)
        text = rng.choice([None, "", "Ab É ", "lower", "MIXED Case é中"]) if rng.random() < 0.5 else f"Text {i}"
        rows.append((i if rng.random() < 0.95 else None, text, rng.choice(["en", None, "d:e"]), s, rng.choice([i, None]), "p", "t", "l"))
    return rows + rows[:3]          # repeated rows


@pytest.mark.parametrize("fanout,height,n", [(2, 3, 300), (16, 1, 700), (16, 3, 300), (3, 2, 1), (16, 3, 17)])
def test_equals_brute_force(spark, fanout, height, n):
    rows = _rows(n, ["a", None, "é", "", "b-", "=", "zz"] + [f"s{i}" for i in range(20)])
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    want = _brute([dict(zip(names, r)) for r in rows], fanout)
    m, got = _audit(spark, rows, fanout=fanout, height=height)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert m.root() == want[0][3]
    if n > 100:
        assert 0 < sum(r[-1] for r in got) < len(got)
        assert len(m.rounds) > 1 or fanout ** height >= n / 3


def test_empty_table(spark):
    m, got = _audit(spark, [])
    assert got == [] and m.root() is None


def test_addresses_are_the_layout():
    """Every node has a place of its own; the upper half of the levels comes
    first, then the subtrees below, each stored in one stretch."""
    for fanout, levels in ((2, 6), (3, 4), (16, 4)):
        per_depth = [M.address(levels, d, np.arange(fanout ** d), fanout) for d in range(levels)]
        assert sorted(np.concatenate(per_depth).tolist()) == list(range(M.nodes_of(levels, fanout)))
        top = levels // 2
        upper = np.concatenate(per_depth[:top])
        assert upper.max() < M.nodes_of(top, fanout)
        size = M.nodes_of(levels - top, fanout)
        for s in range(fanout ** top):
            mine = np.concatenate([per_depth[d][s * fanout ** (d - top):(s + 1) * fanout ** (d - top)] for d in range(top, levels)])
            base = M.nodes_of(top, fanout) + s * size
            assert sorted(mine.tolist()) == list(range(base, base + size))


def test_blocks_hold_the_nodes():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(21)]
    want = _levels([x.hex() for x in leaves], 4)
    cells = M.build_block(leaves, 3, 4)
    for depth, nodes in zip((3, 2, 1, 0), want):
        for i, x in enumerate(nodes):
            at = int(M.address(4, depth, np.array([i]), 4)[0]) * 32
            assert cells[at:at + 32].hex() == x
    # a partly filled block higher than its leaves need is hashed up to its root
    assert M.build_block(leaves[:1], 2, 4)[:32].hex() == _h(_h(leaves[0].hex()))


def test_part_of_the_leaves(spark):
    rows = _rows(400, ["a", "b"])
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    m = M.manifest(docs, fanout=4, height=2, keep={"doc_id": F.col("doc_id")})
    asked = m.leaves.where("doc_id % 50 = 0")
    got = M.fold(M.proofs(m, asked), "leaf").collect()
    assert len(got) == asked.count() > 0 and {r["folded_root"] for r in got} == {m.root()}
    assert m.blocks().where("scope = 'group' and round = 0").agg(F.sum("leaves")).first()[0] == len(rows)
