"""Merkle manifest of a dataset, in blocks of van Emde Boas layout.

Every row is a leaf. The leaves of a group (a source) stand in the order of
their ids; every ``FANOUT`` consecutive nodes have the hash of their digests
as parent, until one is left, the group's root. The groups' roots, in the
order of the groups, form one more tree, whose root stands for the dataset.

A tree is cut into aligned blocks of ``HEIGHT`` levels of hashing, so that a
block has at most FANOUT ** HEIGHT leaves whatever the size of its group.
Inside a block the nodes lie in van Emde Boas order: a subtree of L levels is
its upper L // 2 levels, then the subtrees below them from left to right,
each laid out in the same way. The place of a node follows from its depth and
index alone (``address``): construction reads the runs of children by it, and
retrieval the siblings on a leaf's way up, so that a way touches few stretches
of memory at any size of page or cache. The roots of a tree's blocks are the
leaves of its next round of blocks, until a round has one block.

Blocks are built where their leaves meet (a shuffle by group and block);
proofs are read top-down, a round at a time, by joining the blocks with the
nodes asked for. No group is ever collected in one task.

A proof is the siblings' digests on the way from the leaf over its group's
root to the dataset's root (32 bytes each, level by level, left to right),
and, per level, the node's place in its run and the length of the run.
``fold`` recomputes the root from any leaf digest and a proof.

Defined results: null cells and empty ones have digests of their own; rows
without id come first in their group; rows with equal ids are in order of
their digests; repeated rows are leaves of their own; rows without group are
one group, which comes first; an empty table has no rows, no blocks and no
root; columns that aren't named as fields are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convkit.llm.stages import documents, written
from convkit.operators.ordering import global_index

FANOUT = 16
HEIGHT = 3              # levels of hashing in a block: 4096 leaves at most
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 32             # bytes
SALTS = 64              # places over which a group's rows are dealt to learn its size


# --- layout ------------------------------------------------------------------

def nodes_of(levels: int, fanout: int = FANOUT) -> int:
    """Nodes of a full subtree of so many levels."""
    return (fanout ** levels - 1) // (fanout - 1)


def address(levels: int, depth: int, index: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """Place of the nodes ``index`` (from the left) of a depth, root 0, in a
    subtree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index, fanout)
    below = levels - top
    each = fanout ** (depth - top)          # nodes of this depth in a lower subtree
    return nodes_of(top, fanout) + index // each * nodes_of(below, fanout) + address(below, depth - top, index % each, fanout)


@lru_cache(maxsize=64)
def _runs(levels: int, depth: int, fanout: int) -> np.ndarray:
    """[run, child]: places of all nodes of a depth, a run of siblings per row."""
    return address(levels, depth, np.arange(fanout ** depth), fanout).reshape(-1, fanout)


def height_of(n: int, fanout: int = FANOUT) -> int:
    """Levels of hashing over n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def build_block(leaves: list[bytes], height: int, fanout: int = FANOUT) -> bytes:
    """The cells of a block, up to the last one used; the root is the first."""
    cells = np.zeros((nodes_of(height + 1, fanout), DIGEST), dtype=np.uint8)
    n = len(leaves)
    at = address(height + 1, height, np.arange(n), fanout)
    cells[at] = np.frombuffer(b"".join(leaves), dtype=np.uint8).reshape(n, DIGEST)
    last = int(at.max())
    for depth in range(height, 0, -1):
        above = -(-n // fanout)
        runs = cells[_runs(height + 1, depth, fanout)[:above]]
        size = np.minimum(fanout, n - fanout * np.arange(above)).tolist()
        up = [hashlib.sha256(r[:k].tobytes().hex().encode()).digest() for r, k in zip(runs, size)]
        at, n = address(height + 1, depth - 1, np.arange(above), fanout), above
        cells[at] = np.frombuffer(b"".join(up), dtype=np.uint8).reshape(n, DIGEST)
        last = max(last, int(at.max()))
    return cells[:last + 1].tobytes()


def siblings(cells: bytes, height: int, n: int, places: np.ndarray, fanout: int = FANOUT):
    """For the leaves ``places`` of a block of n leaves: digests
    [leaf, fanout per level, 32], which of them are siblings, and per leaf and
    level the place in the run and the length of the run."""
    full = np.zeros((nodes_of(height + 1, fanout), DIGEST), dtype=np.uint8)
    got = np.frombuffer(cells, dtype=np.uint8).reshape(-1, DIGEST)
    full[:len(got)] = got
    digests, others, place, run = [], [], [], []
    index, child = places, np.arange(fanout)
    for depth in range(height, 0, -1):
        up, own = index // fanout, index % fanout
        size = np.minimum(fanout, n - fanout * up)
        digests.append(full[_runs(height + 1, depth, fanout)[up]])
        others.append((child < size[:, None]) & (child != own[:, None]))
        place.append(own)
        run.append(size)
        index, n = up, -(-n // fanout)
    none = np.empty((len(places), 0))
    return (np.concatenate([none[:, :, None].repeat(DIGEST, 2).astype(np.uint8), *digests], axis=1),
            np.concatenate([none.astype(bool), *others], axis=1),
            np.column_stack([none.astype(np.int32), *place]), np.column_stack([none.astype(np.int32), *run]))


def fold_proof(digest: bytes, proof: bytes, places: list[int], runs: list[int]) -> str:
    """Root (hex) that a leaf digest and a proof make."""
    own, rest, at = digest.hex(), proof.hex(), 0
    for place, run in zip(places, runs):
        left, end = at + 2 * DIGEST * place, at + 2 * DIGEST * (run - 1)
        own = hashlib.sha256((rest[at:left] + own + rest[left:end]).encode()).hexdigest()
        at = end
    return own


# --- leaves --------------------------------------------------------------------

def leaf_digest(cells: list[Column]) -> Column:
    """Digest (32 bytes) of a row: each cell as its UTF-8 byte count, a colon and its value, "-" if null."""
    def field(c):
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.unhex(F.sha2(F.concat(*[field(c) for c in cells]).cast("binary"), 256))


def group_key(c: Column) -> Column:
    """A string that is never null and sorts nulls first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


# --- trees ---------------------------------------------------------------------

_BLOCK = "tree string, block long, n long, leaves int, height int, cells binary, root binary, last boolean"
_BLOCK_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("leaves", pa.int32()), ("height", pa.int32()),
                          ("cells", pa.binary()), ("root", pa.binary()), ("last", pa.bool_())])


def _rounds(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """Written tables of blocks, a table per round. ``nodes``: tree, pos, n (leaves of the tree), digest."""
    per_block = fanout ** height

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t["n"][0].as_py()
        left = height_of(n, fanout)
        h = min(height, left)
        cells = build_block(t["digest"].to_pylist(), h, fanout)
        row = [t["tree"][0].as_py(), t["block"][0].as_py(), n, t.num_rows, h, cells, cells[:DIGEST], left <= height]
        return pa.table([[x] for x in row], schema=_BLOCK_ARROW)

    out = []
    while True:
        dealt = nodes.select("tree", "pos", "n", "digest", F.floor(F.col("pos") / per_block).cast("long").alias("block"))
        out.append(written(dealt.groupBy("tree", "block").applyInArrow(build, _BLOCK), f"merkle-{len(out)}"))
        more = out[-1].where(~F.col("last"))
        if more.isEmpty():
            return out
        nodes = more.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / per_block).cast("long").alias("n"),
                            F.col("root").alias("digest"))


_PROOF = "siblings binary, places array<int>, runs array<int>, subroot binary, root binary"


def _empty_proof(df: DataFrame, subroot: Column, root: Column) -> DataFrame:
    none = F.array().cast("array<int>")
    return df.withColumns({"siblings": F.lit("").cast("binary"), "places": none, "runs": none, "subroot": subroot, "root": root})


def _read(asked: DataFrame, blocks: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """``asked`` (tree, pos, more columns) with the proof's columns. ``above``:
    (tree, block) and the proof of each block's root."""
    per_block = fanout ** height
    kept = asked.columns
    left = asked.withColumn("block", F.floor(F.col("pos") / per_block).cast("long"))
    right = blocks.select("tree", "block", "leaves", "height", "cells").join(above, ["tree", "block"])

    def read(rows: pa.Table, block: pa.Table) -> pa.Table:
        b = {c: block[c][0].as_py() for c in block.column_names}
        digests, others, place, run = siblings(b["cells"], b["height"], b["leaves"], rows["pos"].to_numpy() % per_block, fanout)
        n, rest = rows.num_rows, np.frombuffer(b["siblings"], dtype=np.uint8).reshape(-1, DIGEST)
        # a leaf's digests in order: its levels of this block, then what all leaves of the block share
        flat = np.concatenate([digests, np.broadcast_to(rest, (n, *rest.shape))], axis=1)[
            np.concatenate([others, np.ones((n, len(rest)), dtype=bool)], axis=1)]
        size = DIGEST * (others.sum(axis=1) + len(rest))
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        proof = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes())])

        def lists(own, upper):
            m = np.concatenate([own, np.tile(np.array(upper, dtype=np.int32), (n, 1))], axis=1).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))
        same = [pa.array([b[c]] * n, pa.binary()) for c in ("subroot", "root")]
        return pa.table([*[rows[c] for c in kept], proof, lists(place, b["places"]), lists(run, b["runs"]), *same],
                        names=[*kept, "siblings", "places", "runs", "subroot", "root"])

    def ways(rows: pa.Table, block: pa.Table) -> pa.Table:
        if not rows.num_rows or not block.num_rows:
            return pa.table({c: rows[c].slice(0, 0) for c in kept} | {"siblings": pa.array([], pa.binary()),
                            "places": pa.array([], pa.list_(pa.int32())), "runs": pa.array([], pa.list_(pa.int32())),
                            "subroot": pa.array([], pa.binary()), "root": pa.array([], pa.binary())})
        return read(rows, block)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields) + ", " + _PROOF
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(ways, schema)


def _above(rounds: list[DataFrame], tops: DataFrame, fanout: int, height: int) -> DataFrame:
    """(tree, block) of the first round with the proofs of the blocks' roots;
    ``tops`` has those of the trees' roots, by tree."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        here = rounds[k].where("last").select("tree", "block").join(tops, "tree")
        if above is not None:
            asked = rounds[k].where(~F.col("last")).select("tree", F.col("block").alias("pos"))
            here = here.unionByName(_read(asked, rounds[k + 1], above, fanout, height).withColumnRenamed("pos", "block"))
        above = written(here, f"merkle-above-{k}") if k else here
    return above


@dataclass
class Manifest:
    """``leaves``: tree (group key), pos, n (leaves of the group), leaf and the columns kept; ``rounds``
    and ``top``: written tables of blocks, of the groups and over their roots."""
    leaves: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    fanout: int
    height: int

    def blocks(self) -> DataFrame:
        """All blocks: scope (group or dataset), round, tree, block, n, leaves, height, cells, root."""
        parts = [t.withColumns({"scope": F.lit(s), "round": F.lit(k)}) for s, ts in (("group", self.rounds), ("dataset", self.top))
                 for k, t in enumerate(ts)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("last")

    def root(self) -> str | None:
        """The dataset's root; None for an empty one."""
        r = self.top[-1].where("last").select(F.lower(F.hex("root"))).first()
        return r[0] if r else None


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None,
             fanout: int = FANOUT, height: int = HEIGHT) -> Manifest:
    """Build the trees of ``docs``. ``keep``: more columns of the leaves, by name."""
    keep = keep or {}
    rows = docs.select(group_key(F.col(group)).alias("tree"), F.col(order).alias("_order"), leaf_digest([F.col(c) for c in fields]).alias("leaf"),
                       *[c.alias(k) for k, c in keep.items()])
    # the last columns only make the order of equal rows the same in every run
    placed = global_index(rows, [F.col("tree"), F.col("_order"), F.col("leaf"), *[F.col(k) for k in keep]], "_place")
    # a group with a third of all rows meets its one row of totals in SALTS places
    spans = placed.groupBy("tree").agg(F.min("_place").alias("_first"), F.count("*").alias("n")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    leaves = placed.withColumn("_salt", (F.col("_place") % SALTS).cast("int")).join(spans, ["tree", "_salt"]).select(
        "tree", (F.col("_place") - F.col("_first")).alias("pos"), "n", "leaf", *keep)
    rounds = _rounds(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")), fanout, height)
    tops = None
    for t in rounds:
        part = t.where("last").select("tree", F.col("root").alias("digest"))
        tops = part if tops is None else tops.unionByName(part)
    tops = written(global_index(tops, [F.col("tree")], "pos"), "merkle-groups")
    n = tops.count()
    top = _rounds(tops.select(F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("n"), "digest"), fanout, height)
    return Manifest(leaves, rounds, top, fanout, height)


def proofs(m: Manifest, asked: DataFrame | None = None) -> DataFrame:
    """``asked`` (rows of ``m.leaves``; default all) with siblings, places,
    runs, subroot (of the group) and root (of the dataset)."""
    shape = (m.fanout, m.height)
    crown = m.top[-1].where("last").select("tree", "root")
    above = _above(m.top, _empty_proof(crown.select("tree", F.col("root").alias("r")), F.col("r"), F.col("r")).drop("r"), *shape)
    first = m.rounds[0]
    for t in m.rounds[1:]:
        first = first.unionByName(t)
    roots = first.where("last").select("tree", F.col("root").alias("own"))
    place = global_index(roots, [F.col("tree")], "pos").select(F.col("tree").alias("group"), F.lit("").alias("tree"), "pos", "own")
    tops = _read(place, m.top[0], above, *shape).select(F.col("group").alias("tree"), "siblings", "places", "runs",
                                                        F.col("own").alias("subroot"), "root")
    tops = written(tops, "merkle-tops")
    return _read(m.leaves if asked is None else asked, m.rounds[0], _above(m.rounds, tops, *shape), *shape)


def fold(rows: DataFrame, digest: str, out: str = "folded_root") -> DataFrame:
    """``rows`` without the proof's columns siblings, places and runs, plus
    ``out``: the root (hex) that the proof makes of the column ``digest``."""
    kept = [c for c in rows.columns if c not in ("siblings", "places", "runs", out)]
    fed = list(dict.fromkeys([*kept, digest]))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                col = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
                got = [fold_proof(*x) for x in zip(*(col[c].to_pylist() for c in (digest, "siblings", "places", "runs")))]
                yield pa.RecordBatch.from_arrays([*[col[c] for c in kept], pa.array(got, pa.string())], names=[*kept, out])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + f", `{out}` string"
    return rows.select(*fed, "siblings", "places", "runs").mapInArrow(run, schema)


def tampered(docs: DataFrame, fields: list[str] = FIELDS) -> Column:
    """Digest of the row with its text in lower case (A-Z), where 5 divides the crc32 of its id; else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cells = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in fields]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(cells))


def audit(spark, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    docs = documents(spark, sf_dir)
    m = manifest(docs, keep={"doc_id": F.col("doc_id"), "changed": tampered(docs)})
    ways = proofs(m).withColumns({"shown": F.coalesce("changed", "leaf"), "proof_sha256": F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256)})
    rows = fold(ways.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "shown", "siblings", "places", "runs"), "shown")
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")}
    return rows.withColumns(text).withColumn("verified", F.col("folded_root") == F.col("root")).drop("shown")
