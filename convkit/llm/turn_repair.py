"""Repair of conversation structure: the cheapest edits that make the roles of
a conversation read ``(s?(ua)+)?`` (initials of system, user, assistant).

Each row is kept (0), given the role that is due (3) or deleted (4; blank and
repeated rows must be), and rows without text are inserted (3); a truncated
row that stays costs 3 more. Of the cheapest scripts the one whose letters
(Delete, Insert, Keep, Rerole) come first in ASCII order is taken.

What may still follow from a row on is a vector of four costs, one per state
(nothing yet, after s, after u, after a), worked out from the end backwards.
The script is read off forwards: of the edits that are tight (their cost plus
the vector behind equals the vector here) the least letter. Vectors are kept
at checkpoints only, the square root of the rows apart; the walk recomputes a
stretch of them when it gets there. That happens twice:

- over Spark: all rows, ordered by conversation and turn, are cut into
  segments of about the square root of their number. A conversation that
  crosses segments has one checkpoint per segment: a segment gives the 4 x 4
  matrix of least costs from its first to its last row, the matrices give the
  vector behind each segment, that gives which state leaves a segment for
  each that may enter it, and so the state that enters each one. So a
  conversation with a third of all rows is never in one task.
- in a segment: a stretch of rows keeps a vector per square root of its rows.

Vectors matter only up to a constant, and few differ, so a step is a look-up.

Defined results: null role and text count as one blank; a null conv_id is a
conversation; turns ascend, nulls first, rows of one turn by role, then by a
digest of role and text; equal rows are repeats of one another; roles that
begin with another letter, or with none, are never kept; conversations without
rows have an empty script; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import inf, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convkit.llm.stages import documents, drop, written
from convkit.operators.ordering import global_index

SEGMENT = 4096          # rows of a segment, at least
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
OK, CUT, GONE = 0, 1, 2                 # kinds of rows: whole, truncated, to be deleted
DUE = (2, 2, 3, 2)                      # the state that the role which is due leads to
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)     # by initial s, u, a, other and state
ROLE = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"


# --- the steps of the dynamic program -----------------------------------------

def _closed(v: list) -> tuple:
    """The vector with insertions allowed, less its least cost."""
    for _ in range(3):
        v = [min(c, INSERT + v[DUE[s]]) for s, c in enumerate(v)]
    least = min(v)
    return tuple(c - least for c in v)


END = _closed([0, inf, inf, 0])         # behind the last row


@lru_cache(maxsize=None)
def back(code: int, behind: tuple) -> tuple[tuple, float]:
    """The vector before a row of a code (3 * initial + kind), and what its constant grew by."""
    kept, kind = KEPT[code // 3], code % 3
    more = TRUNCATED if kind == CUT else 0
    raw = []
    for s in range(4):
        c = DELETE + behind[s]
        if kind != GONE:
            c = min(c, REROLE + more + behind[DUE[s]])
            if kept[s] is not None:
                c = min(c, KEEP + more + behind[kept[s]])
        raw.append(c)
    v = _closed(raw)
    return v, min(raw)


@lru_cache(maxsize=None)
def edit(code: int, behind: tuple, state: int) -> tuple[int, str, int, int]:
    """Insertions before a row, the row's letter, the next state, the cost."""
    here, grown = back(code, behind)
    kept, kind = KEPT[code // 3], code % 3
    more = TRUNCATED if kind == CUT else 0
    n, s = 0, state
    while True:
        cost = here[s] + grown
        if cost == DELETE + behind[s]:
            return n, "D", s, n * INSERT + DELETE
        if cost == INSERT + here[DUE[s]] + grown:
            n, s = n + 1, DUE[s]
        elif kept[s] is not None and cost == KEEP + more + behind[kept[s]]:
            return n, "K", kept[s], n * INSERT + KEEP + more
        else:
            return n, "R", DUE[s], n * INSERT + REROLE + more


def last_inserts(state: int) -> list[str]:
    """Roles that are due behind the last row."""
    out = []
    while state in (1, 2):
        state = DUE[state]
        out.append(ROLE[state])
    return out


def inserted(state: int, n: int) -> tuple[list[str], int]:
    """The roles that n insertions have, and the state behind them."""
    out = []
    for _ in range(n):
        state = DUE[state]
        out.append(ROLE[state])
    return out, state


def matrix(codes: list[int]) -> list[float]:
    """Least cost from each state before the rows to each state behind them, row by row."""
    out = [[0.0] * 4 for _ in range(4)]
    for t in range(4):
        goal = [inf] * 4
        goal[t] = 0
        v, total = _closed(goal), 0
        for code in reversed(codes):
            v, grown = back(code, v)
            total += grown
        for s in range(4):
            out[s][t] = float(v[s] + total)
    return [x for row in out for x in row]


def before(m: list[float], behind: tuple) -> tuple:
    """The vector before the rows of a matrix."""
    return _closed([min(m[4 * s + t] + behind[t] for t in range(4)) for s in range(4)])


def walk(codes: list[int], behind: tuple, state: int):
    """(insertions, letter, state before, next state, cost) of each row. Vectors
    are kept every isqrt(rows) rows; a stretch is recomputed when the walk gets to it."""
    n = len(codes)
    step = max(1, isqrt(n))
    kept, v = {}, behind
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            kept[i] = v                             # behind row i
        v, _ = back(codes[i], v)
    i = 0
    while i < n:
        last = min(i + step - i % step, n) - 1      # the next row with a checkpoint behind it
        stretch = [kept[last]]
        for k in range(last, i, -1):
            stretch.append(back(codes[k], stretch[-1])[0])
        for k, b in zip(range(i, last + 1), reversed(stretch)):
            ins, letter, then, cost = edit(codes[k], b, state)
            yield ins, letter, state, then, cost
            state = then
        i = last + 1


# --- rows ----------------------------------------------------------------------

def _fields(*cells: Column) -> Column:
    """One string of several cells, each with its length, so that no two lists of cells make the same."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cells])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the crc32 of ``conv_id:turn`` names (mod 20: 0 drops the
    row, 1 empties it, 2 removes ``.!?``, 3 repeats it, 4 makes its role user)."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    d = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_d") == 3, F.lit(2)).otherwise(F.lit(1))
    return (d.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_n"))
             .drop("_n"))


def small_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows without their text: conv_id, turn, role, rid (digest of
    the row), said (of role and text), copies, blank, cut, seen (role and text
    came in an earlier turn). Counts are summed before they are shuffled."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    full = F.rtrim(text, F.lit(_SPACE))
    one = rows.select("conv_id", "turn", role.alias("role"), F.unhex(F.md5(_fields(F.col("conv_id"), F.col("turn"), role, text))).alias("rid"),
                      F.unhex(F.md5(_fields(role, text))).alias("said"), (full == "").alias("blank"), (~F.right(full, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    one = one.groupBy("conv_id", "turn", "role", "rid", "said", "blank", "cut").agg(F.count("*").alias("copies"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")           # nulls first
    conv = F.md5(_fields(F.col("conv_id")))
    one = one.withColumns({"_conv": conv, "_turn": turn})
    first = one.groupBy("_conv", "said").agg(F.min("_turn").alias("_first"))
    return one.join(first, ["_conv", "said"]).withColumn("seen", F.col("_turn") != F.col("_first")).drop("_conv", "_turn", "_first")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    i = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (3 * i + F.when(F.col("blank") | F.col("seen"), GONE).when(F.col("cut"), CUT).otherwise(OK)).cast("int")


def _pieces(t: pa.Table):
    """(first, end) of the conversations in a sorted segment."""
    conv = t["conv_id"].combine_chunks()
    if isinstance(conv, pa.ChunkedArray):
        conv = pa.concat_arrays(conv.chunks)
    ids = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))


def _known(info: pa.Table) -> dict[int, dict]:
    return {r["side"]: r for r in info.to_pylist()}


def scripts(small: DataFrame, segment: int | None = None) -> DataFrame:
    """Written table with one row per row of ``small``: its columns, place (in
    the order of all rows), segment, inserts (roles put before it), letter,
    due (the role it gets), tail (roles put behind the last row of a
    conversation), cost, and on the first row of each conversation and segment
    script (the letters of that stretch), ends (its first and last initials)
    and illegal (neighbouring rows inside it whose initials don't follow one
    another)."""
    conv = f"conv_id {small.schema['conv_id'].dataType.simpleString()}"
    order = [F.col(c) for c in ("conv_id", "turn", "role", "said")]
    placed = written(global_index(small.withColumn("code", _code()), order, "place"), "repair-rows")
    if segment is None:
        segment = max(SEGMENT, isqrt(placed.count()))
    placed = placed.withColumn("segment", F.floor(F.col("place") / segment).cast("long"))
    lean = placed.select("segment", "place", "conv_id", "code", "copies")

    # 1. the first and last conversations of a segment may go on beyond it
    def edges(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        found = _pieces(t)
        codes = t["code"].to_pylist()
        out = [(t["segment"][0].as_py(), side, t["conv_id"][a].as_py(), matrix(codes[a:b]))
               for side, (a, b) in enumerate([found[0], found[-1]][:len(found)])]
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                         pa.array([r[2] for r in out], t.schema.field("conv_id").type), pa.array([r[3] for r in out], pa.list_(pa.float64()))],
                        names=["segment", "side", "conv_id", "matrix"])
    edge = written(lean.groupBy("segment").applyInArrow(edges, f"segment long, side int, {conv}, matrix array<double>"), "repair-edges")

    # 2. the vector behind each stretch of a conversation, from its last stretch on
    def vectors(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["segment"], r["side"]))
        v = END
        for r in reversed(rows):
            r["behind"], v = list(map(float, v)), before(r["matrix"], v)
        return pa.Table.from_pylist([{k: r[k] for k in ("segment", "side", "conv_id", "behind")} | {"last": r is rows[-1]} for r in rows],
                                    schema=pa.schema([("segment", pa.int64()), ("side", pa.int32()), ("conv_id", t.schema.field("conv_id").type),
                                                      ("behind", pa.list_(pa.float64())), ("last", pa.bool_())]))
    vector = written(edge.groupBy("conv_id").applyInArrow(vectors, f"segment long, side int, {conv}, behind array<double>, last boolean"), "repair-vectors")

    # 3. the state that leaves a stretch for each that may enter it
    def exits(t: pa.Table, info: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        found, known, codes, out = _pieces(t), _known(info), t["code"].to_pylist(), []
        for side, (a, b) in enumerate([found[0], found[-1]][:len(found)]):
            behind, leave = tuple(known[side]["behind"]), []
            for s in range(4):
                for *_, s, _cost in walk(codes[a:b], behind, s):
                    pass
                leave.append(s)
            out.append(known[side] | {"leave": leave})
        return pa.Table.from_pylist([{k: r[k] for k in ("segment", "side", "conv_id", "behind", "last", "leave")} for r in out],
                                    schema=pa.schema([*info.schema, ("leave", pa.list_(pa.int32()))]))
    leave = written(lean.groupBy("segment").cogroup(vector.groupBy("segment")).applyInArrow(
        exits, f"segment long, side int, {conv}, behind array<double>, last boolean, leave array<int>"), "repair-exits")

    # 4. the state that enters each stretch
    def entries(t: pa.Table) -> pa.Table:
        rows, s = sorted(t.to_pylist(), key=lambda r: (r["segment"], r["side"])), 0
        for r in rows:
            r["state"], s = s, r["leave"][s]
        return pa.Table.from_pylist([{k: r[k] for k in ("segment", "side", "behind", "last", "state")} for r in rows],
                                    schema=pa.schema([("segment", pa.int64()), ("side", pa.int32()), ("behind", pa.list_(pa.float64())), ("last", pa.bool_()), ("state", pa.int32())]))
    enter = written(leave.groupBy("conv_id").applyInArrow(entries, "segment long, side int, behind array<double>, last boolean, state int"), "repair-entries")

    # 5. the script
    def emit(t: pa.Table, info: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        found, known, codes, copies = _pieces(t), _known(info), t["code"].to_pylist(), t["copies"].to_pylist()
        initial = [(r or "")[:1] for r in t["role"].to_pylist()]
        n = t.num_rows
        ins, letters, due, tail, costs = [None] * n, [None] * n, [None] * n, [[]] * n, [0] * n
        script, ends, illegal = [None] * n, [None] * n, [None] * n
        for k, (a, b) in enumerate(found):
            side = 0 if k == 0 else 1 if k == len(found) - 1 else None
            r = known[side] if side is not None else {"behind": END, "last": True, "state": 0}
            text, s = [], r["state"]
            for i, (m, letter, at, s, cost) in zip(range(a, b), walk(codes[a:b], tuple(r["behind"]), r["state"])):
                ins[i], at = inserted(at, m)
                letters[i], due[i] = letter, ROLE[s] if letter == "R" else None
                again = copies[i] - 1
                costs[i] = cost + DELETE * again
                text.append("I" * m + letter + "D" * again)
            if r["last"]:
                tail[b - 1] = last_inserts(s)
                costs[b - 1] += INSERT * len(tail[b - 1])
                text.append("I" * len(tail[b - 1]))
            pairs = sum(initial[i] + initial[i + 1] not in LEGAL for i in range(a, b - 1))
            script[a], ends[a] = "".join(text), [initial[a], initial[b - 1]]
            illegal[a] = pairs + sum(copies[a:b]) - (b - a)
        more = [pa.array(ins, pa.list_(pa.string())), pa.array(letters, pa.string()), pa.array(due, pa.string()), pa.array(tail, pa.list_(pa.string())),
                pa.array(costs, pa.int64()), pa.array(script, pa.string()), pa.array(ends, pa.list_(pa.string())), pa.array(illegal, pa.int64())]
        return pa.table([*t.columns, *more], names=[*t.column_names, "inserts", "letter", "due", "tail", "cost", "script", "ends", "illegal"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    out = written(placed.groupBy("segment").cogroup(enter.groupBy("segment")).applyInArrow(
        emit, f"{fields}, inserts array<string>, letter string, due string, tail array<string>, cost long, script string, ends array<string>, illegal long"),
        "repair-scripts")
    for d in (edge, vector, leave, enter):
        drop(d)
    return out


def repaired(rows: DataFrame, script: DataFrame) -> DataFrame:
    """conv_id, place, sub, role, text, letter of the repaired conversations, in the order of place and sub."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    # equal rows are summed up before they are shuffled: one text each
    texts = rows.select(F.unhex(F.md5(_fields(F.col("conv_id"), F.col("turn"), role, text))).alias("rid"), text.alias("text")).groupBy("rid").agg(
        F.first("text").alias("text"))
    stays = script.where("letter <> 'D' or size(inserts) + size(tail) > 0").select("rid", "conv_id", "place", "role", "letter", "due", "inserts", "tail")

    def empty(c):
        return F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("letter")))
    own = F.array(F.struct(F.coalesce("due", "role").alias("role"), F.col("text"), F.col("letter")))
    both = stays.join(texts, "rid").select("conv_id", "place", F.posexplode(F.concat(
        empty("inserts"), F.when(F.col("letter") == "D", F.slice(own, 1, 0)).otherwise(own), empty("tail"))).alias("sub", "r"))
    return both.select("conv_id", "place", "sub", "r.role", "r.text", "r.letter")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines. The rows of a
    conversation pass through one task as a stream (a digest can't be made of
    parts), which holds one batch at a time."""
    field = lines.schema["conv_id"]
    rows = lines.select("conv_id", "place", "sub", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions(
        "conv_id", "place", "sub")

    def run(batches):
        conv, state, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {field.dataType.simpleString()}, repaired_sha256 string")


def summary(script: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    again = F.col("copies") - 1
    counts = script.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("seen"), F.col("copies")).otherwise(again)).alias("duplicate"),
        F.sum(F.when(F.col("cut") & ~F.col("blank") & ~F.col("seen"), 1).otherwise(0)).alias("truncated"),
        F.sum("cost").alias("cost"), F.sum("illegal").alias("_inside"),
        F.array_sort(F.collect_list(F.when(F.col("script").isNotNull(), F.struct("place", "script", "ends")))).alias("_parts"))
    turns = script.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    n = F.size("_parts")
    meets = F.zip_with(F.slice("_parts", 1, n - 1), F.slice("_parts", 2, n - 1), lambda x, y: F.concat(x["ends"][1], y["ends"][0]))
    counts = counts.withColumns({"illegal": F.col("_inside") + F.size(F.filter(meets, lambda p: ~p.isin(*LEGAL))),
                                 "audit": F.array_join(F.transform("_parts", lambda p: p["script"]), "")}).drop("_inside", "_parts")
    cond = counts["conv_id"].eqNullSafe(turns["conv_id"])
    return counts.join(turns, cond).drop(turns["conv_id"])


def report(conversations: DataFrame, segment: int | None = None) -> DataFrame:
    """Every conv_id of ``conversations`` with the report on its damaged rows."""
    rows = damage(conversations)
    script = scripts(small_rows(rows), segment)
    found, shown = summary(script), digests(repaired(rows, script))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["conv_id"]), "left").drop(found["conv_id"])
    out = out.join(shown, out["conv_id"].eqNullSafe(shown["conv_id"]), "left").drop(shown["conv_id"])
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def audit(spark, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir, "conversations"))
