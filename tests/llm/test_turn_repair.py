"""Conversation repair against an exhaustive search over scripts."""
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from convkit.llm import turn_repair as R

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def _order(r):
    f = "".join(f"{len(x.encode())}:{x}" for x in r[2:])
    return r[1] is not None, r[1] or 0, r[2], hashlib.md5(f.encode()).digest()


def _brute(rows):
    """Report of one conversation's damaged rows: least (cost, script) over all scripts, by plain recursion."""
    rows = sorted(rows, key=_order)
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        full = text.rstrip(SPACE)
        kind = 0 if not full else 1 if (role, text) in seen else 2 if full[-1] not in ".!?" else 3
        seen.add((role, text))
        kinds.append(kind)
        if kind < 3:
            counts[kind] += 1

    @lru_cache(maxsize=None)
    def best(i, shape, spare=3):
        """Least (cost, script, lines) from row i on, if the initials so far end in ``shape``, with ``spare`` insertions here."""
        found = [(0, "", ())] if i == len(rows) and shape in ("", "a") else []
        due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[shape]
        options = []
        if spare:
            options.append((3, "I", due[0], f"{due}:", i, spare - 1))
        if i < len(rows):
            role, text, more = rows[i][2], rows[i][3], 3 if kinds[i] == 2 else 0
            options.append((4, "D", shape, None, i + 1, 3))
            if kinds[i] >= 2:
                if role[:1] == due[0] or (role[:1] == "s" and shape == ""):
                    options.append((more, "K", role[0], f"{role}:{text}", i + 1, 3))
                options.append((3 + more, "R", due[0], f"{due}:{text}", i + 1, 3))
        for cost, letter, to, line, *at in options:
            c, s, lines = best(at[0], to, at[1])
            found.append((cost + c, letter + s, (line, *lines) if line is not None else lines))
        return min(found, default=(float("inf"), "", ()))
    cost, script, lines = best(0, "")
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
    return gaps, *counts, illegal, cost, script, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        out[c] = _brute([r for r in _damaged(rows) if r[0] == c])
    return out


def _rows(n, seed, ids=40, long=None):
    rng = random.Random(seed)
    texts = ["Hello there.", "Cut off here", "  \t ", "", None, "Really?", "Wow! ", "x", "é中!", "no end \n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "assistant"]
    rows, turn = [], {}
    for _ in range(n):
        c = long if long is not None and rng.random() < 0.5 else rng.choice([None, *range(ids)])
        turn[c] = turn.get(c, -1) + rng.choice([1, 1, 1, 1, 0, 2])
        rows.append((c, turn[c] if rng.random() < 0.95 else None, rng.choice(roles), f"{rng.choice(texts) or ''}" if rng.random() < 0.3 else rng.choice(texts)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, code string, place int")


def _got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("segment,long", [(None, None), (7, None), (5, 3), (1, 0)])
def test_equals_exhaustive_search(spark, segment, long):
    """Segments of a few rows: conversations go over many of them."""
    rows = _rows(220, 11 + (segment or 0), long=long)
    assert _got(R.report(_frame(spark, rows), segment)) == _expected(rows)


def test_equal_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Same.")] * 150 + [(1, 1, "assistant", "Yes.")] * 3 + [(2, 0, None, None)]
    assert _got(R.report(_frame(spark, rows), 4)) == _expected(rows)
    assert R.report(_frame(spark, [])).count() == 0


def test_walk_recomputes_stretches():
    """The walk over checkpoints equals a walk that keeps every vector."""
    rng = random.Random(3)
    for n in (1, 2, 3, 10, 50, 333):
        codes = [rng.randrange(12) for _ in range(n)]
        vectors = [R.END]
        for c in reversed(codes):
            vectors.append(R.back(c, vectors[-1])[0])
        vectors.reverse()
        state, want = 0, []
        for c, behind in zip(codes, vectors[1:]):
            ins, letter, then, cost = R.edit(c, behind, state)
            want.append((ins, letter, state, then, cost))
            state = then
        assert list(R.walk(codes, R.END, 0)) == want
        # the cost read off is the least cost, and matrices of parts give the same vectors
        cut = rng.randrange(n + 1)
        assert R.before(R.matrix(codes[:cut]), R.before(R.matrix(codes[cut:]), R.END)) == vectors[0]
        assert R.back.cache_info().currsize < 5000


def test_repaired_rows(spark):
    rows = [(5, 1, "assistant", "Fine."), (5, 2, "assistant", "Then this."), (6, 1, "system", "Be kind."), (6, 2, "user", "Hi.")]
    script = R.scripts(R.small_rows(_frame(spark, rows)))
    got = [(r["conv_id"], r["role"], r["text"], r["letter"]) for r in R.repaired(_frame(spark, rows), script).orderBy("place", "sub").collect()]
    assert got[-3:] == [(6, "system", "Be kind.", "K"), (6, "user", "Hi.", "K"), (6, "assistant", "", "I")]
    assert got[:-3] == [(5, "user", "Fine.", "R"), (5, "assistant", "Then this.", "K")]
