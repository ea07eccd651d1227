"""ST1: token-budgeted conversation context per user, as keyed state.

Messages may arrive in any order: state and new messages are merged by ts
before trimming, and anything older than an already dropped message is
ignored, so the state stays bounded and the result exact.

State per uid holds the kept messages (ts, tokens), newest last, never
more than the budget allows plus the newest one, so it is bounded. Each
update emits the current context summary; the final emission per uid
equals the batch rule (W4, ``history_final``) on the same input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convkit.operators.scoring import HISTORY_BUDGET

OUT_SCHEMA = "uid long, from_ts long, n_kept long, tokens long, seen long"
STATE_SCHEMA = "ts array<long>, tok array<long>, seen long, cut long"


def _trim(ts: list, tok: list, budget: int) -> tuple[list, list]:
    """Keep the newest message and older ones while the total fits."""
    keep, total = 0, 0
    for t in reversed(tok):
        if keep > 0 and total + t > budget:
            break
        total += t
        keep += 1
    return ts[len(ts) - keep:], tok[len(tok) - keep:]


def _make_update(budget: int, timeout_ms: int | None):
    def update(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:           # a user who has been silent for so long starts anew
            state.remove()
            return
        if state.exists:
            ts, tok, seen, cut = state.get
            ts, tok = list(ts), list(tok)
        else:
            ts, tok, seen, cut = [], [], 0, None
        # Merge each Arrow batch with the state by ts and trim. A message
        # older than one already dropped (`cut`) can never be in the kept
        # suffix again, so the result is exact in any arrival order and a
        # very active user never needs the whole micro-batch in memory.
        for pdf in pdfs:
            pdf = pdf[pdf["text"] != ""]
            seen += len(pdf)
            if cut is not None:
                pdf = pdf[pdf["ts"] > cut]
            merged = sorted(zip(ts + pdf["ts"].astype("int64").tolist(), tok + pdf["n_tokens"].astype("int64").tolist()))
            all_ts = [t for t, _ in merged]
            ts, tok = _trim(all_ts, [n for _, n in merged], budget)
            dropped = all_ts[:len(all_ts) - len(ts)]
            if dropped:
                cut = dropped[-1] if cut is None else max(cut, dropped[-1])
        state.update((ts, tok, seen, cut))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        # without any message but empty ones, a lone EOS
        yield pd.DataFrame({"uid": [int(key[0])], "from_ts": pd.array([ts[0] if ts else None], dtype="Int64"), "n_kept": [len(ts)],
                            "tokens": [sum(tok) if ts else 1], "seen": [seen]})
    return update


def history_updates(msgs: DataFrame, budget: int = HISTORY_BUDGET, timeout_ms: int | None = None) -> DataFrame:
    """Streaming (or batch) frame of (uid, ts, n_tokens, text) -> updates.
    With ``timeout_ms`` the state of a user who sends nothing for that long
    (processing time) is dropped; without, it stays, as in the original."""
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return msgs.groupBy("uid").applyInPandasWithState(_make_update(budget, timeout_ms), OUT_SCHEMA, STATE_SCHEMA, "update", kind)


def latest(updates: DataFrame) -> DataFrame:
    """Final context per uid from the written update log."""
    return (updates.groupBy("uid").agg(F.max_by(F.struct("from_ts", "n_kept", "tokens"),
                                                F.struct("_batch", "seen")).alias("_s"))
                   .select("uid", "_s.from_ts", "_s.n_kept", "_s.tokens"))
