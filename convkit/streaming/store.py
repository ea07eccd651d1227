"""ST1 on the keyed state API: contexts of very many users, off the heap.

The same rule as :mod:`convkit.streaming.history`, for more users than state
in executor memory allows: the state lies in RocksDB, a list of the kept
messages (the budget bounds its length) beside one row of counters, and is
written back only where it changed. A user who stays silent is forgotten by a
timer of their own; ``ttl_ms`` lets the store drop whatever has not been
written for so long, also without a timer.

Times are processing times. A user's timer runs on from their last message; a
message that comes after the timer is due, in the same batch that would let it
go off, finds the user forgotten as well, so the result does not depend on how
messages fall into batches.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convkit.operators.scoring import HISTORY_BUDGET
from convkit.streaming.history import OUT_SCHEMA, _trim

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, and run no batches
    without data: with timers of processing time Spark runs those for ever, so
    a job over what is available would not end. Due timers go off in the next
    batch with data. Afterwards the session is as it was."""
    own = {PROVIDER: ROCKSDB, EMPTY_BATCHES: "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ContextStore(StatefulProcessor):
    """Per user: list state ``kept`` (ts, tok; newest last) and value state
    ``totals`` (seen; cut: the newest dropped message; last: when a message came)."""

    def __init__(self, budget: int = HISTORY_BUDGET, silence_ms: int | None = None, ttl_ms: int | None = None):
        self.budget, self.silence_ms, self.ttl_ms = budget, silence_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "ts long, tok long", self.ttl_ms)
        self.totals = handle.getValueState("totals", "seen long, cut long, last long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.silence_ms else 0
        seen, cut, last = self.totals.get() if self.totals.exists() else (0, None, now)
        kept = [(int(t), int(n)) for t, n in self.kept.get()] if seen else []
        if self.silence_ms and now - last >= self.silence_ms:
            seen, cut, kept = 0, None, []
        before = list(kept)
        for pdf in rows:                # one Arrow batch at a time: the list never grows beyond it and the budget
            pdf = pdf[pdf["text"] != ""]
            seen += len(pdf)
            if cut is not None:
                pdf = pdf[pdf["ts"] > cut]
            merged = sorted(kept + list(zip(pdf["ts"].astype("int64").tolist(), pdf["n_tokens"].astype("int64").tolist())))
            ts, tok = _trim([t for t, _ in merged], [n for _, n in merged], self.budget)
            dropped = merged[:len(merged) - len(ts)]
            if dropped:
                cut = dropped[-1][0] if cut is None else max(cut, dropped[-1][0])
            kept = list(zip(ts, tok))
        if kept != before or not before:
            self.kept.put(kept) if kept else self.kept.clear()
        self.totals.update((seen, cut, now))
        if self.silence_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)
            self.handle.registerTimer(now + self.silence_ms)
        tokens = sum(n for _, n in kept)
        yield pd.DataFrame({"uid": [int(key[0])], "from_ts": pd.array([kept[0][0] if kept else None], dtype="Int64"), "n_kept": [len(kept)],
                            "tokens": [tokens if kept else 1], "seen": [seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.totals.clear()
        return iter([])

    def close(self) -> None:
        pass


def stored_updates(msgs: DataFrame, budget: int = HISTORY_BUDGET, silence_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Stream of (uid, ts, n_tokens, text) -> updates, as
    :func:`history.history_updates`. Start it inside :func:`rocksdb`."""
    mode = "ProcessingTime" if silence_ms or ttl_ms else "None"
    return msgs.groupBy("uid").transformWithStateInPandas(ContextStore(budget, silence_ms, ttl_ms), OUT_SCHEMA, "Update", mode)
