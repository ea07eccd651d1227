"""S2 on a stream: the last row of a key wins, over all micro-batches.

A stream that decides row by row keeps every repeat. Here each key's winning
row is keyed state of a streaming aggregate (:func:`threads.last_wins` on a
stream; the state store is the session's, see :func:`store.rocksdb`), and each
micro-batch writes the winning rows of the keys it touched: an upsert log.
A row that arrives late, with a lower order than one already seen, loses in
the state and only writes the winner again. Readers merge the log by key, so
a batch that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convkit.operators import threads as TH
from convkit.streaming.runner import run_to_table


def upserted(stream: DataFrame, path: str, tag: str = "upserts") -> DataFrame:
    """Run a stream of winning rows to its end; the log so far (``_batch``)."""
    return run_to_table(stream, "update", tag=tag, path=path)


def merged(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of an upsert log: that of its latest batch. A batch has
    a key once, so nothing is left to chance; a key that every batch touches
    is one row per task before the shuffle."""
    rest = [c for c in log.columns if c not in keys and c != "_batch"]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in log.columns if c != "_batch"])


SUBMISSION_KEY, COMMENT_KEY = ["month", "id"], ["month", "link_id", "name"]


def submission_upserts(subs: DataFrame, order: str, path: str) -> DataFrame:
    """PF1 on a stream of submissions: the table after all that came so far."""
    return merged(upserted(TH.submission_filter(subs, order=order), path), SUBMISSION_KEY)


def comment_upserts(comments: DataFrame, subs: DataFrame, order: str, path: str) -> DataFrame:
    """PF2 on a stream of comments, against the submissions' table."""
    return merged(upserted(TH.comment_admission(comments, subs, order=order), path), COMMENT_KEY)
