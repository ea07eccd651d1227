"""ST2: stateless admission and normalisation on a stream.

The same Column functions as the batch jobs; the only join is a
stream-static semi join against the month's submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convkit.operators import quality as Q
from convkit.operators import threads as TH
from convkit.sources import adapters as AD


def admitted_stream(conversations_stream: DataFrame, subs: DataFrame) -> DataFrame:
    c = AD.comments_from(conversations_stream)
    return TH.comment_admission(c, TH.submission_filter(subs), once=False)


def quality_stream(documents_stream: DataFrame) -> DataFrame:
    return Q.quality_filter(AD.doc_pairs_from(documents_stream))
