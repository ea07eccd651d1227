"""N-gram and sequence helpers as Column expressions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ngrams(tokens, n: int) -> Column:
    """All contiguous n-grams of ``tokens`` joined by one space.

    Built with ``zip_with`` over shifted slices: no index lambda that would
    re-evaluate the token expression per element.
    """
    t = _c(tokens)
    k = F.greatest(F.size(t) - n + 1, F.lit(0))
    g = F.slice(t, 1, k)
    for j in range(1, n):
        g = F.zip_with(g, F.slice(t, j + 1, k), lambda a, b: F.concat(a, F.lit(" "), b))
    return g


def ngrams_upto(tokens, max_n: int) -> Column:
    """n-grams for n = 1..max_n, concatenated."""
    return F.concat(*[ngrams(tokens, n) for n in range(1, max_n + 1)])


def _tag(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))


def tagged_ngrams(tokens, max_n: int) -> Column:
    """array<struct<n int, g string>> for n = 1..max_n (one explode gives all n)."""
    return F.concat(*[F.transform(ngrams(tokens, n), _tag(n)) for n in range(1, max_n + 1)])


def _lcs(left: list[list], right: list[list]) -> np.ndarray:
    """LCS lengths of pairs of token lists: one row of the table of all pairs
    at a time. A row's cells depend on those to their left only through a
    running maximum."""
    m, n = max(map(len, left), default=0), max(map(len, right), default=0)
    a = np.full((len(left), m), -1, dtype=np.int64)
    b = np.full((len(right), n), -2, dtype=np.int64)
    for i, (x, y) in enumerate(zip(left, right)):
        ids: dict = {}
        a[i, :len(x)] = [ids.setdefault(t, len(ids)) for t in x]
        b[i, :len(y)] = [ids.setdefault(t, len(ids)) for t in y]
    row = np.zeros((len(left), n + 1), dtype=np.int32)
    for k in range(m):
        np.maximum.accumulate(np.maximum(row[:, 1:], (row[:, :-1] + 1) * (b == a[:, k:k + 1])), axis=1, out=row[:, 1:])
    return row[:, -1]


@F.pandas_udf(Ty.IntegerType())
def lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence length of two token arrays. Pairs of
    similar length share a table of bounded size."""
    x = [list(v) if v is not None else [] for v in a]
    y = [list(v) if v is not None else [] for v in b]
    out = np.zeros(len(x), dtype=np.int32)
    order = sorted(range(len(x)), key=lambda i: (len(y[i]), len(x[i])))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and len(y[order[j]]) <= 1.25 * len(y[order[i]]) + 8 and (j - i + 1) * (len(y[order[j]]) + 1) <= 1 << 20:
            j += 1
        some = order[i:j]
        out[some] = _lcs([x[q] for q in some], [y[q] for q in some])
        i = j
    return pd.Series(out, dtype="int32")


def count_grams(text: str, max_n: int) -> list[Counter]:
    """Counts of the n-grams of words with one space between them, n = 1..max_n."""
    ws = text.split(" ") if text else []
    g, out = ws, [Counter(ws)]
    for n in range(1, max_n):
        g = [f"{a} {b}" for a, b in zip(g, ws[n:])]
        out.append(Counter(g))
    return out
