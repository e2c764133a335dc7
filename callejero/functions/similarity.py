"""The one vectorised helper: the matching-blocks ratio of two strings, as difflib defines it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either is null. Repeated pairs of a batch are computed once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = SequenceMatcher(None, *pair).ratio()
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def numbered_grams(text: Column, q: int) -> Column:
    """The runs of q letters of a text, each with a number for its first, second, ... time: a set of as many as there are."""
    at = F.sequence(F.lit(1), F.char_length(text) - (q - 1))
    grams = F.when(F.char_length(text) >= q, F.transform(at, lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def ratio_bound(a: str | Column, b: str | Column, m: str | Column, n: str | Column) -> Column:
    """The most that seq_ratio of two texts can be: twice the letters in common (numbered, as sets) over m + n letters."""
    m, n = (F.col(x) if isinstance(x, str) else x for x in (m, n))
    return F.when(m + n > 0, 2 * F.size(F.array_intersect(a, b)) / (m + n)).otherwise(1.0)
