"""Similarity of vectors and of strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """null where a vector is null, empty or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(T.DoubleType())
def _matched(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    gaps = str.maketrans("", "", " \n")
    plain = lambda s: s.translate(gaps)
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, plain(x), plain(y)).ratio() * 100, 2) for x, y in zip(a, b)], dtype="float64")


def character_accuracy(text: Column, truth: Column) -> Column:
    """Percent of characters in matching blocks, without spaces and line feeds; two places. No SQL function computes it."""
    return _matched(text, truth)
