"""Gestalt similarity (FN-17), which no built-in function expresses, as an Arrow-batched pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest common blocks; nulls count as empty."""
    from difflib import SequenceMatcher

    pairs = zip(a.fillna(""), b.fillna(""), strict=True)
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")
