"""Whether a statement fits a value, and comparison of names."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import half_up

def states(stated: float, decimals: int, percent: bool, value: float, most: int, fraction: bool) -> bool:
    """Whether a stated number is a fair rounding of a value shown with `most` decimals. Fractions may be stated as percentages
    or, with two more decimals, as fractions; a statement more precise than the value is never fair."""
    if fraction and (percent or abs(stated) > 1):
        return decimals <= most and Decimal(repr(stated)) == half_up(value * 100, decimals)
    limit = most + 2 if fraction else most
    return decimals <= limit and not percent and Decimal(repr(stated)) == half_up(value, decimals)


def similarity(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths (100 for two empty strings)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])
