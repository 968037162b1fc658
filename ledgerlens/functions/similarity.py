"""Ratcliff-Obershelp similarity of strings.

Python's difflib is the definition, its treatment of frequent characters included. The
ratio is not symmetric, so the order of arguments is part of every caller's meaning.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in seen:
            seen[x, y] = ratio(x, y)
        out.append(seen[x, y])
    return pd.Series(out, dtype="float64")


def may_reach(a: Column, b: Column, least: float) -> Column:
    """A bound that loses nothing: the ratio is at most twice the shorter length over both."""
    la, lb = F.length(a), F.length(b)
    return (2 * F.least(la, lb) >= least * (la + lb)) & (la + lb > 0)
