"""Indel-based fuzzy ratio (the token-sort ratio used for name matching).

ratio(a, b) = 100 * (1 - indel(a, b) / (len a + len b)), indel = insertions +
deletions = len a + len b - 2 * LCS(a, b). The LCS length uses the
bit-parallel algorithm (one big-int step per character of ``b``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    dist = total - 2 * lcs_length(a, b)
    return 100.0 * (1.0 - dist / total)


def token_sort(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(token_sort(a), token_sort(b))


@F.pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Vectorised over an Arrow batch of already token-sorted strings."""
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def token_sorted(c: Column) -> Column:
    """JVM-side token sort: split on whitespace, sort, join with one space."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")
