"""Size-checked broadcast.

``broadcast_if_small`` hints a broadcast only when Catalyst's optimized-plan
estimate (an upper bound for scans, filters and projections) is below the
limit; otherwise the join is left to the planner and AQE, which re-plans at
runtime from measured shuffle sizes (sort-merge beyond the threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - not available (e.g. Spark Connect)
        return None


def broadcast_if_small(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df
