"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows that a side may have to be broadcast; beyond it the join shuffles and AQE splits skew.
BROADCAST_ROWS = 200_000


def bounded(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it is counted to have at most ``limit`` rows."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side
