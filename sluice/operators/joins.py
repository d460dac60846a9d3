"""How joined tables travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000  # tables of more rows than this are joined by a shuffle


def few(df: DataFrame) -> DataFrame:
    """Broadcast a table only if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
