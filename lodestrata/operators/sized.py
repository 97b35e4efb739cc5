"""Broadcast only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side of at most this many rows is broadcast; a larger one is left to a shuffle join.
BROADCAST_ROWS = 100_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame holds at most ``rows`` rows; reads no more than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the frame is proven small.

    Beyond the limit the frame comes back as it is and the join shuffles, with
    AQE splitting skewed keys.
    """
    return F.broadcast(df) if fits(df, rows) else df
