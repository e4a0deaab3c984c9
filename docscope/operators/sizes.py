"""Broadcasts behind a look at the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of more rows, or of more bytes (as JSON), than this is not broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of at most ``size`` bytes in all.

    What travels to one place for this are the sizes of at most ``rows`` + 1 rows, not the rows.
    """
    sizes = df.select(F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("n")).limit(rows + 1)
    seen = sizes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
    return seen["rows"] <= rows and seen["size"] <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small by rows and bytes; else unchanged, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df
