"""Arithmetic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars, prices being for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def price_drifted(pinned: Column, live: Column, tolerance: float = 0.001) -> Column:
    return F.when(pinned == 0, live != 0).otherwise(F.abs(live - pinned) / pinned > tolerance)


def upper_median(values: Column) -> Column:
    """The element at position n // 2 of the sorted values (an aggregate over ``values``)."""
    kept = F.sort_array(F.collect_list(values))
    return F.element_at(kept, (F.floor(F.count(values) / 2) + 1).cast("int"))
