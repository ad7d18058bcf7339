"""Ratios, means and shares with a fixed number of places, exact before they are rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, places: int = 0) -> Column:
    """``part / whole`` of whole numbers from 0 on, rounded half up to ``places``; null if there is no whole.

    The quotient is taken in whole numbers, so no binary fraction decides a tie.
    """
    scale = 10**places
    part, whole = part.cast("long"), whole.cast("long")
    scaled = F.call_function("div", part * (2 * scale) + whole, whole * 2)
    return F.when(whole > 0, scaled / F.lit(float(scale)))


def mean_seconds(total_ms: Column, n: Column, places: int = 0) -> Column:
    """The mean of ``n`` durations that add up to ``total_ms`` milliseconds, in seconds."""
    return ratio(total_ms, n * 1000, places)


def days(span_ms: Column) -> Column:
    """Milliseconds as days with one place."""
    return ratio(span_ms, F.lit(86_400_000), 1)
