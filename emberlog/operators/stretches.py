"""Looking back and ahead in time without putting a whole run into one task.

The time of each group is cut into stretches. Inside a stretch a window finds the last
(or next) value; what a stretch leaves to those after it is one row, and a scan over
these rows, not over events, carries it across. So a group of any length is spread over
as many tasks as it has stretches, and no buffer holds more than one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.operators.intervals import bin_of

STRETCH_MS = 600_000
_STRETCH = "stretch of time"


def _null_safe(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    renamed = right.select(*[F.col(c).alias(f"{c} of stretch") for c in by], *[c for c in right.columns if c not in by])
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"{c} of stretch"))
        on = same if on is None else on & same
    return left.join(renamed, on, "left").drop(*[f"{c} of stretch" for c in by])


def carried(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], ahead: bool = False, strict: bool = False, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """``df`` with, for each of ``values``, the last one that isn't null among the rows of the group
    up to this one in ``order`` (``ahead``: the next from this one on; ``strict``: without this one).

    ``order`` begins with a time in milliseconds and has no nulls; rows that tie in all of it have no
    order among them. Keys in ``by`` may be null."""
    names = list(values)
    held = df.withColumn(_STRETCH, bin_of(F.col(order[0]), stretch_ms)).withColumns({f"given {n}": v for n, v in values.items()})
    key = F.struct(*order)
    turned = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    local = W.partitionBy(*by, _STRETCH).orderBy(*turned).rowsBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    best = F.min_by if ahead else F.max_by
    # what a stretch leaves behind: its last value, as seen from the next stretch
    left = held.groupBy(*by, _STRETCH).agg(*[best(F.col(f"given {n}"), F.when(F.col(f"given {n}").isNotNull(), key)).alias(f"left {n}") for n in names])
    stretch = F.col(_STRETCH).desc() if ahead else F.col(_STRETCH).asc()
    across = W.partitionBy(*by).orderBy(stretch).rowsBetween(W.unboundedPreceding, -1)
    border = left.select(*by, _STRETCH, *[F.last(f"left {n}", ignorenulls=True).over(across).alias(f"before {n}") for n in names])
    inside = held.withColumns({f"within {n}": F.last(f"given {n}", ignorenulls=True).over(local) for n in names})
    met = _null_safe(inside, border, [*by, _STRETCH])
    return met.select(*[c for c in df.columns if c not in names], *[F.coalesce(f"within {n}", f"before {n}").alias(n) for n in names])


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], stretch_ms: int = STRETCH_MS) -> DataFrame:
    """``df`` with the running sum of each of ``values`` over the rows of the group up to this one in ``order``."""
    names = list(values)
    held = df.withColumn(_STRETCH, bin_of(F.col(order[0]), stretch_ms)).withColumns({f"given {n}": F.coalesce(v, F.lit(0)).cast("long") for n, v in values.items()})
    local = W.partitionBy(*by, _STRETCH).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    left = held.groupBy(*by, _STRETCH).agg(*[F.sum(f"given {n}").alias(f"left {n}") for n in names])
    across = W.partitionBy(*by).orderBy(_STRETCH).rowsBetween(W.unboundedPreceding, -1)
    border = left.select(*by, _STRETCH, *[F.sum(f"left {n}").over(across).alias(f"before {n}") for n in names])
    inside = held.withColumns({f"within {n}": F.sum(f"given {n}").over(local) for n in names})
    met = _null_safe(inside, border, [*by, _STRETCH])
    return met.select(*[c for c in df.columns if c not in names], *[(F.col(f"within {n}") + F.coalesce(f"before {n}", F.lit(0))).alias(n) for n in names])
