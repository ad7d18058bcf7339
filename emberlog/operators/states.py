"""What was known at a moment, and what came after it. Planned by the analysed design, beyond its code.

A state is the last value seen of each field, with its age: a value older than the field's
horizon is stale and no longer told as the value. An outcome sums what happened in a span
after a moment, for several spans at once, and says whether the data end before the span does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.stretches import STRETCH_MS, carried, running


def states(moments: DataFrame, observations: DataFrame, by: list[str], horizons: dict[str, int | None], stretch_ms: int = STRETCH_MS) -> DataFrame:
    """``moments`` (``by``, rel_ms, ...) with four columns a field: its value, null when stale; ``_last``,
    whatever its age; ``_age_ms``; ``_status`` (observed, stale or unknown).

    ``observations`` is (``by``, rel_ms, seq, field, value); those of the same millisecond count, of
    several the one with the greatest seq. A horizon of None never makes a value stale. A moment or
    observation without a time knows nothing and is no evidence.
    """
    columns = moments.columns
    seen = observations.where("rel_ms is not null and value is not null").select(*by, "rel_ms", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), "field", F.struct("rel_ms", "value").alias("seen"), F.lit(None).cast(moments.schema.simpleString()).alias("moment"))
    asked = moments.select(*by, F.col("rel_ms"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("field"), F.lit(None).cast(seen.schema["seen"].dataType).alias("seen"), F.struct(*columns).alias("moment"))
    rows = seen.unionByName(asked.where("rel_ms is not null"))
    fields = {f"at {f}": F.when(F.col("field") == f, F.col("seen")) for f in horizons}
    known = carried(rows, by, ["rel_ms", "kind", "seq"], fields, stretch_ms=stretch_ms).where("kind = 1")
    known = known.unionByName(asked.where("rel_ms is null"), allowMissingColumns=True)
    out: list[Column] = []
    for f, horizon in horizons.items():
        last, age = F.col(f"at {f}")["value"], F.col("moment.rel_ms") - F.col(f"at {f}")["rel_ms"]
        fresh = F.lit(True) if horizon is None else age <= horizon
        status = F.when(age.isNull(), "unknown").when(fresh, "observed").otherwise("stale")
        out += [F.when(fresh, last).alias(f), last.alias(f"{f}_last"), age.alias(f"{f}_age_ms"), status.alias(f"{f}_status")]
    return known.select("moment.*", *out)


def outcomes(moments: DataFrame, happened: DataFrame, by: list[str], key: str, horizons: list[int], components: dict[str, str], end: str, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """One row per moment and horizon: (``by``, key, horizon_ms, actual_ms, truncated, the components).

    ``moments`` has ``by``, ``key`` (unique), rel_ms and ``end``, the time at which its data end; ``happened``
    has ``by``, rel_ms and the columns of ``components`` (name of the result to whole-number column). A
    component is the sum over what happened after the moment, up to and with the horizon, or the end if
    that comes first (truncated). Each is the difference of two running sums, so the spans may be as many
    and as long as they like. Without an end nothing is truncated.
    """
    names = list(components)
    spans = F.explode(F.array(*[F.lit(h).cast("long") for h in (0, *horizons)]))
    m = moments.select(*by, F.col(key).alias("key"), F.col("rel_ms").alias("from_ms"), F.col(end).alias("end_ms"), spans.alias("horizon_ms"))
    until = F.greatest("from_ms", F.least(F.col("from_ms") + F.col("horizon_ms"), "end_ms"))
    probes = m.select(*by, until.alias("rel_ms"), F.lit(1).alias("kind"), "key", "horizon_ms", "from_ms", "end_ms", *[F.lit(0).cast("long").alias(n) for n in names])
    facts = happened.where("rel_ms is not null").select(*by, "rel_ms", F.lit(0).alias("kind"), *[F.col(c).cast("long").alias(n) for n, c in components.items()])
    summed = running(facts.unionByName(probes.where("rel_ms is not null"), allowMissingColumns=True), by, ["rel_ms", "kind"], {n: F.col(n) for n in names}, stretch_ms).where("kind = 1")
    # a moment's probes meet once; the one of span 0 is what its others are counted from
    tail = F.struct("horizon_ms", F.col("rel_ms").alias("until_ms"), *names)
    met = summed.groupBy(*by, "key", "from_ms", "end_ms").agg(F.array_sort(F.collect_list(tail)).alias("at"))
    zero = F.get("at", F.lit(0))
    one = met.select(*by, F.col("key"), "from_ms", "end_ms", zero.alias("zero"), F.explode(F.slice("at", 2, len(horizons))).alias("x"))
    return one.select(*by, F.col("key").alias(key), F.col("x.horizon_ms").alias("horizon_ms"), (F.col("x.until_ms") - F.col("from_ms")).alias("actual_ms"), (F.coalesce(F.col("from_ms") + F.col("x.horizon_ms") > F.col("end_ms"), F.lit(False))).alias("truncated"), *[(F.col(f"x.{n}") - F.col(f"zero.{n}")).alias(n) for n in names])


def around(moments: DataFrame, happened: DataFrame, by: list[str], key: str, windows: list[int], components: dict[str, str], stretch_ms: int = STRETCH_MS) -> DataFrame:
    """One row per moment and window: (``by``, key, window_ms, the components), sums over what happened at most
    ``window_ms`` before or after the moment, both ends and the moment itself included. As in :func:`outcomes`
    each is the difference of two running sums. A moment without a time has no row."""
    names = list(components)
    edges = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("window_ms"), F.lit(side).alias("side")) for w in windows for side in (0, 1)]))
    m = moments.where("rel_ms is not null").select(*by, F.col(key).alias("key"), "rel_ms", edges.alias("edge"))
    at = F.when(F.col("edge.side") == 0, F.col("rel_ms") - F.col("edge.window_ms") - 1).otherwise(F.col("rel_ms") + F.col("edge.window_ms"))
    probes = m.select(*by, at.alias("rel_ms"), F.lit(1).alias("kind"), "key", "edge.window_ms", "edge.side", *[F.lit(0).cast("long").alias(n) for n in names])
    facts = happened.where("rel_ms is not null").select(*by, "rel_ms", F.lit(0).alias("kind"), *[F.col(c).cast("long").alias(n) for n, c in components.items()])
    summed = running(facts.unionByName(probes, allowMissingColumns=True), by, ["rel_ms", "kind"], {n: F.col(n) for n in names}, stretch_ms).where("kind = 1")
    signed = lambda n: F.sum(F.when(F.col("side") == 1, F.col(n)).otherwise(-F.col(n)))
    return summed.groupBy(*by, "key", "window_ms").agg(*[signed(n).alias(n) for n in names]).withColumnRenamed("key", key)
