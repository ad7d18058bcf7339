"""Fixtures: pulls picked as examples to encode, their timelines, and their grouping by coverage.

Examples, not a statistic: the selection is the permissive one and nothing measured
on them says anything about all runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.runs import stream_label


def select(runs: DataFrame, pulls: DataFrame, events: DataFrame, min_events: int = 20, limit: int = 30) -> DataFrame:
    """Pulls of selected ``runs`` with at least ``min_events`` events: bosses first, then those with most events.

    ``pulls`` has is_boss and duration_ms. Ties go to the smaller pull id.
    """
    counted = events.where("pull_id is not null").groupBy("pull_id").agg(F.count("*").alias("events"))
    p = pulls.join(runs.select("run_id", "dungeon_key", "keystone_level"), "run_id").join(counted, "pull_id", "left")
    p = p.withColumn("events", F.coalesce("events", F.lit(0).cast("long"))).where(F.col("events") >= min_events)
    chosen = p.select("pull_id", "run_id", "dungeon_key", "keystone_level", "is_boss", "duration_ms", "events")
    return chosen.orderBy(F.desc("is_boss"), F.desc("events"), "pull_id").limit(limit)


def timelines(fixtures: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the fixtures, with ``seq``, their place in (rel_ms, event_id) order, as (pull, seq, ...)."""
    own = events.join(fixtures.select("pull_id"), "pull_id", "left_semi")
    at = F.struct("rel_ms", "event_id")
    return own.withColumn("seq", at).select("pull_id", "seq", "rel_ms", "event_id", *[c for c in own.columns if c not in ("pull_id", "rel_ms", "event_id", "seq")])


def streams(fixtures: DataFrame, coverage: DataFrame) -> DataFrame:
    """``fixtures`` with the streams that their run has whole, sorted and comma-joined; none is empty."""
    label = stream_label(F.col("data_type"), F.col("hostility"))
    have = coverage.where("status = 'ok'").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set(label)), ",").alias("streams"))
    return fixtures.join(have, "run_id", "left").withColumn("streams", F.coalesce("streams", F.lit("")))


def by_coverage(fixtures: DataFrame) -> DataFrame:
    """Fixtures with streams grouped by them: formats are compared within a group only."""
    return fixtures.groupBy("streams").agg(F.count("*").alias("fixtures"), F.sum("events").alias("events"), F.min("pull_id").alias("example"))


def widest(fixtures: DataFrame) -> DataFrame:
    """The fixtures of the group with most streams, then most fixtures, then the first in order."""
    n = F.when(F.col("streams") == "", 0).otherwise(F.size(F.split("streams", ",")))
    best = by_coverage(fixtures).orderBy(n.desc(), F.desc("fixtures"), "streams").limit(1)
    return fixtures.join(F.broadcast(best.select("streams")), "streams", "left_semi")


def concatenated(fixtures: DataFrame, events: DataFrame) -> DataFrame:
    """One timeline of several pulls' events, one pull after another in the order of their ids."""
    own = timelines(fixtures, events)
    return own.withColumn("seq", F.struct("pull_id", "rel_ms", "event_id"))


def ordered_events(events: DataFrame) -> DataFrame:
    """Events by run and time, ties by id."""
    return events.orderBy("run_id", "rel_ms", "event_id")


def ordered_pages(pages: DataFrame) -> DataFrame:
    """Pages by stream (type, hostility, source, target; null first) and page."""
    keys = [F.asc_nulls_first(c) for c in ("data_type", "hostility", "source_id", "target_id") if c in pages.columns]
    return pages.orderBy("run_id", *keys, "page_index")


def newest_first(registry: DataFrame, key: str = "id") -> DataFrame:
    """Zones or expansions by id, the newest first, those without one last."""
    return registry.orderBy(F.desc_nulls_last(key))


def costliest(measurements: DataFrame) -> DataFrame:
    """Stream measurements by events, most first; ties by label."""
    return measurements.orderBy(F.desc("events"), "label")
