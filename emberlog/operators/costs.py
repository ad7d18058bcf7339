"""What collecting cost: streams, sessions, last pages and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.numbers import days, mean_seconds, ratio

GAP_MS = 60_000


def by_stream(pages: DataFrame) -> DataFrame:
    """Pages, events, runs and pages per run (one place) of each stream."""
    g = pages.groupBy("data_type").agg(F.count("*").alias("pages"), F.sum("event_count").alias("events"), F.countDistinct("run_id").alias("runs"))
    return g.withColumn("pages_per_run", ratio(F.col("pages"), F.col("runs"), 1))


def session_gaps(pages: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Per run with more than one page: time between pages, without pauses over ``gap_ms``, and the pauses."""
    gap = F.col("fetched_at_ms") - F.lag("fetched_at_ms").over(W.partitionBy("run_id").orderBy("fetched_at_ms"))
    g = pages.withColumn("gap", gap).groupBy("run_id").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("gap").between(0, gap_ms), F.col("gap")).otherwise(0)).alias("working_ms"), F.count_if(F.col("gap") > gap_ms).alias("pauses"))
    return g.where("pages > 1")


def last_pages(pages: DataFrame) -> DataFrame:
    """The last page of each stream."""
    w = W.partitionBy("run_id", "data_type").orderBy(F.desc("page_index"))
    return pages.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def incomplete_streams(pages: DataFrame) -> DataFrame:
    """Streams whose last page still has a cursor."""
    return last_pages(pages).where("next_cursor_ms is not null").select("run_id", "data_type", "page_index", "next_cursor_ms")


def summary(pages: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """One row of totals and means. Means of time are over runs with more than one page, whose
    working time leaves out pauses; a run's first page has no time of its own."""
    total = pages.agg(F.count("*").alias("pages"), F.sum("event_count").alias("events"), F.countDistinct("run_id").alias("runs"), F.max("event_count").alias("largest_page"))
    timed = session_gaps(pages, gap_ms).agg(F.count("*").alias("paged_runs"), F.sum("working_ms").alias("working_ms"), F.sum(F.col("pages") - 1).alias("steps"), F.count_if(F.col("pauses") > 0).alias("runs_with_pauses"))
    both = total.join(F.broadcast(timed), how="cross")  # one row each
    return both.select("pages", "events", "runs", "largest_page", "paged_runs", "runs_with_pauses", mean_seconds(F.col("working_ms"), F.col("paged_runs"), 1).alias("seconds_per_run"), mean_seconds(F.col("working_ms"), F.col("steps"), 2).alias("seconds_per_page"), ratio(F.col("pages"), F.col("paged_runs"), 1).alias("pages_per_run"))


def api_points(diagnostics: DataFrame) -> DataFrame:
    """Points and runs from the JSON details of cost diagnostics; malformed ones and unknown points don't count."""
    detail = F.from_json("detail", "points double, runs long", {"mode": "PERMISSIVE"})
    d = diagnostics.where("kind = 'api-cost'").withColumn("d", detail).where("d.points is not null and d.points >= 0")
    return d.agg(F.count("*").alias("jobs"), F.sum("d.points").alias("points"), F.sum("d.runs").alias("runs")).withColumn("points_per_run", F.try_divide("points", "runs"))


def progress_faults(pages: DataFrame) -> DataFrame:
    """Pages whose cursor does not move forward, or that come again as a whole."""
    w = W.partitionBy("run_id", "data_type").orderBy("page_index")
    before = F.lag("next_cursor_ms").over(w)
    p = pages.withColumn("before", before)
    fault = F.when(F.col("next_cursor_ms") < F.col("before"), "backwards").when((F.col("next_cursor_ms") == F.col("before")) & (F.col("event_count") == 0), "stalled")
    return p.withColumn("fault", fault).where("fault is not null").select("run_id", "data_type", "page_index", "fault")


def page_gaps(events: DataFrame) -> DataFrame:
    """Largest gap and number of steps backwards per stream, in emitted order."""
    w = W.partitionBy("run_id", "data_type").orderBy("event_id")
    step = F.col("rel_ms") - F.lag("rel_ms").over(w)
    return events.withColumn("step", step).groupBy("run_id", "data_type").agg(F.max("step").alias("max_gap_ms"), F.count_if(F.col("step") < 0).alias("out_of_order"))


def date_span(runs: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")
    return runs.agg(F.min("abs_start_ms").alias("lo"), F.max("abs_start_ms").alias("hi")).select(day(F.col("lo")).alias("first_day"), day(F.col("hi")).alias("last_day"), (F.col("hi") - F.col("lo")).alias("span_ms"), days(F.col("hi") - F.col("lo")).alias("days"))


def dedupe_state(runs: DataFrame) -> DataFrame:
    """Whether duplicates were ever looked for: empty, never_run, stale or current."""
    g = runs.agg(F.count("*").alias("runs"), F.count_if(F.col("is_canonical").isNull()).alias("unclassified"))
    return g.withColumn("state", F.when(F.col("runs") == 0, "empty").when(F.col("runs") == F.col("unclassified"), "never_run").when(F.col("unclassified") > 0, "stale").otherwise("current"))
