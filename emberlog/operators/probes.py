"""Tallies over samples of a stream: what it holds, and whether two streams are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tally(events: DataFrame, column: str) -> DataFrame:
    """Rows by value of a column, null included, most frequent first."""
    return events.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.asc_nulls_first("value"))


def sample_summary(events: DataFrame, json: str = "raw") -> DataFrame:
    """One row: events, distinct sources, events that name a copy, distinct keys and bytes per event."""
    keys = events.select(F.explode(F.json_object_keys(json)).alias("k")).agg(F.countDistinct("k").alias("keys"))
    own = events.agg(F.count("*").alias("events"), F.countDistinct("source_id").alias("sources"), F.count("source_instance").alias("with_instance"), F.sum(F.octet_length(json)).alias("bytes"))
    return own.join(F.broadcast(keys), how="cross").withColumn("bytes_per_event", F.try_divide("bytes", "events"))  # one row each


def repeated_species(npcs: DataFrame) -> DataFrame:
    """(pull_id, npc_game_id, reason) of species with several copies: a range of ids, or listed more than once."""
    span = F.col("max_instance_id") > F.col("min_instance_id")
    g = npcs.groupBy("pull_id", "npc_game_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(span, F.lit(False))).alias("span"))
    return g.where("span or n > 1").select("pull_id", "npc_game_id", F.when(F.col("span"), "instance range").otherwise("listed twice").alias("reason"))


def same_stream(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows of each side and how many of the left the right also has, as multisets."""
    a, b = (df.groupBy(*key).agg(F.count("*").alias("n")) for df in (left, right))
    both = a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), key, "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("right_rows"), F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("shared"))


def collection_summary(outcomes: DataFrame) -> DataFrame:
    """One row over run outcomes (status, events, pages): runs, complete and failed ones, events and pages."""
    return outcomes.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status").isin("collection-failed", "malformed", "validation-failed")).alias("failed"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def focus_resolution(runs: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: runs, runs in which the focus actor was found, and whether it was found nowhere, which is an error."""
    j = runs.select("run_id").distinct().join(resolved.select("run_id", "actor_id"), "run_id", "left")
    return j.agg(F.count("*").alias("runs"), F.count("actor_id").alias("resolved")).withColumn("failed", (F.col("runs") > 0) & (F.col("resolved") == 0))
