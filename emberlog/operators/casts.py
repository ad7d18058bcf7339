"""Abilities that go together, and casts by copy of an actor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.numbers import ratio


def paired(casts: DataFrame, window_ms: int) -> DataFrame:
    """Per pair of abilities (a < b) that one copy casts within ``window_ms``: matched casts of each.

    ``casts``: event_id, run_id, source_id, source_instance (null is a copy of its own),
    ability, rel_ms. Time is cut into bins of the window's width, and a cast of ``b``
    also looks into the neighbour bins, so casts meet only where they can match.
    """
    key = ["run_id", "source_id", "no_copy", "copy"]
    c = casts.withColumn("no_copy", F.col("source_instance").isNull()).withColumn("copy", F.coalesce("source_instance", F.lit(0))).withColumn("bin", F.floor(F.col("rel_ms") / window_ms))
    a = c.select(*key, "bin", F.col("ability").alias("ability_a"), F.col("event_id").alias("a_id"), F.col("rel_ms").alias("a_ms"))
    b = c.select(*key, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("ability").alias("ability_b"), F.col("event_id").alias("b_id"), F.col("rel_ms").alias("b_ms"))
    met = a.join(b, [*key, "bin"]).where((F.col("ability_a") < F.col("ability_b")) & (F.abs(F.col("a_ms") - F.col("b_ms")) <= window_ms))
    # each side is counted apart: two distinct counts in one aggregate would expand every match
    left = met.select("ability_a", "ability_b", "a_id").distinct().groupBy("ability_a", "ability_b").agg(F.count("*").alias("matched_a"))
    right = met.select("ability_a", "ability_b", "b_id").distinct().groupBy("ability_a", "ability_b").agg(F.count("*").alias("matched_b"))
    return left.join(right, ["ability_a", "ability_b"])


def enemy_casts(events: DataFrame) -> DataFrame:
    """Casts of enemies that name an ability and a source."""
    return events.where("type = 'cast' and hostility = 'Enemies' and ability_game_id is not null and source_id is not null")


def pair_rates(pairs: DataFrame, casts: DataFrame, min_pairs: int = 1, inseparable_at: float = 0.95, limit: int | None = 10) -> DataFrame:
    """Matched over all casts of each side (three places); inseparable if both rates reach the bound;
    cast_ratio, the more frequent side over the other (two places). The ``limit`` pairs with most matches of a come first."""
    total = casts.groupBy("ability").agg(F.count("*").alias("n"))
    p = pairs.where(F.col("matched_a") >= min_pairs)
    p = p.join(total.withColumnsRenamed({"ability": "ability_a", "n": "casts_a"}), "ability_a").join(total.withColumnsRenamed({"ability": "ability_b", "n": "casts_b"}), "ability_b")
    p = p.withColumns({"rate_a": ratio(F.col("matched_a"), F.col("casts_a"), 3), "rate_b": ratio(F.col("matched_b"), F.col("casts_b"), 3)})
    both = (F.col("rate_a") >= inseparable_at) & (F.col("rate_b") >= inseparable_at)
    often = ratio(F.greatest("casts_a", "casts_b"), F.least("casts_a", "casts_b"), 2)
    p = p.select("ability_a", "ability_b", "matched_a", "matched_b", "casts_a", "casts_b", "rate_a", "rate_b", both.alias("inseparable"), often.alias("cast_ratio"))
    return p if limit is None else p.orderBy(F.desc("matched_a"), "ability_a", "ability_b").limit(limit)


def copy_timelines(casts: DataFrame) -> DataFrame:
    """Per (pull, source, instance, ability) of casts inside a pull by a numbered copy: count, first and last."""
    inside = casts.where("pull_id is not null and pull_rel_ms is not null and source_instance is not null")
    return inside.groupBy("pull_id", "source_id", "source_instance", "ability").agg(F.count("*").alias("casts"), F.min("pull_rel_ms").alias("first_ms"), F.max("pull_rel_ms").alias("last_ms"))


def several_copies(timelines: DataFrame) -> DataFrame:
    """(pull, source, ability) with more than one copy, with each copy's timeline."""
    copy = F.struct("source_instance", "casts", "first_ms", "last_ms")
    g = timelines.groupBy("pull_id", "source_id", "ability").agg(F.array_sort(F.collect_list(copy)).alias("copies"), F.max("casts").alias("most_casts"))
    return g.where(F.size("copies") > 1).withColumn("n_copies", F.size("copies").cast("long"))


def median_gap(timelines: DataFrame) -> DataFrame:
    """Median over copies of the mean recast gap, by ability; halves go to the even neighbour.

    Copies are first counted by (ability, gap), and the middle is found among the running
    counts, so no buffer holds an ability's copies.
    """
    gap = ((F.col("last_ms") - F.col("first_ms")) / (F.col("casts") - 1)).alias("gap")
    counted = timelines.where("casts > 1").groupBy("ability", gap).agg(F.count("*").alias("n"))
    w = W.partitionBy("ability").orderBy("gap")
    upto = counted.withColumns({"upto": F.sum("n").over(w), "copies": F.sum("n").over(W.partitionBy("ability"))})
    # the lower and the upper middle lie where the running count first reaches them
    at = lambda rank: F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("gap"))
    low, high = F.floor((F.col("copies") + 1) / 2), F.floor(F.col("copies") / 2) + 1
    g = upto.groupBy("ability").agg(F.max("copies").alias("copies"), F.max(at(low)).alias("a"), F.max(at(high)).alias("b"))
    return g.select("ability", "copies", F.bround((F.col("a") + F.col("b")) / 2, 0).cast("long").alias("median_gap_ms"))


def best_examples(several: DataFrame, limit: int = 5) -> DataFrame:
    """One example per source, that with most casts, then most copies; the first ``limit`` sources so ranked."""
    order = [F.desc("most_casts"), F.desc("n_copies"), F.asc("pull_id"), F.asc("ability")]
    best = several.withColumn("rn", F.row_number().over(W.partitionBy("source_id").orderBy(*order))).where("rn = 1")
    return best.orderBy(*order[:2], "source_id").limit(limit).select("source_id", "pull_id", "ability", "most_casts", "n_copies")


def unknown_members(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of ``facts`` with a known, non-negative ``key`` that ``dimension`` lacks, counted by it."""
    return facts.where(F.col(key) >= 0).join(dimension, key, "left_anti").groupBy(key).agg(F.count("*").alias("events"))
