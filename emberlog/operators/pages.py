"""Event pages: the multiset at a page boundary, where to go on, and field tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drop_boundary_repeats(before: DataFrame, page: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows of ``page`` without those that ``before`` emitted already, as multisets.

    A row goes only while an identical emitted copy is left: of three equal rows in
    the page and two emitted, one stays. ``seq`` orders equal rows.
    """
    nth = lambda df: df.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("seq")))
    emitted = nth(before).select(key, "nth")
    return nth(page).join(emitted, [key, "nth"], "left_anti").drop("nth")


def resume_points(pages: DataFrame) -> DataFrame:
    """Per stream the page to fetch next and its cursor; a stream without open cursor is finished."""
    w = W.partitionBy("run_id", "data_type").orderBy(F.desc("page_index"))
    last = pages.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    done = F.col("next_cursor_ms").isNull()
    return last.select("run_id", "data_type", F.when(~done, F.col("page_index") + 1).alias("next_page"), F.col("next_cursor_ms").alias("cursor_ms"), done.alias("finished"))


def field_tallies(payloads: DataFrame, json: str = "props") -> DataFrame:
    """How many rows have each top-level key."""
    return payloads.select(F.explode(F.json_object_keys(json)).alias("field")).groupBy("field").agg(F.count("*").alias("rows"))


def unexpected_fields(payloads: DataFrame, known: list[str], json: str = "props") -> DataFrame:
    return field_tallies(payloads, json).where(~F.col("field").isin(known)).select("field")


def share_verdict(counts: DataFrame) -> DataFrame:
    """Whether a filter was honoured: ``unfiltered``, ``enemies``, ``friendlies`` counts and ``exhausted``.

    Parts that add up split the stream; a part that equals the whole ignored the
    filter; anything else, or a capped probe, is inconclusive.
    """
    whole, e, f = F.col("unfiltered"), F.col("enemies"), F.col("friendlies")
    verdict = F.when(~F.col("exhausted"), "inconclusive").when((e + f == whole) & (e > 0) & (f > 0), "split").when((e == whole) & (f == whole) & (whole > 0), "ignored").otherwise("inconclusive")
    return counts.withColumn("verdict", verdict)


def focus_verdict(counts: DataFrame) -> DataFrame:
    """What a narrowing by source or target meant, from counts of rows that fit (``matching``) and don't."""
    n = F.col("matching") + F.col("foreign")
    return counts.withColumn("verdict", F.when(F.col("matching").isNull() | F.col("foreign").isNull(), "UNKNOWN").when(n == 0, "EMPTY").when(F.col("foreign") == 0, "CONFIRMED").when(F.col("matching") == 0, "REFUSED").otherwise(F.format_string("MIXED %d%%", F.floor(100 * F.col("matching") / n).cast("long"))))


def cursor_semantics(pages: DataFrame) -> DataFrame:
    """Per page: next cursor against the last timestamp of the page."""
    c, last = F.col("next_cursor_ms"), F.col("last_ms")
    return pages.where(c.isNotNull()).select("run_id", "data_type", "page_index", F.when(c == last, "inclusive").when(c > last, "exclusive").otherwise("unexpected").alias("semantics"))
