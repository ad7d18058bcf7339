"""Lists of reports to collect, from text or from a paged listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.text import report_code


#: Positions of a list that are numbered together.
STRETCH = 100_000


def parse_list(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(codes, rejects) of a list: one code or URL per line, first comma field, ``#`` comments.

    Codes (report_code, rank) come in order of their first mention; rejects (line, text up to 120 characters).
    """
    lines = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", "\r?\n")).alias("line", "raw"))
    field = F.trim(F.split_part("raw", F.lit(","), F.lit(1)))
    body = lines.withColumn("field", field).where("field <> '' and not startswith(field, '#')").withColumn("code", report_code(F.col("field")))
    return rank_codes(body.where("code is not null").select(F.col("code").alias("report_code"), F.col("line").alias("position"))), body.where("code is null").select("line", F.substring("field", 1, 120).alias("text"))


def rank_codes(found: DataFrame, limit: int | None = None) -> DataFrame:
    """(report_code, rank): by first position, each code once.

    Codes are numbered within stretches of positions, behind the codes of earlier
    stretches, so the only window over everything has a row for each stretch.
    """
    first = found.groupBy("report_code").agg(F.min("position").alias("position")).withColumn("stretch", F.floor(F.col("position") / STRETCH))
    before = F.sum("n").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    starts = first.groupBy("stretch").agg(F.count("*").alias("n")).select("stretch", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(W.partitionBy("stretch").orderBy("position"))
    ranked = first.withColumn("own", own).join(starts, "stretch").select("report_code", (F.col("start") + F.col("own") - 1).alias("rank"))
    return ranked if limit is None else ranked.where(F.col("rank") < limit)


def from_listing(pages: DataFrame, source_type: str, seed: str, limit: int | None = None) -> DataFrame:
    """Provenance rows of a paged listing: ``pages`` (page, has_more_pages, codes).

    Pages count up to the first empty one or the first without a next one.
    """
    stop = pages.where("not has_more_pages or size(codes) = 0").agg(F.min("page").alias("stop"))
    p = pages.join(F.broadcast(stop), how="cross").where("stop is null or page <= stop")
    c = p.select("page", F.posexplode("codes").alias("pos", "report_code")).select("report_code", "page", (F.col("page") * 1_000_000 + F.col("pos")).alias("position"))
    page = c.groupBy("report_code").agg(F.min_by("page", "position").alias("page"))
    return rank_codes(c, limit).join(page, "report_code").select("report_code", F.lit(source_type).alias("source_type"), F.lit(seed).alias("seed"), "rank", "page")
