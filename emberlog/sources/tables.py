"""Stored tables: scans with explicit schemas, counts and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import TABLES, schema


def scan(spark: SparkSession, root: str, table: str, **equal) -> DataFrame:
    """A table, with equality predicates that reach the scan; ``None`` asks for nulls."""
    df = spark.read.schema(schema(table)).parquet(f"{root}/{table}")
    for column, value in equal.items():
        df = df.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return df


def events_of(spark: SparkSession, root: str, runs: DataFrame, **equal) -> DataFrame:
    """Events of a run set in (run_id, rel_ms) order; the set is joined, never collected."""
    return scan(spark, root, "events", **equal).join(runs.select("run_id").distinct(), "run_id", "left_semi").orderBy("run_id", "rel_ms", "event_id")


def counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each frame."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in sorted(frames.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def table_counts(spark: SparkSession, root: str) -> DataFrame:
    return counts({t: scan(spark, root, t) for t in TABLES if _exists(spark, f"{root}/{t}")})


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def size_bytes(spark: SparkSession, root: str) -> int:
    fs, at = _path(spark, root)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
