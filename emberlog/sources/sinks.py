"""Writing: keyed merges on plain files, replacement of partitions, and diagnostics.

A merge is computed as a frame and written to a new version of the table; replacing
what belongs to a run is an overwrite of its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matched(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & left[k].eqNullSafe(right[k])
    return out


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with rows of equal keys (nulls are equal) replaced by ``new``, which must have each key once."""
    return old.join(new, _matched(old, new, key), "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, _matched(new, old, key), "left_anti"))


def merge_seen(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Dimension rows keep their first and last time seen; other columns come from the later row."""
    both = old.unionByName(new)
    rest = [c for c in old.columns if c not in (key, "first_seen", "last_seen")]
    latest = F.max_by(F.struct(*rest), "last_seen") if rest else None
    g = both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *([latest.alias("r")] if rest else []))
    return g.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in old.columns])


def carry_over(new_runs: DataFrame, prior: DataFrame) -> DataFrame:
    """Collected again, a run keeps its duplicate group and canonical mark."""
    p = prior.select("run_id", F.col("duplicate_group_id").alias("g0"), F.col("is_canonical").alias("c0"))
    j = new_runs.join(p, "run_id", "left")
    kept = {"duplicate_group_id": "g0", "is_canonical": "c0"}
    return j.select(*[F.coalesce(c, kept[c]).alias(c) if c in kept else F.col(c) for c in new_runs.columns])


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite exactly the partitions that ``df`` has rows of; doing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def reset_run(events: DataFrame, run_id) -> tuple[DataFrame, int]:
    """Events without a run's, and how many went."""
    gone = events.where(F.col("run_id") == run_id).count()
    return events.where(~F.col("run_id").eqNullSafe(F.lit(run_id))), gone


def append_diagnostics(df: DataFrame, path: str) -> None:
    df.select("job_id", "run_id", "kind", "severity", "detail", "created_at").write.mode("append").parquet(path)


def check_identity(recorded: list[tuple[int, str]], scheme: int, fingerprint: str) -> bool:
    """Whether this writer is the first; another scheme or salt is refused."""
    if not recorded:
        return True
    if (scheme, fingerprint) not in recorded:
        raise ValueError("the store was written under another identity scheme")
    return False
