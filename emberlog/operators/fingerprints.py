"""Content fingerprints of runs, drift between two states, and derivations.

Digests are built bottom-up (row, page, run, corpus) from hashes that are sorted
within their parent, so no step holds more than one parent's children. Nulls and
values are tagged apart. The version is part of every run digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
GRADES = ("page", "deep")


def field(value: Column) -> Column:
    """One field: its length and text, or a mark for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "N;").otherwise(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def row_digest(*columns: str) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in columns]), 256)


def combine(digests: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(digests)), ""), 256)


def page_component(pages: DataFrame, columns: list[str]) -> DataFrame:
    return pages.groupBy("run_id").agg(combine(row_digest(*columns)).alias("pages_digest"))


#: What the coverage manifest contributes, in this order.
COVERAGE = ["data_type", "hostility", "source_id", "target_id", "scope", "pages", "events", "status"]


def coverage_component(coverage: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(run_id, coverage_digest, streams): "asked for, none" and "never asked for" differ here and in no page."""
    columns = columns or [c for c in COVERAGE if c in coverage.columns]
    return coverage.groupBy("run_id").agg(combine(row_digest(*columns)).alias("coverage_digest"), F.count("*").alias("streams"))


def event_component(events: DataFrame, page: list[str], columns: list[str]) -> DataFrame:
    """Deep component: rows by page, pages by run."""
    by_page = events.groupBy("run_id", *[p for p in page if p != "run_id"]).agg(combine(row_digest(*columns)).alias("d"))
    return by_page.groupBy("run_id").agg(combine(F.col("d")).alias("events_digest"))


def run_digests(components: DataFrame, grade: str) -> DataFrame:
    """(run_id, grade, digest) from a frame of run_id and component digests; a lacking component is tagged."""
    if grade not in GRADES:
        raise ValueError(f"unknown grade {grade}")
    parts = [c for c in components.columns if c != "run_id"]
    stamp = F.lit(f"v{VERSION};{grade};")
    return components.select("run_id", F.lit(grade).alias("grade"), F.sha2(F.concat(stamp, *[field(F.col(c)) for c in parts]), 256).alias("digest"))


def corpus_fingerprint(digests: DataFrame) -> DataFrame:
    """One row: grade, number of runs and the digest over all run digests.

    Run digests are first combined in 4096 groups, so no list holds them all.
    """
    by_group = digests.groupBy("grade", F.substring("digest", 1, 3).alias("g")).agg(F.count("*").alias("n"), combine(F.col("digest")).alias("d"))
    return by_group.groupBy("grade").agg(F.sum("n").alias("runs"), combine(F.col("d")).alias("fingerprint"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs (run_id, change) that changed, are gone or were added. Grades must agree."""
    grades = {r["grade"] for r in before.select("grade").distinct().unionAll(after.select("grade").distinct()).distinct().limit(3).collect()}
    if len(grades) > 1:
        raise ValueError("fingerprints of different grades can't be compared")
    both = before.select("run_id", F.col("digest").alias("old")).join(after.select("run_id", F.col("digest").alias("new")), "run_id", "full_outer")
    change = F.when(F.col("new").isNull(), "gone").when(F.col("old").isNull(), "added").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("run_id", change.alias("change"))


def verify(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """A derivation's runs (derivation_id, run_id, run_digest) against current digests: drifted or missing ones."""
    now = current.select("run_id", F.col("digest").alias("now"))
    j = recorded.join(now, "run_id", "left").where(~F.col("run_digest").eqNullSafe(F.col("now")))
    return j.select("derivation_id", "run_id", F.when(F.col("now").isNull(), "missing").otherwise("drifted").alias("state"))


def begin(derivation_id: str, kind: str, digests: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """The rows that a derivation starts with: its header and its runs with their digests."""
    head = corpus_fingerprint(digests).select(F.lit(derivation_id).alias("derivation_id"), F.lit(kind).alias("kind"), F.lit("running").alias("status"), F.lit(None).cast("double").alias("finished_at"), F.col("fingerprint").alias("corpus_fingerprint"), F.col("grade").alias("fingerprint_grade"), F.lit(VERSION).alias("fingerprint_version"), F.col("runs").alias("run_count"), F.lit(policy).alias("dedupe_policy"))
    return head, digests.select(F.lit(derivation_id).alias("derivation_id"), "run_id", F.col("digest").alias("run_digest"))


def exclude(exclusions: DataFrame, derivation_id: str, left_out: DataFrame) -> DataFrame:
    """``exclusions`` (derivation_id, run_id, reason, detail) with the runs that a derivation left out,
    (run_id, reason, detail); a run that it left out before has its new reason."""
    new = left_out.select(F.lit(derivation_id).alias("derivation_id"), "run_id", "reason", "detail")
    kept = exclusions.join(new, ["derivation_id", "run_id"], "left_anti")
    return kept.select(new.columns).unionByName(new)


def finish(derivations: DataFrame, derivation_id: str, at: float, status: str = "complete") -> DataFrame:
    """``derivations`` with one of them ended; the others stay as they are."""
    own = F.col("derivation_id") == derivation_id
    return derivations.withColumns({"finished_at": F.when(own, F.lit(at)).otherwise(F.col("finished_at")), "status": F.when(own, F.lit(status)).otherwise(F.col("status"))})
