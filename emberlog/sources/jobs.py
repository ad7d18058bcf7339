"""Collection jobs: what ran, with which versions, and how it ended."""

from __future__ import annotations

import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSIONS = {"software_version": "0.1.0", "normalizer_version": 1, "query_version": 1, "schema_version": 5, "identity_scheme_version": 1}
SCHEMA = (
    "job_id string, started_at double, finished_at double, status string, sample_profile string, event_profile string, config_hash string, "
    "software_version string, normalizer_version long, query_version long, schema_version long, git_commit string, git_dirty long, "
    "reports_attempted long, reports_completed long, reports_failed long, notes string, identity_scheme_version long"
)


def provenance(folder: str = ".") -> dict:
    """Versions, and the commit of the folder if it is a checkout."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    try:
        head, state = git("rev-parse", "HEAD"), git("status", "--porcelain")
    except OSError:
        return VERSIONS | {"git_commit": None, "git_dirty": None}
    known = head.returncode == 0
    return VERSIONS | {"git_commit": head.stdout.strip() if known else None, "git_dirty": int(bool(state.stdout.strip())) if known else None}


class Job:
    """A job's row; ``with`` marks it complete, or interrupted if the block fails."""

    def __init__(self, spark: SparkSession, started_at: float, event_profile: str | None = None, sample_profile: str | None = None, config_hash: str | None = None, notes: str | None = None):
        self.spark = spark
        self.row = {c.split()[0]: None for c in SCHEMA.split(", ")} | provenance() | {"job_id": uuid.uuid4().hex, "started_at": started_at, "status": "running", "event_profile": event_profile, "sample_profile": sample_profile, "config_hash": config_hash, "notes": notes, "reports_attempted": 0, "reports_completed": 0, "reports_failed": 0}

    def report(self, ok: bool) -> None:
        self.row["reports_attempted"] += 1
        self.row["reports_completed" if ok else "reports_failed"] += 1

    def finish(self, at: float, status: str = "complete") -> DataFrame:
        self.row |= {"finished_at": at, "status": status}
        return self.frame()

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(self.row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)

    def __enter__(self) -> Job:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.row["status"] == "running":
            self.row["status"] = "complete" if kind is None else "interrupted"
