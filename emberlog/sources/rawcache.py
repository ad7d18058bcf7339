"""The cache of raw responses: one gzip JSON envelope per request.

``kind/report/<key>.json.gz``. An unreadable or malformed file is a miss, never an error.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.paged import open_store

FORMAT = 1
ENVELOPE = "cache_format_version int, kind string, report_code string, params string, query_version int, fetched_at double, provenance string, response string"


class SecretInPayload(ValueError):
    """A payload that holds a registered secret is not written."""


def cache_key(kind: str, query_version: int, params: dict) -> str:
    text = json.dumps({"kind": kind, "params": params, "query_version": query_version}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def segment(value: str | None, most: int = 64) -> str:
    return re.sub(r"[^\w-]", "_", value or "none")[:most]


def path_for(root: str, kind: str, report_code: str | None, key: str) -> str:
    return f"{root}/{segment(kind)}/{segment(report_code)}/{key}.json.gz"


def put(root: str, kind: str, params: dict, response, report_code: str | None = None, query_version: int = 1, fetched_at: float = 0.0, secrets: tuple = ()) -> str:
    """Write an envelope beside its place and move it there."""
    body = json.dumps({"cache_format_version": FORMAT, "kind": kind, "report_code": report_code, "params": params, "query_version": query_version, "fetched_at": fetched_at, "provenance": {}, "response": response}, sort_keys=True)
    if any(s and s in body for s in secrets):
        raise SecretInPayload(kind)
    path = path_for(root, kind, report_code, cache_key(kind, query_version, params))
    store, at = open_store(path)
    store.create_dir(at.rpartition("/")[0])
    with store.open_output_stream(f"{at}.part", compression=None) as f:
        f.write(gzip.compress(body.encode()))
    store.move(f"{at}.part", at)
    return path


def read(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Envelopes with their path; nested parts stay JSON text."""
    reader = spark.read.option("wholetext", True).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz")
    raw = reader.text(f"{root}/{segment(kind)}" if kind else root).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.select("path", F.from_json("value", ENVELOPE).alias("e")).select("path", "e.*")
    return parsed.where(F.col("cache_format_version") == FORMAT)


def stats(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes by kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").load(root)
    kind = F.regexp_extract("path", "([^/]+)/[^/]+/[^/]+$", 1)
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def audit(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """Files whose text matches any of the patterns, and how many do."""
    raw = spark.read.option("wholetext", True).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").text(root)
    hits = sum((F.col("value").rlike(p).cast("int") for p in patterns), F.lit(0))
    return raw.select(F.col("_metadata.file_path").alias("path"), hits.alias("hits")).where("hits > 0")
