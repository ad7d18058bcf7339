"""Cohorts: a definition says who matches now, an evaluation who stood behind a published number.
Planned by the analysed design, beyond its code.

An evaluation keeps its members, which are runs and players and never what was derived from
them, its exclusions with their reasons, and the fingerprint of the corpus that it saw. Its id
is made of its content: the same definition over the same evidence is the same evaluation,
and recording it again changes nothing; anything else has another id, so none is overwritten.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.fingerprints import combine, corpus_fingerprint, row_digest
from emberlog.operators.runs import DedupePolicy, RunSet
from emberlog.sources.tables import _exists


@dataclass(frozen=True)
class Definition:
    """``streams`` and ``policy`` have no default: a cohort says what it needs. ``filters`` are equalities
    on columns of runs."""

    cohort_id: str
    streams: tuple[str, ...]
    policy: DedupePolicy
    filters: dict[str, object] = field(default_factory=dict)
    version: int = 1

    def canonical(self) -> str:
        said = {"cohort_id": self.cohort_id, "filters": self.filters, "policy": self.policy.value, "streams": sorted(set(self.streams)), "version": self.version}
        return json.dumps(said, sort_keys=True, separators=(",", ":"))

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


@dataclass
class Evaluation:
    head: DataFrame
    members: DataFrame
    exclusions: DataFrame


def member_fingerprint(members: DataFrame) -> DataFrame:
    """One row: members, runs and the digest over all (run_id, actor_id). Digests are combined by their
    beginnings, so no list holds them all."""
    each = members.select("run_id", row_digest("run_id", "actor_id").alias("d"))
    runs = members.select("run_id").distinct().agg(F.count("*").alias("runs"))
    fine = each.groupBy(F.substring("d", 1, 4).alias("g")).agg(F.count("*").alias("n"), combine(F.col("d")).alias("d"))
    coarse = fine.groupBy(F.substring("g", 1, 2).alias("g")).agg(F.sum("n").alias("n"), combine(F.col("d")).alias("d"))
    whole = coarse.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), combine(F.col("d")).alias("fingerprint"))
    return whole.join(F.broadcast(runs), how="cross")  # one row each


def evaluate(definition: Definition, runs: DataFrame, coverage: DataFrame, roster: DataFrame, digests: DataFrame) -> Evaluation:
    """``digests``: (run_id, grade, digest) of the corpus. A run without a roster is a member with a null actor.
    ``provisional`` says that a member run is neither canonical nor a duplicate by anyone's word."""
    chosen = RunSet.select(runs, definition.policy, **definition.filters)
    if definition.streams:
        chosen = chosen.require(coverage, sorted(set(definition.streams)))
    members = chosen.included.select("run_id").join(roster.select("run_id", F.col("player_id").alias("actor_id")).distinct(), "run_id", "left")
    corpus = corpus_fingerprint(digests).select(F.col("fingerprint").alias("corpus_fingerprint"))
    open_runs = chosen.included.agg(F.coalesce(F.bool_or("provisional"), F.lit(False)).alias("provisional"))
    excluded = chosen.exclusions.agg(F.count("*").alias("excluded"))
    head = member_fingerprint(members)
    for one_row in (corpus, open_runs, excluded):
        head = head.join(F.broadcast(one_row), how="left")
    named = F.sha2(F.concat_ws(";", F.lit(definition.digest()), "fingerprint", F.coalesce("corpus_fingerprint", F.lit("none"))), 256)
    head = head.select(
        named.alias("evaluation_id"),
        F.lit(definition.cohort_id).alias("cohort_id"),
        F.lit(definition.version).alias("definition_version"),
        F.lit(definition.policy.value).alias("dedupe_policy"),
        "corpus_fingerprint",
        F.col("fingerprint").alias("member_fingerprint"),
        "runs",
        "members",
        "excluded",
        "provisional",
    )
    return Evaluation(head, members, chosen.exclusions)


def record(spark: SparkSession, root: str, evaluation: Evaluation) -> str:
    """Write an evaluation below ``root`` and give its id. Its head comes last and makes it valid; what a failed
    attempt left is written anew, what has a head is never touched."""
    head = evaluation.head.first()  # one row
    name = head["evaluation_id"]
    at = {part: f"{root}/{part}/evaluation_id={name}" for part in ("members", "exclusions", "heads")}
    if _exists(spark, f"{at['heads']}/_SUCCESS"):
        return name
    evaluation.members.write.mode("overwrite").parquet(at["members"])
    evaluation.exclusions.write.mode("overwrite").parquet(at["exclusions"])
    spark.createDataFrame([head], evaluation.head.schema).drop("evaluation_id").coalesce(1).write.mode("overwrite").parquet(at["heads"])
    return name


def recorded(spark: SparkSession, root: str) -> Evaluation:
    """All valid evaluations below ``root``, told apart by evaluation_id."""
    head, members, exclusions = (spark.read.parquet(f"{root}/{part}") for part in ("heads", "members", "exclusions"))
    valid = head.select("evaluation_id")
    return Evaluation(head, members.join(valid, "evaluation_id", "left_semi"), exclusions.join(valid, "evaluation_id", "left_semi"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, actor_id, change) of members that ``joined`` or ``left`` between two evaluations; a null actor is one like any other."""
    side = lambda df, n: df.select("run_id", "actor_id", F.lit(n).alias("n"))
    both = side(before, -1).unionByName(side(after, 1)).groupBy("run_id", "actor_id").agg(F.sum("n").alias("n"))
    return both.where("n <> 0").select("run_id", "actor_id", F.when(F.col("n") > 0, "joined").otherwise("left").alias("change"))
