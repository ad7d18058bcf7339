"""Selection of runs, with what was left out and why, and how deep the evidence is."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.numbers import mean_seconds, ratio


class DedupePolicy(Enum):
    """What happens to runs that nobody classified as canonical or duplicate."""

    STRICT = "strict"
    PERMISSIVE = "permissive"


def exclusion_reason(policy: DedupePolicy) -> Column:
    if not isinstance(policy, DedupePolicy):
        raise TypeError("a dedupe policy has to be named")
    duplicate = F.when(F.col("is_canonical") == 0, "duplicate")
    return duplicate.when(F.col("is_canonical").isNull(), "unclassified") if policy is DedupePolicy.STRICT else duplicate


class RunSet:
    """Runs under a policy: included (with ``provisional``), and exclusions (run_id, reason, detail)."""

    def __init__(self, included: DataFrame, exclusions: DataFrame):
        self.included, self.exclusions = included, exclusions

    @staticmethod
    def select(runs: DataFrame, policy: DedupePolicy, run_ids: list | DataFrame | None = None, **equal) -> RunSet:
        """``equal``: dungeon_key, key_bracket, hotfix_epoch and other columns; None is no condition."""
        reason = exclusion_reason(policy)
        for column, value in equal.items():
            if value is not None:
                runs = runs.where(F.col(column) == value)
        if isinstance(run_ids, DataFrame):
            runs = runs.join(run_ids, "run_id", "left_semi")
        elif run_ids is not None:
            runs = runs.where(F.col("run_id").isin(run_ids) if run_ids else F.lit(False))
        judged = runs.withColumn("reason", reason)
        kept = judged.where("reason is null").drop("reason").withColumn("provisional", F.col("is_canonical").isNull())
        return RunSet(kept, judged.where("reason is not null").select("run_id", "reason", F.lit(None).cast("string").alias("detail")))

    def require(self, coverage: DataFrame, streams: list[str]) -> RunSet:
        """Keep runs that have every stream with status ok; a stream is ``Type`` (any hostility) or ``Type@Host``.

        Only streams that were collected for the whole party count; the detail of an
        exclusion names what is missing.
        """
        missing = missing_streams(self.included, coverage, streams)
        gone = missing.select("run_id", F.lit("missing-coverage").alias("reason"), F.col("missing").alias("detail"))
        return RunSet(self.included.join(missing, "run_id", "left_anti"), self.exclusions.unionByName(gone))

    def exclusion_counts(self) -> DataFrame:
        return self.exclusions.groupBy("reason").agg(F.count("*").alias("runs"))


def stream_spec(spec: Column) -> tuple[Column, Column]:
    """``Type@Host`` as its parts, trimmed; no host is null."""
    return F.trim(F.split_part(spec, F.lit("@"), F.lit(1))), F.nullif(F.trim(F.split_part(spec, F.lit("@"), F.lit(2))), F.lit(""))


def missing_streams(runs: DataFrame, coverage: DataFrame, streams: list[str]) -> DataFrame:
    """(run_id, missing) of runs that lack a required stream; missing ones sorted and comma-joined."""
    have = coverage.where("status = 'ok'").select("run_id", "data_type", "hostility")
    either = have.select("run_id", F.col("data_type").alias("spec")).unionAll(have.where("hostility is not null").select("run_id", F.concat_ws("@", "data_type", "hostility").alias("spec"))).where(F.col("spec").isin(streams))
    wanted = runs.select("run_id", F.explode(F.array(*map(F.lit, streams))).alias("spec"))
    lacking = wanted.join(either, ["run_id", "spec"], "left_anti")
    return lacking.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("spec")), ",").alias("missing"))


def coverage_report(runs: DataFrame, coverage: DataFrame, streams: list[str]) -> DataFrame:
    """Per required stream: how many runs, and how many have it."""
    lacking = missing_streams(runs, coverage, streams).select("run_id", F.explode(F.split("missing", ",")).alias("stream")).groupBy("stream").agg(F.count("*").alias("lacking"))
    total = runs.agg(F.count("*").alias("runs"))
    specs = runs.sparkSession.createDataFrame([(s,) for s in streams], "stream string")
    # one row beside a short list
    return specs.join(F.broadcast(total), how="cross").join(F.broadcast(lacking), "stream", "left").select("stream", "runs", (F.col("runs") - F.coalesce("lacking", F.lit(0))).alias("with_stream"))


def coverage_rows(pages: DataFrame) -> DataFrame:
    """The coverage manifest recomputed from pages: none, a failed page or an open last cursor is not ok."""
    stream = ["run_id", "data_type", "hostility"] if "hostility" in pages.columns else ["run_id", "data_type"]
    bad = F.count_if(F.col("status") != "ok") if "status" in pages.columns else F.lit(0).cast("long")
    g = pages.groupBy(*stream).agg(F.count("*").alias("pages"), F.sum("event_count").alias("events"), bad.alias("bad_pages"), F.max(F.struct("page_index", "next_cursor_ms"))["next_cursor_ms"].alias("open_cursor"))
    status = F.when(F.col("bad_pages") == F.col("pages"), "failed").when((F.col("bad_pages") > 0) | F.col("open_cursor").isNotNull(), "partial").otherwise("ok")
    return g.select(*stream, "pages", "events", status.alias("status"))


def coverage_shapes(coverage: DataFrame) -> DataFrame:
    """Runs by the set of streams that they have, what each set lacks against the widest, and an example."""
    shape = coverage.groupBy("run_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    g = shape.groupBy("labels").agg(F.count("*").alias("runs"), F.min("run_id").alias("example"))
    widest = g.agg(F.max(F.struct(F.size("labels"), "labels"))["labels"].alias("widest"))
    return g.join(F.broadcast(widest), how="cross").select(F.array_join("labels", ",").alias("streams"), "runs", "example", F.array_join(F.array_except("widest", "labels"), ",").alias("missing"))


def evidence(runs: DataFrame, roster: DataFrame, events: DataFrame, pulls: DataFrame) -> DataFrame:
    """One row of counts: runs, reports, players, parties (distinct rosters), pulls, events."""
    own = lambda df: df.join(runs.select("run_id"), "run_id", "left_semi")
    parts = [
        runs.agg(F.count("*").alias("runs"), F.countDistinct("report_code").alias("reports")),
        own(roster).agg(F.countDistinct("player_id").alias("players")),
        parties(own(roster)).agg(F.count("*").alias("parties")),
        own(pulls).agg(F.count("*").alias("pulls")),
        own(events).agg(F.count("*").alias("events")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), how="cross")  # one row each
    return out


def parties(roster: DataFrame) -> DataFrame:
    """Distinct rosters with the number of runs that they played."""
    party = roster.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("player_id")), lambda x: x.cast("string")), ",").alias("party"))
    return party.groupBy("party").agg(F.count("*").alias("runs"))


def independent_units(unit: str, events: DataFrame, roster: DataFrame) -> DataFrame:
    """How many independent units there are: player, party, run, pull, npc_instance, or else events."""
    if unit == "player":
        return roster.agg(F.countDistinct("player_id").alias("n"))
    if unit == "party":
        return parties(roster).agg(F.count("*").alias("n"))
    if unit == "run":
        return events.agg(F.countDistinct("run_id").alias("n"))
    if unit == "pull":
        return events.agg(F.countDistinct("pull_id").alias("n"))
    if unit == "npc_instance":
        copies = events.where("hostility = 'Enemies' and source_instance is not null").select("run_id", "source_id", "source_instance").distinct()
        return copies.agg(F.count("*").alias("n"))
    return events.agg(F.count("*").alias("n"))


def matching(df: DataFrame, equal: dict) -> DataFrame:
    """Rows that equal a map of columns to values; None is null."""
    for column, value in equal.items():
        df = df.where(F.col(f"`{column}`").eqNullSafe(F.lit(value)))
    return df


def concentration(events: DataFrame, roster: DataFrame, equal: dict | None = None) -> DataFrame:
    """Largest number of events of one run, and of runs of one player, with their shares of the totals
    (four places). ``equal`` narrows the events."""
    events = matching(events, equal or {})
    by_run = events.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("top_run_events"), F.sum("n").alias("events"))
    by_player = roster.groupBy("player_id").agg(F.countDistinct("run_id").alias("n")).agg(F.max("n").alias("top_player_runs"))
    runs = roster.agg(F.countDistinct("run_id").alias("runs"))
    one = by_run.join(F.broadcast(by_player), how="cross").join(F.broadcast(runs), how="cross")  # one row each
    return one.withColumns({"top_run_share": ratio(F.col("top_run_events"), F.col("events"), 4), "top_player_share": ratio(F.col("top_player_runs"), F.col("runs"), 4)})


def durations(runs: DataFrame, *by: str) -> DataFrame:
    """Runs by columns: how many, their mean duration in whole seconds, least and highest level."""
    g = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("n"), F.min("keystone_level").alias("min_level"), F.max("keystone_level").alias("max_level"))
    return g.select(*by, "runs", mean_seconds(F.col("ms"), F.col("n")).alias("mean_s"), "min_level", "max_level")


def assigned_share(events: DataFrame) -> DataFrame:
    """One row: events, those in a pull, those in none, and the assigned percentage (two places)."""
    n = events.agg(F.count("*").alias("events"), F.count("pull_id").alias("assigned"))
    return n.select("events", "assigned", (F.col("events") - F.col("assigned")).alias("unassigned"), ratio(100 * F.col("assigned"), F.col("events"), 2).alias("assigned_pct"))


def stream_label(data_type: Column, hostility: Column, source: Column | None = None, target: Column | None = None, focus: Column | None = None) -> Column:
    """``Type[@Host]``, with ``[source=..]`` and ``[target=..]`` where the stream is narrowed, or `` (focus)`` after a party's stream of one actor."""
    label = F.concat(data_type, F.coalesce(F.concat(F.lit("@"), F.nullif(hostility, F.lit(""))), F.lit("")))
    for name, actor in (("source", source), ("target", target)):
        if actor is not None:
            label = F.concat(label, F.coalesce(F.concat(F.lit(f"[{name}="), actor.cast("string"), F.lit("]")), F.lit("")))
    return label if focus is None else F.concat(label, F.when(focus, " (focus)").otherwise(""))


def packs(npcs: DataFrame, pulls: DataFrame, exact: bool, limit: int | None = 25) -> DataFrame:
    """Packs by signature: occurrences, runs and mean seconds (one place), and where ``pulls`` has them
    whether any is a boss's and the first name; most frequent first."""
    from emberlog.functions.signatures import composition_signature, species_signature

    signed = composition_signature(npcs) if exact else species_signature(npcs)
    joined = pulls.join(signed, "pull_id").where("signature is not null and signature <> ''")
    out = joined.groupBy("dungeon_key", "signature").agg(F.count("*").alias("occurrences"), F.countDistinct("run_id").alias("runs"), F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("n"), *[F.max("is_boss").alias("boss")] * ("is_boss" in pulls.columns), *[F.min("name").alias("a_name")] * ("name" in pulls.columns))
    out = out.withColumn("mean_s", mean_seconds(F.col("ms"), F.col("n"), 1)).drop("ms", "n")
    return out if limit is None else out.orderBy(F.desc("occurrences"), F.asc_nulls_first("dungeon_key"), "signature").limit(limit)


def npc_pulls(npcs: DataFrame, pulls: DataFrame, npc_game_id: int, limit: int | None = 25) -> DataFrame:
    found = npcs.where(F.col("npc_game_id") == npc_game_id).join(pulls, "pull_id").select("dungeon_key", "pull_id", "instance_count")
    return found if limit is None else found.orderBy(F.asc_nulls_first("dungeon_key"), "pull_id", F.asc_nulls_first("instance_count")).limit(limit)
