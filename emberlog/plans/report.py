"""The validation report: small frames, collected once each, as JSON and Markdown."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import diagnostics_by_kind
from emberlog.operators import casts, costs, intervals, lookups, runs, timelines

#: Rows of a section that are shown.
SHOWN = 20


@dataclass
class Section:
    title: str
    frame: DataFrame
    order: list[str] = field(default_factory=list)
    shown: int = SHOWN


def sections(tables: dict[str, DataFrame], pair_window_ms: int = 50) -> list[Section]:
    """Sections over corpus tables: runs, events (assigned), pulls, pages, and, where given, diagnostics, actors and abilities."""
    r, e, p, g = (tables[k] for k in ("runs", "events", "pulls", "pages"))
    c = e.where("type = 'cast' and hostility = 'Enemies' and ability is not null and source_id is not null")
    overlaps = intervals.overlap_pairs(p)
    several = casts.several_copies(casts.copy_timelines(c))
    pairs = casts.pair_rates(casts.paired(c, pair_window_ms), c, limit=None)
    out = [
        Section("Runs by status", r.groupBy("collection_status").agg(F.count("*").alias("runs")), ["collection_status"]),
        Section("Runs by bracket", runs.durations(r, "key_bracket"), ["key_bracket"]),
        Section("Runs by epoch", r.groupBy("hotfix_epoch").agg(F.count("*").alias("runs")), ["hotfix_epoch"]),
        Section("Dates", costs.date_span(r)),
        Section("Duplicates", costs.dedupe_state(r)),
        Section("Events by stream", e.groupBy("data_type", "hostility").agg(F.count("*").alias("events")), ["-events", "data_type", "hostility"]),
        Section("Events by pull", intervals.assignment_stats(e, p).agg(*[F.sum(x).alias(x) for x in ("events", "assigned", "unassigned", "before_first", "between_pulls", "after_last")])),
        Section("Overlapping pulls", overlaps.groupBy("kind").agg(F.count("*").alias("pairs"), F.sum("overlap_ms").alias("overlap_ms")), ["kind"]),
        Section("Cost by stream", costs.by_stream(g), ["-pages", "data_type"]),
        Section("Incomplete streams", costs.incomplete_streams(g), ["run_id", "data_type"]),
        Section("Working time", costs.session_gaps(g), ["-working_ms", "run_id"]),
        Section("Paired abilities", pairs, ["-matched_a", "ability_a", "ability_b"], 10),
        Section("Copies of one actor", casts.best_examples(several), ["-most_casts", "source_id"], 5),
    ]
    if "coverage" in tables:
        out.append(Section("Stream shapes", runs.coverage_shapes(tables["coverage"]), ["-runs", "streams"]))
    if "diagnostics" in tables:
        out.append(Section("Diagnostics", diagnostics_by_kind(tables["diagnostics"]), ["-n", "kind", "severity"]))
    for key, column in (("actors", "source_id"), ("abilities", "ability_game_id")):
        if key in tables:
            out.append(Section(f"Unknown {key}", casts.unknown_members(e, tables[key], column), ["-events", column]))
    state = r.agg(F.count("*").alias("runs"), F.count_if(F.col("is_canonical").isNull()).alias("unclassified"))
    more = [
        e.agg(F.count_if(F.col("pull_id").isNull()).alias("unassigned"), F.count_if((F.col("hostility") == "Enemies") & F.col("source_instance").isNull()).alias("no_instance")),
        overlaps.agg(F.count("*").alias("overlaps")),
        pairs.agg(F.count_if("inseparable").alias("inseparable")),
        runs.coverage_shapes(tables["coverage"]).agg(F.count("*").alias("shapes")) if "coverage" in tables else e.sparkSession.range(1).select(F.lit(1).alias("shapes")),
    ]
    for m in more:
        state = state.join(F.broadcast(m), how="cross")  # one row each
    return [*out, Section("Known limitations", lookups.limitations(state), ["slot"])]


def benchmark_sections(measurements: DataFrame) -> list[Section]:
    """Codecs measured on timelines (:func:`timelines.measured`): cost by scale, ratios to codec A, and what can't be read back."""
    m = timelines.against_a(measurements)
    return [
        Section("Cost by scale (estimated tokens)", m.groupBy("codec", "scale").agg(F.count("*").alias("timelines"), F.sum("tokens").alias("tokens"), F.sum("total_bytes").alias("bytes"), F.bool_and("reversible").alias("reversible")), ["codec", "scale"]),
        Section("Ratio to codec A", m.where("scale = 0").groupBy("codec").agg(F.min("ratio_to_a").alias("least"), F.max("ratio_to_a").alias("most")), ["codec"]),
        Section("Not reversible", m.where("not reversible").select("codec", "timeline", "scale"), ["codec", "timeline", "scale"]),
    ]


def stream_sections(measurements: DataFrame) -> list[Section]:
    """What streams cost to probe: a stream that wasn't read to its end is a lower bound."""
    told = F.when(F.col("exhausted"), "yes").otherwise("no, a lower bound")
    return [Section("Streams", measurements.withColumn("whole", told).drop("exhausted"), ["-events", "label"])]


def focus_sections(verdicts: DataFrame) -> list[Section]:
    return [Section("Narrowed streams", verdicts, ["run_id"]), Section("Verdicts", verdicts.groupBy("verdict").agg(F.count("*").alias("streams")), ["-streams", "verdict"])]


def recon_sections(zones: DataFrame, matches: DataFrame) -> list[Section]:
    return [Section("Zones, newest first", zones, ["-id"]), Section("Registry matches", matches, ["state", "key"])]


def collect(found: list[Section]) -> dict[str, list[dict]]:
    out = {}
    for s in found:
        order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in s.order]
        df = s.frame.orderBy(*order) if order else s.frame
        out[s.title] = [r.asDict() for r in df.limit(s.shown).collect()]
    return out


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def to_markdown(report: dict) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["# Validation report"]
    for title, found in report.items():
        lines += ["", f"## {title}", ""]
        if not found:
            lines.append("None.")
            continue
        names = list(found[0])
        lines += ["| " + " | ".join(names) + " |", "|" + " - |" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in found)]
    return "\n".join(lines) + "\n"
