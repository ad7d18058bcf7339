"""Commands over a folder of stored tables: ``python -m emberlog.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from emberlog.operators import duplicates, fingerprints, intervals, runs
from emberlog.plans import report
from emberlog.session import session
from emberlog.sources import config, rawcache, reports, tables


def corpus(spark, root: str) -> dict:
    t = {name: tables.scan(spark, root, table) for name, table in (("runs", "dungeon_runs"), ("pulls", "pulls"), ("coverage", "run_stream_coverage"), ("diagnostics", "ingest_diagnostics"))}
    t["events"] = tables.scan(spark, root, "events").withColumn("ability", F.col("ability_game_id"))
    t["pages"] = tables.scan(spark, root, "event_pages").withColumn("fetched_at_ms", (F.col("fetched_at") * 1000).cast("long"))
    focus = F.col("source_id").isNotNull() | F.col("target_id").isNotNull()
    t["coverage"] = t["coverage"].withColumn("label", runs.stream_label(F.col("data_type"), F.col("hostility"), focus=focus))
    return t


def validate(spark, a) -> None:
    t = corpus(spark, a.root)
    if a.dungeon:
        kept = t["runs"].where(F.col("dungeon_key") == a.dungeon)
        t = {k: kept if k == "runs" else v.join(kept.select("run_id"), "run_id", "left_semi") for k, v in t.items()}
    found = report.collect(report.sections(t))
    print(report.to_json(found) if a.json else report.to_markdown(found))


def stats(spark, a) -> None:
    r = tables.scan(spark, a.root, "dungeon_runs", collection_status="complete")
    runs.durations(r, "dungeon_key", "key_bracket").orderBy("dungeon_key", "key_bracket").show(1000, False)


def dedupe(spark, a) -> None:
    r = tables.scan(spark, a.root, "dungeon_runs")
    roster = tables.scan(spark, a.root, "run_players")
    pairs = duplicates.scored(duplicates.candidates(duplicates.fingerprints(r, roster)))
    duplicates.groups(r, pairs).where("duplicate_group_id is not null").orderBy("duplicate_group_id", "run_id").show(1000, False)


def packs(spark, a) -> None:
    s = runs.RunSet.select(tables.scan(spark, a.root, "dungeon_runs"), runs.DedupePolicy(a.policy), dungeon_key=a.dungeon)
    pulls = tables.scan(spark, a.root, "pulls").join(s.included.select("run_id"), "run_id", "left_semi")
    runs.packs(tables.scan(spark, a.root, "pull_npcs"), pulls, a.exact).show(1000, False)
    s.exclusion_counts().show()


def overlaps(spark, a) -> None:
    intervals.overlap_pairs(tables.scan(spark, a.root, "pulls")).groupBy("kind").count().show()


def fingerprint(spark, a) -> None:
    p = tables.scan(spark, a.root, "event_pages")
    d = fingerprints.run_digests(fingerprints.page_component(p, ["data_type", "hostility", "source_id", "target_id", "page_index", "event_count", "next_cursor_ms", "status"]), "page")
    fingerprints.corpus_fingerprint(d).show(1, False)


def cache_stats(spark, a) -> None:
    rawcache.stats(spark, a.root).orderBy("kind").show(1000, False)


def cache_audit(spark, a) -> None:
    rawcache.audit(spark, a.root, a.pattern).show(1000, False)


def report_list_check(spark, a) -> None:
    with open(a.root, encoding="utf-8") as f:
        for df in reports.parse_list(spark, f.read()):
            df.show(1000, False)


def config_check(spark, a) -> None:
    c = config.load(a.root)
    print(config.brackets(c), config.epochs(c), config.config_hash([a.root]))
    config.profiles(spark, c).show(1000, False)


def table_counts(spark, a) -> None:
    tables.table_counts(spark, a.root).show(100, False)


COMMANDS = {f.__name__.replace("_", "-"): f for f in (validate, stats, dedupe, packs, overlaps, fingerprint, cache_stats, cache_audit, report_list_check, config_check, table_counts)}


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="emberlog", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("root", help="folder of tables, cache folder or file")
    p.add_argument("--dungeon")
    p.add_argument("--policy", choices=[x.value for x in runs.DedupePolicy], help="needed by packs")
    p.add_argument("--exact", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--pattern", action="append", default=[])
    a = p.parse_args(args)
    if a.command == "packs" and not a.policy:
        p.error("packs needs a --policy")
    COMMANDS[a.command](session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
