"""Fixtures, legends, measured codecs, duplicate scores, exclusions and the driver's rules, by hand."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from emberlog.functions import driver
from emberlog.functions.numbers import ratio
from emberlog.operators import casts, duplicates, fingerprints, fixtures, normalize, runs, timelines
from emberlog.plans import report


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ratio_rounds_halves_up(spark):
    df = spark.createDataFrame([(1, 8), (5, 1000), (2, 3), (0, 5), (7, 0), (None, 3)], "a long, b long")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"), 2)).collect()] == [0.13, 0.01, 0.67, 0.0, None, None]


def prints(spark, rows_):
    df = spark.createDataFrame(rows_, "run_id string, report_code string, dungeon_key string, keystone_level long, abs_start_ms long, duration_ms long, affixes array<long>, who array<string>")
    who = df.select("run_id", F.explode("who").alias("player_id"))
    return duplicates.fingerprints(df.drop("who"), who)


@pytest.mark.parametrize(
    "a, b, confidence",
    [
        ([[9, 10], ["p", "q"]], [[9, 10], ["p", "q"]], 0.95),
        ([[9, 10], []], [[9, 10], ["q"]], 0.65),
        ([[9], []], [[10], ["q"]], 0.55),
        ([[], []], [[], []], 0.55),
        ([None, []], [None, []], 0.55),
        ([[9], ["p", "q"]], [[9], ["p", "r"]], None),
    ],
)
def test_affixes_count(spark, a, b, confidence):
    made = prints(spark, [("r1:1", "r1", "d", 10, 0, 1000, *a), ("r2:1", "r2", "d", 10, duplicates.TOLERANCE_MS // 2, 1000, *b)])
    got = duplicates.scored(duplicates.candidates(made)).collect()
    assert [r.confidence for r in got] == ([] if confidence is None else [pytest.approx(confidence)])


def test_affixes_lift_a_pair_over_the_bound(spark):
    gap = int(duplicates.TOLERANCE_MS * 0.9)
    pair = lambda x, y: duplicates.scored(duplicates.candidates(prints(spark, [("a:1", "a", "d", None, 0, 0, x, []), ("b:1", "b", "d", None, gap, 0, y, [])]))).collect()
    assert pair([1], [2]) == [] and [r.confidence for r in pair([1], [1])] == [pytest.approx(0.53)]
    assert pair([1], [1])[0].reason == f"dungeon d at level unknown; start gap {gap} ms; durations alike: 0 ms; roster unknown; equal affixes"


def test_a_level_of_minus_one_is_not_unknown(spark):
    made = prints(spark, [("a:1", "a", "d", -1, 0, 5, None, []), ("b:1", "b", "d", None, 0, 5, None, [])])
    assert duplicates.candidates(made).count() == 0
    c = spark.createDataFrame([(1, 1, 5, -1, "x", 0), (2, 1, 5, None, "y", 0)], "event_id long, run_id long, source_id long, source_instance long, ability string, rel_ms long")
    assert casts.paired(c, 100).count() == 0


EVENT = [(1, 1, 0, "cast", 7, 1, 9, None, 100, 5), (1, 2, 10, "damage", 7, 2, None, None, None, None), (1, 3, 30, None, 50, None, 7, 1, 200, 0), (2, 1, 5, "cast", 8, None, 50, None, 100, 1)]


def test_legend_names_what_the_timeline_uses(spark):
    e = spark.createDataFrame(EVENT, timelines.EVENT)
    players = spark.createDataFrame([(50, "P1"), (51, "P2")], "actor long, symbol string")
    d = timelines.Dictionary.build(e, players=players)
    got = {r.timeline: r for r in d.legends(e).collect()}
    assert got[1].legend == "#v scheme=group\n#P P1\n#E E1=7:1 E2=9 E3=7:2\n#A A0=100 A1=200\n#T C=cast D=damage"
    assert got[2].legend == "#v scheme=group\n#P P1\n#E E1=8\n#A A0=100\n#T C=cast"
    assert json.loads(got[2].legend_json) == {"player_scheme": "group", "players": {"P1": "50"}, "enemies": {"E1": "8"}, "abilities": {"A0": "100"}, "types": {"C": "cast"}}


@pytest.mark.parametrize("codec", ["C", "D", "E", "G"])
def test_codecs_with_players(spark, codec):
    e = spark.createDataFrame([r for r in EVENT if r[3] or codec == "E"], timelines.EVENT)
    d = timelines.Dictionary.build(e, codec == "G", spark.createDataFrame([(50, "P1")], "actor long, symbol string"))
    m = timelines.measured(e, codec, d).where("scale = 0").orderBy("timeline").collect()
    assert [r.reversible for r in m] == [True, True]
    legend = {r.timeline: len(r.legend.encode()) for r in d.legends(e).collect()}
    assert all(r.legend_bytes == legend[r.timeline] < r.total_bytes for r in m)


def test_an_unknown_type_shifts_nothing(spark):
    e = spark.createDataFrame(EVENT, timelines.EVENT)
    d = timelines.Dictionary.build(e.where("type = 'cast'"))
    line = timelines.encode(e, "E", d).where("timeline = 1 and seq = 2").first().line
    assert line == "10 _ 7 2 _ _ _ _"
    back = timelines.decode(timelines.encode(e, "E", d), "E", d).where("timeline = 1 and seq = 2").first()
    assert (back.type, back.source_id, back.source_instance) == (None, 7, 2)


def test_any_number_of_types(spark):
    """More types than there are letters: the rest stand for themselves, and every line reads back."""
    names = [f"t{i}" for i in range(1500)] + ["5", "X0", "c", "C", None]
    e = spark.createDataFrame([(i % 3, i, i, t, 1, None, None, None, None, None) for i, t in enumerate(names)], timelines.EVENT)
    d = timelines.Dictionary.build(e)
    assert len(d.types) < 30 and {"c", "C", "5"} <= set(d.types) and len(set(d.types.values())) == len(d.types)
    rows = lambda df: sorted((r.timeline, r.seq, r.type or "") for r in df.collect())
    for codec in ("E", "G"):
        back = timelines.decode(timelines.encode(e.where("type is not null"), codec, d), codec, d)
        assert rows(back) == rows(e.where("type is not null"))
    legend = d.legends(e).where("timeline = 0").first().legend.split("\n")[-1]
    assert legend.startswith("#T ") and legend.count("=") == len({t for t in names[::3] if t})
    assert timelines.type_codes(["t", "t1", "t2"] + [f"t{i}" for i in range(3, 20)] + ["x0"])["t"] == "T"


def test_ratio_to_a_and_report(spark):
    e = spark.createDataFrame(EVENT, timelines.EVENT)
    m = timelines.measured(e, "A").unionAll(timelines.measured(e, "B"))
    r = timelines.against_a(m).where("scale = 0").collect()
    assert all(x.ratio_to_a == 1.0 for x in r if x.codec == "A") and all(x.ratio_to_a < 1 for x in r if x.codec == "B")
    assert {x.scale for x in m.collect()} == {0}  # no timeline has ten events
    shown = report.to_markdown(report.collect(report.benchmark_sections(m)))
    assert "## Ratio to codec A" in shown and "## Not reversible\n\nNone." in shown
    streams = spark.createDataFrame([("x", 5, True), ("y", 9, False)], "label string, events long, exhausted boolean")
    assert [r["whole"] for r in report.collect(report.stream_sections(streams))["Streams"]] == ["no, a lower bound", "yes"]


def test_fixtures(spark):
    r = spark.createDataFrame([("a", "d", 10), ("b", None, None)], "run_id string, dungeon_key string, keystone_level long")
    p = spark.createDataFrame([("a:1", "a", 0, 5), ("a:2", "a", 1, 5), ("b:1", "b", 1, 5), ("c:1", "c", 1, 5)], "pull_id string, run_id string, is_boss long, duration_ms long")
    e = spark.createDataFrame([(i, pull, t) for i, (pull, t) in enumerate([("a:1", 3), ("a:1", 1), ("a:1", 1), ("a:2", 5), ("b:1", 1), ("b:1", 0), ("c:1", 0), (None, 7)])], "event_id long, pull_id string, rel_ms long")
    chosen = fixtures.select(r, p, e, min_events=1)
    assert [x.pull_id for x in chosen.collect()] == ["b:1", "a:2", "a:1"]
    assert [x.pull_id for x in fixtures.select(r, p, e, min_events=2, limit=1).collect()] == ["b:1"]
    assert fixtures.select(r, p, e, min_events=9).count() == 0
    cov = spark.createDataFrame([("a", "Casts", "Enemies", "ok"), ("a", "Buffs", None, "ok"), ("b", "Casts", None, "partial")], "run_id string, data_type string, hostility string, status string")
    s = fixtures.streams(chosen, cov)
    assert rows(fixtures.by_coverage(s)) == [("", 1, 2, "b:1"), ("Buffs,Casts@Enemies", 2, 4, "a:1")]
    w = fixtures.widest(s)
    assert {x.pull_id for x in w.collect()} == {"a:1", "a:2"}
    assert [x.event_id for x in fixtures.concatenated(w, e).orderBy("seq").collect()] == [1, 2, 0, 3]


def test_orders(spark):
    z = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "id long, name string")
    assert [r.id for r in fixtures.newest_first(z).collect()] == [3, 1, None]
    p = spark.createDataFrame([("r", "b", None, 1), ("r", "b", None, 0), ("r", "a", "E", 0), ("r", "a", None, 2)], "run_id string, data_type string, hostility string, page_index long")
    assert [(r.data_type, r.hostility, r.page_index) for r in fixtures.ordered_pages(p).collect()] == [("a", None, 2), ("a", "E", 0), ("b", None, 0), ("b", None, 1)]
    e = spark.createDataFrame([("b", 1, 1), ("a", 2, 3), ("a", 2, 2)], "run_id string, rel_ms long, event_id long")
    assert [r.event_id for r in fixtures.ordered_events(e).collect()] == [2, 3, 1]


def test_exclusions_are_replaced_and_derivations_end(spark):
    none = spark.createDataFrame([], "derivation_id string, run_id long, reason string, detail string")
    out = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "run_id long, reason string, detail string")
    once = fingerprints.exclude(none, "d", out)
    again = fingerprints.exclude(once, "d", out.where("run_id = 1").withColumn("reason", F.lit("c")))
    assert rows(again) == [("d", 1, "c", None), ("d", 2, "b", "x")]
    heads = spark.createDataFrame([("d", "running", None), ("e", "running", None)], "derivation_id string, status string, finished_at double")
    assert rows(fingerprints.finish(heads, "d", 3.0, "failed")) == [("d", "failed", 3.0), ("e", "running", None)]


def test_coverage_tells_asked_from_never_asked(spark):
    cov = lambda rows_: fingerprints.coverage_component(spark.createDataFrame(rows_, "run_id long, data_type string, pages long, events long, status string")).first()
    assert cov([(1, "Casts", 1, 0, "ok")]).coverage_digest != cov([(1, "Casts", 1, 0, "ok"), (1, "Buffs", 0, 0, "ok")]).coverage_digest
    assert cov([(1, "Casts", None, 0, "ok")]).coverage_digest != cov([(1, "Casts", 0, 0, "ok")]).coverage_digest


def test_labels_filters_and_empty_json(spark):
    df = spark.createDataFrame([("Casts", "Enemies", 5, None), ("Casts", None, None, 6), ("Buffs", "", None, None)], "t string, h string, s long, g long")
    assert [r[0] for r in df.select(runs.stream_label(F.col("t"), F.col("h"), F.col("s"), F.col("g"))).collect()] == ["Casts@Enemies[source=5]", "Casts[target=6]", "Buffs"]
    assert runs.matching(df, {"t": "Casts", "h": None}).count() == 1 and runs.matching(df, {}).count() == 3
    made = spark.sql("select array(1) a, cast(array() as array<int>) b, cast(null as array<int>) c, map('x', 1) d, cast(map() as map<string, int>) e")
    assert tuple(made.select(*[normalize.json_or_null(F.col(c)) for c in "abcde"]).first()) == ("[1]", None, None, '{"x":1}', None)


def test_median_gap_counts_its_way_to_the_middle(spark):
    t = spark.createDataFrame([("a", 0, 10 * g, 2) for g in (1, 5, 5, 9)] + [("b", 0, 30, 4), ("b", 0, 50, 2), ("b", 0, 70, 2)] + [("c", 0, 5, 1)], "ability string, first_ms long, last_ms long, casts long")
    assert rows(casts.median_gap(t)) == [("a", 4, 50), ("b", 3, 50)]


def test_settings_and_log_redaction():
    text = 'A=1\nexport B = "x # y"\nC=\'q"r\'\nD=v # comment\nE=a#b\n=no\nnothing\nF=\nG="open\nA=2'
    assert driver.parse_dotenv(text) == {"A": "2", "B": "x # y", "C": 'q"r', "D": "v", "E": "a#b", "F": "", "G": '"open'}
    r = driver.Redactor()
    got = driver.load_settings({"ID": None, "KEY": None, "N": 2}, {"KEY"}, r, "ID=from file\nKEY=hidden-key\nN=5", {"ID": "from env", "N": " "})
    assert got == {"ID": "from env", "KEY": "hidden-key", "N": 2}
    with pytest.raises(ValueError, match="whole number"):
        driver.load_settings({"N": 2}, set(), r, "", {"N": "x"})
    seen = []
    handler = logging.Handler()
    handler.emit = lambda record: seen.append(logging.Formatter().format(record))
    log = logging.Logger("own")
    log.addHandler(handler)
    r.install(log)
    r.install(log)
    assert len(log.filters) == len(handler.filters) == 1
    log.warning("got %s and %d", "hidden-key", 7)
    log.warning("Bearer abcdefghijkl and %(a)s", {"a": "client_secret=abcdef"})
    try:
        raise RuntimeError("hidden-key failed")
    except RuntimeError:
        log.exception("oops")
    assert seen[0] == "got [REDACTED] and 7" and "abcdef" not in seen[1] and "hidden-key" not in seen[2] and "RuntimeError" in seen[2]


def test_guard_waits_or_gives_up():
    now, slept = [0.0], []
    g = driver.Guard(reserve=10, clock=lambda: now[0])
    g.acquire()
    g.observe(driver.Budget(100, 95, 30))
    with pytest.raises(driver.QuotaExhausted) as e:
        g.acquire(wait=False)
    assert e.value.wait == 31.0
    g.acquire(sleep=slept.append)
    now[0] = 40.0
    assert g.delay() == 1.0 and slept == [31.0]


def test_logs_are_redacted():
    import logging

    seen = []
    handler = logging.Handler()
    handler.emit = lambda record: seen.append(logging.Formatter().format(record))
    log = logging.Logger("emberlog.example")
    log.addHandler(handler)
    driver.Redactor(("hidden-key",)).install(log)
    log.info("key %s of %d", "hidden-key", 5)
    log.info("Bearer abcdefghijkl")
    log.info("plain")
    assert seen == ["key [REDACTED] of 5", "Bearer [REDACTED]", "plain"]


def test_guard_waits_for_the_reserve_and_for_what_it_was_told():
    clock = [100.0]
    guard = driver.Guard(reserve=200, clock=lambda: clock[0])
    assert guard.delay() == 0
    guard.observe(driver.Budget.parse({"limitPerHour": 3600, "pointsSpentThisHour": 3500, "pointsResetIn": 60}))
    assert guard.delay() == 61
    clock[0] = 130.0
    assert guard.delay() == 31
    guard.hold(500)
    assert guard.delay() == 500
