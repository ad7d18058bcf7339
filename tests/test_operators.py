"""Hand-made corpora: what the tables of the driver do not contain."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions.signatures import composition_signature, instance_count, species_signature
from emberlog.operators import casts, costs, duplicates, fingerprints, intervals, lookups, normalize, pages, runs, timelines


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PULL = "pull_id string, run_id long, rel_start_ms long, rel_end_ms long"


def brute_assign(pulls, run, at):
    hits = [(s, e, p) for p, r, s, e in pulls if r == run and s <= at <= e]
    return max(hits)[2] if hits else None


@pytest.mark.parametrize("bin_ms", [3_600_000, 7])
def test_assignment_as_brute_force(spark, bin_ms):
    rng = random.Random(1)
    pulls = [(f"p{i}", rng.randint(0, 2), s := rng.randint(0, 80), s + rng.randint(-1, 25)) for i in range(40)]
    pulls += [("touch1", 9, 10, 20), ("touch2", 9, 20, 30), ("equal", 9, 10, 20)]
    events = [(i, rng.randint(0, 3), rng.randint(0, 110)) for i in range(400)] + [(1000 + i, 9, t) for i, t in enumerate([9, 10, 15, 20, 30, 31])]
    got = intervals.assign(frame(spark, events, "event_id long, run_id long, rel_ms long"), frame(spark, pulls, PULL), bin_ms).collect()
    assert {r.event_id: r.pull_id for r in got} == {i: brute_assign(pulls, r, t) for i, r, t in events}
    assert len(got) == len(events)


def test_assignment_stats_bucket_what_is_free(spark):
    pulls = frame(spark, [("a", 1, 10, 20), ("b", 1, 30, 40)], PULL)
    events = frame(spark, [(i, 1, t) for i, t in enumerate([5, 10, 25, 40, 41])] + [(9, 2, 7)], "event_id long, run_id long, rel_ms long")
    got = {r.run_id: r for r in intervals.assignment_stats(intervals.assign(events, pulls), pulls).collect()}
    assert (got[1].assigned, got[1].before_first, got[1].between_pulls, got[1].after_last) == (2, 1, 1, 1)
    assert (got[2].events, got[2].unassigned, got[2].between_pulls) == (1, 1, 1)


def test_overlap_kinds_and_equal_starts_once(spark):
    pulls = frame(spark, [("a", 1, 0, 10), ("b", 1, 10, 20), ("c", 1, 2, 5), ("d", 1, 8, 12), ("e", 1, 0, 10)], PULL)
    got = {(r.a_pull, r.b_pull): r.kind for r in intervals.overlap_pairs(pulls, 3).collect()}
    assert got[("a", "b")] == "touching" and got[("a", "c")] == "nested" and got[("a", "d")] == "partial" and got[("a", "e")] == "nested"
    assert ("e", "a") not in got and ("d", "b") in got


def test_paired_abilities(spark):
    twins = [(i, 1, 7, None, a, 100_000 * i + d) for i in range(12) for a, d in (("x", 0), ("y", 5))]
    rows = [(k, *r[1:]) for k, r in enumerate(twins)] + [(900 + i, 1, 7, 2, "x", 50_000_000 + 100_000 * i) for i in range(3)]
    c = frame(spark, rows, "event_id long, run_id long, source_id long, source_instance long, ability string, rel_ms long")
    p = casts.paired(c, 10).collect()
    assert [(r.ability_a, r.ability_b, r.matched_a, r.matched_b) for r in p] == [("x", "y", 12, 12)]
    rate = casts.pair_rates(casts.paired(c, 10), c).first()
    assert rate.casts_a == 15 and not rate.inseparable


def test_copies_stay_apart_and_unknown_ones_are_left_out(spark):
    rows = [(f"p{t // 100}", 5, i, "bolt", t) for i in (1, 2, None) for t in (10 * (i or 0), 60, 80)]
    c = frame(spark, rows, "pull_id string, source_id long, source_instance long, ability string, pull_rel_ms long")
    t = casts.copy_timelines(c)
    assert {(r.source_instance, r.first_ms, r.casts) for r in t.collect()} == {(1, 10, 3), (2, 20, 3)}
    assert casts.median_gap(t).first().median_gap_ms == 32
    assert [r.n_copies for r in casts.best_examples(casts.several_copies(t)).collect()] == [2]


RUN = "run_id string, dungeon_key string, key_bracket string, is_canonical int"


def test_policies(spark):
    r = frame(spark, [("a", "d", "9", None), ("b", "d", "9", 0), ("c", "d", "9", 1), ("e", "x", "9", 1)], RUN)
    loose = runs.RunSet.select(r, runs.DedupePolicy.PERMISSIVE, dungeon_key="d")
    assert {(x.run_id, x.provisional) for x in loose.included.collect()} == {("a", True), ("c", False)}
    strict = runs.RunSet.select(r, runs.DedupePolicy.STRICT)
    assert {(x.run_id, x.reason) for x in strict.exclusions.collect()} == {("a", "unclassified"), ("b", "duplicate")}
    assert runs.RunSet.select(r, runs.DedupePolicy.STRICT, run_ids=[]).included.count() == 0
    with pytest.raises(TypeError):
        runs.RunSet.select(r, "strict")


def test_coverage_gate(spark):
    r = frame(spark, [(x, "d", "9", 1) for x in "abc"], RUN)
    cov = frame(spark, [("a", "Casts", "Enemies", "ok"), ("a", "Deaths", None, "ok"), ("b", "Casts", "Friendlies", "ok"), ("b", "Deaths", None, "partial")], "run_id string, data_type string, hostility string, status string")
    s = runs.RunSet.select(r, runs.DedupePolicy.STRICT).require(cov, ["Casts@Enemies", "Deaths"])
    assert [x.run_id for x in s.included.collect()] == ["a"]
    assert {(x.run_id, x.detail) for x in s.exclusions.collect()} == {("b", "Casts@Enemies,Deaths"), ("c", "Casts@Enemies,Deaths")}
    report = {x.stream: (x.runs, x.with_stream) for x in runs.coverage_report(r, cov, ["Casts", "Deaths"]).collect()}
    assert report == {"Casts": (3, 2), "Deaths": (3, 1)}


def test_coverage_status(spark):
    p = frame(spark, [("a", "Casts", 0, 5, 7, "ok"), ("a", "Casts", 1, 5, None, "ok"), ("b", "Casts", 0, 5, 9, "ok"), ("c", "Casts", 0, 0, None, "failed")], "run_id string, data_type string, page_index long, event_count long, next_cursor_ms long, status string")
    assert {x.run_id: x.status for x in runs.coverage_rows(p).collect()} == {"a": "ok", "b": "partial", "c": "failed"}


def test_signatures(spark):
    n = frame(spark, [("p", 100, 3), ("p", 9, None), ("p", 100, 2), ("p", None, 4), ("q", None, 1)], "pull_id string, npc_game_id long, instance_count long")
    assert {r.pull_id: r.signature for r in species_signature(n).collect()} == {"p": "9|100", "q": ""}
    row = composition_signature(n).first()
    assert (row.signature, row.species, row.total) == ("9x1 | 100x5", 2, 6)
    c = frame(spark, [(None, None), (1, 18), (1, None), (5, 2)], "min_instance_id long, max_instance_id long").select(instance_count().alias("c")).collect()
    assert [tuple(r.c) for r in c] == [(1, "inferred"), (18, "inferred"), (None, "unknown"), (None, "unknown")]


def run_rows(*rows):
    return [(r, rep, "d", 10, start, 1000, roster) for r, rep, start, roster in rows]


PRINT = "run_id string, report_code string, dungeon_key string, keystone_level long, abs_start_ms long, duration_ms long, roster array<string>"


def test_duplicates(spark):
    m = 60_000
    five = list("vwxyz")
    prints = frame(spark, run_rows(("a", "r1", 0, five), ("b", "r2", 30_000, five), ("c", "r3", 40 * m, five), ("d", "r1", 0, five), ("e", "r4", 60_000, list("klmno")), ("f", "r5", 90_000, [])), PRINT)
    got = {(r.a_run_id, r.b_run_id): r.confidence for r in duplicates.scored(duplicates.candidates(prints)).collect()}
    assert got[("a", "b")] >= 0.9 and ("a", "d") not in got and ("a", "e") not in got and ("a", "c") not in got and ("b", "f") in got
    groups = {r.run_id: (r.duplicate_group_id, r.is_canonical) for r in duplicates.groups(prints, duplicates.scored(duplicates.candidates(prints))).collect()}
    assert groups["a"] == ("dup-a", 1) and groups["b"] == ("dup-a", 0) and groups["c"] == (None, 1)


def test_connected_is_transitive(spark):
    links = frame(spark, [(i, i + 1) for i in range(1, 20)] + [(50, 40)], "a long, b long")
    assert {r.member: r.label for r in duplicates.connected(links).collect()} == {**{i: 1 for i in range(1, 21)}, 40: 40, 50: 40}


def test_fingerprints(spark):
    p = [("a", 0, 5), ("a", 1, None), ("b", 0, 5)]
    d = lambda rows: fingerprints.run_digests(fingerprints.page_component(frame(spark, rows, "run_id string, page_index long, n long"), ["page_index", "n"]), "page")
    same = d(p[::-1])
    assert fingerprints.drift(d(p), same).count() == 0
    changed = d([("a", 0, 6), ("a", 1, None), ("c", 0, 5)])
    assert {(r.run_id, r.change) for r in fingerprints.drift(d(p), changed).collect()} == {("a", "changed"), ("b", "gone"), ("c", "added")}
    assert fingerprints.corpus_fingerprint(d(p)).first() == fingerprints.corpus_fingerprint(same).first()
    with pytest.raises(ValueError):
        fingerprints.run_digests(same, "other")
    with pytest.raises(ValueError):
        fingerprints.drift(d(p), same.withColumn("grade", F.lit("deep")))


def test_boundary_multiset(spark):
    s = "fingerprint string, seq long"
    left = pages.drop_boundary_repeats(frame(spark, [("x", 1), ("x", 2), ("y", 3)], s), frame(spark, [("x", 10), ("x", 11), ("x", 12), ("z", 13)], s))
    assert sorted((r.fingerprint, r.seq) for r in left.collect()) == [("x", 12), ("z", 13)]


def test_verdicts(spark):
    c = frame(spark, [("a", 10, 4, 6, True), ("b", 10, 10, 10, True), ("c", 10, 4, 6, False), ("d", 10, 3, 3, True)], "k string, unfiltered long, enemies long, friendlies long, exhausted boolean")
    assert {r.k: r.verdict for r in pages.share_verdict(c).collect()} == {"a": "split", "b": "ignored", "c": "inconclusive", "d": "inconclusive"}
    f = frame(spark, [("a", 5, 0), ("b", 0, 0), ("c", 0, 5), ("d", 3, 1), ("e", None, 1)], "k string, matching long, foreign long")
    assert {r.k: r.verdict for r in pages.focus_verdict(f).collect()} == {"a": "CONFIRMED", "b": "EMPTY", "c": "REFUSED", "d": "MIXED 75%", "e": "UNKNOWN"}


def test_progress_faults(spark):
    p = frame(spark, [(1, "C", 0, 5, 10), (1, "C", 1, 5, 8), (2, "C", 0, 5, 10), (2, "C", 1, 0, 10), (3, "C", 0, 5, 10), (3, "C", 1, 5, 20)], "run_id long, data_type string, page_index long, event_count long, next_cursor_ms long")
    assert {(r.run_id, r.fault) for r in costs.progress_faults(p).collect()} == {(1, "backwards"), (2, "stalled")}


def test_api_points_skip_what_is_malformed(spark):
    d = frame(spark, [("api-cost", '{"points": 12.5, "runs": 2}'), ("api-cost", "broken"), ("api-cost", '{"runs": 3}'), ("api-cost", '{"points": -1, "runs": 3}'), ("x", '{"points": 1}')], "kind string, detail string")
    r = costs.api_points(d).first()
    assert (r.jobs, r.points, r.runs, r.points_per_run) == (1, 12.5, 2, 6.25)


EVENTS = [
    (1, 0, 1000, "cast", 5, 1, 9, None, 77, None), (1, 1, 1000, "cast", 5, 2, None, None, 77, 10), (1, 2, 1500, "damage", 9, None, 5, 1, 12, 0),
    (1, 3, 1500, "damage", 9, None, 5, 1, 12, 0), (1, 4, 1400, "begincast", None, None, 8, None, None, -3), (2, 0, 5, "death", 9, None, 9, None, 12, 1),
]


@pytest.mark.parametrize("codec", timelines.CODECS)
def test_codecs_round_trip(spark, codec):
    e = frame(spark, EVENTS, timelines.EVENT)
    d = timelines.Dictionary.build(e, by_frequency=codec == "G")
    lines = timelines.encode(e, codec, d)
    back = timelines.decode(lines, codec, d, timelines.default_targets(e), (timelines.VERSION, d.hash()))
    assert timelines.reversible(e, back), back.orderBy("timeline", "seq").collect()
    with pytest.raises(timelines.CodecMismatch):
        timelines.decode(lines, codec, d, timelines.default_targets(e), ("0", d.hash()))


def test_codec_text_and_measures(spark):
    e = frame(spark, EVENTS, timelines.EVENT)
    lines = timelines.encode(e, "C", timelines.Dictionary.build(e))
    text = {r.timeline: r.text for r in timelines.texts(lines).collect()}
    m = {(r.timeline, r.scale): r for r in timelines.measure(lines, (2, None)).collect()}
    assert m[1, 0].bytes == len(text[1].encode()) and m[1, 0].lines == 5 and m[1, 2].lines == 2
    assert timelines.type_codes(sorted(["cast", "click", "cc", "c"])) == {"c": "C", "cast": "A", "cc": "c", "click": "L"}


def test_event_normalisation(spark):
    raw = [
        '{"timestamp": 12, "type": "cast", "sourceID": 3, "abilityGameID": 12.9, "tick": true, "isAoE": false, "facing": 90, "classResources": [{"amount": 1}], "note": "say \\"hi\\""}',
        '{"type": null, "amount": "12.5", "sourceInstance": " 12 ", "stack": true}',
    ]
    a, b = normalize.events(frame(spark, [(r,) for r in raw], "raw string")).collect()
    assert (a.rel_ms, a.type, a.source_id, a.ability_game_id, a.is_tick, a.is_aoe, a.is_buff, a.target_id) == (12, "cast", 3, 12, 1, 0, None, None)
    assert a.extra == '{"classResources":[{"amount":1}],"facing":90,"note":"say \\"hi\\""}'
    assert (b.rel_ms, b.type, b.source_instance, b.stack, b.extra) == (0, "unknown", 12, None, None)


def test_run_roster_and_pull_rows(spark):
    fights = spark.read.json(spark.sparkContext.parallelize(['{"report_code": "R", "report_start_ms": 1000, "fight": {"id": 7, "startTime": 10.0, "endTime": 4.0, "keystoneLevel": 10, "keystoneBonus": 0}}', '{"report_code": "R", "report_start_ms": 1000, "fight": {"id": 1, "startTime": 0.0, "endTime": 4.0}}']))
    r = normalize.runs(fights).collect()
    assert [(x.run_id, x.duration_ms, x.abs_start_ms, x.timed) for x in r] == [("R:7", 0, 1010, 0)]
    players = frame(spark, [("R:7", 1, "Player", "Ann", "Prot", "Warrior-Protection"), ("R:7", 2, "Player", "Bob", None, "Mage"), ("R:7", 3, "NPC", "Rat", None, None), ("R:7", 4, "Player", "Cid", "Holy", "")], "run_id string, id long, type string, name string, subType string, icon string")
    got = {x.actor_id: (x["class"], x.spec, x.role) for x in normalize.roster(players, frame(spark, [("R:7", 1), ("R:7", 2), ("R:7", 4)], "run_id string, id long"), "s").collect()}
    assert got == {1: ("Warrior", "Prot", "dps"), 2: ("Mage", None, None), 4: (None, "Holy", "healer")}
    p = frame(spark, [("r", 5, (2, 50.0, 60.0, 0)), ("r", 5, (None, 10.0, 20.0, 0)), ("r", 5, (1, 70.0, 90.0, 33))], "run_id string, run_start_ms long, pull struct<id:long,startTime:double,endTime:double,encounterID:long>")
    got = normalize.pulls(p).orderBy("pull_index").collect()
    assert [(x.pull_id, x.pull_index, x.is_boss, x.run_rel_start_ms, x.prev_pull_id) for x in got] == [("r:2", 1, 0, 45, None), ("r:1", 2, 1, 65, "r:2")]


def test_brackets_epochs_and_names(spark):
    levels = frame(spark, [(x,) for x in [None, 1, 2, 6, 8, 9, 10, 12, 15, 99]], "x long").select(T.bracket(F.col("x"), T.BRACKETS).alias("b")).collect()
    assert [r.b for r in levels] == [None, None, "2-6", "2-6", "7-8", "9", "10", "11-12", "15+", "15+"]
    at = frame(spark, [(99,), (100,), (199,), (200,), (None,)], "x long").select(T.epoch(F.col("x"), [("e", 100, 200)]).alias("e")).collect()
    assert [r.e for r in at] == ["unclassified", "e", "e", "unclassified", "unclassified"]
    with pytest.raises(ValueError):
        T.check_epochs([("a", None, 10), ("b", 9, None)])
    n = frame(spark, [("Ann-Realm",), (" ann-realm ",), ("player-0123456789ab",), ("",), (None,)], "n string").select(T.focus_candidates(F.col("n"), "s").alias("c")).collect()
    assert n[0].c == n[1].c and len(n[0].c) == 2 and n[2].c == ["player-0123456789ab"] and n[3].c == n[4].c == []


def test_redaction(spark):
    rows = [("Authorization: Bearer abcdefgh.ijk",), ("{'client_secret': 'hunter22', 'a': 1}",), ("x=1&access_token=qwerty&y=2",), ("key is topsecret99 or topsecret",), ("abc",)]
    got = [r.t for r in frame(spark, rows, "t string").select(T.redact(F.col("t"), ["topsecret", "topsecret99", "abc"]).alias("t")).collect()]
    p = T.PLACEHOLDER
    assert got == [f"Authorization: Bearer {p}", f"{{'client_secret': '{p}', 'a': 1}}", f"x=1&access_token={p}&y=2", f"key is {p} or {p}", "abc"]


def test_zone_matching(spark):
    d = frame(spark, [("a", "Alpha", []), ("b", "Beta", ["Bee"]), ("c", "Gamma", []), ("x", "None", [])], "key string, display_name string, aliases array<string>")
    e = frame(spark, [(1, 10, "alpha"), (1, 11, " BEE "), (2, 21, "Beta"), (1, 12, "Gamma"), (1, 13, "gamma")], "zone_id long, encounter_id long, name string")
    assert {r.key: (r.state, r.encounter_id) for r in lookups.match_zones(d, e).collect()} == {"a": ("matched", 10), "b": ("matched", 11), "c": ("ambiguous", None), "x": ("unmatched", None)}


def test_overlay_and_profiles(spark):
    base = frame(spark, [("a", 1, "old"), ("b", 2, "keep")], "key string, zone_id long, note string")
    got = {r.key: (r.zone_id, r.note) for r in lookups.merge_overlay(base, frame(spark, [("a", 9), ("n", 5)], "key string, zone_id long"), ["zone_id"]).collect()}
    assert got == {"a": (9, "old"), "b": (2, "keep"), "n": (5, None)}
    p = frame(spark, [("full", ["Casts@Enemies", " Deaths "], True), ("own", ["CombatantInfo"], True)], "profile string, event_types array<string>, include_combatant_info boolean")
    assert {tuple(r) for r in lookups.profile_requests(p).collect()} == {("full", "Casts", "Enemies"), ("full", "Deaths", None), ("full", "CombatantInfo", None), ("own", "CombatantInfo", None)}


def test_focus_actor_takes_the_first_candidate(spark):
    a = frame(spark, [("r", 1, "n2"), ("r", 2, "n1"), ("q", 3, "n2")], "run_id string, actor_id long, name string")
    roster = a.select("run_id", "actor_id")
    assert {tuple(r) for r in lookups.focus_actor(a, roster, ["n1", "n2"]).collect()} == {("r", 2), ("q", 3)}
    assert lookups.focus_actor(a, roster, []).count() == 0


def test_connected_over_many_rounds(spark):
    """Size estimates that every round multiplied took all of the driver's heap after a dozen rounds."""
    n, m = 3000, 10007
    links = spark.range(n).select((F.col("id") * 7919 % m).alias("a"), ((F.col("id") + 1) * 7919 % m).alias("b"))
    label = duplicates.connected(links)
    assert int(str(label._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**63
    assert label.agg(F.count("*"), F.min("label"), F.max("label")).first() == (n + 1, 0, 0)


def test_connected_in_rounds_as_in_one_task(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1300)] + [(7000, 7000)]
    for kind in ("long", "int", "string"):
        links = frame(spark, [tuple(map(str, p)) for p in pairs] if kind == "string" else pairs, f"a {kind}, b {kind}")
        rounds, one = ({r.member: r.label for r in duplicates.connected(links, together).collect()} for together in (0, 10_000))
        own = [tuple(r) for r in links.collect()]
        label, before = {x: x for p in own for x in p}, None
        while before != label:
            before = dict(label)
            for a, b in own:
                label[a] = label[b] = min(label[a], label[b])
        assert rounds == one == label


def test_pairs_that_span_connect_what_all_do(spark):
    """All pairs of the runs of one start are listed no more where a few connect them."""
    rng = random.Random(5)
    t = duplicates.TOLERANCE_MS
    rows = []
    for i in range(700):
        who = rng.choice([[], [], rng.sample("abcdefghijkl", rng.randint(1, 5)), ["a", "b", "c"]]) if i % 7 else []
        start = rng.choice([rng.randrange(150 * t), rng.randrange(150) * t, rng.randrange(600) * t // 4 + rng.choice([0, 1, -1])])
        rows.append((f"{i:03}", rng.choice(["r1", "r1", "r2", "r3", f"s{i}", None]), rng.choice(["d", "e", "e", None]), rng.choice([None, 0, 2]), start, rng.choice([None, 0, 1, 900, 990, 1000, 1100, 1111, 1112, rng.randrange(5000)]), rng.choice([None, [], [9], [10], [9, 10]]), who))
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        df = frame(spark, rows, "run_id string, report_code string, dungeon_key string, keystone_level long, abs_start_ms long, duration_ms long, affixes array<long>, who array<string>")
        prints = duplicates.fingerprints(df.drop("who"), df.select("run_id", F.explode("who").alias("player_id")))
        every, spanning = (duplicates.scored(duplicates.candidates(prints, spanning=s)) for s in (False, True))
        want, got = (sorted(map(tuple, duplicates.groups(df, pairs).select("run_id", "duplicate_group_id").collect())) for pairs in (every, spanning))
        assert got == want and len({g for _, g in want}) > 20
        of = lambda pairs: {(r.a_run_id, r.b_run_id, r.confidence, r.reason) for r in pairs.collect()}
        assert of(spanning) <= of(every)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = frame(spark, [(i, f"r{i}", "d", 5, 0, None, None, ["p"] if i % 3 else []) for i in range(300)], "run_id long, report_code string, dungeon_key string, keystone_level long, abs_start_ms long, duration_ms long, affixes array<long>, who array<string>")
    prints = duplicates.fingerprints(one.drop("who"), one.select("run_id", F.explode("who").alias("player_id")))
    assert duplicates.candidates(prints, spanning=True).count() < 10 * 300 < duplicates.candidates(prints).count()
    assert {r.duplicate_group_id for r in duplicates.groups(one, duplicates.scored(duplicates.candidates(prints, spanning=True))).collect()} == {"dup-0"}
