"""Interval bins, lossless extras, states, outcomes, casts and keyed names in their edge cases."""

import hmac
import itertools
import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.functions import keyed, text
from emberlog.operators import archetypes, builds, intervals, normalize, states, views

EVENT = "event_id long, run_id long, rel_ms long"
PULL = "pull_id string, run_id long, rel_start_ms long, rel_end_ms long"


def test_intervals_of_any_length(spark):
    events = [(i, 1, t) for i, t in enumerate([0, 5, 10**7, 10**12, 10**16, 2 * 10**16, -7, 3])] + [(3, 2, 5), (3, 2, 5), (9, 1, None)]
    pulls = [("all", 1, 0, 10**16), ("short", 1, 4, 6), ("day", 1, 10**7 - 5, 10**7 + 86_400_000), ("min", 1, -(2**63), -5), ("back", 1, 9, 1), ("none", 1, None, 5), ("two", 2, 0, 2**63 - 1)]
    e, p = spark.createDataFrame(events, EVENT), spark.createDataFrame(pulls, PULL)
    for hot in (10**6, 1):
        got = sorted(((r.event_id, r.run_id, r.rel_ms, r.pull_id) for r in intervals.assign(e, p, hot_rows=hot).collect()), key=str)
        want = []
        for i, run, t in events:
            held = [(a, z, name) for name, of, a, z in pulls if of == run and None not in (a, t) and a <= t <= z]
            want.append((i, run, t, max(held)[2] if held else None))
        assert got == sorted(want, key=str)
    pairs = {(r.a_pull, r.b_pull, r.kind) for r in intervals.overlap_pairs(p).collect()}
    assert pairs == {("all", "short", "nested"), ("all", "day", "nested")}
    overlaps = intervals.overlap_pairs(p)
    contested = {(r.a_pull, r.b_pull, r.assigned_to): r.events for r in intervals.contested_events(overlaps, intervals.assign(e, p)).collect()}
    assert contested == {("all", "short", "short"): 1, ("all", "day", "day"): 1}
    assert intervals.assign(e.limit(0), p).count() == 0 and intervals.assign(e, p.limit(0)).where("pull_id is null").count() == len(events)


def test_random_intervals_as_brute_force(spark):
    rng = random.Random(3)
    pulls = [(str(i), rng.randint(1, 2), a, a + rng.choice([0, 3, 100, 5000, 10**6])) for i in range(60) for a in [rng.randint(-1000, 10_000)]]
    e, p = spark.createDataFrame([(i, rng.randint(1, 3), rng.randint(-2000, 20_000)) for i in range(300)], EVENT), spark.createDataFrame(pulls, PULL)
    for width in (7, 1000):
        for r in intervals.assign(e, p, bin_ms=width).collect():
            held = [(a, z, name) for name, of, a, z in pulls if of == r.run_id and a <= r.rel_ms <= z]
            assert r.pull_id == (max(held)[2] if held else None)
        want = sum(1 for x in pulls for y in pulls if x[1] == y[1] and (x[2], x[0]) < (y[2], y[0]) and y[2] <= x[3])
        assert intervals.overlap_pairs(p, bin_ms=width).count() == want


def test_extra_keeps_every_value_with_its_type(spark):
    extras = [{"foo": "123", "bar": "true", "baz": "{x}", "nl": "a\nb", "q": 'say "x" \\ \u0001', 'k"ey': 1}, {"n": None, "t": True, "f": 1.5, "big": 2**70, "deep": {"b": [1, "2", None], "a": {}}, "e": "", "uni": "é🙂"}, {}]
    payloads = [json.dumps({"timestamp": 5, "type": "cast", "sourceID": 3, **x}) for x in extras] + ["not json", "[1, 2]", '{"cut": ', None, '"text"', ""]
    df = spark.createDataFrame(list(enumerate(payloads)), "i long, raw string")
    got = {r.i: r for r in normalize.events(df).collect()}
    assert json.loads(got[0].extra) == extras[0] and json.loads(got[1].extra) == extras[1] and got[2].extra is None
    assert (got[0].rel_ms, got[0].type, got[0].source_id) == (5, "cast", 3)
    assert [json.loads(got[i].extra) if got[i].extra is not None else None for i in range(3, 9)] == [{"unparsed": p} if p is not None else None for p in payloads[3:]]


def test_states_look_back_over_any_gap(spark):
    rng = random.Random(5)
    seen = [(rng.choice([1, 2, None]), rng.randint(0, 3000) * 1000, i, rng.choice(["hp", "build"]), i) for i in range(200)]
    moments = [(rng.choice([1, 2, 3, None]), rng.randint(-5, 3005) * 1000, i) for i in range(200)] + [(1, None, 900)]
    o = spark.createDataFrame(seen, "run_id long, rel_ms long, seq long, field string, value long")
    m = spark.createDataFrame(moments, "run_id long, rel_ms long, id long")
    got = {r.id: r for r in states.states(m, o, ["run_id"], {"hp": 2000, "build": None}, stretch_ms=10_000).collect()}
    assert len(got) == len(moments)
    for run, t, i in moments:
        for field, horizon in (("hp", 2000), ("build", None)):
            last = max(((at, seq, v) for of, at, seq, f, v in seen if of == run and f == field and t is not None and at <= t), default=None)
            r = got[i]
            if last is None:
                assert (r[field], r[f"{field}_age_ms"], r[f"{field}_status"]) == (None, None, "unknown")
            else:
                stale = horizon is not None and t - last[0] > horizon
                assert (r[field], r[f"{field}_last"], r[f"{field}_age_ms"], r[f"{field}_status"]) == (None if stale else last[2], last[2], t - last[0], "stale" if stale else "observed")


def test_outcomes_as_brute_force(spark):
    rng = random.Random(6)
    facts = [(rng.choice([1, 2]), rng.randint(0, 500), rng.randint(-5, 9), rng.choice([0, 1, None])) for _ in range(300)]
    moments = [(rng.choice([1, 2, 3]), rng.randint(0, 520), i, rng.choice([500, None, 100])) for i in range(80)]
    f, m = spark.createDataFrame(facts, "run_id long, rel_ms long, hurt long, died long"), spark.createDataFrame(moments, "run_id long, rel_ms long, id long, end_ms long")
    got = {(r.id, r.horizon_ms): r for r in states.outcomes(m, f, ["run_id"], "id", [10, 100, 1000], {"damage": "hurt", "deaths": "died"}, "end_ms", stretch_ms=30).collect()}
    assert len(got) == 3 * len(moments)
    for run, t, i, end in moments:
        for h in (10, 100, 1000):
            until = t + h if end is None else max(t, min(t + h, end))
            inside = [x for x in facts if x[0] == run and t < x[1] <= until]
            r = got[i, h]
            assert (r.damage, r.deaths, r.actual_ms, r.truncated) == (sum(x[2] for x in inside), sum(x[3] or 0 for x in inside), until - t, end is not None and t + h > end)


def test_windows_around_moments(spark):
    rng = random.Random(16)
    facts = [(rng.choice([1, 2]), rng.randint(0, 300), rng.randint(-5, 9)) for _ in range(200)]
    moments = [(rng.choice([1, 2, 3]), rng.randint(0, 300), i) for i in range(60)] + [(1, None, 99)]
    f, m = spark.createDataFrame(facts, "run_id long, rel_ms long, hurt long"), spark.createDataFrame(moments, "run_id long, rel_ms long, id long")
    got = {(r.id, r.window_ms): r.damage for r in states.around(m, f, ["run_id"], "id", [0, 3, 50], {"damage": "hurt"}, stretch_ms=20).collect()}
    assert got == {(i, w): sum(x[2] for x in facts if x[0] == run and abs(x[1] - t) <= w) for run, t, i in moments if t is not None for w in (0, 3, 50)}


def test_each_event_is_in_one_link(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 2]), rng.choice([None, 1]), rng.randint(0, 60), rng.choice("sie")) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, run_id long, who long, rel_ms long, kind string")
    kinds = [df.where(F.col("kind") == k) for k in "sie"]
    got = {r.event_id: r.start_id for r in views.linked_interrupts(*kinds, ["run_id", "who"], 5, stretch_ms=7).collect()}
    open_, want = {}, {}
    for i, run, who, t, kind in sorted(rows, key=lambda r: (r[3], "sie".index(r[4]), r[0])):
        held = open_.pop((run, who), None)
        if kind == "s":
            open_[run, who] = (i, t)
        elif kind == "i":
            want[i] = held[0] if held and t - held[1] <= 5 else None
    assert got == want
    linked = [s for s in got.values() if s is not None]
    assert len(linked) == len(set(linked)) > 5
    casts = views.occurrences(*kinds, ["run_id", "who"], 5, stretch_ms=7)
    assert {r.outcome_id: r.event_id for r in casts.where("outcome = 'interrupted'").collect()} == {i: s for i, s in want.items() if s is not None}
    causes = views.causes(casts, df.where("kind = 'e' and who = 1").select("run_id", "who", "rel_ms"), df.limit(0), ["run_id", "who"], 5, stretch_ms=7).collect()
    assert len(causes) == casts.where("outcome <> 'completed'").count() == len({r.event_id for r in causes}) and {r.cause for r in causes} <= {"interrupt", "death", "unknown"}


def test_waits_end_once(spark):
    cast = spark.createDataFrame([(1, 1, None, 7, 0, 100), (2, 1, None, 7, 10, 100), (3, 1, None, 7, 10, 100), (4, 1, 1, 7, 50, 100), (5, 1, 1, 7, 90, None), (6, 1, 2, 7, 5, None), (7, 1, 3, 7, 120, 100)], "event_id long, run_id long, who long, ability long, rel_ms long, end_ms long")
    deaths = spark.createDataFrame([(1, 1, 60), (1, 1, 90), (1, None, 10)], "run_id long, who long, rel_ms long")
    got = {r.event_id: (r.ended_by, r.duration_ms) for r in views.recasts(cast, deaths, ["run_id", "who"], "ability", "end_ms", stretch_ms=20).collect()}
    assert got == {1: ("recast", 10), 2: ("recast", 0), 3: ("death", 0), 4: ("death", 10), 5: ("death", 0), 6: ("open", None), 7: ("end", 0)}
    curve = views.survival(spark.createDataFrame([(1, "recast", 5), (1, "recast", 5), (1, "end", 5), (1, "recast", 9), (1, "death", 3), (2, "end", 4), (2, "open", None)], "ability long, ended_by string, duration_ms long"), ["ability"])
    assert sorted(tuple(r) for r in curve.collect()) == [(1, 5, 4, 2, 0.5), (1, 9, 1, 1, 0.0)]
    assert {r.ability: r.median_ms for r in views.median_waits(curve, ["ability"]).collect()} == {1: 5}


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 200])
def test_keyed_names_are_hmac(spark, size):
    rng = random.Random(size)
    rows = [(bytes(rng.randrange(256) for _ in range(size)), bytes(rng.randrange(256) for _ in range(n))) for n in (0, 1, 55, 64, 300)]
    df = spark.createDataFrame([(bytearray(k), bytearray(m)) for k, m in rows], "k binary, m binary")
    got = [r[0] for r in df.select(keyed.hmac_sha256(F.col("k"), F.col("m"))).collect()]
    assert got == [hmac.new(k, m, "sha256").hexdigest() for k, m in rows]
    assert df.select(keyed.hmac_sha256(F.lit(None), F.col("m"))).first()[0] is None


def test_keyed_names_are_made_without_a_step_for_each_byte(spark):
    """Every byte as a key, those that a pad turns into zero too; a lambda run for each byte took minutes over a million names."""
    keys = [bytes(range(i, i + 64)) for i in range(0, 256, 64)] + [b"\x36" * 64, b"\x5c" * 64, "\u0100\u0136".encode()]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select(keyed.hmac_sha256(F.col("k"), F.lit("m")))
    assert [r[0] for r in df.collect()] == [hmac.new(k, b"m", "sha256").hexdigest() for k in keys]
    assert "lambda" not in df._jdf.queryExecution().toString()


def test_rates_sum_to_one(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice([1, 2, None]), rng.choice("ab"), rng.choice([None, "x", "y"]), 5) for _ in range(100)], "actor long, type string, hit string, same long")
    rates = views.base_rates(df, ["actor", "type"], ["hit", "same"])
    totals = rates.groupBy("context", "actor", "type", "field").agg(F.sum("n").alias("n"), F.max("of").alias("of"), F.round(F.sum("rate"), 4).alias("rate")).collect()
    assert all(r.n == r.of and abs(r.rate - 1) < 1e-3 for r in totals)
    bits = {(r.context, r.field): r.bits for r in views.field_entropy(rates).collect()}
    assert all(bits[c, "same"] == 0 for c in ("actor", "type", "actor,type")) and bits["type", "hit"] > 1


def test_archetypes_as_brute_force(spark):
    rng = random.Random(9)
    pulls = [(i, rng.choice(["a", "a", None])) for i in range(160)] + [(900, "a")]
    npcs = [(i, s, rng.choice([1, 1, 2, 3, None, 0])) for i, _ in pulls[:-1] for s in rng.sample(range(6), rng.randint(1, 5))] + [(1, None, 3)]
    p, n = spark.createDataFrame(pulls, "pull_id long, dungeon_key string"), spark.createDataFrame(npcs, "pull_id long, npc_game_id long, instance_count long")
    held = {}
    for i, s, k in npcs:
        if s is not None and (k is None or k > 0):
            held.setdefault(i, {})[s] = held.get(i, {}).get(s, 0) + (1 if k is None else k)
    comps = {(dict(pulls)[i], tuple(sorted(c.items()))) for i, c in held.items()}

    def alike(x, y):
        both = sum(min(k, dict(y[1]).get(s, 0)) for s, k in x[1])
        return x[0] == y[0] and 5 * both >= 4 * (sum(k for _, k in x[1]) + sum(k for _, k in y[1]) - both)

    want = sum(alike(x, y) for x in comps for y in comps if str(x) < str(y))
    of, nodes = archetypes.compositions(p, n)
    assert nodes.count() == len(comps) and archetypes.similar(nodes).count() == want > 5
    got = {r.pull_id: r for r in archetypes.archetypes(p, n).collect()}
    assert set(got) == set(held) and all((r.distance == 0) == (r.match_kind == "exact") for r in got.values())
    groups = {}
    for r in got.values():
        groups.setdefault(r.archetype_id, []).append(r)
    assert all(r.members == len(own) and any(x.match_kind == "exact" for x in own) for own in groups.values() for r in own)
    key = lambda i: (dict(pulls)[i], tuple(sorted(held[i].items())))
    assert all(got[i].archetype_id == got[j].archetype_id for i in held for j in held if alike(key(i), key(j)))
    assert archetypes.archetypes(p.limit(0), n).count() == 0


def test_builds_of_any_shape(spark):
    gear = [0] * 12 + [7, 5]
    rows = [
        {"talents": [3, 1], "gear": gear, "stats": {"haste": 120, "crit": 99.5}, "itemLevel": 600, "specID": 65},
        {"talents": [{"id": 1}, {"id": 3, "rank": 1}], "gear": [{"id": x} for x in [0] * 12 + [5, 7]], "stats": {"crit": 0, "haste": 199}, "itemLevel": 684.5},
        {"talents": [{"id": 1, "rank": 2}, 3], "gear": [9, *gear[1:]], "extra": {"x": 1}},
        {"talents": "none", "gear": [], "stats": {}},
    ]
    raw = [json.dumps(r) for r in rows] + ["{", None]
    got = [r for r in builds.builds(spark.createDataFrame(list(enumerate(raw)), "i long, raw string")).orderBy("i").collect()]
    assert got[0].talent_hash == got[1].talent_hash != got[2].talent_hash
    assert got[0].equipment_hash == got[1].equipment_hash != got[2].equipment_hash
    assert got[0].stat_hash == got[1].stat_hash and got[0].config_hash == got[1].config_hash and got[2].stat_hash is None
    assert {(r.trinket_low, r.trinket_high) for r in got[:3]} == {(5, 7)} and len({r.trinket_hash for r in got[:3]}) == 1
    assert [r.item_level for r in got[:2]] == [600.0, 684.5] and [r.spec_id for r in got[:2]] == [65, None]
    assert all(x is None for r in got[3:] for x in (r.talent_hash, r.equipment_hash, r.trinket_hash, r.stat_hash, r.config_hash))


def test_iso_instants(spark):
    good = ["2024-01-02T03:04:05Z", "2024-01-02", "20240102", "2024-02-29 23:59:59.987654", "2024-01-02T03:04", "1969-12-31T23:59:59.5+05:30", "2024-01-02T03:04:05-0800"]
    bad = ["", None, "2024-13-01", "2023-02-29", "2024-01-02T25:00:00", "2024-01-02 ", "01/02/2024", "1704104923", "2024-0102", "2024-01-02T03:04:60", "2024-01", "2024-01-02T03:04:05 PM"]
    want = []
    for g in good:
        at = datetime.fromisoformat(g)
        want.append(int(((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1) // 1000))
    df = spark.createDataFrame(list(enumerate(good + bad)), "i int, t string")
    assert [r.at for r in df.select("i", text.iso_millis(F.col("t")).alias("at")).orderBy("i").collect()] == want + [None] * len(bad)


def test_likenesses_dont_shuffle_what_shares_one_species(spark):
    """Compositions that have a species in common but aren't alike used to be shuffled as pairs, twice."""
    sets = [{x: n, y: 2, z: 2} for x, y, z in itertools.combinations(range(22), 3) for n in (2, 3)]
    rows = [(f"{i:064x}", "d", sorted(s.items()), sum(s.values()), 1) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node string, dungeon_key string, species array<struct<npc_game_id:long,n:long>>, size long, pulls long")
    of = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    settled = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    settled()
    before = of()
    got = {(r.a, r.b, r.shared, r.either) for r in archetypes.similar(nodes).collect()}
    settled()
    assert got == {(f"{i:064x}", f"{i + 1:064x}", 6, 7) for i in range(0, len(sets), 2)}
    assert of() - before < 3_000_000


def test_archetypes_read_the_species_once(spark):
    """The species of all pulls used to be gathered again where pulls meet their archetypes."""
    p, n = spark.createDataFrame([(1, "a")], "pull_id long, dungeon_key string"), spark.createDataFrame([(1, 5, 2)], "pull_id long, npc_game_id long, instance_count long")
    found = archetypes.archetypes(p, n)
    assert "instance_count" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.pull_id, r.match_kind, r.distance, r.members) for r in found.collect()] == [(1, "exact", 0.0, 1)]


def test_likenesses_of_any_size_as_brute_force(spark):
    """A composition used to be dealt out to every place that its own size allowed, whichever size the other one had."""
    rng = random.Random(3)
    sets = []
    for i in range(400):
        scale = rng.choice([1, 1, 3, 40])
        base = {s: rng.randint(1, scale) for s in rng.sample(range(30), rng.randint(1, 9))} if i % 4 == 0 else dict(sets[-1][1])
        if i % 4:
            for s in rng.sample(sorted(base), rng.randint(0, 1)) + rng.sample(range(30), 1):
                base[s] = max(0, base.get(s, 0) + rng.choice([-1, 1, 1, -2, 2])) or 1
        sets.append((rng.choice(["d", "d", None]) if i % 4 == 0 else sets[-1][0], base))
    comps = sorted({(str(d), tuple(sorted(c.items()))) for d, c in sets})
    rows = [(f"{i:064x}", None if d == "None" else d, list(c), sum(n for _, n in c), 1) for i, (d, c) in enumerate(comps)]
    nodes = spark.createDataFrame(rows, "node string, dungeon_key string, species array<struct<npc_game_id:long,n:long>>, size long, pulls long")
    for num, den in ((4, 5), (1, 2)):
        want = set()
        for i, x in enumerate(rows):
            for y in rows[i + 1 :]:
                both = sum(min(n, dict(y[2]).get(s, 0)) for s, n in x[2])
                if x[1] == y[1] and den * both >= num * (x[3] + y[3] - both):
                    want.add((x[0], y[0], both, x[3] + y[3] - both))
        got = [tuple(r) for r in archetypes.similar(nodes, num, den).collect()]
        assert len(got) == len(set(got)) > 100 and set(got) == want
    dealt = archetypes._dealt
    light = [r for r in rows if r[3] <= 8]
    batch = pa.RecordBatch.from_pydict({"node": [r[0].encode() for r in light], "dungeon_key": [r[1] for r in light], "dungeon": [0] * len(light), "species": [[{"npc_game_id": s, "n": n} for s, n in r[2]] for r in light], "size": [r[3] for r in light]})
    # up to a weight of eight the smaller of two lies in the larger one whole: it has one place
    assert sum(len(b) for b in dealt(False, np.zeros(archetypes._SLOTS, np.int64), 4, 5)([batch])) == len(light)
