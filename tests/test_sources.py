import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.schema import KEYS, TABLES, schema
from emberlog.sources import config, paged, rawcache, reports, sinks, tables
from emberlog.streaming import pages as stream


def test_schemas(spark):
    assert len(TABLES) == 21 and schema("events").names[0] == "event_id" and len(schema("events")) == 41
    assert all(set(k) <= set(schema(t).names) for t, k in KEYS.items())


def test_scan_with_predicates(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 1.0, 0)], "player_id string, first_seen double, last_seen double, run_count long")
    rows.write.parquet(f"{tmp_path}/players")
    got = tables.scan(spark, str(tmp_path), "players", player_id="2")
    assert got.count() == 1 and "PushedFilters: [IsNotNull(player_id), EqualTo(player_id,2)]" in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in tables.table_counts(spark, str(tmp_path)).collect()] == [("players", 2)]
    assert tables.size_bytes(spark, str(tmp_path)) > 0 and tables.size_bytes(spark, f"{tmp_path}/none") == 0


def test_raw_cache(spark, tmp_path):
    root = str(tmp_path / "cache")
    path = rawcache.put(root, "fights", {"b": 1, "a": 2}, {"data": [1]}, "R/1")
    assert rawcache.put(root, "fights", {"a": 2, "b": 1}, {"data": [1]}, "R/1") == path
    rawcache.put(root, "zones", {}, {"z": 1})
    with pytest.raises(rawcache.SecretInPayload):
        rawcache.put(root, "zones", {"x": 1}, "has topsecret", secrets=("topsecret",))
    (tmp_path / "cache/fights/broken.json.gz").write_bytes(b"not gzip")
    got = rawcache.read(spark, root).orderBy("kind").collect()
    assert [(r.kind, r.report_code, r.response) for r in got] == [("fights", "R/1", '{"data":[1]}'), ("zones", None, '{"z":1}')]
    assert rawcache.audit(spark, root, ["data"]).count() == 1
    assert {r.kind: r.files for r in rawcache.stats(spark, root).collect()}["zones"] == 1


def test_report_list(spark):
    text = "# list\nhttps://x.example/reports/AbCdEfGh12345678#fight=3, comment\n\nAbCdEfGh12345678\nZyXwVuTs87654321/\nnot a code!\n"
    codes, rejects = reports.parse_list(spark, text)
    assert [(r.report_code, r["rank"]) for r in codes.orderBy("rank").collect()] == [("AbCdEfGh12345678", 0), ("ZyXwVuTs87654321", 1)]
    assert [r.text for r in rejects.collect()] == ["not a code!"]
    listing = spark.createDataFrame([(1, True, ["a", "b"]), (2, True, ["b", "c"]), (3, False, []), (4, True, ["z"])], "page long, has_more_pages boolean, codes array<string>")
    got = reports.from_listing(listing, "guild", "g", limit=3).orderBy("rank").collect()
    assert [(r.report_code, r["rank"], r.page) for r in got] == [("a", 0, 1), ("b", 1, 1), ("c", 2, 2)]


def test_config(spark, tmp_path):
    f = tmp_path / "c.yml"
    f.write_text("key_brackets:\n  - {key: low, min: 2, max: 5}\n  - {key: high, min: 6, max: null}\nepochs:\n  - {name: unclassified, start: null, end: null}\n  - {name: e, start: '2026-01-01T00:00:00Z', end: null}\nevent_profiles:\n  p: {event_types: [Casts@Enemies], include_combatant_info: true}\ndungeons:\n  - {key: a, display_name: A, encounter_ids: [3]}\n")
    c = config.load(str(f))
    assert config.brackets(c) == [("low", 2, 5), ("high", 6, None)] and config.epochs(c) == [("e", 1767225600000, None)]
    assert config.dungeons(spark, c).first().encounter_ids == [3] and len(config.config_hash([str(f)])) == 16
    with pytest.raises(ValueError):
        config.profiles(spark, c, {"Deaths"})
    assert config.profiles(spark, c, {"Casts"}).count() == 1


def put_page(root, name, index, events, after):
    d = root / name
    d.mkdir(parents=True, exist_ok=True)
    (d / f"{index}.json").write_text(json.dumps({"data": events, "nextPageTimestamp": after}))


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(paged.EventPages)
    put_page(tmp_path, "s1", 0, [{"t": 1}, {"t": 2}], 3)
    put_page(tmp_path, "s1", 1, [{"t": 3}], None)
    put_page(tmp_path, "s2", 0, [{"t": 9}], None)
    got = spark.read.format("event_pages").load(str(tmp_path)).collect()
    assert sorted((r.stream, r.page_index, r.seq_in_page) for r in got) == [("s1", 0, 0), ("s1", 0, 1), ("s1", 1, 0), ("s2", 0, 0)]
    put_page(tmp_path, "s3", 0, [{"t": 9}], 10)
    put_page(tmp_path, "s3", 1, [], 10)
    with pytest.raises(paged.PaginationStall):
        list(paged.follow(str(tmp_path), "s3"))
    reader = paged.PageStreamReader(str(tmp_path))
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 5 and list(reader.read(end)[0]) == []


def test_merges(spark):
    s = "k string, i long, v string"
    old, new = spark.createDataFrame([("a", None, "1"), ("b", 1, "1")], s), spark.createDataFrame([("a", None, "2"), ("c", None, "2")], s)
    assert {tuple(r) for r in sinks.upsert(old, new, ["k", "i"]).collect()} == {("a", None, "2"), ("b", 1, "1"), ("c", None, "2")}
    assert {tuple(r) for r in sinks.insert_absent(old, new, ["k", "i"]).collect()} == {("a", None, "1"), ("b", 1, "1"), ("c", None, "2")}
    seen = "k string, first_seen double, last_seen double, name string"
    got = sinks.merge_seen(spark.createDataFrame([("a", 1.0, 2.0, "x")], seen), spark.createDataFrame([("a", 5.0, 6.0, "y")], seen), "k").first()
    assert tuple(got) == ("a", 1.0, 6.0, "y")
    left, gone = sinks.reset_run(spark.createDataFrame([(1, 1), (2, 2), (3, None)], "e long, run_id long"), 1)
    assert gone == 1 and left.count() == 2
    assert sinks.check_identity([], 1, "f") and not sinks.check_identity([(1, "f")], 1, "f")
    with pytest.raises(ValueError):
        sinks.check_identity([(1, "f")], 1, "g")


def test_page_commits_are_idempotent(spark, tmp_path):
    out = str(tmp_path / "events")
    page = spark.createDataFrame([("s", 0, 0, "a"), ("s", 0, 1, "b"), ("s", 1, 0, "c")], "stream string, page_index long, seq long, raw string")
    sinks.replace_partitions(page, out, ["stream", "page_index"])
    sinks.replace_partitions(page.where("page_index = 0"), out, ["stream", "page_index"])
    assert spark.read.parquet(out).count() == 3


def page_rows(index, events, cursor, after):
    return [{"stream": "s", "page_index": index, "seq_in_page": i, "cursor_ms": cursor, "next_cursor_ms": after, "rel_ms": t, "raw": raw} for i, (t, raw) in enumerate(events)]


def test_stream_drops_what_a_boundary_repeats(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(map(json.dumps, rows)))
    put("1.json", page_rows(0, [(1, "a"), (5, "twin"), (5, "twin"), (5, "x")], None, 5))
    # page 2 comes before page 1; page 1 sends the boundary again, and one more twin
    put("2.json", page_rows(2, [(9, "end"), (9, "last")], 9, None))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: stream.write_available(stream.without_repeats(stream.read(spark, str(source))), out, check).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 4
    put("3.json", page_rows(1, [(5, "twin"), (5, "x"), (5, "twin"), (5, "twin"), (9, "end")], 5, 9))
    run()
    got = [(r.rel_ms, r.raw) for r in spark.read.parquet(out).orderBy("page_index", "seq_in_page").collect()]
    assert got == [(1, "a"), (5, "twin"), (5, "twin"), (5, "x"), (5, "twin"), (9, "end"), (9, "last")]


EMPTY = {"stream": "s", "seq_in_page": None, "cursor_ms": None, "next_cursor_ms": None, "rel_ms": None, "raw": None}


def test_stream_goes_on_behind_an_empty_page(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(map(json.dumps, rows)))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda gap=10**9: stream.write_available(stream.without_repeats(stream.read(spark, str(source)), gap), out, check).awaitTermination()
    put("0.json", page_rows(0, [(1, "a"), (5, "b")], None, 5))
    put("2.json", page_rows(2, [(5, "b"), (6, "c"), (7, "d")], 5, 7))
    put("3.json", page_rows(3, [(7, "d"), (8, "e"), (8, "f")], 7, None))
    run()
    assert [r.raw for r in spark.read.parquet(out).orderBy("rel_ms", "raw").collect()] == ["a", "b"]
    put("1.json", [EMPTY | {"page_index": 1, "next_cursor_ms": 5}])
    run()
    assert [r.raw for r in spark.read.parquet(out).orderBy("rel_ms", "raw").collect()] == list("abcdef")
    put("again.json", page_rows(2, [(5, "b"), (6, "c"), (7, "d")], 5, 7))  # a page that comes again is passed over
    run()
    assert spark.read.parquet(out).count() == 6


def test_stream_tells_of_a_page_that_stays_away(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(map(json.dumps, rows)))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: stream.write_available(stream.without_repeats(stream.read(spark, str(source)), 1), out, check).awaitTermination()
    put("0.json", page_rows(0, [(1, "a")], None, 1))
    put("2.json", page_rows(2, [(6, "c")], 1, None))
    run()
    put("other.json", [EMPTY | {"stream": "t", "page_index": 0}])  # any data lets the timer of s fire
    run()
    got = [(r.page_index, r.raw, r.note) for r in spark.read.parquet(out).orderBy("page_index").collect()]
    assert got == [(0, "a", None), (1, None, "gap"), (2, "c", None)]


def test_stream_commit_and_windows(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, page_rows(0, [(1, "a"), (2, "b")], None, None))))
    out = str(tmp_path / "out")
    run = lambda: stream.commit(stream.read(spark, str(source)), out, str(tmp_path / "check"), buckets=2).awaitTermination()
    run()
    (source / "2.json").write_text("\n".join(map(json.dumps, [*page_rows(1, [(3, "c")], None, None), EMPTY | {"page_index": 2}])))
    run()
    # a page that is sent again takes the place of what it was
    (source / "3.json").write_text("\n".join(map(json.dumps, page_rows(0, [(1, '{"b": 1, "a": [2, {"d": 1, "c": 2}]}')], None, None))))
    run()
    assert sorted((r.page_index, r.raw) for r in stream.committed(spark, out).collect()) == [(0, '{"b": 1, "a": [2, {"d": 1, "c": 2}]}'), (1, "c")]
    assert sorted((r.page_index, r.events, r.batch) for r in stream.manifest(spark, out).collect()) == [(0, 1, 2), (1, 1, 1), (2, 0, 1)]
    digest = {r.raw: r.fingerprint for r in stream.committed(spark, out).collect()}
    assert digest['{"b": 1, "a": [2, {"d": 1, "c": 2}]}'] == hashlib.sha256(b'{"a":[2,{"c":2,"d":1}],"b":1}').hexdigest() and digest["c"] == hashlib.sha256(b"c").hexdigest()
    files = [f for f in (tmp_path / "out" / "data").rglob("*.parquet")]
    assert len(files) <= 3 * 2
    # a batch whose manifest was never written isn't there, and written again it is there once
    import shutil

    shutil.rmtree(tmp_path / "out" / "manifest" / "batch=1")
    assert stream.committed(spark, out).count() == 1
    e = spark.createDataFrame([(1, "2024-01-01 00:00:10", 3), (1, "2024-01-01 00:00:50", 4), (1, "2024-01-01 00:09:00", 5)], "run_id long, at string, amount long").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted((r.events, r.amount) for r in stream.density(e).collect()) == [(1, 5), (2, 7)]
    assert sorted((r.last_at - r.first_at).seconds for r in stream.sessions(e).collect()) == [0, 40]


class Kept:
    """A state variable of the processor that stays in this process; texts that it holds count as on disk."""

    def __init__(self):
        self.value, self.held = None, {}

    exists = lambda self: self.value is not None or bool(self.held)
    get = lambda self: self.value
    containsKey = lambda self, key: key in self.held
    getValue = lambda self, key: self.held[key]
    removeKey = lambda self, key: self.held.pop(key)
    keys = lambda self: iter(self.held)
    clear = lambda self: self.held.clear()

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.held[key] = value


class Handle:
    getValueState = getMapState = lambda self, *_: Kept()
    registerTimer = deleteTimer = lambda self, _: None


class Now:
    getCurrentProcessingTimeInMs = lambda self: 0


@pytest.mark.parametrize("held_rows", [1, 7, 10**6])
def test_processor_emits_page_by_page(held_rows):
    """A worker used to hold all that a batch had of a stream, given and emitted; now pages are emitted one
    at a time, and rows beyond ``held_rows`` wait in the state, wherever a page's rows lie in the batch."""
    p = stream.Boundaries(10**9, held_rows)
    p.init(Handle())
    sent = [(page, json.dumps({"seq_in_page": i, "rel_ms": page * 10 + i, "raw": f"{page}:{i}", "next_cursor_ms": page * 10 + 4})) for page in range(12) for i in range(5)]
    sent += [(page + 1, json.dumps({"seq_in_page": -1, "rel_ms": page * 10 + 4, "raw": f"{page}:4", "next_cursor_ms": page * 10 + 14})) for page in range(11)]
    late = [x for x in sent if x[0] == 3]
    random.Random(held_rows).shuffle(sent)
    most = []

    def frames():
        for i in range(0, len(sent), 4):
            yield pd.DataFrame([x for x in sent[i : i + 4] if x[0] != 3], columns=["page_index", "row"])
            most.append(len(p.waiting.held))

    got = list(p.handleInputRows(("s",), frames(), Now()))
    assert [f.page_index.unique().tolist() for f in got] == [[0], [1], [2]] and (max(most) > 0) == (held_rows < 100)
    again = pd.DataFrame([*late, *[x for x in sent if x[0] == 5]], columns=["page_index", "row"])  # page 5 waits already
    got += list(p.handleInputRows(("s",), iter([again]), Now()))
    assert [json.loads(r)["raw"] for f in got for r in f.row] == [f"{page}:{i}" for page in range(12) for i in range(5)]
    assert not p.parts.held and not p.waiting.held
