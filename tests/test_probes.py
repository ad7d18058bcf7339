import pytest

from emberlog.operators import probes
from emberlog.sources import config, jobs


def test_tallies(spark):
    e = spark.createDataFrame([(1, None, "cast", '{"a": 1}'), (1, 2, "cast", '{"a": 1, "b": 2}'), (2, None, None, "{}")], "source_id long, source_instance long, type string, raw string")
    assert [tuple(r) for r in probes.tally(e, "type").collect()] == [("cast", 2), (None, 1)]
    r = probes.sample_summary(e).first()
    assert (r.events, r.sources, r.with_instance, r["keys"], r.bytes) == (3, 2, 1, 2, 26)
    s = probes.same_stream(e, e.where("source_id = 1"), ["source_id", "type"]).first()
    assert (s.left_rows, s.right_rows, s.shared) == (3, 2, 2)


def test_repeated_species(spark):
    n = spark.createDataFrame([("p", 1, 1, 4), ("p", 2, None, None), ("p", 2, None, None), ("p", 3, 1, 1)], "pull_id string, npc_game_id long, min_instance_id long, max_instance_id long")
    assert {tuple(r) for r in probes.repeated_species(n).collect()} == {("p", 1, "instance range"), ("p", 2, "listed twice")}


def test_outcomes(spark):
    o = spark.createDataFrame([("complete", 5, 1), ("malformed", None, None)], "status string, events long, pages long")
    assert tuple(probes.collection_summary(o).first()) == (2, 1, 1, 5, 1)
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    found = spark.createDataFrame([("a", 3)], "run_id string, actor_id long")
    assert tuple(probes.focus_resolution(runs, found).first()) == (2, 1, False)
    assert probes.focus_resolution(runs, found.limit(0)).first().failed


def test_jobs(spark):
    with jobs.Job(spark, 1.0, "mechanics") as job:
        job.report(True)
        job.report(False)
    row = job.finish(2.0).first()
    assert (row.status, row.reports_attempted, row.reports_completed, row.reports_failed, row.schema_version) == ("complete", 2, 1, 1, 5)
    with pytest.raises(RuntimeError), jobs.Job(spark, 1.0) as broken:
        raise RuntimeError
    assert broken.frame().first().status == "interrupted"


def test_sample_profiles_and_overlay(spark):
    c = {"key_brackets": [{"key": "9", "min": 9, "max": 9}], "event_profiles": {"e": {}}, "sample_profiles": {"ok": {"key_brackets": ["9"], "event_profile": "e"}, "bad": {"key_brackets": ["10"]}}}
    assert config.sample_profile(c, "ok")["event_profile"] == "e"
    with pytest.raises(ValueError):
        config.sample_profile(c, "bad")
    with pytest.raises(KeyError):
        config.sample_profile(c, "none")
    m = spark.createDataFrame([("a", "matched", 5), ("b", "ambiguous", None)], "key string, state string, encounter_id long")
    assert config.overlay_yaml(m) == "dungeons:\n- key: a\n  encounter_ids:\n  - 5\n"
