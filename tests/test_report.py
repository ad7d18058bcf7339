import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog import cli
from emberlog.functions import driver, privacy
from emberlog.operators import intervals
from emberlog.plans import bindings as B
from emberlog.plans import report
from emberlog.schema import schema

SF = "/root/testdata/sf0.001"


def corpus(spark):
    pulls = B.pulls(spark, SF)
    e = intervals.assign(B.events(spark, SF).withColumn("type", F.lit("cast")).withColumn("ability", F.col("data_type")), pulls)
    r = B.runs(spark, SF).withColumns({"key_bracket": F.lit("9"), "hotfix_epoch": F.lit("unclassified")})
    diag = spark.createDataFrame([("gap", "warning")], "kind string, severity string")
    cov = B.events(spark, SF).select("run_id", F.col("data_type").alias("label"))
    return {"runs": r, "events": e, "pulls": pulls, "pages": B.pages(spark, SF), "diagnostics": diag, "coverage": cov}


def test_report(spark):
    found = report.collect(report.sections(corpus(spark)))
    assert json.loads(report.to_json(found))["Diagnostics"] == [{"kind": "gap", "severity": "warning", "n": 1}]
    text = report.to_markdown(found)
    assert text.count("\n## ") == len(found) and "results describe what was collected" in text
    total = found["Events by pull"][0]
    assert total["assigned"] + total["before_first"] + total["between_pulls"] + total["after_last"] == total["events"]


def test_empty_report(spark):
    found = report.collect(report.sections({k: v.limit(0) for k, v in corpus(spark).items()}))
    assert found["Runs by status"] == [] and "None." in report.to_markdown(found)
    assert {r["slot"] for r in found["Known limitations"]} >= {0, 7}


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    for t in ("dungeon_runs", "pulls", "pull_npcs", "run_players", "event_pages", "events", "run_stream_coverage", "ingest_diagnostics"):
        spark.createDataFrame([], schema(t)).write.parquet(f"{tmp_path}/{t}")
    for command in (["validate"], ["validate", "--json", "--dungeon", "d"], ["stats"], ["dedupe"], ["packs", "--policy", "strict"], ["overlaps"], ["fingerprint"], ["table-counts"]):
        assert cli.main([command[0], str(tmp_path), *command[1:]]) == 0
    assert "Validation report" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["packs", str(tmp_path)])


def test_privacy(spark):
    raw = {"owner": {"id": 1, "name": "Ann"}, "title": "Raid night", "data": {"actors": [{"name": "Bob", "type": "Player", "server": "X"}, {"name": "Rat", "type": "NPC"}]}}
    clean = privacy.sanitize(raw, "s")
    assert clean["owner"]["name"].startswith("uploader-") and clean["title"].startswith("redacted-")
    bob, rat = clean["data"]["actors"]
    assert bob["name"].startswith("player-") and bob["server"].startswith("redacted-") and rat["name"] == "Rat" and raw["title"] == "Raid night"
    df = spark.createDataFrame([(json.dumps(raw),), ("broken",), (None,)], "j string")
    got = [r.s for r in df.select(privacy.sanitize_json(F.col("j"), "s").alias("s")).collect()]
    assert json.loads(got[0]) == clean and got[1:] == [None, None]
    assert privacy.redact_keys({"a": [{"Access_Token": "x", "n": 1}], "token": ""}) == {"a": [{"Access_Token": "[REDACTED]", "n": 1}], "token": ""}
    assert privacy.blamed("You may not view the compact name for this", ["name", "compactName", "id"]) == {"compactName"}
    assert privacy.blamed("invalid id given", ["id", "identity"]) == {"id"}


def test_driver_rules():
    assert driver.parse_dotenv("# c\nexport A = 'x y'\nB=\"2\"\nnothing\nC=a=b") == {"A": "x y", "B": "2", "C": "a=b"}
    assert driver.retry_after("5") == 5 and driver.retry_after("soon") is None and driver.retry_after(None) is None
    rng = random.Random(1)
    assert all(0.7 * b <= driver.backoff(n, rng=rng) <= 1.3 * b for n, b in ((1, 1), (3, 4), (20, 60)))
    assert driver.backoff(1, wait=9999) == 3600
    b = driver.Budget.parse({"limitPerHour": 100, "pointsSpentThisHour": 90, "pointsResetIn": 30})
    assert b.remaining == 10 and b.wait_for(5) == 0 and b.wait_for(5, reserve=8) == 30 and driver.Budget.parse({}) is None
    assert driver.cost_between(b, driver.Budget(100, 95, 20)) == 5 and driver.cost_between(b, driver.Budget(100, 3, 3600)) is None
