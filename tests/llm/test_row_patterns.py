"""Row patterns against backtracking, on many small stretches."""

import random
from datetime import datetime, timedelta

import brute
import numpy as np
import pytest

from emberlog.llm import row_patterns

DDL = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, props string, key string, stretch int"
BEGIN = datetime(2024, 1, 1)


def frame(spark, rows):
    made = [(i, None if us is None else BEGIN + timedelta(microseconds=us), key, kind, None if value is None else float(value), "{}", "k", 7) for i, us, key, kind, value in rows]
    return spark.createDataFrame(made, DDL)


def found(spark, rows, **options):
    got = row_patterns.match(frame(spark, rows), **options).collect()
    return sorted(((r.client_id, r.match_no, r.first_id, r.last_id, r.n_rows, r.sum_cents, r.labels) for r in got), key=str)


def walk(rng, n, keys, hot=0.4):
    rows, now = [], 0
    for i in range(n):
        now += rng.choice([0, 1, 1000, 60_000_000, 299_999_999, 300_000_000, 300_000_001] if rng.random() < 0.3 else [1_000_000])
        key = 0 if rng.random() < hot else rng.choice([None, *range(keys)])
        rows.append((i, rng.choice([now] * 30 + [None]), key, rng.choice(["click"] * 5 + ["view"] * 4 + ["error", None]), rng.choice([None, float("nan"), float("inf"), -0.005, *([rng.randint(-3, 3) + rng.choice([0, 0.004, 0.005])] * 40)])))
    return rows + rng.sample(rows, n // 5)


@pytest.mark.parametrize("seed", range(4))
def test_as_backtracking(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = walk(rng, 700, [1, 3, 8, 3][seed], [0.9, 0.4, 0.1, 1.0][seed])
    assert found(spark, rows, stretches=[1, 7, 40, 60][seed]) == brute.valleys(rows) != []


@pytest.mark.parametrize("stretches", [2, 13, 50])
def test_runs_over_many_stretches(spark, stretches):
    """Long falls and rises: segments lie over several stretches, some stretches hold nothing else."""
    rng, rows, i = random.Random(stretches), [], 0
    for key in (1, 2, 3):
        now, value = 0, 0.0
        for fall, rise in ((40, 50), (1, 1), (1, 60), (30, 1), (2, 2), (90, 90), (60, 3)):
            for step in [-1] * fall + [1] * rise:
                now, value, i = now + 1_000_000, value + step * rng.choice([1, 2]), i + 1
                rows.append((i, now, key, rng.choice(["click", "view", "view"]), value))
    assert found(spark, rows, stretches=stretches) == brute.valleys(rows) != []


def test_blocks_of_a_stretch(spark, monkeypatch):
    rows = walk(random.Random(9), 900, 3)
    schema = row_patterns._arrow_schema("key long, us long, id long, cents long, moves boolean, goal boolean")
    import pyarrow as pa

    tables = []
    for us, i, key, kind, value in sorted((us, i, key, kind, value) for i, us, key, kind, value in {r for r in rows if r[1] is not None and r[2] is not None and (r[4] is None or r[4] == r[4])} if kind is not None and value is not None and abs(value) < 9):
        tables.append((key, us, i, int(np.floor(100 * value + 0.5)), kind != "error", kind == "click"))
    tables.sort()
    batches = pa.table(list(map(list, zip(*tables))), schema=schema).to_batches(max_chunksize=5)
    out = row_patterns._arrow_schema("kind byte, key long, stretch int, place long, first_id long, last_id long, n_rows long, sum_cents long, n_down long, cents long, phase string, rows_end long, sum_end long, edge struct<" + row_patterns._EDGE.replace(" ", ":").replace(",:", ",") + ">")

    def results(block):
        monkeypatch.setattr(row_patterns, "BLOCK_ROWS", block)
        monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
        return [r for b in row_patterns._scanner(out, 300_000_000)(iter(batches)) for r in b.to_pylist()]

    assert results(1) == results(30) == results(10_000)


def test_tree_finds_the_last():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 100):
        values = rng.integers(-5, 5, n)
        low, high, least = rng.integers(0, n, 300), rng.integers(0, n, 300), rng.integers(-6, 6, 300)
        want = [next((k for k in range(z, a - 1, -1) if values[k] >= x), -1) for a, z, x in zip(low, high, least)]
        assert row_patterns.MaxTree(values).last(low, high, least).tolist() == want


def test_nothing_to_match(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, 1, "click", 1.0), (2, 2, None, "click", 0.5), (3, None, 1, "click", 0.0)]) == []
    # a match over exactly five minutes, and one microsecond more
    row = lambda i, us, v: (i, us, 5, "click", v)
    assert len(found(spark, [row(1, 0, 3.0), row(2, 300_000_000, 1.0), row(3, 600_000_000, 2.0), row(4, 900_000_000, 3.0)])) == 1
    assert found(spark, [row(1, 0, 3.0), row(2, 300_000_001, 1.0), row(3, 600_000_000, 2.0), row(4, 900_000_000, 3.0)]) == []


def test_rows_that_differ_elsewhere_are_two(spark):
    rows = frame(spark, [(1, 0, 5, "click", 3.0), (2, 1, 5, "view", 1.0), (3, 2, 5, "view", 2.0), (4, 3, 5, "click", 3.0)])
    from pyspark.sql import functions as F

    twice = rows.unionByName(rows.where("click_id = 4").withColumn("props", F.lit(None).cast("string"))).unionByName(rows)
    assert [tuple(r) for r in row_patterns.match(twice).collect()] == [(5, 1, 1, 4, 5, 1200, "ADUUP")]
