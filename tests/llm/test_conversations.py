"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest

from emberlog.llm import conversations, queries

DDL = "conv_id long, turn long, role string, text string, conv string, absent boolean"
TEXTS = ["Yes.", "No!", "why", "Well. ", "a b\n", "", " \t", "Why?", None, "é…", "Yes. "]
ROLES = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", None, "unit"]


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for _ in range(rng.randint(1, most)):
            rows.append((rng.choice([c] * 20 + [None]), rng.choice([None, *range(8)]), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.6 else f"Say {rng.random()}."))
    return rows


def expected(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role, text))
    out = {}
    for conv, own in by_conv.items():
        *counts, lines = brute.repaired(own)
        out[conv] = (*counts, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed, convs, most", [(1, 300, 6), (2, 40, 25), (3, 2, 150)])
def test_as_brute_force(spark, seed, convs, most):
    rows = made(seed, convs, most)
    df = spark.createDataFrame([(*r, "x", False) for r in rows], DDL)
    assert result(conversations.repair(df)) == expected(rows)


def test_the_query_on_damaged_rows(spark, tmp_path):
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = made(4, 150, 7) + [(gone, 0, "user", "Yes.")]
    spark.createDataFrame([(*r, "x", False) for r in rows], DDL).write.parquet(str(tmp_path / "conversations.parquet"))
    after, convs = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        after += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = expected(after)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = result(queries.op13_conversation_repair(spark, str(tmp_path)))
    assert got == {c: want.get(c, nothing) for c in convs}
    assert got[gone] == nothing


def test_small_cases(spark):
    df = lambda rows: spark.createDataFrame([(1, i, role, text, "x", False) for i, (role, text) in enumerate(rows)], DDL)
    audit = lambda rows: [(r.audit, r.cost, r.n_repaired) for r in conversations.repair(df(rows)).collect()]
    assert audit([]) == []
    assert audit([("system", "Be.")]) == [("D", 4, 0)]
    assert audit([("user", "A."), ("assistant", "B.")]) == [("KK", 0, 2)]
    assert audit([("assistant", "A.")]) == [("IK", 3, 2)]
    assert audit([("user", "A.")]) == [("KI", 3, 2)]
    assert audit([("user", "A."), ("user", "A."), ("assistant", "B.")]) == [("KDK", 4, 2)]
    assert audit([("user", "a")]) == [("D", 4, 0)]  # keeping costs 3 and the missing answer 3
    # one long conversation, streamed
    many = [("user" if i % 2 == 0 else "assistant", f"{i}." * 50) for i in range(5000)]
    assert audit(many) == [("K" * 5000, 0, 5000)]
