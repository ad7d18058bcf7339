"""Answers and introspected schemas as tables; token counts."""

import json

from pyspark.sql import functions as F

from emberlog.functions import connector as C
from emberlog.functions.tokenizers import token_count
from emberlog.operators import timelines

NAMED = lambda kind, name: {"kind": kind, "name": name, "ofType": None}
WRAP = lambda kind, inner: {"kind": kind, "name": None, "ofType": inner}
TYPES = [
    {"name": "Report", "kind": "OBJECT", "fields": [
        {"name": "code", "args": [], "type": WRAP("NON_NULL", NAMED("SCALAR", "String"))}, {"name": "owner", "args": [], "type": NAMED("OBJECT", "User")}, {"name": "state", "args": [], "type": NAMED("OBJECT", "State")},
        {"name": "fights", "args": [{"name": "ids"}], "type": WRAP("NON_NULL", WRAP("LIST", NAMED("OBJECT", "Fight")))}, {"name": "bare", "args": [], "type": NAMED("OBJECT", "Bare")},
    ]},
    {"name": "User", "kind": "OBJECT", "fields": [{"name": n, "args": [], "type": NAMED("SCALAR", "String")} for n in ("avatar", "battleTag", "name", "id", "rank")]},
    {"name": "State", "kind": "OBJECT", "fields": [{"name": "isArchived", "args": [], "type": NAMED("SCALAR", "Boolean")}, {"name": "since", "args": [{"name": "zone"}], "type": NAMED("SCALAR", "Int")}, {"name": "kind", "args": [], "type": NAMED("ENUM", "Kind")}, {"name": "url", "args": [], "type": NAMED("SCALAR", "String")}]},
    {"name": "Fight", "kind": "OBJECT", "fields": []}, {"name": "Bare", "kind": "OBJECT", "fields": [{"name": "icon", "args": [], "type": NAMED("SCALAR", "String")}]},
    {"name": "Kind", "kind": "ENUM", "enumValues": [{"name": "Casts"}, {"name": "Deaths"}]},
]
CASES = [(200, '{"data": {"a": 1}}', "ok"), (200, '{"data": {"a": 1}, "errors": []}', "ok"), (200, '{"data": {"a": 1}, "errors": [{}]}', "fatal"), (200, '{"data": null}', "fatal"), (200, "<html>", "again"), (200, None, "again"), (429, "", "wait"), (500, "", "again"), (None, None, "again"), (401, "", "again"), (403, "", "fatal"), (404, "{}", "fatal")]


def test_answers_are_judged(spark):
    rows = [(i, s, b) for i, (s, b, _) in enumerate(CASES)]
    got = spark.createDataFrame(rows, "i int, status int, body string").select("i", C.outcome(F.col("status"), F.col("body")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [w for *_, w in CASES]


def test_introspection_as_tables(spark):
    df = spark.createDataFrame([(json.dumps(t),) for t in TYPES], "type string")
    got = {(r.type, r.field): (r.takes_arguments, r.kind, r.named) for r in C.type_fields(df).collect()}
    assert got["Report", "fights"] == (True, "OBJECT", "Fight") and got["Report", "code"] == (False, "SCALAR", "String") and len(got) == 15
    wanted = spark.createDataFrame([("Report", "code"), ("Report", "gone"), ("No", "x")], "type string, field string")
    assert sorted(map(tuple, C.absent(wanted, C.type_fields(df)).collect())) == [("No", "x"), ("Report", "gone")]


def test_real_tokens(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    made = Tokenizer(WordLevel({"[U]": 0, "a": 1}, unk_token="[U]"))
    made.pre_tokenizer = Whitespace()
    path = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}-words.json"
    made.save(path)
    lines = spark.createDataFrame([(1, 1, "a b"), (1, 2, "a"), (2, 1, "")], "timeline long, seq long, line string")
    got = timelines.measure(lines, (1, None), tokens=lambda c: token_count(c, path)).collect()
    assert {(r.timeline, r.scale): r.tokens for r in got} == {(1, 1): 2, (1, 0): 3, (2, 1): 0, (2, 0): 0}
    assert spark.createDataFrame([(None,)], "t string").select(token_count(F.col("t"), path)).first()[0] is None
