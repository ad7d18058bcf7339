"""Answers of a query API and introspected schemas, as tables. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(status: Column, body: Column) -> Column:
    """What an answer means: ``ok``, ``wait`` (asked too often), ``again`` (worth another try) or ``fatal``.

    No status is a timeout. An answer with errors is fatal even if it also has data; one that isn't JSON, or
    whose token was refused, may be better next time.
    """
    errors = F.get_json_object(body, "$.errors")
    readable = F.try_parse_json(body).isNotNull()
    return (
        F.when(status == 429, "wait")
        .when(status.isNull() | (status >= 500) | (status == 401), "again")
        .when(status >= 400, "fatal")
        .when(~F.coalesce(readable, F.lit(False)), "again")
        .when(errors.isNotNull() & (errors != "[]") | F.get_json_object(body, "$.data").isNull(), "fatal")
        .otherwise("ok")
    )


_REF = "kind string, name string, ofType struct<{}>"
_DEEP = "kind string, name string"
for _ in range(6):
    _DEEP = _REF.format(_DEEP)
TYPES = f"name string, kind string, fields array<struct<name:string, args:array<struct<name:string>>, type:struct<{_DEEP}>>>, enumValues array<struct<name:string>>"


def type_fields(types: DataFrame, json_col: str = "type") -> DataFrame:
    """(type, field, takes_arguments, kind, named) of introspected types, a JSON text each."""
    t = types.select(F.from_json(json_col, TYPES).alias("t")).select(F.col("t.name").alias("type"), F.explode("t.fields").alias("f"))
    levels = ["f.type" + ".ofType" * i for i in range(7)]
    last = lambda part: F.coalesce(*[F.when(F.col(f"{at}.kind").isin("NON_NULL", "LIST"), None).otherwise(F.col(f"{at}.{part}")) for at in levels])
    return t.select("type", F.col("f.name").alias("field"), (F.coalesce(F.size("f.args"), F.lit(0)) > 0).alias("takes_arguments"), last("kind").alias("kind"), last("name").alias("named"))


def absent(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted (type, field) pairs that the schema lacks."""
    return wanted.join(present, ["type", "field"], "left_anti")
