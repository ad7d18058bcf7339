"""Every query of the registry against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from emberlog import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations stamps".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(zip(*[table.column(n).to_pylist() for n in names]), key=str), {n: str(table.schema.field(n).type).replace("large_", "") for n in names}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    assert not {"map", "array", "struct"} & {t.split("<")[0] for _, t in got.dtypes}
    assert rows(got.toArrow()) == rows(oracle.sql(registry.ORACLE_SQL[name]).to_arrow_table())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
