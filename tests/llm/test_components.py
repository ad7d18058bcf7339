import random

import pytest
from brute import union_find

from emberlog.llm.components import components


@pytest.mark.parametrize("together", [0, 10_000])
def test_both_ways_agree_with_union_find(spark, together):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.member: r.label for r in components(df, together).collect()}
    assert got == union_find((a, b) for a, b in links if None not in (a, b) and a != b)


@pytest.mark.parametrize("together", [0, 10_000])
def test_empty(spark, together):
    assert components(spark.createDataFrame([], "a binary, b binary"), together).count() == 0
