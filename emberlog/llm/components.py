"""Connected components of a link table by alternating large and small stars.

Every round replaces links by links to smaller members, so the table never grows;
it ends as stars around the smallest member of each component. Links stay in
tables of the shared folder and are never collected. A table that is counted and
found small is left to one task. A member with very many
links is no bottleneck: minima are pre-aggregated, and the joins can be split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberlog.llm.common import drop_scratch, enter, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionAll(own)


#: Links up to which one task finds the components in memory, in arrays of a few tens of bytes a link.
MAX_TOGETHER = 100_000


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that links (a, b) connect each of the numbers up to ``n`` with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches):
        enter("components")
        held = [(batch.column(0), batch.column(1)) for batch in batches]
        if not held:
            return
        a, b = (pa.chunked_array([pair[i] for pair in held]) for i in (0, 1))
        members = pa.chunked_array([*a.chunks, *b.chunks]).unique()
        members = members.take(pc.array_sort_indices(members))
        code = lambda x: pc.index_in(x, members).to_numpy()
        label = members.take(pa.array(smallest(code(a), code(b), len(members))))
        for i in range(0, len(members), 10_000):
            yield pa.RecordBatch.from_arrays([members.slice(i, 10_000).cast(kind), label.slice(i, 10_000).cast(kind)], ["member", "label"])

    kind = to_arrow_type(links.schema["a"].dataType)
    name = links.schema["a"].dataType.simpleString()
    return links.repartition(1).mapInArrow(run, f"member {name}, label {name}")


def components(links: DataFrame, together: int = MAX_TOGETHER) -> DataFrame:
    """(member, label) of every member of a link (a, b); the label is the smallest member.

    Up to ``together`` links one task does it; more go through rounds of stars.
    Links of a member with itself and links with a null are ignored; repeated
    links count once; an empty table gives an empty result.
    """
    now = materialize(links.select("a", "b").where("a != b"), "links")
    if now.count() <= together:
        return materialize(_in_one_task(now), "labels")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == seen or state["n"] == 0:
            return now.select(F.col("a").alias("member"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("member"), F.col("b").alias("label")).distinct())
        seen = state
        after = materialize(_small_star(_large_star(now)).distinct(), "links")
        drop_scratch(now)
        now = after
