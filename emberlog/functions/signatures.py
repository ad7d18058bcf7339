"""Signatures of the set and the multiset of a pull's species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def species_signature(npcs: DataFrame) -> DataFrame:
    """(pull_id, signature): distinct ids in numeric order, joined by ``|``; null ids don't count."""
    ids = F.array_sort(F.collect_set("npc_game_id"))
    return npcs.groupBy("pull_id").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), "|").alias("signature"))


def composition_signature(npcs: DataFrame) -> DataFrame:
    """(pull_id, signature, species, total): ``{id}x{n}`` by id, joined by `` | ``; an unknown count is 1.

    A pull without species has a null signature.
    """
    each = npcs.where("npc_game_id is not null").groupBy("pull_id", "npc_game_id").agg(F.sum(F.coalesce("instance_count", F.lit(1))).alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.struct("npc_game_id", "n")))
    g = each.groupBy("pull_id").agg(sorted_.alias("s"), F.sum("n").alias("total"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["npc_game_id"].cast("string"), F.lit("x"), x["n"].cast("string"))), " | ")
    return g.select("pull_id", F.nullif(text, F.lit("")).alias("signature"), F.size("s").cast("long").alias("species"), "total")


def instance_count(low: str = "min_instance_id", high: str = "max_instance_id"):
    """Number of copies from a range of instance ids, with how it is known, as a struct."""
    lo, hi = F.col(low), F.col(high)
    inferred = lambda n: F.struct(n.cast("long").alias("n"), F.lit("inferred").alias("confidence"))
    unknown = F.struct(F.lit(None).cast("long").alias("n"), F.lit("unknown").alias("confidence"))
    return F.when(lo.isNull() & hi.isNull(), inferred(F.lit(1))).when(lo.isNull() | hi.isNull() | (hi < lo), unknown).otherwise(inferred(hi - lo + 1))
