"""Abilities that are one action, by paired evidence. Planned by the analysed design, beyond its code.

An action is what an actor does once and the log tells under several ability ids. The
default is that each ability is an action of its own; to merge two is a claim, and it
needs that both are cast with the other nearly always and as often: four casts against
one are not one for one, whatever their rates. Groups are what claims connect. A group in
which every pair was measured so is ``measured``, one that hangs together by chains only is
``inferred``; what a person says (``manual``) goes before both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.duplicates import connected
from emberlog.session import materialize

#: The part that an event type plays in an action, most telling first.
ROLES = {
    "cast": ["begincast", "cast", "empowerstart", "empowerend"],
    "impact": ["damage", "heal", "absorbed", "dispel", "interrupt"],
    "aura": ["applybuff", "applydebuff", "removebuff", "removedebuff", "refreshbuff", "refreshdebuff"],
    "summon": ["summon"],
}
RATE, ONE_FOR_ONE = 0.95, 1.05


def verdict(rate: float = RATE, one_for_one: float = ONE_FOR_ONE) -> Column:
    """What a pair's evidence (``casts.pair_rates``) allows to claim: ``one action``; ``not one for one``, if the two always
    go together but one comes more often; else ``separate``. A rate that isn't known claims nothing."""
    together = (F.col("rate_a") >= rate) & (F.col("rate_b") >= rate)
    return F.when(together & (F.col("cast_ratio") <= one_for_one), "one action").when(together, "not one for one").otherwise("separate")


def roles(events: DataFrame, ability: str = "ability", kind: str = "type", parts: dict[str, list[str]] = ROLES) -> DataFrame:
    """(ability, role): the part that most events of an ability play, of equal ones the first in ``parts``;
    events of other types don't count, and an ability without any that does has a null role."""
    rank = F.lit(None).cast("int")
    for i, kinds in reversed(list(enumerate(parts.values()))):
        rank = F.when(F.col(kind).isin(kinds), i).otherwise(rank)
    counted = events.where(F.col(ability).isNotNull()).groupBy(F.col(ability).alias("ability"), rank.alias("rank")).agg(F.count("*").alias("n"))
    best = counted.groupBy("ability").agg(F.max(F.when(F.col("rank").isNotNull(), F.struct("n", (-F.col("rank")).alias("first"))))["first"].alias("best"))
    names = F.array(*map(F.lit, parts))
    return best.select("ability", F.get(names, -F.col("best")).alias("role"))


def mapping(abilities: DataFrame, pairs: DataFrame, manual: DataFrame | None = None, rate: float = RATE, one_for_one: float = ONE_FOR_ONE) -> DataFrame:
    """(ability, action_id, confidence, members, claims, least_rate, matched) of each ability once.

    ``abilities``: (ability), repeats and nulls don't count. ``pairs``: rows of ``casts.pair_rates`` over all
    pairs. ``manual``: (ability, action_id) as a person decided, one row an ability; its abilities leave their
    group. An action is named after its smallest ability; ``claims`` are the pairs of the group that were
    measured as one action, ``least_rate`` the least rate and ``matched`` the least matches among them, null
    where nothing was claimed.
    """
    each = abilities.select("ability").where("ability is not null").distinct()
    claims = pairs.where(verdict(rate, one_for_one) == "one action")
    if manual is not None:
        own = manual.where("ability is not null").groupBy("ability").agg(F.min("action_id").alias("manual_id"))
        for side in ("ability_a", "ability_b"):
            claims = claims.join(own.select(F.col("ability").alias(side)), side, "left_anti")
    claims = materialize(claims, "claims")  # few rows, read more than once, out of a large join
    label = connected(claims.select(F.col("ability_a").alias("a"), F.col("ability_b").alias("b")))
    evidence = claims.join(label.select(F.col("member").alias("ability_a"), "label"), "ability_a").groupBy("label").agg(
        F.count("*").alias("claims"), F.min(F.least("rate_a", "rate_b")).alias("least_rate"), F.min(F.least("matched_a", "matched_b")).alias("matched")
    )
    size = label.groupBy("label").agg(F.count("*").alias("members"))
    found = each.join(label.withColumnRenamed("member", "ability"), "ability", "left").join(evidence.join(size, "label"), "label", "left")
    whole = F.col("members") * (F.col("members") - 1) / 2 == F.col("claims")
    confidence = F.when(F.col("label").isNull(), "separate").when(whole, "measured").otherwise("inferred")
    action = F.coalesce("label", "ability")
    if manual is not None:
        found = found.join(own, "ability", "left")
        confidence, action = F.when(F.col("manual_id").isNotNull(), "manual").otherwise(confidence), F.coalesce("manual_id", action)
    return found.select("ability", action.alias("action_id"), confidence.alias("confidence"), F.coalesce("members", F.lit(1)).cast("long").alias("members"), F.coalesce("claims", F.lit(0)).cast("long").alias("claims"), "least_rate", "matched")
