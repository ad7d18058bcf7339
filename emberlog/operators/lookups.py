"""Resolution against registries: dungeons, zones, profiles, overlays and focus actors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_dungeons(runs: DataFrame, dungeons: DataFrame) -> DataFrame:
    """``runs`` (run_id, encounter_id, zone_name) with dungeon_key: by encounter, else by name.

    ``dungeons``: position, key, display_name, aliases, encounter_ids. Of several the first in config order wins.
    """
    by_id = dungeons.select(F.explode("encounter_ids").alias("encounter_id"), F.struct("position", "key").alias("d")).groupBy("encounter_id").agg(F.min("d")["key"].alias("by_id"))
    names = F.array_union(F.array("key", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    by_name = dungeons.select(F.explode(names).alias("n"), F.struct("position", "key").alias("d")).groupBy(F.lower(F.trim("n")).alias("zone")).agg(F.min("d")["key"].alias("by_name"))
    j = runs.join(by_id, "encounter_id", "left").withColumn("zone", F.lower(F.trim("zone_name"))).join(by_name, "zone", "left")
    return j.select("run_id", F.coalesce("by_id", "by_name").alias("dungeon_key"))


def match_zones(dungeons: DataFrame, encounters: DataFrame) -> DataFrame:
    """Registry names against (zone_id, encounter_id, name), in two passes.

    Names that one encounter bears settle a season's zone, if they agree on one; a
    name that several bear is then taken from that zone. State: matched, ambiguous or unmatched.
    """
    names = F.array_union(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    wanted = dungeons.select("key", F.explode(names).alias("n")).select("key", F.lower(F.trim("n")).alias("n"))
    hits = wanted.join(encounters.select("zone_id", "encounter_id", F.lower(F.trim("name")).alias("n")), "n").select("key", "zone_id", "encounter_id").distinct()
    per = hits.groupBy("key").agg(F.count("*").alias("hits"))
    zone = hits.join(per.where("hits = 1"), "key", "left_semi").agg(F.countDistinct("zone_id").alias("zones"), F.min("zone_id").alias("season"))
    inside = hits.join(F.broadcast(zone.where("zones = 1")), F.col("zone_id") == F.col("season")).groupBy("key").agg(F.count("*").alias("in_season"), F.min("encounter_id").alias("season_encounter"))
    single = hits.join(per.where("hits = 1"), "key", "left_semi").select("key", F.col("encounter_id").alias("own_encounter"))
    j = dungeons.select("key").join(per, "key", "left").join(inside, "key", "left").join(single, "key", "left")
    one_in_season = F.col("in_season") == 1
    state = F.when(F.col("hits").isNull(), "unmatched").when((F.col("hits") == 1) | one_in_season, "matched").otherwise("ambiguous")
    return j.select("key", state.alias("state"), F.when(F.col("hits") == 1, F.col("own_encounter")).when(one_in_season, F.col("season_encounter")).alias("encounter_id"))


def merge_overlay(base: DataFrame, overlay: DataFrame, identity: list[str]) -> DataFrame:
    """``base`` with the overlay's identity fields where it has them; keys that only it knows are appended."""
    o = overlay.select("key", *[F.col(c).alias(f"o_{c}") for c in identity])
    j = base.join(o, "key", "full_outer")
    return j.select("key", *[F.coalesce(f"o_{c}", c).alias(c) if c in identity else F.col(c) for c in base.columns if c != "key"])


def profile_requests(profiles: DataFrame) -> DataFrame:
    """Streams that a profile asks for: (profile, data_type, hostility), CombatantInfo added where wanted and not named."""
    s = profiles.select("profile", F.explode("event_types").alias("spec"))
    own = s.select("profile", F.trim(F.split_part("spec", F.lit("@"), F.lit(1))).alias("data_type"), F.nullif(F.trim(F.split_part("spec", F.lit("@"), F.lit(2))), F.lit("")).alias("hostility"))
    info = profiles.where("include_combatant_info").select("profile", F.lit("CombatantInfo").alias("data_type"), F.lit(None).cast("string").alias("hostility"))
    return own.unionByName(info.join(own.where("data_type = 'CombatantInfo'"), "profile", "left_anti")).distinct()


def focus_actor(actors: DataFrame, roster: DataFrame, candidates: list[str]) -> DataFrame:
    """(run_id, actor_id): the player of each run whose name comes first among the candidates."""
    if not candidates:
        return roster.select("run_id", "actor_id").limit(0)
    rank = actors.sparkSession.createDataFrame([(i, c) for i, c in enumerate(candidates)], "position int, name string")
    hit = actors.join(rank, "name").join(roster, ["run_id", "actor_id"])
    return hit.groupBy("run_id").agg(F.min(F.struct("position", "actor_id"))["actor_id"].alias("actor_id"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, with its rank among the kept ones left to ``order``."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where("rn = 1").drop("rn")


def limitations(state: DataFrame) -> DataFrame:
    """Known limitations that a one-row frame of counts calls for, as (slot, text).

    ``state``: runs, unclassified, unassigned, overlaps, no_instance, shapes, inseparable.
    """
    texts = [
        ("runs = 0", "no runs were collected"),
        ("unclassified > 0", "some runs were never checked for duplicates"),
        ("unassigned > 0", "some events lie in no pull"),
        ("overlaps > 0", "some pulls overlap, and their events went to the later one"),
        ("no_instance > 0", "some enemy casts do not say which copy cast them"),
        ("shapes > 1", "runs were collected with different streams"),
        ("inseparable > 0", "some abilities always go together"),
        ("true", "results describe what was collected, not what exists"),
    ]
    found = F.array(*[F.when(F.expr(c), F.struct(F.lit(i).alias("slot"), F.lit(t).alias("text"))) for i, (c, t) in enumerate(texts)])
    return state.select(F.explode(F.array_compact(found)).alias("l")).select("l.slot", "l.text")
