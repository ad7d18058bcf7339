"""Raw payloads as typed rows. Every function is one projection over parsed JSON.

Null means that the source did not say; nothing is filled in. Fields that have no
column of their own are kept as JSON in ``extra``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.signatures import instance_count
from emberlog.functions.text import class_and_spec, identity_hash, pseudonym, role

#: Event fields with a column of their own, and that column.
PROMOTED = {
    "type": "type", "sourceID": "source_id", "sourceInstance": "source_instance", "targetID": "target_id", "targetInstance": "target_instance",
    "abilityGameID": "ability_game_id", "extraAbilityGameID": "extra_ability_game_id", "amount": "amount", "absorbed": "absorbed", "blocked": "blocked",
    "mitigated": "mitigated", "unmitigatedAmount": "unmitigated_amount", "overkill": "overkill", "hitType": "hit_type", "tick": "is_tick", "isAoE": "is_aoe",
    "isBuff": "is_buff", "stack": "stack", "hitPoints": "hit_points", "maxHitPoints": "max_hit_points", "buffs": "buffs", "killerID": "killer_id",
    "killerInstance": "killer_instance", "killingAbilityGameID": "killing_ability_game_id", "x": "x", "y": "y", "mapID": "map_id",
}
#: Further event fields that are known and go to ``extra``.
KNOWN_EXTRA = ["armor", "attackPower", "spellPower", "versatility", "avoidance", "absorb", "itemLevel", "classResources", "resourceActor", "facing", "fight", "fake"]
_PARSED, _FIELDS = "parsed payload", "payload fields"
_TEXT, _FLAG = {"type", "buffs"}, {"tick", "isAoE", "isBuff"}


def _whole(text: Column) -> Column:
    """A JSON number or text as a whole number: floats are cut off, other text and booleans are null."""
    return F.coalesce(text.try_cast("long"), F.when(text.rlike("^-?[0-9]+\\.[0-9]+([eE][+-]?[0-9]+)?$"), text.try_cast("double").try_cast("long")))


def events(raw: DataFrame, json: str = "raw") -> DataFrame:
    """``raw`` with typed event columns, rel_ms and extra (the other keys as JSON, sorted, or null).

    A missing timestamp is 0; a missing or null type is ``unknown``. ``extra`` is JSON whose values
    have the types that they came with. A text that is no JSON object, or one with repeated keys,
    is kept whole under ``unparsed``.
    """
    # the text is parsed once for all columns, and once for what is left over
    known = ", ".join(f"`{key}` string" for key in (*PROMOTED, "timestamp"))
    body = F.try_parse_json(json)
    whole = F.schema_of_variant(body).startswith("OBJECT")
    raw = raw.withColumns({_PARSED: F.from_json(json, known), _FIELDS: F.when(whole, body.cast("map<string,variant>"))})
    get = lambda key: F.col(_PARSED)[key]
    columns = {}
    for key, name in PROMOTED.items():
        if key in _FLAG:
            columns[name] = F.when(get(key).isin("true", "1"), 1).when(get(key).isin("false", "0"), 0).cast("long")
        else:
            columns[name] = get(key) if key in _TEXT else _whole(get(key))
    columns["type"] = F.coalesce(columns["type"], F.lit("unknown"))
    columns["rel_ms"] = F.coalesce(_whole(get("timestamp")), F.lit(0))
    rest = F.map_filter(_FIELDS, lambda k, v: ~k.isin(*PROMOTED, "timestamp"))
    unparsed = F.when(F.col(json).isNotNull(), F.to_json(F.create_map(F.lit("unparsed"), F.col(json))))
    columns["extra"] = F.when(F.col(_FIELDS).isNull(), unparsed).when(F.size(rest) > 0, F.to_json(rest))
    return raw.withColumns(columns).drop(_PARSED, _FIELDS)


def rebase(events: DataFrame, report_start: str = "report_start_ms", run_start: str = "run_start_ms", pull_start: str = "pull_start_ms") -> DataFrame:
    """Report-relative times as absolute, run- and pull-relative ones; null goes through."""
    return events.withColumns({"abs_ms": F.col(report_start) + F.col("rel_ms"), "run_rel_ms": F.col("rel_ms") - F.col(run_start), "pull_rel_ms": F.col("rel_ms") - F.col(pull_start)})


def flag(value: Column) -> Column:
    """A boolean as 1 or 0; null stays null."""
    return value.cast("boolean").cast("long")


def _given(raw: DataFrame, path: str, kind: str) -> Column:
    """A column or a field of a struct column, null if the payload's schema lacks it."""
    name, _, field = path.partition(".")
    there = name in raw.columns and (not field or field in raw.schema[name].dataType.fieldNames())
    return F.col(path) if there else F.lit(None).cast(kind)


def json_or_null(value: Column) -> Column:
    """An array, map or struct as JSON; null if it is null or holds nothing."""
    text = F.to_json(value)
    return F.when(~text.isin("[]", "{}"), text)


def reports(raw: DataFrame, salt: str, status: str = "metadata-only") -> DataFrame:
    """Report rows from (code, title, startTime, endTime, zone, owner, region, visibility, revision,
    segments, archiveStatus, retrieved_at). Versions of log and game are never told, so they are null."""
    hashed = lambda c: F.when(c.isNotNull() & (c != ""), identity_hash(c, salt))
    none = F.lit(None).cast("string")
    return raw.select(
        F.col("code").alias("report_code"), hashed(F.col("title")).alias("title_hash"), F.when(F.col("owner.name") != "", pseudonym("uploader", F.col("owner.name"), salt)).alias("owner_hash"),
        F.coalesce(F.col("startTime").cast("long"), F.lit(0)).alias("start_time_ms"), F.coalesce(F.col("endTime").cast("long"), F.lit(0)).alias("end_time_ms"),
        F.col("zone.id").cast("long").alias("zone_id"), F.col("zone.name").alias("zone_name"), F.col("region.id").cast("long").alias("region_id"), F.col("region.slug").alias("region_slug"),
        F.col("revision").cast("long").alias("revision"), F.col("segments").cast("long").alias("segments"), "visibility",
        flag(_given(raw, "archiveStatus.isArchived", "boolean")).alias("is_archived"), flag(_given(raw, "archiveStatus.isAccessible", "boolean")).alias("is_accessible"), _given(raw, "archiveStatus.archiveDate", "long").cast("long").alias("archive_date"),
        none.alias("log_version"), none.alias("game_version"), _given(raw, "retrieved_at", "double").alias("retrieved_at"), F.lit(status).alias("collection_status"),
    )


def runs(fights: DataFrame) -> DataFrame:
    """Keystone runs from (report_code, report_start_ms, fight): others aren't runs."""
    f = fights.where("fight.keystoneLevel is not null")
    start, end = F.coalesce(F.col("fight.startTime").cast("long"), F.lit(0)), F.coalesce(F.col("fight.endTime").cast("long"), F.lit(0))
    bonus = F.col("fight.keystoneBonus").cast("long")
    return f.select(
        F.concat_ws(":", "report_code", F.col("fight.id").cast("string")).alias("run_id"), "report_code", F.col("fight.id").cast("long").alias("fight_id"),
        start.alias("rel_start_ms"), end.alias("rel_end_ms"), (F.col("report_start_ms") + start).alias("abs_start_ms"), (F.col("report_start_ms") + end).alias("abs_end_ms"),
        F.greatest(F.lit(0), end - start).alias("duration_ms"), F.col("fight.keystoneLevel").cast("long").alias("keystone_level"), bonus.alias("keystone_bonus"),
        F.when(bonus.isNotNull(), (bonus > 0).cast("long")).alias("timed"), json_or_null(_given(f, "fight.keystoneAffixes", "array<long>")).alias("keystone_affixes"),
        json_or_null(_given(f, "fight.npcCountMap", "map<string,long>")).alias("npc_count_map"), flag(_given(f, "fight.kill", "boolean")).alias("kill"),
    )


def actors(master: DataFrame, salt: str) -> DataFrame:
    """Actor rows from (report_code, actors): names of players and pets become pseudonyms, others stay."""
    a = master.select("report_code", F.explode("actors").alias("a")).where("a.id is not null")
    kind, name = F.col("a.type"), F.col("a.name")
    shown = F.when(name.isNull(), None).when(kind == "Player", pseudonym("player", name, salt)).when(kind.isin("Pet", "PlayerPet"), pseudonym("pet", name, salt)).otherwise(name)
    return a.select("report_code", F.col("a.id").cast("long").alias("actor_id"), F.col("a.gameID").cast("long").alias("game_id"), shown.alias("name"), kind.alias("type"), F.col("a.subType").alias("sub_type"), F.col("a.icon").alias("icon"), F.col("a.petOwner").cast("long").alias("pet_owner"), F.when(kind == "Player", 1).otherwise(0).cast("long").alias("is_player"))


def abilities(master: DataFrame) -> DataFrame:
    a = master.select(F.explode("abilities").alias("a")).where("a.gameID is not null")
    return a.select(F.col("a.gameID").cast("long").alias("game_id"), F.col("a.name").alias("name"), F.col("a.icon").alias("icon"), F.col("a.type").alias("type"))


def roster(actors_raw: DataFrame, friendly: DataFrame, salt: str) -> DataFrame:
    """Players of a run: (run_id, id, name, type, subType, icon) among ``friendly`` (run_id, id), with a name."""
    p = actors_raw.where("type = 'Player' and name is not null and trim(name) <> ''").join(friendly, ["run_id", "id"], "left_semi")
    cls, spec = class_and_spec(F.col("icon"), F.col("subType"))
    return p.select("run_id", F.col("id").cast("long").alias("actor_id"), identity_hash(F.col("name"), salt).alias("player_id"), cls.alias("class"), spec.alias("spec"), role(cls, spec).alias("role"), F.lit(None).cast("double").alias("item_level"))


def pulls(raw: DataFrame) -> DataFrame:
    """Pull rows from (run_id, run_start_ms, pull): ordered by (start, id); rows without id take a position and go."""
    start, end = F.coalesce(F.col("pull.startTime").cast("long"), F.lit(0)), F.coalesce(F.col("pull.endTime").cast("long"), F.lit(0))
    position = F.row_number().over(W.partitionBy("run_id").orderBy(start, F.asc_nulls_first("pull.id"))) - 1
    p = raw.withColumn("pull_index", position.cast("long")).where("pull.id is not null")
    p = p.select(
        "run_id", F.concat_ws(":", F.col("run_id").cast("string"), F.col("pull.id").cast("string")).alias("pull_id"), "pull_index",
        F.when(F.coalesce(F.col("pull.encounterID"), F.lit(0)) > 0, 1).otherwise(0).cast("long").alias("is_boss"), start.alias("rel_start_ms"), end.alias("rel_end_ms"),
        (start - F.col("run_start_ms")).alias("run_rel_start_ms"), F.greatest(F.lit(0), end - start).alias("duration_ms"),
        json_or_null(F.transform(_given(raw, "pull.maps", "array<struct<id:long>>"), lambda m: m["id"].cast("long"))).alias("map_ids"), json_or_null(_given(raw, "pull.boundingBox", "struct<minX:long>")).alias("bounding_box"),
    )
    w = W.partitionBy("run_id").orderBy("pull_index")
    return p.withColumns({"prev_pull_id": F.lag("pull_id").over(w), "next_pull_id": F.lead("pull_id").over(w)})


def npcs(raw: DataFrame) -> DataFrame:
    """Pull NPC rows from (pull_id, npc), with the number of copies and how it is known."""
    c = instance_count("npc.minimumInstanceID", "npc.maximumInstanceID")
    return raw.where("npc.gameID is not null").select("pull_id", F.col("npc.gameID").cast("long").alias("npc_game_id"), F.col("npc.id").cast("long").alias("actor_id"), F.col("npc.minimumInstanceID").cast("long").alias("min_instance_id"), F.col("npc.maximumInstanceID").cast("long").alias("max_instance_id"), c["n"].alias("instance_count"), c["confidence"].alias("instance_count_confidence"))
