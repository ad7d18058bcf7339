"""Queries of the ingest side: payloads as typed rows, identities, sinks, streams and registries.

Payloads are built from the driver's tables as JSON or nested columns and go through the
library's normalisation; the SQL computes the expected columns from the tables directly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import privacy
from emberlog.functions import text as T
from emberlog.operators import casts, costs, duplicates, fingerprints, fixtures, lookups, normalize, probes, runs
from emberlog.plans import bindings as B
from emberlog.registry import _ASSIGNED as ASSIGNED
from emberlog.registry import _COVERAGE as COVERAGE
from emberlog.registry import _DIGESTS, _F, _SCORED, SALT, _digests, assigned, query
from emberlog.registry import _coverage as coverage
from emberlog.registry import _pairs as scored_pairs
from emberlog.session import shared_folder
from emberlog.sources import reports, sinks
from emberlog.streaming import pages as page_stream


def hashed(value: str, size: int = 12) -> str:
    """SQL of an identity hash."""
    return f"substr(sha256('{SALT}:' || lower(trim({value}))), 1, {size})"


def _json(**fields):
    return F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()]))


# --- payloads ----------------------------------------------------------------


def _raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads with unknown fields of each kind: numbers, texts that look like numbers and flags, flags, nested values with
    control characters and nulls. Every fiftieth is cut off."""
    raw = _json(timestamp="rel_ms", type="nullif(type, 'view')", sourceID="source_id", sourceInstance="source_instance", targetID="target_id", abilityGameID="ability_game_id", amount="amount", tick="case when ability_game_id % 3 = 0 then null else ability_game_id % 3 = 1 end", facing="ability_game_id % 7", armor="target_id", note="string(ability_game_id)", flagged="'true'", seen="ability_game_id % 2 = 0")
    nested = F.regexp_replace(raw, "\\}$", F.lit(',"deep":{"b":[1,"2",null,{"c":1.5}],"a":"x\\\\n\\\\"y\\\\""}}'))
    broken = F.concat(F.lit('{"broken": '), F.col("event_id").cast("string"))
    return B.events(spark, sf).select("event_id", F.when(F.col("event_id") % 50 == 0, broken).otherwise(nested).alias("raw"))


@query(
    "normalize_events",
    """select event_id, case when event_id % 50 > 0 then rel_ms else 0 end as rel_ms, case when type = 'view' or event_id % 50 = 0 then 'unknown' else type end as type,
  case when event_id % 50 > 0 then source_id end as source_id, case when event_id % 50 > 0 then source_instance end as source_instance, case when event_id % 50 > 0 then target_id end as target_id,
  case when event_id % 50 > 0 then ability_game_id end as ability_game_id, case when event_id % 50 > 0 then amount end as amount,
  case when ability_game_id % 3 = 0 or event_id % 50 = 0 then null when ability_game_id % 3 = 1 then 1 else 0 end::bigint as is_tick, null::bigint as hit_type,
  case when event_id % 50 = 0 then '{"unparsed":"{\\"broken\\": ' || event_id || '"}' else '{' || case when target_id is not null then '"armor":' || target_id || ',' else '' end || '"deep":{"a":"x\\n\\"y\\"","b":[1,"2",null,{"c":1.5}]},"facing":' || (ability_game_id % 7)
    || ',"flagged":"true","note":"' || ability_game_id || '","seen":' || (ability_game_id % 2 = 0) || '}' end as extra from ev""",
)
def _(spark, sf):
    return normalize.events(_raw_events(spark, sf)).select("event_id", "rel_ms", "type", "source_id", "source_instance", "target_id", "ability_game_id", "amount", "is_tick", "hit_type", "extra")


@query("rebased_times", "select event_id, 1000 + rel_ms as abs_ms, rel_ms - source_id as run_rel_ms, rel_ms - target_id as pull_rel_ms from ev")
def _(spark, sf):
    e = B.events(spark, sf).select("event_id", "rel_ms", F.lit(1000).cast("long").alias("report_start_ms"), F.col("source_id").alias("run_start_ms"), F.col("target_id").alias("pull_start_ms"))
    return normalize.rebase(e).select("event_id", "abs_ms", "run_rel_ms", "pull_rel_ms")


@query("event_fingerprints", """select event_id, sha256('{"amount":"' || amount || '","type":"' || type || '"}') as fingerprint from ev""")
def _(spark, sf):
    body = F.create_map(F.lit("type"), "type", F.lit("amount"), F.col("amount").cast("string"))
    return B.events(spark, sf).select("event_id", F.sha2(T.canonical_json(body), 256).alias("fingerprint"))


@query(
    "normalize_reports",
    f"""select cast(c_custkey as varchar) as report_code, case when c_custkey % 5 > 0 then {hashed('c_name')} end as title_hash, case when c_custkey % 3 > 0 then 'uploader-' || {hashed('c_name')} end as owner_hash,
  1000 * c_custkey as start_time_ms, case when c_custkey % 7 = 0 then 0 else 2000 * c_custkey end as end_time_ms, n_nationkey::bigint as zone_id, n_name as zone_name, n_regionkey::bigint as region_id, lower(n_name) as region_slug,
  3::bigint as revision, null::bigint as segments, 'public' as visibility, case when c_custkey % 4 > 0 then (c_custkey % 4 = 1)::bigint end as is_archived, case when c_custkey % 4 > 0 then 1::bigint end as is_accessible,
  case when c_custkey % 4 > 0 then c_custkey::bigint end as archive_date, null::varchar as log_version, null::varchar as game_version, 12.5::double as retrieved_at, 'metadata-only' as collection_status
from customer join nation on n_nationkey = c_nationkey""",
)
def _(spark, sf):
    c = B.table(spark, sf, "customer").join(B.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    raw = c.select(
        F.col("c_custkey").cast("string").alias("code"), F.expr("case when c_custkey % 10 = 0 then null when c_custkey % 5 = 0 then '' else c_name end").alias("title"),
        F.expr("struct(case when c_custkey % 3 > 0 then c_name end as name)").alias("owner"), (F.col("c_custkey") * 1000).alias("startTime"), F.expr("case when c_custkey % 7 > 0 then 2000 * c_custkey end").alias("endTime"),
        F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("zone"), F.struct(F.col("n_regionkey").alias("id"), F.lower("n_name").alias("slug")).alias("region"),
        F.lit(3).alias("revision"), F.lit(None).cast("int").alias("segments"), F.lit("public").alias("visibility"),
        F.expr("case when c_custkey % 4 > 0 then struct(c_custkey % 4 = 1 as isArchived, true as isAccessible, c_custkey as archiveDate) end").alias("archiveStatus"), F.lit(12.5).alias("retrieved_at"),
    )
    return normalize.reports(raw, SALT)


@query(
    "normalize_runs",
    """select o_custkey || ':' || o_orderkey as run_id, o_custkey::varchar as report_code, o_orderkey::bigint as fight_id, o_orderkey * 10 as rel_start_ms, o_orderkey * 10 + 500 - o_orderkey % 1000 as rel_end_ms,
  5000 + o_orderkey * 10 as abs_start_ms, 5000 + o_orderkey * 10 + 500 - o_orderkey % 1000 as abs_end_ms, greatest(0, 500 - o_orderkey % 1000) as duration_ms, 2 + o_orderkey % 18 as keystone_level,
  case when o_orderkey % 3 > 0 then o_orderkey % 3 - 1 end as keystone_bonus, case when o_orderkey % 3 > 0 then (o_orderkey % 3 - 1 > 0)::bigint end as timed,
  case when o_orderkey % 4 > 0 then '[9,' || o_orderkey % 5 || ']' end as keystone_affixes, case when o_orderkey % 6 > 0 then '{"' || o_orderkey % 50 || '":' || o_orderkey % 6 || '}' end as npc_count_map,
  (o_orderkey % 2 = 0)::bigint as kill from orders where o_orderkey % 11 > 0""",
)
def _(spark, sf):
    fight = F.expr("""struct(o_orderkey as id, o_orderkey * 10 as startTime, o_orderkey * 10 + 500 - o_orderkey % 1000 as endTime, case when o_orderkey % 11 > 0 then 2 + o_orderkey % 18 end as keystoneLevel,
      case when o_orderkey % 3 > 0 then o_orderkey % 3 - 1 end as keystoneBonus, case when o_orderkey % 4 > 0 then array(9, o_orderkey % 5) when o_orderkey % 8 = 0 then cast(array() as array<long>) end as keystoneAffixes,
      case when o_orderkey % 6 > 0 then map(cast(o_orderkey % 50 as string), o_orderkey % 6) else cast(map() as map<string, long>) end as npcCountMap, o_orderkey % 2 = 0 as kill)""")
    return normalize.runs(B.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("report_code"), F.lit(5000).cast("long").alias("report_start_ms"), fight.alias("fight")))


@query("npc_counts_read", "select (o_orderkey % 50)::varchar as npc, count(*) as runs, cast(sum(o_orderkey % 6) as bigint) as copies from orders where o_orderkey % 6 > 0 group by 1")
def _(spark, sf):
    text = normalize.json_or_null(F.expr("case when o_orderkey % 6 > 0 then map(cast(o_orderkey % 50 as string), o_orderkey % 6) else cast(map() as map<string, long>) end"))
    read = B.table(spark, sf, "orders").select(F.explode(F.from_json(text, "map<string,long>")).alias("npc", "n"))
    return read.groupBy("npc").agg(F.count("*").alias("runs"), F.sum("n").alias("copies"))


def _master(spark: SparkSession, sf: str) -> DataFrame:
    actor = F.expr("""struct(case when c_custkey % 13 > 0 then c_custkey end as id, c_custkey % 100 as gameID, case when c_custkey % 17 > 0 then c_name end as name,
      case c_custkey % 4 when 0 then 'Player' when 1 then 'Pet' when 2 then 'NPC' else 'PlayerPet' end as type, c_mktsegment as subType, 'Mage-Frost' as icon, case when c_custkey % 4 = 1 then c_custkey - 1 end as petOwner)""")
    return B.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("report_code")).agg(F.collect_list(actor).alias("actors"))


@query(
    "normalize_actors",
    f"""select c_nationkey as report_code, c_custkey::bigint as actor_id, (c_custkey % 100)::bigint as game_id,
  case when c_custkey % 17 = 0 then null when c_custkey % 4 = 0 then 'player-' || {hashed('c_name')} when c_custkey % 4 = 2 then c_name else 'pet-' || {hashed('c_name')} end as name,
  case c_custkey % 4 when 0 then 'Player' when 1 then 'Pet' when 2 then 'NPC' else 'PlayerPet' end as type, c_mktsegment as sub_type, 'Mage-Frost' as icon,
  case when c_custkey % 4 = 1 then c_custkey - 1 end::bigint as pet_owner, (c_custkey % 4 = 0)::bigint as is_player from customer where c_custkey % 13 > 0""",
)
def _(spark, sf):
    return normalize.actors(_master(spark, sf), SALT)


@query("normalize_abilities", "select p_partkey::bigint as game_id, p_name as name, p_brand as icon, p_type as type from part where p_partkey % 9 > 0")
def _(spark, sf):
    a = F.expr("struct(case when p_partkey % 9 > 0 then p_partkey end as gameID, p_name as name, p_brand as icon, p_type as type)")
    return normalize.abilities(B.table(spark, sf, "part").groupBy("p_size").agg(F.collect_list(a).alias("abilities")))


@query(
    "normalize_roster",
    f"""select run_id, player_id as actor_id, {hashed("'Name ' || player_id")} as player_id, 'Priest' as class, case when player_id % 3 = 0 then 'Holy' when player_id % 3 = 1 then 'Shadow' end as spec,
  case when player_id % 3 = 0 then 'healer' when player_id % 3 = 1 then 'dps' end as role, null::double as item_level from ro where player_id % 5 > 1 and run_id % 3 > 0""",
)
def _(spark, sf):
    r = B.roster(spark, sf)
    raw = r.select("run_id", F.col("player_id").alias("id"), F.expr("case player_id % 5 when 0 then null when 1 then '  ' else concat('Name ', player_id) end").alias("name"), F.lit("Player").alias("type"), F.expr("case player_id % 3 when 0 then 'Holy' when 1 then 'Shadow' else '' end").alias("subType"), F.lit("Priest-Any").alias("icon"))
    return normalize.roster(raw, r.where("run_id % 3 > 0").select("run_id", F.col("player_id").alias("id")), SALT)


@query(
    "normalize_pulls",
    """, pl as (select run_id, split_part(pull_id, ':', 2)::bigint as k, rel_start_ms as s from pu),
ix as (select *, row_number() over (partition by run_id order by s, case when k % 4 > 0 then k end nulls first) - 1 as pull_index from pl),
kept as (select *, run_id || ':' || k as pull_id from ix where k % 4 > 0)
select run_id, pull_id, pull_index, (k % 3 = 0)::bigint as is_boss, s as rel_start_ms, s + 50 - k % 100 as rel_end_ms, s - run_id as run_rel_start_ms, greatest(0, 50 - k % 100) as duration_ms,
  case when k % 5 > 0 then '[' || k % 5 || ',7]' end as map_ids, case when k % 2 = 0 then '{"minX":' || k || ',"maxX":' || k + 10 || '}' end as bounding_box,
  lag(pull_id) over (partition by run_id order by pull_index) as prev_pull_id, lead(pull_id) over (partition by run_id order by pull_index) as next_pull_id from kept""",
)
def _(spark, sf):
    p = B.pulls(spark, sf).select("run_id", F.split_part("pull_id", F.lit(":"), F.lit(2)).cast("long").alias("k"), F.col("rel_start_ms").alias("s"))
    pull = F.expr("""struct(case when k % 4 > 0 then k end as id, case when k % 3 = 0 then 5 when k % 3 = 1 then 0 end as encounterID, s as startTime, s + 50 - k % 100 as endTime,
      case when k % 5 > 0 then array(struct(k % 5 as id), struct(7L as id)) else cast(array() as array<struct<id: long>>) end as maps, case when k % 2 = 0 then struct(k as minX, k + 10 as maxX) end as boundingBox)""")
    return normalize.pulls(p.select("run_id", F.col("run_id").cast("long").alias("run_start_ms"), pull.alias("pull")))


@query(
    "normalize_npcs",
    """select l_orderkey as pull_id, l_partkey::bigint as npc_game_id, l_suppkey::bigint as actor_id, case when l_linenumber % 4 > 0 then 2 end::bigint as min_instance_id, case when l_linenumber % 4 > 1 then l_linenumber end::bigint as max_instance_id,
  case l_linenumber % 4 when 0 then 1 when 1 then null else case when l_linenumber >= 2 then l_linenumber - 1 end end::bigint as instance_count, case l_linenumber % 4 when 0 then 'inferred' when 1 then 'unknown' else 'inferred' end as instance_count_confidence
from lineitem where l_partkey % 10 > 0""",
)
def _(spark, sf):
    npc = F.expr("struct(case when l_partkey % 10 > 0 then l_partkey end as gameID, l_suppkey as id, case when l_linenumber % 4 > 0 then 2 end as minimumInstanceID, case when l_linenumber % 4 > 1 then l_linenumber end as maximumInstanceID)")
    return normalize.npcs(B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pull_id"), npc.alias("npc")))


@query("repeated_species", "select l_orderkey as pull_id, l_partkey % 30 as npc_game_id, case when bool_or(l_linenumber % 4 = 3) then 'instance range' else 'listed twice' end as reason from lineitem group by 1, 2 having bool_or(l_linenumber % 4 = 3) or count(*) > 1")
def _(spark, sf):
    n = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pull_id"), (F.col("l_partkey") % 30).alias("npc_game_id"), F.expr("case when l_linenumber % 4 > 1 then 2 end").alias("min_instance_id"), F.expr("case when l_linenumber % 4 > 1 then l_linenumber % 4 end").alias("max_instance_id"))
    return probes.repeated_species(n)


# --- identities and text -----------------------------------------------------


@query(
    "json_deidentified",
    f"""select c_custkey, '{{"actors":[{{"id":' || c_custkey || ',"name":"' || case when c_custkey % 3 = 0 then 'player-' || {hashed('c_name')} else c_name end || '","type":"' || case when c_custkey % 3 = 0 then 'Player' else 'NPC' end || '"}}],"guild":"redacted-' || {hashed('c_mktsegment', 8)} || '","owner":{{"name":"uploader-' || {hashed('c_name')} || '"}}}}' as clean from customer""",
)
def _(spark, sf):
    raw = F.to_json(F.struct(F.struct(F.col("c_name").alias("name")).alias("owner"), F.col("c_mktsegment").alias("guild"), F.array(F.struct(F.col("c_custkey").alias("id"), F.expr("case when c_custkey % 3 = 0 then 'Player' else 'NPC' end").alias("type"), F.col("c_name").alias("name"))).alias("actors")))
    return B.table(spark, sf, "customer").select("c_custkey", privacy.sanitize_json(raw, SALT).alias("clean"))


@query("json_keys_redacted", """select c_custkey, '{"a":{"Token":"' || case when c_custkey % 4 = 0 then '' else '[REDACTED]' end || '"},"name":"' || c_name || '","password":"[REDACTED]"}' as clean from customer""")
def _(spark, sf):
    raw = F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("pw").alias("password"), F.struct(F.expr("case when c_custkey % 4 = 0 then '' else c_name end").alias("Token")).alias("a")))
    return B.table(spark, sf, "customer").select("c_custkey", privacy.redact_json(raw).alias("clean"))


@query("focus_candidates", f"""select c_custkey, case when c_custkey % 4 = 0 then '' when c_custkey % 4 = 1 then 'player-' || {hashed("'Ann'")} when c_custkey % 4 = 2 then 'player-' || {hashed("'Ann-' || c_name")} || ',player-' || {hashed("'Ann'")} else 'player-00112233' end as candidates from customer""")
def _(spark, sf):
    name = F.expr("case c_custkey % 4 when 0 then case when c_custkey % 8 = 0 then null else ' ' end when 1 then ' Ann ' when 2 then concat('Ann-', c_name) else 'Player-00112233' end")
    name = F.when(F.col("c_custkey") % 4 == 3, F.lower(name)).otherwise(name)
    return B.table(spark, sf, "customer").select("c_custkey", F.array_join(T.focus_candidates(name, SALT), ",").alias("candidates"))


@query("stream_labels", "select event_id, data_type || coalesce('@' || hostility, '') || '[source=' || source_id || ']' || coalesce('[target=' || target_id || ']', '') as label, data_type || coalesce('@' || hostility, '') || case when source_id % 2 = 0 then ' (focus)' else '' end as focus_label from ev")
def _(spark, sf):
    kind, host = F.col("data_type"), F.col("hostility")
    return B.events(spark, sf).select("event_id", runs.stream_label(kind, host, F.col("source_id"), F.col("target_id")).alias("label"), runs.stream_label(kind, host, focus=F.col("source_id") % 2 == 0).alias("focus_label"))


@query("unix_seconds", "select event_id, case when rel_ms * 1000 > 1e11 then rel_ms * 1000 / 1000 else rel_ms * 1000 end::double as at_s from ev")
def _(spark, sf):
    return B.events(spark, sf).select("event_id", T.seconds((F.col("rel_ms") * 1000).cast("double")).alias("at_s"))


@query("whole_numbers", "select event_id, case when ability_game_id % 3 = 0 then ability_game_id end as n, (ability_game_id % 2 = 0)::bigint as flag from ev")
def _(spark, sf):
    text = F.expr("case ability_game_id % 3 when 0 then cast(ability_game_id as string) when 1 then concat('x', ability_game_id) else '' end")
    return B.events(spark, sf).select("event_id", T.as_int(text).alias("n"), normalize.flag(F.col("ability_game_id") % 2 == 0).alias("flag"))


@query("fields_blamed", "select page_id, case when page_id % 3 = 0 then 'rating' when page_id % 3 = 1 then 'countReached' else '' end as blamed from pages")
def _(spark, sf):
    told = {i: ",".join(sorted(privacy.blamed(m, ["rating", "countReached", "count", "kill"]))) for i, m in enumerate(['Cannot query field "rating"', "unknown count_reached on type Fight", "timeout"])}
    found = F.create_map(*[F.lit(x) for kv in told.items() for x in kv])
    return B.table(spark, sf, "pages").select("page_id", found[(F.col("page_id") % 3).cast("int")].alias("blamed"))


# --- registries, lists, focus ------------------------------------------------


@query("zone_matches", "select p_name as key, case when n = 1 then 'matched' else 'ambiguous' end as state, case when n = 1 then k end as encounter_id from (select p_name, count(*) as n, min(p_partkey)::bigint as k from part group by 1 having count(distinct p_size) > 0)")
def _(spark, sf):
    p = B.table(spark, sf, "part")
    dungeons = p.select(F.col("p_name").alias("key"), F.upper("p_name").alias("display_name"), F.lit(None).cast("array<string>").alias("aliases")).distinct()
    # every encounter has a zone of its own, so names that several bear stay ambiguous
    encounters = p.select(F.col("p_partkey").cast("long").alias("zone_id"), F.col("p_partkey").cast("long").alias("encounter_id"), F.concat(F.lit(" "), "p_name").alias("name"))
    return lookups.match_zones(dungeons, encounters)


@query("overlay_merged", "select c_custkey as key, case when c_custkey % 3 = 0 then c_custkey * 10 else c_nationkey end::bigint as zone_id, c_name as display_name from customer union all select -c_custkey - 1, c_custkey * 10, null from customer where c_custkey < 20")
def _(spark, sf):
    c = B.table(spark, sf, "customer")
    base = c.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("zone_id"), F.col("c_name").alias("display_name"))
    over = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 10).alias("zone_id")).unionAll(c.where("c_custkey < 20").select((-F.col("c_custkey") - 1).alias("key"), (F.col("c_custkey") * 10).alias("zone_id")))
    return lookups.merge_overlay(base, over, ["zone_id"])


@query("profile_streams", "select distinct n_name as profile, r_name as data_type, case when n_nationkey % 2 = 0 then 'Enemies' end as hostility from nation join region on true union all select n_name, 'CombatantInfo', null from nation where n_nationkey % 3 = 0")
def _(spark, sf):
    region = B.table(spark, sf, "region").agg(F.collect_list("r_name").alias("names"))  # five rows
    n = B.table(spark, sf, "nation").join(region, how="cross")
    spec = lambda x: F.when(F.col("n_nationkey") % 2 == 0, F.concat(x, F.lit(" @ Enemies"))).otherwise(x)
    return lookups.profile_requests(n.select(F.col("n_name").alias("profile"), F.transform("names", spec).alias("event_types"), (F.col("n_nationkey") % 3 == 0).alias("include_combatant_info")))


@query("focus_resolution", "select count(*) as runs, count(a) as resolved, count(*) > 0 and count(a) = 0 as failed from (select run_id, max(player_id) filter (player_id = 11) as a from ro group by 1)")
def _(spark, sf):
    r = B.roster(spark, sf)
    found = r.where("player_id = 11").select("run_id", F.col("player_id").alias("actor_id"))
    return probes.focus_resolution(r, found)


@query("zones_newest_first", "select case when c_custkey % 10 > 0 then c_custkey end as id, c_name as name from customer")
def _(spark, sf):
    return fixtures.newest_first(B.table(spark, sf, "customer").select(F.expr("case when c_custkey % 10 > 0 then c_custkey end").alias("id"), F.col("c_name").alias("name")))


@query("listing_codes", "select 'code' || o_custkey as report_code, 'guild' as source_type, 'seed' as seed, row_number() over (order by min(o_orderkey)) - 1 as rank, (min(o_orderkey) // 1000)::bigint as page from orders group by o_custkey")
def _(spark, sf):
    o = B.table(spark, sf, "orders").withColumn("page", F.floor(F.col("o_orderkey") / 1000))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))), lambda x: F.concat(F.lit("code"), x["o_custkey"].cast("string")))
    return reports.from_listing(o.groupBy("page").agg(codes.alias("codes")).withColumn("has_more_pages", F.lit(True)), "guild", "seed")


# --- events, probes, pages ---------------------------------------------------


@query("enemy_casts", "select event_id from ev where type in ('purchase', 'click') and hostility = 'Enemies' and ability_game_id is not null and target_id is not null")
def _(spark, sf):
    e = B.events(spark, sf).withColumn("type", F.when(F.col("type").isin("purchase", "click"), "cast").otherwise("begincast")).withColumn("source_id", F.col("target_id"))
    return casts.enemy_casts(e).select("event_id")


@query("events_in_order", "select run_id, rel_ms, event_id from ev order by run_id, rel_ms, event_id")
def _(spark, sf):
    return fixtures.ordered_events(B.events(spark, sf).select("run_id", "rel_ms", "event_id"))


@query("pages_in_order", "select run_id, data_type, page_index, event_count from pg order by run_id, data_type, page_index")
def _(spark, sf):
    return fixtures.ordered_pages(B.pages(spark, sf)).select("run_id", "data_type", "page_index", "event_count")


@query("streams_by_cost", "select data_type as label, cast(sum(event_count) as bigint) as events, count(*) as pages from pg group by 1 order by events desc, label")
def _(spark, sf):
    return fixtures.costliest(B.pages(spark, sf).groupBy(F.col("data_type").alias("label")).agg(F.sum("event_count").alias("events"), F.count("*").alias("pages")))


@query("probe_type_tally", "select cast(source_instance as varchar) as value, count(*) as rows from ev group by 1")
def _(spark, sf):
    return probes.tally(B.events(spark, sf), "source_instance")


@query("probe_sample_summary", "select count(*) as events, count(distinct source_id) as sources, count(source_instance) as with_instance, cast(sum(octet_length(encode(props))) as bigint) as bytes, (select count(distinct k) from (select unnest(json_keys(props)) as k from ev)) as keys, sum(octet_length(encode(props))) / count(*) as bytes_per_event from ev")
def _(spark, sf):
    return probes.sample_summary(B.events(spark, sf), "props")


@query("streams_shared", """, a as (select amount, type, count(*) as n from ev where hostility = 'Enemies' group by 1, 2), b as (select amount, type, count(*) as n from ev where hostility = 'Friendlies' group by 1, 2)
select (select sum(n) from a)::bigint as left_rows, (select sum(n) from b)::bigint as right_rows, (select sum(least(a.n, b.n)) from a join b using (amount, type))::bigint as shared""")
def _(spark, sf):
    e = B.events(spark, sf)
    return probes.same_stream(e.where("hostility = 'Enemies'"), e.where("hostility = 'Friendlies'"), ["amount", "type"])


@query("collection_summary", "select count(*) as runs, count(*) filter (collection_status = 'complete') as complete, count(*) filter (collection_status = 'metadata-only') as failed, cast(sum(run_id % 7) as bigint) as events, cast(sum(run_id % 3) as bigint) as pages from ru")
def _(spark, sf):
    r = B.runs(spark, sf)
    status = F.when(F.col("collection_status") == "metadata-only", "malformed").otherwise(F.col("collection_status"))
    return probes.collection_summary(r.select(status.alias("status"), (F.col("run_id") % 7).alias("events"), (F.col("run_id") % 3).alias("pages")))


@query("pages_progress_faults", "select run_id, data_type, page_index, case when c < b then 'backwards' else 'stalled' end as fault from (select *, lag(c) over (partition by run_id, data_type order by page_index) as b from (select *, case when page_index % 3 = 2 then last_ms - 100000000 when page_index % 5 = 4 then 0 else last_ms end as c, case when page_index % 2 = 0 then 0 else event_count end as n from pg)) where c < b or c = b and n = 0")
def _(spark, sf):
    p = B.pages(spark, sf).withColumn("next_cursor_ms", F.expr("case when page_index % 3 = 2 then last_ms - 100000000 when page_index % 5 = 4 then 0 else last_ms end"))
    return costs.progress_faults(p.withColumn("event_count", F.expr("case when page_index % 2 = 0 then 0 else event_count end")))


@query("api_points", f"select count(*) as jobs, sum(cast(p as double)) as points, cast(sum(r) as bigint) as runs, sum(cast(p as double)) / sum(r) as points_per_run from (select ability_game_id as p, 1 + ability_game_id % 5 as r from ev where ability_game_id % 4 in (0, 1) and type = 'click')")
def _(spark, sf):
    detail = F.expr("""case ability_game_id % 4 when 2 then '{broken' when 3 then '{"runs": 2}' else concat('{"points": ', ability_game_id, ', "runs": ', 1 + ability_game_id % 5, '}') end""")
    return costs.api_points(B.events(spark, sf).select(F.when(F.col("type") == "click", "api-cost").otherwise("other").alias("kind"), detail.alias("detail")))


@query("diagnostics_by_kind", _SCORED + "select 'duplicate_candidate' as kind, 'info' as severity, count(*) as n from hit having count(*) > 0")
def _(spark, sf):
    return T.diagnostics_by_kind(duplicates.diagnostics(scored_pairs(spark, sf)))


# --- fixtures ----------------------------------------------------------------

_FIXED = ASSIGNED + """
, fx as (
  select p.pull_id, p.run_id, ru.dungeon_key, ru.keystone_level, (p.run_id % 2 = 0)::int as is_boss, p.rel_end_ms - p.rel_start_ms as duration_ms, count(eva.event_id) as events
  from pu p join ru using (run_id) left join eva on eva.pull_id = p.pull_id where coalesce(ru.is_canonical, 1) <> 0 group by all having count(eva.event_id) >= 1
  order by is_boss desc, events desc, p.pull_id limit 40
)
"""
_HAVE = ", have as (select run_id, string_agg(data_type, ',' order by data_type) as streams from cov where status = 'ok' group by 1), st as (select fx.*, coalesce(streams, '') as streams from fx left join have using (run_id))\n"


def _fixtures(spark, sf):
    kept = runs.RunSet.select(B.runs(spark, sf), runs.DedupePolicy.PERMISSIVE).included
    p = B.pulls(spark, sf).withColumns({"is_boss": F.expr("cast(run_id % 2 = 0 as int)"), "duration_ms": F.expr("rel_end_ms - rel_start_ms")})
    return fixtures.select(kept, p, assigned(spark, sf), min_events=1, limit=40)


@query("fixtures_selected", _FIXED + "select * from fx")
def _(spark, sf):
    return _fixtures(spark, sf)


@query("fixtures_by_coverage", _FIXED + COVERAGE + _HAVE + "select streams, count(*) as fixtures, cast(sum(events) as bigint) as events, min(pull_id) as example from st group by 1")
def _(spark, sf):
    return fixtures.by_coverage(fixtures.streams(_fixtures(spark, sf), coverage(spark, sf)))


@query(
    "fixtures_concatenated",
    _FIXED + COVERAGE + _HAVE + """, best as (select streams from st group by 1 order by case when streams = '' then 0 else len(string_split(streams, ',')) end desc, count(*) desc, streams limit 1)
select row_number() over (order by pull_id, rel_ms, event_id) - 1 as seq, pull_id, event_id, rel_ms from eva where pull_id in (select pull_id from st semi join best using (streams))""",
)
def _(spark, sf):
    chosen = fixtures.widest(fixtures.streams(_fixtures(spark, sf), coverage(spark, sf)))
    one = fixtures.concatenated(chosen, assigned(spark, sf).select("pull_id", "event_id", "rel_ms"))
    # one timeline of at most 40 pulls
    return one.select((F.row_number().over(W.orderBy("seq")) - 1).cast("long").alias("seq"), "pull_id", "event_id", "rel_ms")


# --- derivations -------------------------------------------------------------

@query("coverage_digests", COVERAGE + f", r as (select run_id, sha256({' || '.join(map(_F, ['data_type', 'pages', 'events', 'status']))}) as d from cov) select run_id, sha256(string_agg(d, '' order by d)) as coverage_digest, count(*) as streams from r group by 1")
def _(spark, sf):
    return fingerprints.coverage_component(runs.coverage_rows(B.pages(spark, sf)))


@query("derivation_runs", _DIGESTS + "select 'd1' as derivation_id, run_id, digest as run_digest from dg")
def _(spark, sf):
    return fingerprints.begin("d1", "test", _digests(spark, sf), "strict")[1]


@query(
    "derivation_finished",
    _DIGESTS + """, g as (select substr(digest, 1, 3) as g, count(*) as n, sha256(string_agg(digest, '' order by digest)) as d from dg group by 1)
select 'd1' as derivation_id, 'test' as kind, 'complete' as status, 7.5::double as finished_at, sha256(string_agg(d, '' order by d)) as corpus_fingerprint, 'page' as fingerprint_grade, 1 as fingerprint_version, cast(sum(n) as bigint) as run_count, 'strict' as dedupe_policy from g""",
)
def _(spark, sf):
    return fingerprints.finish(fingerprints.begin("d1", "test", _digests(spark, sf), "strict")[0], "d1", 7.5)


@query("derivation_exclusions", "select 'd1' as derivation_id, run_id, case when run_id % 2 = 0 then 'by hand' when is_canonical is null then 'unclassified' else 'duplicate' end as reason, case when run_id % 2 = 0 then 'again' end as detail from ru where coalesce(is_canonical, 0) = 0")
def _(spark, sf):
    left_out = runs.RunSet.select(B.runs(spark, sf), runs.DedupePolicy.STRICT).exclusions
    none = spark.createDataFrame([], "derivation_id string, run_id long, reason string, detail string")
    once = fingerprints.exclude(none, "d1", left_out)
    return fingerprints.exclude(once, "d1", left_out.where("run_id % 2 = 0").select("run_id", F.lit("by hand").alias("reason"), F.lit("again").alias("detail")))


# --- sinks and streams -------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/emberlog-{uuid.uuid4().hex}-{name}"


@query("sink_replaced_pulls", "select pull_id, run_id, case when run_id % 8 = 3 then 0 else rel_start_ms end as rel_start_ms, run_id % 8 as part from pu where not (run_id % 8 = 3 and run_id % 3 = 0)")
def _(spark, sf):
    path = _folder(spark, "pulls")
    p = B.pulls(spark, sf).select("pull_id", "run_id", "rel_start_ms", (F.col("run_id") % 8).alias("part"))
    sinks.replace_partitions(p, path, ["part"])
    for _ in range(2):  # a second time changes nothing
        sinks.replace_partitions(p.where("part = 3 and run_id % 3 <> 0").withColumn("rel_start_ms", F.lit(0).cast("long")), path, ["part"])
    return spark.read.schema(p.schema).parquet(path)


@query("sink_reset_run", "select data_type, count(*) as events from ev where run_id <> 5 group by 1")
def _(spark, sf):
    left, _ = sinks.reset_run(B.events(spark, sf), 5)
    return left.groupBy("data_type").agg(F.count("*").alias("events"))


@query("sink_merge_seen", "select c_custkey as key, case when c_custkey % 2 = 0 then 'later' else c_name end as name, least(10, case when c_custkey % 2 = 0 then c_custkey else 10 end)::bigint as first_seen, greatest(20, case when c_custkey % 2 = 0 then 20 + c_custkey else 20 end)::bigint as last_seen from customer")
def _(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(10).cast("long").alias("first_seen"), F.lit(20).cast("long").alias("last_seen"))
    new = c.where("key % 2 = 0").select("key", F.lit("later").alias("name"), F.col("key").cast("long").alias("first_seen"), (F.col("key") + 20).cast("long").alias("last_seen"))
    return sinks.merge_seen(c, new, "key")


@query("sink_diagnostics", "select run_id, 'note' as kind, 'info' as severity from ru union all select run_id, 'again', 'warning' from ru where run_id % 2 = 0")
def _(spark, sf):
    path = _folder(spark, "diagnostics")
    told = lambda df, kind, severity: df.select(F.lit("j").alias("job_id"), "run_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("detail"), F.lit(1.0).alias("created_at"))
    first = told(B.runs(spark, sf), "note", "info")
    sinks.append_diagnostics(first, path)
    sinks.append_diagnostics(told(B.runs(spark, sf).where("run_id % 2 = 0"), "again", "warning"), path)
    return spark.read.schema(first.schema).parquet(path).select("run_id", "kind", "severity")


@query("stream_page_commits", "select event_type as stream, (event_id // 5000)::bigint as page_index, count(*) as rows, count(distinct sha256(json(props)::varchar)) as fingerprints from events group by 1, 2")
def _(spark, sf):
    path, checkpoint = _folder(spark, "pages"), _folder(spark, "pages-checkpoint")
    schema = B.table(spark, sf, "events").schema
    for _ in range(2):  # started again, it goes on behind what it has committed
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        rows = rows.select(F.col("event_type").alias("stream"), F.floor(F.col("event_id") / 5000).alias("page_index"), (F.col("event_id") % 5000).alias("seq_in_page"), F.col("props").alias("raw"))
        page_stream.commit(rows, path, checkpoint).awaitTermination()
    return page_stream.committed(spark, path).groupBy("stream", "page_index").agg(F.count("*").alias("rows"), F.countDistinct("fingerprint").alias("fingerprints"))


def _sent_pages(spark: SparkSession, sf: str, size: int = 500) -> DataFrame:
    """Events of each type in pages, sent as a source sends them: a page begins with all events at its cursor, so those
    that the page before held come again; behind every page stands an empty one."""
    w = W.partitionBy("type").orderBy("rel_ms", "event_id")
    e = B.events(spark, sf).select("type", "rel_ms", "event_id", F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("page"))
    last = e.groupBy("type", "page").agg(F.max("rel_ms").alias("cursor"))
    again = e.join(last.withColumnsRenamed({"page": "of", "cursor": "at"}), "type").where("rel_ms = at and page <= of").select("type", "rel_ms", "event_id", (F.col("of") + 1).alias("page"), F.lit(0).alias("part"))
    more = last.select("type", F.col("page")).alias("p").join(last.select("type", (F.col("page") - 1).alias("page")).alias("q"), ["type", "page"], "left_semi")  # pages with one behind
    sent = e.withColumn("part", F.lit(1)).unionByName(again.join(more.select("type", (F.col("page") + 1).alias("page")), ["type", "page"], "left_semi"))
    seq = F.row_number().over(W.partitionBy("type", "page").orderBy("part", "rel_ms", "event_id")).cast("long")
    rows = sent.withColumn("seq_in_page", seq).join(last, ["type", "page"])
    raw = F.to_json(F.struct("event_id"))
    full = rows.select(F.col("type").alias("stream"), (F.col("page") * 2).alias("page_index"), "seq_in_page", F.lit(None).cast("long").alias("cursor_ms"), F.col("cursor").alias("next_cursor_ms"), "rel_ms", raw.alias("raw"))
    none = F.lit(None).cast("long")
    empty = last.select(F.col("type").alias("stream"), (F.col("page") * 2 + 1).alias("page_index"), none.alias("seq_in_page"), none.alias("cursor_ms"), F.col("cursor").alias("next_cursor_ms"), none.alias("rel_ms"), F.lit(None).cast("string").alias("raw"))
    return full.unionByName(empty)


@query("stream_boundaries", "select type as stream, rel_ms, '{\"event_id\":' || event_id || '}' as raw, null::varchar as note from ev")
def _(spark, sf):
    sent, kept, checkpoint = (_folder(spark, name) for name in ("sent", "boundaries", "boundaries-checkpoint"))
    _sent_pages(spark, sf).repartition(6, "stream", "page_index").write.parquet(sent)  # pages come in any order
    for _ in range(2):  # started again, it goes on from its state
        pages = spark.readStream.schema(page_stream.ROW).option("maxFilesPerTrigger", 2).parquet(sent)
        page_stream.write_available(page_stream.without_repeats(pages, gap_ms=86_400_000), kept, checkpoint).awaitTermination()
    return spark.read.schema(page_stream.KEPT).parquet(kept).select("stream", "rel_ms", "raw", "note")
