"""Queries of what is derived from events: states, outcomes, casts and their causes, waits, copies, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import keyed, text
from emberlog.operators import archetypes, builds, states, views
from emberlog.plans import bindings as B
from emberlog.registry import query

DAY, HOUR = 86_400_000, 3_600_000
#: Runs of the tables last a month; a quarter of a day is a stretch.
STRETCH = 6 * HOUR


def _moments(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are the moments that are asked about; a run's data end with its last event."""
    e = B.events(spark, sf)
    ends = e.groupBy("run_id").agg(F.max("rel_ms").alias("end_ms"))
    return e.where("type = 'error'").select("run_id", "event_id", "rel_ms").join(ends, "run_id", "left")


_SEEN = "last_value(case when type = '{0}' then struct_pack(a := rel_ms, v := amount) end ignore nulls) over w as {0}"
_STATES = f"""
, known as (select *, {_SEEN.format('purchase')}, {_SEEN.format('signup')}, row_number() over () as n from ev
  window w as (partition by run_id order by rel_ms, (type not in ('purchase', 'signup'))::int, event_id rows between unbounded preceding and current row))
select run_id, event_id, rel_ms, case when rel_ms - purchase.a <= {DAY} then purchase.v end as purchase, purchase.v as purchase_last, rel_ms - purchase.a as purchase_age_ms,
  case when purchase is null then 'unknown' when rel_ms - purchase.a <= {DAY} then 'observed' else 'stale' end as purchase_status,
  signup.v as signup, signup.v as signup_last, rel_ms - signup.a as signup_age_ms, case when signup is null then 'unknown' else 'observed' end as signup_status
from known where type = 'error'
"""


@query("state_fields", _STATES)
def _(spark, sf):
    seen = B.events(spark, sf).where("type in ('purchase', 'signup')").select("run_id", "rel_ms", F.col("event_id").alias("seq"), F.col("type").alias("field"), F.col("amount").alias("value"))
    return states.states(_moments(spark, sf).drop("end_ms"), seen, ["run_id"], {"purchase": DAY, "signup": None}, STRETCH)


@query(
    "state_outcomes",
    f""", mo as (select run_id, event_id, rel_ms from ev where type = 'error'), fin as (select run_id, max(rel_ms) as end_ms from ev group by 1)
select mo.run_id, event_id, h as horizon_ms, least(h, end_ms - rel_ms) as actual_ms, rel_ms + h > end_ms as truncated,
  (select count(*) from ev x where x.run_id = mo.run_id and x.type = 'signup' and x.rel_ms > mo.rel_ms and x.rel_ms <= mo.rel_ms + h) as deaths,
  (select cast(coalesce(sum(amount), 0) as bigint) from ev x where x.run_id = mo.run_id and x.type = 'purchase' and x.rel_ms > mo.rel_ms and x.rel_ms <= mo.rel_ms + h) as damage
from mo join fin using (run_id), (values ({HOUR}::bigint), ({DAY}), ({7 * DAY})) t(h)""",
)
def _(spark, sf):
    happened = B.events(spark, sf).select("run_id", "rel_ms", F.expr("int(type = 'signup')").alias("died"), F.expr("if(type = 'purchase', amount, 0)").alias("hurt"))
    return states.outcomes(_moments(spark, sf), happened, ["run_id"], "event_id", [HOUR, DAY, 7 * DAY], {"deaths": "died", "damage": "hurt"}, "end_ms", STRETCH)


@query(
    "state_windows",
    f""", mo as (select run_id, event_id, rel_ms from ev where type = 'error')
select mo.run_id, event_id, w as window_ms, (select count(*) from ev x where x.run_id = mo.run_id and x.type = 'signup' and abs(x.rel_ms - mo.rel_ms) <= w) as deaths,
  (select count(*) from ev x where x.run_id = mo.run_id and x.type = 'click' and abs(x.rel_ms - mo.rel_ms) <= w) as casts from mo, (values ({HOUR}::bigint), ({3 * HOUR}), ({5 * HOUR})) t(w)""",
)
def _(spark, sf):
    happened = B.events(spark, sf).select("run_id", "rel_ms", F.expr("int(type = 'signup')").alias("died"), F.expr("int(type = 'click')").alias("cast"))
    return states.around(_moments(spark, sf), happened, ["run_id"], "event_id", [HOUR, 3 * HOUR, 5 * HOUR], {"deaths": "died", "casts": "cast"}, STRETCH)


# --- casts -------------------------------------------------------------------

CAST = ["run_id", "source_instance", "ability"]
ACTOR = CAST[:2]
WINDOW = 6 * HOUR


def _kind(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return B.events(spark, sf).where(F.col("type") == name).select("run_id", "source_instance", (F.col("ability_game_id") % 3).alias("ability"), "event_id", "rel_ms")


def _casts(spark, sf):
    """Views start a cast, errors interrupt it, clicks end it."""
    return [_kind(spark, sf, k) for k in ("view", "error", "click")]


_LINE = f"""
, line as (select run_id, source_instance, ability_game_id % 3 as ability, event_id, rel_ms, case type when 'view' then 0 when 'error' then 1 else 2 end as kind from ev where type in ('view', 'error', 'click')),
nb as (select *, lag(kind) over w as kind0, lag(event_id) over w as id0, lag(rel_ms) over w as ms0, lead(kind) over w as kind1, lead(event_id) over w as id1, lead(rel_ms) over w as ms1
  from line window w as (partition by run_id, source_instance, ability order by rel_ms, kind, event_id)),
oc as (select run_id, source_instance, ability, event_id, rel_ms, case when ms1 - rel_ms <= {WINDOW} then case kind1 when 2 then 'completed' when 1 then 'interrupted' else 'incomplete' end else 'incomplete' end as outcome, id1, ms1 from nb where kind = 0)
"""


@query("cast_interrupts", _LINE + f"select run_id, source_instance, ability, event_id, rel_ms, case when kind0 = 0 and rel_ms - ms0 <= {WINDOW} then id0 end as start_id, case when kind0 = 0 and rel_ms - ms0 <= {WINDOW} then rel_ms - ms0 end as delay_ms from nb where kind = 1")
def _(spark, sf):
    return views.linked_interrupts(*_casts(spark, sf), CAST, WINDOW, STRETCH)


@query("cast_occurrences", _LINE + "select run_id, source_instance, ability, event_id, rel_ms, outcome, case when outcome <> 'incomplete' then id1 end as outcome_id, case when outcome <> 'incomplete' then ms1 end as outcome_ms from oc")
def _(spark, sf):
    return views.occurrences(*_casts(spark, sf), CAST, WINDOW, STRETCH)


@query(
    "cast_causes",
    _LINE + f""", ca as (select *, (select min(d.rel_ms) from ev d where d.type = 'signup' and d.run_id = oc.run_id and d.source_instance is not distinct from oc.source_instance and d.rel_ms between oc.rel_ms and oc.rel_ms + {WINDOW}) as death_ms,
  (select min(d.rel_ms) from ev d where d.type = 'purchase' and d.run_id = oc.run_id and d.source_instance is not distinct from oc.source_instance and d.rel_ms between oc.rel_ms and oc.rel_ms + {WINDOW}) as control_ms
  from oc where outcome <> 'completed'),
cc as (select *, case when outcome = 'interrupted' then 'interrupt' when death_ms is not null then 'death' when control_ms is not null then 'control' else 'unknown' end as cause from ca)
select run_id, source_instance, ability, event_id, rel_ms, cause, case cause when 'control' then 'medium' when 'unknown' then 'unknown' else 'high' end as confidence, case when cause = 'interrupt' then id1 end as interrupt_id, death_ms, control_ms from cc""",
)
def _(spark, sf):
    casts = views.occurrences(*_casts(spark, sf), CAST, WINDOW, STRETCH)
    return views.causes(casts, _kind(spark, sf, "signup"), _kind(spark, sf, "purchase"), ACTOR, WINDOW, STRETCH)


def _waits(spark, sf):
    e = B.events(spark, sf)
    ends = e.groupBy("run_id").agg(F.max("rel_ms").alias("end_ms"))
    return views.recasts(_kind(spark, sf, "click").join(ends, "run_id"), _kind(spark, sf, "signup"), ACTOR, "ability", "end_ms", STRETCH)


_WAITS = """
, fin as (select run_id, max(rel_ms) as end_ms from ev group by 1),
cl as (select run_id, source_instance, ability_game_id % 3 as ability, event_id, rel_ms, lead(rel_ms) over (partition by run_id, source_instance, ability_game_id % 3 order by rel_ms, event_id) as next_ms from ev where type = 'click'),
un as (select cl.*, end_ms, (select min(d.rel_ms) from ev d where d.type = 'signup' and d.run_id = cl.run_id and d.source_instance is not distinct from cl.source_instance and d.rel_ms >= cl.rel_ms) as death_ms from cl join fin using (run_id)),
wt as (select run_id, source_instance, ability, event_id, rel_ms, case least(next_ms, death_ms, end_ms) when next_ms then 'recast' when death_ms then 'death' else 'end' end as ended_by, least(next_ms, death_ms, end_ms) - rel_ms as duration_ms from un),
ds as (select ability, duration_ms, count(*) filter (ended_by = 'recast') as recasts, count(*) as n from wt group by 1, 2),
rk as (select ability, duration_ms, recasts, cast(sum(n) over (partition by ability order by duration_ms desc) as bigint) as at_risk from ds),
cv as (select ability, duration_ms, at_risk, recasts, round(case when bool_or(recasts = at_risk) over w then 0 else exp(sum(case when recasts < at_risk then ln(1 - recasts / at_risk) else 0 end) over w) end, 6) as waiting
  from rk where recasts > 0 window w as (partition by ability order by duration_ms))
"""


@query("recast_waits", _WAITS + "select * from wt")
def _(spark, sf):
    return _waits(spark, sf)


@query("recast_survival", _WAITS + "select * from cv")
def _(spark, sf):
    return views.survival(_waits(spark, sf), ["ability"])


@query("recast_medians", _WAITS + "select ability, min(duration_ms) filter (waiting <= 0.5) as median_ms from cv group by 1")
def _(spark, sf):
    return views.median_waits(views.survival(_waits(spark, sf), ["ability"]), ["ability"])


# --- copies, names, rates ----------------------------------------------------


@query(
    "resolved_instances",
    """, cp as (select run_id, ability_game_id % 5 as npc, min(source_instance) as low, max(source_instance) as high, bool_or(source_instance is null) as open from ev where type = 'purchase' group by 1, 2)
select event_id, source_instance, case when source_instance is not null then source_instance when not open and low = high then low end as resolved,
  case when source_instance is not null then 'told' when open is null then 'not listed' when open then 'range unknown' when low = high then 'only copy' else 'several copies' end as how
from ev left join cp on cp.run_id = ev.run_id and cp.npc = ability_game_id % 5""",
)
def _(spark, sf):
    e = B.events(spark, sf).withColumn("npc", F.col("ability_game_id") % 5)
    listed = e.where("type = 'purchase'").select("run_id", "npc", F.col("source_instance").alias("min_instance_id"), F.col("source_instance").alias("max_instance_id"))
    return views.resolved_instances(e, listed, ["run_id", "npc"], "source_instance").select("event_id", "source_instance", "resolved", "how")


_PAD = "xor(rpad(hex(encode({0})), 128, '0').unhex()::bit, repeat('{1}', 64).unhex()::bit)::blob"


@query(
    "export_pseudonyms",
    f"select c_custkey, 'p-' || substr(sha256({_PAD.format('c_mktsegment', '5C')} || sha256({_PAD.format('c_mktsegment', '36')} || encode(c_name)).unhex()), 1, 16) as pseudonym from customer",
)
def _(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", keyed.export_pseudonym(F.col("c_mktsegment"), F.col("c_name")).alias("pseudonym"))


_RATES = """
, st as (select type, source_instance, 'hostility' as field, hostility as value from ev union all select type, source_instance, 'target_id', target_id::varchar from ev),
ct as (select 'type' as context, type, null::bigint as source_instance, field, value, count(*) as n from st group by all
  union all select 'source_instance', null, source_instance, field, value, count(*) from st group by all
  union all select 'type,source_instance', type, source_instance, field, value, count(*) from st group by all),
rt as (select *, cast(sum(n) over (partition by context, field, type, source_instance) as bigint) as "of" from ct)
"""


@query("field_base_rates", _RATES + 'select *, round(n / "of", 6) as rate from rt')
def _(spark, sf):
    return views.base_rates(B.events(spark, sf), ["type", "source_instance"], ["hostility", "target_id"])


@query("field_entropy", _RATES + 'select context, field, round(abs(sum(-(n / total) * log2(n / "of"))), 4) as bits from (select *, sum(n) over (partition by context, field) as total from rt) group by 1, 2')
def _(spark, sf):
    return views.field_entropy(views.base_rates(B.events(spark, sf), ["type", "source_instance"], ["hostility", "target_id"]))


@query(
    "iso_instants",
    r""", t as (select stamp_id, raw, regexp_extract(raw, '^([0-9]{4})-?([0-9]{2})-?([0-9]{2})([T ]([0-9]{2}):([0-9]{2}):([0-9]{2}))?(Z|[+-][0-9]{2}:?[0-9]{2})?$', ['y', 'm', 'd', 'hms', 'h', 'mi', 's', 'z']) as g from stamps)
select stamp_id, case when raw is not null and g.y <> '' and (raw like '____-__-__%' or raw not like '%-%') then
  epoch_ms(try_cast(g.y || '-' || g.m || '-' || g.d || ' ' || case when g.hms <> '' then g.h || ':' || g.mi || ':' || g.s else '00:00:00' end as timestamp))
  - case when g.z in ('', 'Z') then 0 else (case g.z[1] when '-' then -1 else 1 end) * (g.z[2:3]::bigint * 60 + g.z[-2:]::bigint) * 60000 end end as at_ms from t""",
)
def _(spark, sf):
    return B.table(spark, sf, "stamps").select("stamp_id", text.iso_millis(F.col("raw")).alias("at_ms"))


# --- archetypes and builds ---------------------------------------------------


def _packs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pulls = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pull_id"), F.expr("case when o_orderkey % 41 = 0 then null else o_orderpriority end").alias("dungeon_key"))
    npcs = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pull_id"), (F.col("l_partkey") % 200).alias("npc_game_id"), F.expr("case when l_linenumber % 4 = 0 then null else 1 + cast(l_quantity as bigint) % 3 end").alias("instance_count"))
    return pulls, npcs


_PACKS = """
, ee as (select l_orderkey as pull_id, l_partkey % 200 as npc, cast(sum(case when l_linenumber % 4 = 0 then 1 else 1 + cast(l_quantity as bigint) % 3 end) as bigint) as n from lineitem group by 1, 2),
ph as (select pull_id, list(struct_pack(npc_game_id := npc, n := n) order by npc) as sp, cast(sum(n) as bigint) as size from ee group by 1),
pn as (select o_orderkey as pull_id, case when o_orderkey % 41 = 0 then null else o_orderpriority end as dungeon, sp, size,
  sha256('{"dungeon_key":' || coalesce('"' || case when o_orderkey % 41 = 0 then null else o_orderpriority end || '"', 'null') || ',"species":[' || array_to_string(list_transform(sp, lambda x: '{"npc_game_id":' || x.npc_game_id || ',"n":' || x.n || '}'), ',') || ']}') as node
  from orders join ph on pull_id = o_orderkey),
nd as (select node, any_value(dungeon) as dungeon, any_value(sp) as sp, any_value(size) as size, count(*) as pulls from pn group by 1),
nx as (select node, dungeon, size, unnest(sp) as x from nd),
co as (select p.node as a, q.node as b, any_value(p.size) as sa, any_value(q.size) as sb, cast(sum(least(p.x.n, q.x.n)) as bigint) as shared from nx p join nx q on p.dungeon is not distinct from q.dungeon and p.x.npc_game_id = q.x.npc_game_id and p.node < q.node and 5 * least(p.size, q.size) >= 4 * greatest(p.size, q.size) group by 1, 2),
lk as (select a, b, shared, sa + sb - shared as either from co where 5 * shared >= 4 * (sa + sb - shared))
"""


@query("pull_likenesses", _PACKS + "select a, b, shared, either from lk")
def _(spark, sf):
    return archetypes.similar(archetypes.compositions(*_packs(spark, sf))[1])


@query(
    "pull_archetypes",
    _PACKS + """, bo as (select a, b, round(shared / either, 6) as s from lk union all select b, a, round(shared / either, 6) from lk),
re as (select a, b from bo union select re.a, bo.b from re join bo on re.b = bo.a),
lb as (select node, coalesce(least(node, min(b)), node) as label, any_value(sp) as sp, any_value(size) as size, any_value(pulls) as pulls from nd left join re on re.a = node group by node),
ne as (select lb.*, pulls + coalesce((select round(sum(s * o.pulls), 4) from bo join nd o on o.node = bo.b where bo.a = lb.node), 0) as near from lb),
md as (select label, arg_min(node, struct_pack(x := -near, y := node)) as archetype_id, cast(sum(pulls) as bigint) as members from ne group by 1),
mt as (select ne.node, archetype_id, members, ne.sp, ne.size, c.sp as core, c.size as core_size,
  cast(list_sum(list_transform(ne.sp, lambda x: least(x.n, coalesce(list_filter(c.sp, lambda y: y.npc_game_id = x.npc_game_id)[1].n, 0)))) as bigint) as shared
  from ne join md using (label) join nd c on c.node = archetype_id)
select pull_id, archetype_id, case when mt.node = archetype_id then 'exact' when list_transform(mt.sp, lambda x: x.npc_game_id) = list_transform(core, lambda x: x.npc_game_id) then 'species' else 'fuzzy' end as match_kind,
  round(1 - shared / (mt.size + core_size - shared), 6) as distance, members from pn join mt on mt.node = pn.node""",
)
def _(spark, sf):
    return archetypes.archetypes(*_packs(spark, sf))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of two shapes: talents and items as numbers, or as objects; some places empty, some without stats."""
    p = B.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("long").alias("k"))
    plain = F.expr("""concat('{"specID":', k % 40, ',"itemLevel":', 600 + k % 50, '.5,"talents":[', k % 3, ',', k % 2, '],"gear":[', array_join(transform(sequence(0, 13), i -> string(case when i > 11 then 900 + (k + i) % 3 else i % (1 + k % 4) end)), ','), ']}')""")
    told = F.expr("""concat('{"specID":', k % 40, ',"talents":[{"id":', k % 2, ',"rank":1},{"id":', k % 3, '}],"gear":[', array_join(transform(sequence(0, 13), i -> concat('{"id":', case when i > 11 then 900 + (k + i) % 3 else i % (1 + k % 4) end, '}')), ','), '],"stats":{"haste":', k % 7 * 100 + 5, ',"crit":', k % 5 * 99, '}}')""")
    return p.withColumn("raw", F.when(F.col("k") % 97 == 0, "none").when(F.col("k") % 2 == 0, plain).otherwise(told)).select("p_partkey", "raw")


_CUT = "substr(sha256({}), 1, 16)"


@query(
    "build_dimensions",
    f""", b as (select p_partkey, p_partkey::bigint as k from part),
w as (select *, k % 97 <> 0 as told, list_transform(range(0, 14), lambda i: struct_pack(slot := case when i > 11 then 12 else i end, id := case when i > 11 then 900 + (k + i) % 3 else i % (1 + k % 4) end)) as items from b),
h as (select *, list_sort(list_filter(items, lambda x: x.id <> 0)) as worn, least(900 + (k + 12) % 3, 900 + (k + 13) % 3) as lo, greatest(900 + (k + 12) % 3, 900 + (k + 13) % 3) as hi from w),
d as (select *, {_CUT.format("least(k % 3, k % 2) || ':1,' || greatest(k % 3, k % 2) || ':1'")} as th,
  {_CUT.format("'[' || array_to_string(list_transform(worn, lambda x: '{\"slot\":' || x.slot || ',\"id\":' || x.id || ',\"gems\":[]}'), ',') || ']'")} as eh, {_CUT.format("lo || ',' || hi")} as rh,
  case when k % 2 = 1 then {_CUT.format("'[{\"stat\":\"crit\",\"bucket\":' || (k % 5 * 99 // 100) || '},{\"stat\":\"haste\",\"bucket\":' || (k % 7) || '}]'")} end as sh from h)
select p_partkey, case when told then k % 40 end as spec_id, case when told and k % 2 = 0 then 600 + k % 50 + 0.5::double end as item_level, case when told then th end as talent_hash, case when told then eh end as equipment_hash,
  case when told then lo end as trinket_low, case when told then hi end as trinket_high, case when told then rh end as trinket_hash, case when told then sh end as stat_hash,
  case when told then {_CUT.format("th || '|' || eh || '|' || rh || '|' || coalesce(sh, '-')")} end as config_hash from d""",
)
def _(spark, sf):
    return builds.builds(_snapshots(spark, sf)).drop("raw")
