"""Queries of what analysts keep: actions out of paired abilities, evaluations of cohorts, projections with fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import actions, casts, cohorts
from emberlog.operators.runs import DedupePolicy
from emberlog.plans import bindings as B
from emberlog.registry import _COVERAGE, _DIGESTS, _F, _coverage, _digests, query, rounded
from emberlog.registry_ingest import _folder
from emberlog.sources import projection

# --- actions -----------------------------------------------------------------

#: Abilities of the tables: type and a digit of the id. Casts of a run within half a day go together.
NEAR_MS, RATE, ONE_FOR_ONE = 43_200_000, 0.12, 1.05
PARTS = {"cast": ["click"], "impact": ["purchase", "error"], "aura": ["view"]}
_ABILITY = "type || ability_game_id % 4"


def _abilities(spark: SparkSession, sf: str) -> DataFrame:
    return B.events(spark, sf).withColumn("ability", F.expr(_ABILITY)).withColumn("source_instance", F.lit(None).cast("long"))


def _rates(casts_of: DataFrame) -> DataFrame:
    return casts.pair_rates(casts.paired(casts_of, NEAR_MS), casts_of, limit=None)


_ACTIONS = f"""
, ab as (select event_id, run_id, source_id, rel_ms, type, {_ABILITY} as ability from ev),
mt as (select a.ability as ability_a, b.ability as ability_b, count(distinct a.event_id) as matched_a, count(distinct b.event_id) as matched_b
  from ab a join ab b on a.run_id = b.run_id and a.source_id = b.source_id and a.ability < b.ability and abs(a.rel_ms - b.rel_ms) <= {NEAR_MS} group by 1, 2),
tot as (select ability, count(*) as n from ab where ability is not null group by 1),
rt as (select ability_a, ability_b, matched_a, matched_b, {rounded("matched_a", "a.n", 3)} as rate_a, {rounded("matched_b", "b.n", 3)} as rate_b, {rounded("greatest(a.n, b.n)", "least(a.n, b.n)", 2)} as cast_ratio
  from mt join tot a on a.ability = ability_a join tot b on b.ability = ability_b),
vd as (select *, case when rate_a >= {RATE} and rate_b >= {RATE} then case when cast_ratio <= {ONE_FOR_ONE} then 'one action' else 'not one for one' end else 'separate' end as verdict from rt),
cl as (select * from vd where verdict = 'one action'),
bo as (select ability_a as a, ability_b as b from cl union select ability_b, ability_a from cl),
re as (select a, a as b from bo union select re.a, bo.b from re join bo on re.b = bo.a),
lb as (select a as ability, min(b) as label, count(distinct b) as members from re group by 1),
ec as (select label, count(*) as claims, min(least(rate_a, rate_b)) as least_rate, min(least(matched_a, matched_b)) as matched from cl join lb on ability = ability_a group by 1)
"""


@query("action_claims", _ACTIONS + "select ability_a, ability_b, rate_a, rate_b, cast_ratio, verdict from vd")
def _(spark, sf):
    found = _rates(_abilities(spark, sf)).withColumn("verdict", actions.verdict(RATE, ONE_FOR_ONE))
    return found.select("ability_a", "ability_b", "rate_a", "rate_b", "cast_ratio", "verdict")


@query(
    "action_mapping",
    _ACTIONS + """select tot.ability, coalesce(lb.label, tot.ability) as action_id, case when lb.label is null then 'separate' when members * (members - 1) = 2 * claims then 'measured' else 'inferred' end as confidence,
  coalesce(members, 1)::bigint as members, coalesce(claims, 0)::bigint as claims, least_rate, matched from tot left join lb using (ability) left join ec on ec.label = lb.label""",
)
def _(spark, sf):
    c = _abilities(spark, sf)
    return actions.mapping(c, _rates(c), rate=RATE, one_for_one=ONE_FOR_ONE)


@query(
    "action_roles",
    """, rk as (select ability_game_id as ability, case type when 'click' then 0 when 'purchase' then 1 when 'error' then 1 when 'view' then 2 end as rank from ev where ability_game_id is not null),
n as (select ability, rank, count(*) as n from rk group by 1, 2)
select ability, ['cast', 'impact', 'aura'][1 + arg_max(rank, struct_pack(n := n, r := -rank)) filter (rank is not null)] as role from n group by 1""",
)
def _(spark, sf):
    return actions.roles(B.events(spark, sf), "ability_game_id", "type", PARTS)


# --- cohorts -----------------------------------------------------------------

_COHORT = cohorts.Definition("clicks-and-views", ("click", "view"), DedupePolicy.STRICT, {"party": 1})
_SAID = '{"cohort_id":"clicks-and-views","filters":{"party":1},"policy":"strict","streams":["click","view"],"version":1}'


def _evaluated(spark: SparkSession, sf: str, definition: cohorts.Definition = _COHORT) -> cohorts.Evaluation:
    """Runs are users of the events, their canonical state and party digits of the id, their roster the instances they use."""
    e = B.events(spark, sf)
    own = e.select("run_id").distinct().withColumns({"is_canonical": F.expr("case run_id % 5 when 0 then null when 1 then 0 else 1 end"), "party": F.col("run_id") % 2})
    roster = e.where("source_instance is not null and run_id % 7 <> 0").select("run_id", F.col("source_instance").alias("player_id"))
    return cohorts.evaluate(definition, own, _coverage(spark, sf), roster, _digests(spark, sf))


_USERS = """
, us as (select distinct run_id, case run_id % 5 when 0 then null when 1 then 0 else 1 end as is_canonical, run_id % 2 as party from ev),
rs as (select distinct run_id, source_instance as actor_id from ev where source_instance is not null and run_id % 7 <> 0),
ju as (select *, (select string_agg(s, ',' order by s) from (values ('click'), ('view')) t(s) where (run_id, s) not in (select run_id, data_type from cov where status = 'ok')) as missing from us where party = 1),
mb as (select ju.run_id, actor_id from ju left join rs using (run_id) where is_canonical = 1 and missing is null),
wide as (select ju.run_id, actor_id from ju left join rs using (run_id) where coalesce(is_canonical, 1) = 1 and missing is null)
"""
_HEAD = f"""
, md as (select sha256({_F('run_id')} || {_F('actor_id')}) as d from mb),
m4 as (select substr(d, 1, 4) as g, count(*) as n, sha256(string_agg(d, '' order by d)) as d from md group by 1),
m2 as (select substr(g, 1, 2) as g, sum(n) as n, sha256(string_agg(d, '' order by d)) as d from m4 group by 1),
m0 as (select cast(coalesce(sum(n), 0) as bigint) as members, sha256(coalesce(string_agg(d, '' order by d), '')) as fingerprint from m2),
c3 as (select sha256(string_agg(digest, '' order by digest)) as d from dg group by substr(digest, 1, 3)),
c0 as (select sha256(string_agg(d, '' order by d)) as corpus from c3)
"""


@query("cohort_members", _COVERAGE + _USERS + "select * from mb")
def _(spark, sf):
    return _evaluated(spark, sf).members


@query(
    "cohort_exclusions",
    _COVERAGE + _USERS + """select run_id, case when is_canonical = 0 then 'duplicate' when is_canonical is null then 'unclassified' else 'missing-coverage' end as reason, case when is_canonical = 1 then missing end as detail
from ju where coalesce(is_canonical, 0) = 0 or missing is not null""",
)
def _(spark, sf):
    return _evaluated(spark, sf).exclusions


@query(
    "cohort_evaluations",
    _COVERAGE + _USERS + _DIGESTS + _HEAD + f"""select sha256(sha256('{_SAID}') || ';' || fingerprint || ';' || corpus) as evaluation_id, 'clicks-and-views' as cohort_id, 1 as definition_version, 'strict' as dedupe_policy,
  corpus as corpus_fingerprint, fingerprint as member_fingerprint, (select count(distinct run_id) from mb) as runs, members, (select count(*) from ju where coalesce(is_canonical, 0) = 0 or missing is not null) as excluded, false as provisional from m0, c0""",
)
def _(spark, sf):
    found, root = _evaluated(spark, sf), _folder(spark, "cohorts")
    for _ in range(2):  # recorded again, nothing changes
        cohorts.record(spark, root, found)
    return cohorts.recorded(spark, root).head.select(found.head.columns)


@query("cohort_changes", _COVERAGE + _USERS + "select *, 'joined' as change from (select * from wide except select * from mb) union all select *, 'left' from (select * from mb except select * from wide)")
def _(spark, sf):
    wider = cohorts.Definition(_COHORT.cohort_id, _COHORT.streams, DedupePolicy.PERMISSIVE, _COHORT.filters, 2)
    return cohorts.changes(_evaluated(spark, sf).members, _evaluated(spark, sf, wider).members)


# --- projections -------------------------------------------------------------

_KINDS = {"amount": "bigint", "data_type": "string", "event_id": "bigint", "hostility": "string", "rel_ms": "bigint", "run_id": "bigint"}
_PRINTS = f"""
, rd as (select data_type, hostility, sha256('{";".join(f"{n}:{t}" for n, t in _KINDS.items())}|' || {' || '.join(map(_F, _KINDS))}) as d from ev),
p5 as (select data_type, hostility, substr(d, 1, 5) as g, count(*) as n, sha256(string_agg(d, '' order by d)) as d from rd group by all),
p2 as (select data_type, hostility, substr(g, 1, 2) as g, sum(n) as n, sha256(string_agg(d, '' order by d)) as d from p5 group by all),
pp as (select data_type, hostility, cast(sum(n) as bigint) as rows, sha256(string_agg(d, '' order by d)) as fingerprint from p2 group by all)
"""
_BY = ["data_type", "hostility"]


def _projected(spark: SparkSession, sf: str) -> str:
    root = _folder(spark, "projection")
    e = B.events(spark, sf).select("event_id", "run_id", "data_type", "hostility", "rel_ms", "amount")
    for _ in range(2):  # built again, nothing is written
        projection.build(e, root, _BY, ["run_id", "rel_ms", "event_id"])
    return root


@query("projection_fingerprints", _PRINTS + "select * from pp")
def _(spark, sf):
    """Of the rows that are read back from the files."""
    return projection.logical_fingerprints(projection.read(spark, _projected(spark, sf)), _BY)


@query("projection_partition", "select event_id, run_id, data_type, hostility, rel_ms, amount from ev where data_type = 'click' and hostility is null")
def _(spark, sf):
    return projection.read(spark, _projected(spark, sf), data_type="click", hostility=None)
