"""Queries over the driver's tables, each with the SQL that must give the same rows.

Every query applies library operators to whole tables through the bindings of
:mod:`emberlog.plans.bindings`; the SQL is written independently, over the same
bindings as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions.signatures import composition_signature, species_signature
from emberlog.operators import casts, costs, duplicates, fingerprints, intervals, lookups, pages, runs, timelines
from emberlog.plans import bindings as B
from emberlog.plans.bindings import sql
from emberlog.sources import sinks, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return put


def rounded(part: str, whole: str, places: int = 0) -> str:
    """SQL of ``part / whole``, rounded half up in whole numbers; null without a whole."""
    part, whole = f"cast({part} as bigint)", f"cast({whole} as bigint)"
    return f"case when {whole} > 0 then (({part} * {2 * 10**places} + {whole}) // ({whole} * 2)) / cast({10**places} as double) end"


# --- intervals ---------------------------------------------------------------

_ASSIGNED = """
, asg as (
  select e.event_id, max(struct_pack(s := p.rel_start_ms, e := p.rel_end_ms, id := p.pull_id)) as p
  from ev e join pu p on e.run_id = p.run_id and e.rel_ms between p.rel_start_ms and p.rel_end_ms group by 1
), eva as (
  select ev.*, asg.p.id as pull_id, ev.rel_ms - asg.p.s as pull_rel_ms from ev left join asg using (event_id)
)
"""
_OVERLAPS = """
, ov as (
  select a.run_id, a.pull_id as a_pull, b.pull_id as b_pull, b.rel_start_ms as from_ms, least(a.rel_end_ms, b.rel_end_ms) as until_ms,
    least(a.rel_end_ms, b.rel_end_ms) - b.rel_start_ms as overlap_ms,
    case when b.rel_start_ms = a.rel_end_ms then 'touching' when b.rel_end_ms <= a.rel_end_ms then 'nested' else 'partial' end as kind
  from pu a join pu b on a.run_id = b.run_id and b.rel_start_ms <= a.rel_end_ms
    and (a.rel_start_ms < b.rel_start_ms or (a.rel_start_ms = b.rel_start_ms and a.pull_id < b.pull_id))
)
"""


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.assign(B.events(spark, sf), B.pulls(spark, sf))


@query("interval_assign_events", _ASSIGNED + "select event_id, run_id, rel_ms, pull_id, pull_rel_ms from eva")
def _(spark, sf):
    return assigned(spark, sf).select("event_id", "run_id", "rel_ms", "pull_id", "pull_rel_ms")


@query(
    "interval_assignment_stats",
    _ASSIGNED + """
, ed as (select run_id, min(rel_start_ms) as f, max(struct_pack(a := rel_start_ms, b := rel_end_ms)).b as l from pu group by 1)
select run_id, count(*) as events, count(pull_id) as assigned, count(*) - count(pull_id) as unassigned,
  count(*) filter (pull_id is null and rel_ms < f) as before_first,
  count(*) filter (pull_id is null and not (rel_ms < f) and rel_ms > l) as after_last,
  count(*) filter (pull_id is null and not coalesce(rel_ms < f or rel_ms > l, false)) as between_pulls
from eva left join ed using (run_id) group by run_id""",
)
def _(spark, sf):
    return intervals.assignment_stats(assigned(spark, sf), B.pulls(spark, sf))


@query("interval_overlap_pairs", _OVERLAPS + "select * from ov")
def _(spark, sf):
    return intervals.overlap_pairs(B.pulls(spark, sf))


@query("interval_overlap_kinds", _OVERLAPS + "select kind, count(*) as pairs, cast(sum(overlap_ms) as bigint) as overlap_ms from ov group by 1")
def _(spark, sf):
    return intervals.overlap_pairs(B.pulls(spark, sf)).groupBy("kind").agg(F.count("*").alias("pairs"), F.sum("overlap_ms").alias("overlap_ms"))


@query(
    "interval_adjacent_overlaps",
    """select run_id, pull_id, nxt as next_pull_id, rel_end_ms - nst as overlap_ms from (
  select *, lead(pull_id) over w as nxt, lead(rel_start_ms) over w as nst from pu window w as (partition by run_id order by rel_start_ms, rel_end_ms, pull_id)
) where nst <= rel_end_ms""",
)
def _(spark, sf):
    return intervals.adjacent_overlaps(B.pulls(spark, sf))


@query(
    "interval_events_in_contested_window",
    _ASSIGNED + _OVERLAPS + """select a_pull, b_pull, kind, coalesce(pull_id, '<unassigned>') as assigned_to, count(*) as events
from ov join eva on ov.run_id = eva.run_id and eva.rel_ms between from_ms and until_ms group by all""",
)
def _(spark, sf):
    return intervals.contested_events(intervals.overlap_pairs(B.pulls(spark, sf)), assigned(spark, sf))


@query(
    "pull_links",
    """select run_id, pull_id, row_number() over w - 1 as pull_index, lag(pull_id) over w as prev_pull_id, lead(pull_id) over w as next_pull_id
from pu window w as (partition by run_id order by rel_start_ms, pull_id)""",
)
def _(spark, sf):
    return intervals.pull_links(B.pulls(spark, sf))


# --- casts -------------------------------------------------------------------

PAIR_MS = 600_000
_PAIRS = f"""
, pr as (
  select a.type as ability_a, b.type as ability_b, count(distinct a.event_id) as matched_a, count(distinct b.event_id) as matched_b
  from ev a join ev b on a.run_id = b.run_id and a.source_id = b.source_id and a.source_instance is not distinct from b.source_instance
    and a.type < b.type and abs(a.rel_ms - b.rel_ms) <= {PAIR_MS} group by 1, 2
)
"""
_COPIES = """
, tl as (
  select pull_id, source_id, source_instance, type as ability, count(*) as casts, min(pull_rel_ms) as first_ms, max(pull_rel_ms) as last_ms
  from eva where pull_id is not null and source_instance is not null group by all
), sc as (
  select pull_id, source_id, ability, count(*) as n_copies, max(casts) as most_casts from tl group by all having count(*) > 1
)
"""


def _casts(df: DataFrame) -> DataFrame:
    return df.withColumn("ability", F.col("type"))


@query("pair_abilities", _PAIRS + "select * from pr")
def _(spark, sf):
    return casts.paired(_casts(B.events(spark, sf)), PAIR_MS)


@query(
    "pair_abilities_rates",
    _PAIRS + f""", tot as (select type as ability, count(*) as n from ev group by 1),
rt as (select ability_a, ability_b, matched_a, matched_b, a.n as casts_a, b.n as casts_b, {rounded("matched_a", "a.n", 3)} as rate_a, {rounded("matched_b", "b.n", 3)} as rate_b,
  {rounded("greatest(a.n, b.n)", "least(a.n, b.n)", 2)} as cast_ratio from pr join tot a on a.ability = ability_a join tot b on b.ability = ability_b)
select *, rate_a >= 0.03 and rate_b >= 0.03 as inseparable from rt order by matched_a desc, ability_a, ability_b limit 10""",
)
def _(spark, sf):
    c = _casts(B.events(spark, sf))
    return casts.pair_rates(casts.paired(c, PAIR_MS), c, inseparable_at=0.03)


@query("copy_timelines", _ASSIGNED + _COPIES + "select * from tl")
def _(spark, sf):
    return casts.copy_timelines(_casts(assigned(spark, sf)))


@query(
    "copy_several",
    _ASSIGNED + _COPIES + """select sc.*, l.copies from sc join (
  select pull_id, source_id, ability, string_agg(source_instance || ':' || casts || ':' || first_ms || ':' || last_ms, ',' order by source_instance) as copies from tl group by all
) l using (pull_id, source_id, ability)""",
)
def _(spark, sf):
    found = casts.several_copies(casts.copy_timelines(_casts(assigned(spark, sf))))
    spelt = F.transform("copies", lambda c: F.concat_ws(":", *[c[x].cast("string") for x in ("source_instance", "casts", "first_ms", "last_ms")]))
    return found.withColumn("copies", F.array_join(spelt, ","))


@query(
    "copy_median_gap",
    _ASSIGNED + _COPIES + "select ability, count(*) as copies, cast(round_even(median((last_ms - first_ms) / (casts - 1)), 0) as bigint) as median_gap_ms from tl where casts > 1 group by 1",
)
def _(spark, sf):
    return casts.median_gap(casts.copy_timelines(_casts(assigned(spark, sf))))


@query(
    "copy_best_example",
    _ASSIGNED + _COPIES + """select source_id, pull_id, ability, most_casts, n_copies from (
  select *, row_number() over (partition by source_id order by most_casts desc, n_copies desc, pull_id, ability) as rn from sc
) where rn = 1 order by most_casts desc, n_copies desc, source_id limit 5""",
)
def _(spark, sf):
    return casts.best_examples(casts.several_copies(casts.copy_timelines(_casts(assigned(spark, sf)))))


@query("anti_unknown_actors", "select source_id, count(*) as events from ev where source_id >= 0 and source_id not in (select c_custkey from customer where c_custkey % 3 <> 0) group by 1")
def _(spark, sf):
    known = B.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("source_id"))
    return casts.unknown_members(B.events(spark, sf), known, "source_id")


@query("anti_unknown_abilities", "select l_partkey as ability, count(*) as events from lineitem where l_partkey not in (select p_partkey from part where p_size % 5 <> 0) group by 1")
def _(spark, sf):
    known = B.table(spark, sf, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").alias("ability"))
    return casts.unknown_members(B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ability")), known, "ability")


# --- runs --------------------------------------------------------------------

EPOCHS = [("first", 788918400000, 852076800000), ("second", 852076800000, 915148800000)]
_BRACKET = "case " + " ".join(f"when keystone_level >= {lo}" + ("" if hi is None else f" and keystone_level <= {hi}") + f" then '{n}'" for n, lo, hi in T.BRACKETS) + " end"
_EPOCH = "case " + " ".join(f"when abs_start_ms >= {lo} and abs_start_ms < {hi} then '{n}'" for n, lo, hi in EPOCHS) + " else 'unclassified' end"


@query("runs_by_status", "select collection_status, count(*) as runs from ru group by 1")
def _(spark, sf):
    return B.runs(spark, sf).groupBy("collection_status").agg(F.count("*").alias("runs"))


@query(
    "runs_by_bracket",
    f"select {_BRACKET} as bracket, count(*) as runs, {rounded('sum(duration_ms)', '1000 * count(duration_ms)')} as mean_s, min(keystone_level) as min_level, max(keystone_level) as max_level from ru group by 1",
)
def _(spark, sf):
    return runs.durations(B.runs(spark, sf).withColumn("bracket", T.bracket(F.col("keystone_level"), T.BRACKETS)), "bracket")


@query("runs_by_epoch", f"select {_EPOCH} as epoch, count(*) as runs from ru group by 1")
def _(spark, sf):
    return B.runs(spark, sf).groupBy(T.epoch(F.col("abs_start_ms"), EPOCHS).alias("epoch")).agg(F.count("*").alias("runs"))


@query(
    "runs_date_span",
    "select strftime(epoch_ms(min(abs_start_ms)), '%Y-%m-%d') as first_day, strftime(epoch_ms(max(abs_start_ms)), '%Y-%m-%d') as last_day, max(abs_start_ms) - min(abs_start_ms) as span_ms, " + rounded("max(abs_start_ms) - min(abs_start_ms)", "86400000", 1) + " as days from ru",
)
def _(spark, sf):
    return costs.date_span(B.runs(spark, sf))


@query("runs_complete_by_dungeon", f"select dungeon_key, {_BRACKET} as bracket, count(*) as runs, {rounded('sum(duration_ms)', '1000 * count(duration_ms)')} as mean_s from ru where collection_status = 'complete' and coalesce(is_canonical, 1) = 1 group by 1, 2")
def _(spark, sf):
    r = B.runs(spark, sf).where("collection_status = 'complete' and coalesce(is_canonical, 1) = 1")
    return runs.durations(r.withColumn("bracket", T.bracket(F.col("keystone_level"), T.BRACKETS)), "dungeon_key", "bracket").drop("min_level", "max_level")


@query("runs_dedupe_state", "select count(*) as runs, count(*) filter (is_canonical is null) as unclassified, case when count(*) = 0 then 'empty' when count(*) = count(*) filter (is_canonical is null) then 'never_run' when count(*) filter (is_canonical is null) > 0 then 'stale' else 'current' end as state from ru")
def _(spark, sf):
    return costs.dedupe_state(B.runs(spark, sf))


_PER = "select run_id, is_canonical is null as provisional from ru where coalesce(is_canonical, 1) <> 0"


@query("runset_permissive", _PER)
def _(spark, sf):
    return runs.RunSet.select(B.runs(spark, sf), runs.DedupePolicy.PERMISSIVE).included.select("run_id", "provisional")


@query("runset_strict", "select run_id, keystone_level from ru where is_canonical = 1 and dungeon_key = '2-HIGH'")
def _(spark, sf):
    return runs.RunSet.select(B.runs(spark, sf), runs.DedupePolicy.STRICT, dungeon_key="2-HIGH").included.select("run_id", "keystone_level")


@query("runset_exclusions", "select case when is_canonical is null then 'unclassified' else 'duplicate' end as reason, count(*) as runs from ru where coalesce(is_canonical, 0) = 0 group by 1")
def _(spark, sf):
    return runs.RunSet.select(B.runs(spark, sf), runs.DedupePolicy.STRICT).exclusion_counts()


# --- streams, coverage and cost ---------------------------------------------


@query("events_by_stream", "select data_type, hostility, count(*) as events from ev group by 1, 2")
def _(spark, sf):
    return B.events(spark, sf).groupBy("data_type", "hostility").agg(F.count("*").alias("events"))


@query("totals_assigned", _ASSIGNED + f"select count(*) as events, count(pull_id) as assigned, count(*) - count(pull_id) as unassigned, {rounded('100 * count(pull_id)', 'count(*)', 2)} as assigned_pct from eva")
def _(spark, sf):
    return runs.assigned_share(assigned(spark, sf))


@query("cost_by_stream", f"select data_type, count(*) as pages, cast(sum(event_count) as bigint) as events, count(distinct run_id) as runs, {rounded('count(*)', 'count(distinct run_id)', 1)} as pages_per_run from pg group by 1")
def _(spark, sf):
    return costs.by_stream(B.pages(spark, sf))


_GAPS = """, gp as (
  select run_id, count(*) as pages, cast(sum(case when gap between 0 and 43200000 then gap else 0 end) as bigint) as working_ms, count(*) filter (gap > 43200000) as pauses
  from (select *, fetched_at_ms - lag(fetched_at_ms) over (partition by run_id order by fetched_at_ms) as gap from pg) group by 1 having count(*) > 1
)
"""


@query(
    "cost_summary",
    _GAPS + f"""select pages, events, runs, largest_page, paged_runs, runs_with_pauses, {rounded("working_ms", "1000 * paged_runs", 1)} as seconds_per_run, {rounded("working_ms", "1000 * steps", 2)} as seconds_per_page, {rounded("pages", "paged_runs", 1)} as pages_per_run
from (select count(*) as pages, cast(sum(event_count) as bigint) as events, count(distinct run_id) as runs, max(event_count) as largest_page from pg),
  (select count(*) as paged_runs, count(*) filter (pauses > 0) as runs_with_pauses, cast(sum(working_ms) as bigint) as working_ms, cast(sum(pages - 1) as bigint) as steps from gp)""",
)
def _(spark, sf):
    return costs.summary(B.pages(spark, sf), gap_ms=43_200_000)


@query("cost_session_gaps", _GAPS + "select * from gp")
def _(spark, sf):
    return costs.session_gaps(B.pages(spark, sf), gap_ms=43_200_000)


@query("cost_last_page", "select run_id, data_type, max(page_index) as page_index from pg group by 1, 2")
def _(spark, sf):
    return costs.last_pages(B.pages(spark, sf)).select("run_id", "data_type", "page_index")


@query("cost_incomplete_streams", "select run_id, data_type, page_index, next_cursor_ms from pg where next_cursor_ms is not null and (run_id, data_type, page_index) in (select run_id, data_type, max(page_index) from pg group by 1, 2)")
def _(spark, sf):
    return costs.incomplete_streams(B.pages(spark, sf))


@query("pages_resume_points", "select run_id, data_type, case when c is not null then p + 1 end as next_page, c as cursor_ms, c is null as finished from (select run_id, data_type, max(page_index) as p, arg_max_null(next_cursor_ms, page_index) as c from pg group by 1, 2)")
def _(spark, sf):
    return pages.resume_points(B.pages(spark, sf))


@query("pages_cursor_semantics", "select run_id, data_type, page_index, case when next_cursor_ms = last_ms then 'inclusive' when next_cursor_ms > last_ms then 'exclusive' else 'unexpected' end as semantics from pg where next_cursor_ms is not null")
def _(spark, sf):
    return pages.cursor_semantics(B.pages(spark, sf))


@query("pages_gaps", "select run_id, data_type, max(step) as max_gap_ms, count(*) filter (step < 0) as out_of_order from (select *, rel_ms - lag(rel_ms) over (partition by run_id, data_type order by event_id) as step from ev) group by 1, 2")
def _(spark, sf):
    return costs.page_gaps(B.events(spark, sf))


_COVERAGE = """
, cov as (
  select run_id, data_type, count(*) as pages, cast(sum(event_count) as bigint) as events,
    case when arg_max_null(next_cursor_ms, page_index) is not null then 'partial' else 'ok' end as status from pg group by 1, 2
)
"""
STREAMS = ["click", "error", "view"]


def _coverage(spark, sf):
    return runs.coverage_rows(B.pages(spark, sf)).withColumn("hostility", F.lit(None).cast("string"))


def _event_runs(spark, sf):
    return B.events(spark, sf).select("run_id").distinct()


@query("coverage_rows", _COVERAGE + "select * from cov")
def _(spark, sf):
    return runs.coverage_rows(B.pages(spark, sf))


@query(
    "coverage_gate",
    _COVERAGE + """select run_id, string_agg(spec, ',' order by spec) as missing from (select distinct run_id from ev), (values ('click'), ('error'), ('view')) t(spec)
where (run_id, spec) not in (select run_id, data_type from cov where status = 'ok') group by 1""",
)
def _(spark, sf):
    return runs.missing_streams(_event_runs(spark, sf), _coverage(spark, sf), STREAMS)


@query(
    "coverage_report",
    _COVERAGE + """select spec as stream, count(*) as runs, count(*) filter ((run_id, spec) in (select run_id, data_type from cov where status = 'ok')) as with_stream
from (select distinct run_id from ev), (values ('click'), ('error'), ('view')) t(spec) group by 1""",
)
def _(spark, sf):
    return runs.coverage_report(_event_runs(spark, sf), _coverage(spark, sf), STREAMS)


@query(
    "coverage_shapes",
    """, lab as (select run_id, list_sort(list(distinct label)) as labels from (select distinct run_id, data_type || coalesce('@' || hostility, '') as label from ev) group by 1),
shp as (select labels, count(*) as runs, min(run_id) as example from lab group by 1),
wid as (select labels from shp order by len(labels) desc, labels desc limit 1)
select array_to_string(shp.labels, ',') as streams, runs, example, coalesce(array_to_string(list_filter(wid.labels, lambda x: not list_contains(shp.labels, x)), ','), '') as missing from shp, wid""",
)
def _(spark, sf):
    label = F.concat("data_type", F.coalesce(F.concat(F.lit("@"), "hostility"), F.lit("")))
    return runs.coverage_shapes(B.events(spark, sf).select("run_id", label.alias("label")))


# --- evidence and packs ------------------------------------------------------


@query(
    "evidence_counts",
    """, inc as (select * from ru where coalesce(is_canonical, 1) <> 0)
select (select count(*) from inc) as runs, (select count(distinct report_code) from inc) as reports, (select count(distinct player_id) from ro semi join inc using (run_id)) as players,
  (select count(distinct p) from (select string_agg(player_id, ',' order by player_id) as p from ro semi join inc using (run_id) group by run_id)) as parties,
  (select count(*) from pu semi join inc using (run_id)) as pulls, (select count(*) from ev semi join inc using (run_id)) as events""",
)
def _(spark, sf):
    kept = runs.RunSet.select(B.runs(spark, sf), runs.DedupePolicy.PERMISSIVE).included
    return runs.evidence(kept, B.roster(spark, sf), B.events(spark, sf), B.pulls(spark, sf))


@query("evidence_parties", "select party, count(*) as runs from (select run_id, string_agg(player_id, ',' order by player_id) as party from ro group by 1) group by 1")
def _(spark, sf):
    return runs.parties(B.roster(spark, sf))


@query("evidence_npc_instances", "select count(*) as n from (select distinct run_id, source_id, source_instance from ev where hostility = 'Enemies' and source_instance is not null)")
def _(spark, sf):
    return runs.independent_units("npc_instance", B.events(spark, sf), B.roster(spark, sf))


def _concentration_sql(where: str) -> str:
    return f""", one as (select (select max(n) from (select count(*) as n from ev where {where} group by run_id)) as top_run_events, (select count(*) from ev where {where}) as events,
  (select max(n) from (select count(*) as n from ro group by player_id)) as top_player_runs, (select count(distinct run_id) from ro) as runs)
select *, {rounded("top_run_events", "events", 4)} as top_run_share, {rounded("top_player_runs", "runs", 4)} as top_player_share from one"""


@query("evidence_concentration", _concentration_sql("true"))
def _(spark, sf):
    return runs.concentration(B.events(spark, sf), B.roster(spark, sf))


@query("evidence_concentration_filtered", _concentration_sql("hostility = 'Enemies' and source_instance is null"))
def _(spark, sf):
    return runs.concentration(B.events(spark, sf), B.roster(spark, sf), {"hostility": "Enemies", "source_instance": None})


_SPECIES = ", sig as (select pull_id, string_agg(npc_game_id, '|' order by npc_game_id) as signature from (select distinct pull_id, npc_game_id from np) group by 1)\n"
_EXACT = """, sig as (
  select pull_id, string_agg(npc_game_id || 'x' || n, ' | ' order by npc_game_id) as signature, count(*) as species, cast(sum(n) as bigint) as total
  from (select pull_id, npc_game_id, cast(sum(coalesce(instance_count, 1)) as bigint) as n from np group by 1, 2) group by 1
)
"""


def _run_pulls(spark, sf):
    return B.runs(spark, sf).select("run_id", F.col("run_id").alias("pull_id"), "dungeon_key", "duration_ms", F.expr("cast(run_id % 9 = 0 as int)").alias("is_boss"), F.concat(F.lit("pull "), F.col("run_id").cast("string")).alias("name"))


@query("species_signatures", _SPECIES + "select * from sig")
def _(spark, sf):
    return species_signature(B.pull_npcs(spark, sf))


@query("composition_signatures", _EXACT + "select * from sig")
def _(spark, sf):
    return composition_signature(B.pull_npcs(spark, sf))


_PACK = "select dungeon_key, signature, count(*) as occurrences, count(distinct run_id) as runs, " + rounded("sum(duration_ms)", "1000 * count(duration_ms)", 1) + " as mean_s, max(is_boss) as boss, min(name) as a_name from sig join (select *, run_id as pull_id, cast(run_id % 9 = 0 as int) as is_boss, 'pull ' || run_id as name from ru) r using (pull_id) where signature <> '' group by 1, 2 order by occurrences desc, dungeon_key nulls first, signature limit 25"


@query("packs_species", _SPECIES + _PACK)
def _(spark, sf):
    return runs.packs(B.pull_npcs(spark, sf), _run_pulls(spark, sf), exact=False)


@query("packs_exact", _EXACT + _PACK)
def _(spark, sf):
    return runs.packs(B.pull_npcs(spark, sf), _run_pulls(spark, sf), exact=True)


@query("npc_pulls", "select dungeon_key, pull_id, instance_count from np join (select *, run_id as pull_id from ru) r using (pull_id) where npc_game_id = 42 order by dungeon_key nulls first, pull_id, instance_count nulls first limit 25")
def _(spark, sf):
    return runs.npc_pulls(B.pull_npcs(spark, sf), _run_pulls(spark, sf), 42)


# --- duplicates --------------------------------------------------------------

# the tables' starts are whole days, so two days is the tolerance here
TOL = 2 * B.DAY_MS
_CANDIDATES = f"""
, fp as (select ru.*, coalesce(r.roster, []) as roster from ru left join (select run_id, list_sort(list(player_id)) as roster from ro group by 1) r using (run_id)),
cand as (
  select a.run_id as a_run_id, b.run_id as b_run_id, abs(a.abs_start_ms - b.abs_start_ms) as gap_ms, a.duration_ms as ad, b.duration_ms as bd, a.roster as ar, b.roster as br,
    a.affixes as aa, b.affixes as ba, a.dungeon_key as dungeon, a.keystone_level as lvl
  from fp a join fp b on a.dungeon_key = b.dungeon_key and a.keystone_level is not distinct from b.keystone_level and a.run_id < b.run_id and a.report_code <> b.report_code
    and abs(a.abs_start_ms - b.abs_start_ms) <= {TOL}
)
"""
_SCORED = f"""{_CANDIDATES}
, sc as (
  select *, len(ar) > 0 and len(br) > 0 as known, len(list_intersect(ar, br)) as shared, abs(ad - bd) as apart, abs(ad - bd) <= 0.1 * greatest(1, ad, bd) as alike, coalesce(len(aa) > 0 and aa = ba, false) as affixed from cand
), sco as (
  select *, round(0.2 + 0.3 * (1 - gap_ms / {TOL}) + case when alike then 0.2 else 0.0 end + 0.3 * case when known then shared / least(len(ar), len(br)) else 0.0 end + case when affixed then 0.1 else 0.0 end, 3) as points from sc
), hit as (select *, least(1.0, points) as confidence from sco where (not known or shared >= 0.6 * least(len(ar), len(br))) and points >= 0.5)
"""


def _prints(spark, sf):
    return duplicates.fingerprints(B.runs(spark, sf), B.roster(spark, sf))


@query("dedupe_candidates", _CANDIDATES + "select a_run_id, b_run_id, gap_ms from cand")
def _(spark, sf):
    return duplicates.candidates(_prints(spark, sf), TOL).select("a_run_id", "b_run_id", F.abs(F.col("a_abs_start_ms") - F.col("b_abs_start_ms")).alias("gap_ms"))


@query("roster_overlap", _CANDIDATES + "select a_run_id, b_run_id, len(list_intersect(ar, br)) as shared, least(len(ar), len(br)) as smaller from cand")
def _(spark, sf):
    c = duplicates.candidates(_prints(spark, sf), TOL)
    return c.select("a_run_id", "b_run_id", F.size(F.array_intersect("a_roster", "b_roster")).cast("long").alias("shared"), F.least(F.size("a_roster"), F.size("b_roster")).cast("long").alias("smaller"))


_GROUPS = f"""{_SCORED}
, pairs as (select a_run_id as a, b_run_id as b from hit), both_ways as (select a, b from pairs union all select b, a from pairs),
reach as (select a as n, a as m from both_ways union select r.n, b.b from reach r join both_ways b on r.m = b.a),
lab as (select n, min(m) as label from reach group by 1)
"""


def _pairs(spark, sf, spanning=False):
    return duplicates.scored(duplicates.candidates(_prints(spark, sf), TOL, spanning), TOL)


@query("dedupe_scores", _SCORED + "select a_run_id, b_run_id, gap_ms, shared, affixed, cast(round(1000 * confidence) as bigint) as confidence_milli from hit")
def _(spark, sf):
    found = _pairs(spark, sf)
    affixed = F.contains("reason", F.lit("equal affixes"))
    return found.select("a_run_id", "b_run_id", "gap_ms", F.when(F.col("known"), F.col("shared")).otherwise(0).cast("long").alias("shared"), affixed.alias("affixed"), F.round(1000 * F.col("confidence")).cast("long").alias("confidence_milli"))


@query(
    "dedupe_diagnostics",
    _SCORED + """select a_run_id as run_id, 'duplicate_candidate' as kind, 'info' as severity, 'probably the same as ' || b_run_id || ' (' || cast(confidence as decimal(4,3)) || '): dungeon ' || dungeon || ' at level ' || coalesce(cast(lvl as varchar), 'unknown')
  || '; start gap ' || gap_ms || ' ms; durations ' || case when alike then 'alike: ' else 'differ: ' end || apart || ' ms; ' || case when known then 'shared players ' || shared else 'roster unknown' end || case when affixed then '; equal affixes' else '' end as detail from hit""",
)
def _(spark, sf):
    return duplicates.diagnostics(_pairs(spark, sf))


@query("dedupe_groups", _GROUPS + "select run_id, case when label is not null then 'dup-' || label end as duplicate_group_id, cast(case when label is null or label = run_id then 1 else 0 end as integer) as is_canonical from ru left join lab on n = run_id")
def _(spark, sf):
    return duplicates.groups(B.runs(spark, sf), _pairs(spark, sf, spanning=True))


@query("dedupe_group_sizes", _GROUPS + "select 'dup-' || label as duplicate_group_id, count(*) as members from lab group by 1 having count(*) > 1")
def _(spark, sf):
    g = duplicates.groups(B.runs(spark, sf), _pairs(spark, sf, spanning=True)).where("duplicate_group_id is not null")
    return g.groupBy("duplicate_group_id").agg(F.count("*").alias("members")).where("members > 1")


# --- pages, fields, verdicts -------------------------------------------------


def _boundary(spark, sf):
    e = B.events(spark, sf).select(F.col("amount").alias("fingerprint"), F.col("event_id").alias("seq"), "type")
    return e.where("type = 'click'").drop("type"), e.where("type = 'view'").drop("type")


@query(
    "pages_boundary_multiset",
    """, nth as (select amount as fingerprint, event_id as seq, type, row_number() over (partition by type, amount order by event_id) as nth from ev where type in ('click', 'view'))
select fingerprint, seq from nth v where type = 'view' and not exists (select 1 from nth c where c.type = 'click' and c.fingerprint = v.fingerprint and c.nth = v.nth)""",
)
def _(spark, sf):
    before, page = _boundary(spark, sf)
    return pages.drop_boundary_repeats(before, page).select("fingerprint", "seq")


@query("probe_field_counts", "select field, count(*) as rows from (select unnest(json_keys(props)) as field from ev) group by 1")
def _(spark, sf):
    return pages.field_tallies(B.events(spark, sf))


@query("unexpected_fields", "select distinct field from (select unnest(json_keys(props)) as field from ev) where field not in ('amount', 'timestamp')")
def _(spark, sf):
    return pages.unexpected_fields(B.events(spark, sf), ["amount", "timestamp"])


@query(
    "hostility_verdicts",
    """, c as (select data_type, count(*) as unfiltered, count(*) filter (hostility = 'Enemies') as enemies, count(*) filter (hostility = 'Friendlies') as friendlies, data_type <> 'error' as exhausted from ev where hostility is not null or data_type = 'view' group by 1)
select *, case when not exhausted then 'inconclusive' when enemies + friendlies = unfiltered and enemies > 0 and friendlies > 0 then 'split' when enemies = unfiltered and friendlies = unfiltered and unfiltered > 0 then 'ignored' else 'inconclusive' end as verdict from c""",
)
def _(spark, sf):
    e = B.events(spark, sf).where("hostility is not null or data_type = 'view'")
    c = e.groupBy("data_type").agg(F.count("*").alias("unfiltered"), F.count_if(F.col("hostility") == "Enemies").alias("enemies"), F.count_if(F.col("hostility") == "Friendlies").alias("friendlies"))
    return pages.share_verdict(c.withColumn("exhausted", F.col("data_type") != "error"))


@query(
    "focus_verdicts",
    """, c as (select run_id, count(*) filter (source_instance = 1) as matching, case when run_id % 10 = 0 then null else count(*) filter (source_instance = 2 and run_id % 2 = 0) end as foreign_ from ev group by 1)
select run_id, matching, foreign_ as "foreign", case when foreign_ is null then 'UNKNOWN' when matching + foreign_ = 0 then 'EMPTY' when foreign_ = 0 then 'CONFIRMED' when matching = 0 then 'REFUSED' else 'MIXED ' || (100 * matching // (matching + foreign_)) || '%' end as verdict from c""",
)
def _(spark, sf):
    c = B.events(spark, sf).groupBy("run_id").agg(F.count_if(F.col("source_instance") == 1).alias("matching"), F.count_if((F.col("source_instance") == 2) & (F.col("run_id") % 2 == 0)).alias("foreign"))
    return pages.focus_verdict(c.withColumn("foreign", F.when(F.col("run_id") % 10 != 0, F.col("foreign"))))


# --- text, JSON, names -------------------------------------------------------

SALT = "example-salt"


@query("pseudonyms", f"select c_custkey, 'player-' || substr(sha256('{SALT}:' || lower(trim(c_name))), 1, 12) as pseudonym, false as was_pseudonym from customer")
def _(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.select("c_custkey", T.pseudonym("player", F.col("c_name"), SALT).alias("pseudonym"), T.is_pseudonym(F.col("c_name")).alias("was_pseudonym"))


@query("redact_text", "select doc_id, md5(replace(replace(text, 'example.com', '[REDACTED]'), 'token', '[REDACTED]')) as digest from documents")
def _(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.redact(F.col("text"), ["token", "example.com", "xyz"])).alias("digest"))


@query("report_codes", "select page_id, nullif(regexp_extract('https://logs.example/reports/' || substr(md5(url), 1, cast(4 + page_id % 20 as integer)) || '#fight=1', '/reports/([A-Za-z0-9]{8,32})', 1), '') as report_code from pages")
def _(spark, sf):
    p = B.table(spark, sf, "pages")
    url = F.concat(F.lit("https://logs.example/reports/"), F.expr("substr(md5(url), 1, cast(4 + page_id % 20 as int))"), F.lit("#fight=1"))
    return p.select("page_id", T.report_code(url).alias("report_code"))


@query("safe_segments", "select page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) as segment from pages")
def _(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", T.safe_segment(F.col("url")).alias("segment"))


@query(
    "token_symbols",
    """select conv_id, turn, cast(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: (length(w) + 3) // 4)) + length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) as bigint) as tokens,
  octet_length(encode(text)) as bytes from conversations""",
)
def _(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", timelines.token_estimate(F.col("text")).alias("tokens"), F.octet_length("text").cast("long").alias("bytes"))


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as missing from events")
def _(spark, sf):
    e = B.table(spark, sf, "events")
    p = F.from_json("props", "k long, none string")
    return e.select("event_id", p["k"].alias("k"), p["none"].alias("missing"))


@query("json_canonical", """select event_id, case when k % 5 = 0 then null else '{"a":"' || k || '","k":"' || type || '"}' end as canonical from (select *, ability_game_id as k from ev)""")
def _(spark, sf):
    e = B.events(spark, sf)
    m = F.when(F.col("ability_game_id") % 5 == 0, F.expr("map_filter(map('k', type), (a, b) -> false)")).otherwise(F.create_map(F.lit("k"), "type", F.lit("a"), F.col("ability_game_id").cast("string")))
    return e.select("event_id", T.canonical_json(m).alias("canonical"))


@query("aura_ids", "select event_id, array_to_string(list_transform(list_filter(string_split(t, '.'), lambda x: x <> ''), lambda x: cast(cast(x as bigint) + 1 as varchar)), ',') as ids from (select event_id, ability_game_id || '.' || source_id || '.' as t from ev)")
def _(spark, sf):
    t = F.concat_ws(".", F.col("ability_game_id").cast("string"), F.col("source_id").cast("string"), F.lit(""))
    return B.events(spark, sf).select("event_id", F.array_join(F.transform(T.aura_ids(t), lambda x: (x + 1).cast("string")), ",").alias("ids"))


@query("class_spec_split", "select p_partkey, nullif(split_part(p_name, ' ', 1), '') as class, nullif(case when p_size % 7 = 0 then '' else p_type end, '') as spec from part")
def _(spark, sf):
    p = B.table(spark, sf, "part")
    cls, spec = T.class_and_spec(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")))
    return p.select("p_partkey", cls.alias("class"), spec.alias("spec"))


@query("role_lookup", "select p_partkey, case when p_size % 7 = 0 then null when split_part(p_name, ' ', 1) = 'red' and p_type = 'SMALL' then 'tank' when p_type = 'ECONOMY' then 'tank' when p_type = 'SMALL' then 'healer' else 'dps' end as role from part")
def _(spark, sf):
    p = B.table(spark, sf, "part")
    roles = {"tank": ["ECONOMY", "red-SMALL"], "healer": ["SMALL"]}
    return p.select("p_partkey", T.role(F.substring_index("p_name", " ", 1), F.when(F.col("p_size") % 7 != 0, F.col("p_type")), roles).alias("role"))


@query("stream_spec_split", "select event_id, data_type, hostility from ev")
def _(spark, sf):
    spec = F.concat_ws("@", "data_type", "hostility")
    kind, host = runs.stream_spec(spec)
    return B.events(spark, sf).select("event_id", kind.alias("data_type"), host.alias("hostility"))


# --- timelines ---------------------------------------------------------------


def _timeline(spark, sf):
    e = B.events(spark, sf)
    return e.select(F.col("run_id").alias("timeline"), F.col("event_id").alias("seq"), "rel_ms", "type", "source_id", "source_instance", "target_id", F.lit(None).cast("long").alias("target_instance"), "ability_game_id", "amount")


_DELTA = "select run_id as timeline, event_id as seq, rel_ms - coalesce(lag(rel_ms) over (partition by run_id order by event_id), 0) as delta from ev"


@query("delta_encode", _DELTA)
def _(spark, sf):
    return timelines.delta_encode(_timeline(spark, sf)).select("timeline", "seq", "delta")


@query("delta_decode", "select run_id as timeline, event_id as seq, rel_ms from ev")
def _(spark, sf):
    coded = timelines.delta_encode(_timeline(spark, sf)).select("timeline", "seq", "delta")
    return timelines.delta_decode(coded).select("timeline", "seq", "rel_ms")


_RANK = ", rk as (select ability_game_id, count(*) as n, row_number() over (order by count(*) desc, ability_game_id) - 1 as rank from ev group by 1)\n"


@query("ability_rank", _RANK + "select ability_game_id, n, rank, 'a' || rank as symbol from rk")
def _(spark, sf):
    return timelines.ability_ranks(_timeline(spark, sf))


_FIRST = """
, seen as (
  select run_id as timeline, source_id as actor, source_instance as instance, event_id as seq, 0 as side from ev
  union all select run_id, target_id, null, event_id, 1 from ev where target_id is not null
), firsts as (select timeline, actor, instance, min(struct_pack(seq := seq, side := side)) as pos from seen group by 1, 2, 3),
en as (select timeline, actor, instance, row_number() over (partition by timeline order by pos, actor) as appearance from firsts)
"""


@query("first_appearance", _FIRST + "select timeline, actor, instance, appearance, 'E' || appearance as symbol from en")
def _(spark, sf):
    return timelines.enemies(_timeline(spark, sf))


@query(
    "codec_g_lines",
    _RANK + _FIRST + f""", d as ({_DELTA})
select d.timeline, d.seq, '+' || delta || ' E' || s.appearance || ' ' || case type when 'click' then 'C' when 'error' then 'E' when 'purchase' then 'P' when 'signup' then 'S' else 'V' end
  || ' a' || rk.rank || '>' || coalesce('E' || t.appearance, '-') || ' ' || amount as line
from d join ev on ev.event_id = d.seq join rk using (ability_game_id)
  join en s on s.timeline = d.timeline and s.actor = ev.source_id and s.instance is not distinct from ev.source_instance
  left join en t on t.timeline = d.timeline and t.actor = ev.target_id and t.instance is null""",
)
def _(spark, sf):
    t = _timeline(spark, sf)
    return timelines.encode(t, "G", timelines.Dictionary.build(t, by_frequency=True))


@query("codec_round_trip", "select run_id as timeline, event_id as seq, rel_ms, type, source_id, source_instance, target_id, cast(null as bigint) as target_instance, ability_game_id, amount from ev")
def _(spark, sf):
    t = _timeline(spark, sf)
    d = timelines.Dictionary.build(t)
    return timelines.decode(timelines.encode(t, "D", d), "D", d, timelines.default_targets(t))


@query("mode_target", "select timeline, t as default_target from (select run_id as timeline, target_id as t, row_number() over (partition by run_id order by count(*) desc, cast(target_id as varchar) desc) as rn from ev where target_id is not null group by 1, 2) where rn = 1")
def _(spark, sf):
    return timelines.default_targets(_timeline(spark, sf)).select("timeline", "default_target")


@query("timeline_measure", """select timeline, scale, count(*) as lines, cast(sum(octet_length(encode(line))) + count(*) - 1 as bigint) as bytes from (
  select run_id as timeline, '[' || (rel_ms - coalesce(lag(rel_ms) over (partition by run_id order by event_id), 0)) || ',"' || type || '",' || source_id || ',' || coalesce(cast(source_instance as varchar), 'null') || ',' || coalesce(cast(target_id as varchar), 'null') || ',null,' || ability_game_id || ',' || amount || ']' as line,
    row_number() over (partition by run_id order by event_id) as rn from ev
), (values (10), (0)) s(scale) where scale = 0 or rn <= scale group by 1, 2""")
def _(spark, sf):
    m = timelines.measure(timelines.encode(_timeline(spark, sf), "B"), (10, None))
    return m.select("timeline", "scale", "lines", "bytes")


# --- fingerprints ------------------------------------------------------------

_F = lambda c: f"case when {c} is null then 'N;' else 'V' || length(cast({c} as varchar)) || ':' || {c} || ';' end"
_PAGE_COLUMNS = ["data_type", "page_index", "event_count", "next_cursor_ms"]
_DIGESTS = f"""
, rows_ as (select run_id, sha256({' || '.join(map(_F, _PAGE_COLUMNS))}) as d from pg),
comp as (select run_id, sha256(string_agg(d, '' order by d)) as pages_digest from rows_ group by 1),
dg as (select run_id, 'page' as grade, sha256('v1;page;' || {_F('pages_digest')}) as digest from comp)
"""


def _digests(spark, sf, change: bool = False):
    p = B.pages(spark, sf)
    if change:
        p = p.where("run_id % 5 <> 0").withColumn("event_count", F.when(F.col("run_id") % 3 == 0, F.col("event_count") + 1).otherwise(F.col("event_count")))
    return fingerprints.run_digests(fingerprints.page_component(p, _PAGE_COLUMNS), "page")


@query("run_digests", _DIGESTS + "select * from dg")
def _(spark, sf):
    return _digests(spark, sf)


@query("run_digests_deep", f""", r as (select run_id, data_type, sha256({' || '.join(map(_F, ['event_id', 'rel_ms', 'target_id', 'amount']))}) as d from ev),
p as (select run_id, sha256(string_agg(d, '' order by d)) as d from r group by run_id, data_type)
select run_id, sha256(string_agg(d, '' order by d)) as events_digest from p group by 1""")
def _(spark, sf):
    return fingerprints.event_component(B.events(spark, sf), ["run_id", "data_type"], ["event_id", "rel_ms", "target_id", "amount"])


@query("corpus_fingerprint", _DIGESTS + ", g as (select substr(digest, 1, 3) as g, count(*) as n, sha256(string_agg(digest, '' order by digest)) as d from dg group by 1) select 'page' as grade, cast(sum(n) as bigint) as runs, sha256(string_agg(d, '' order by d)) as fingerprint from g")
def _(spark, sf):
    return fingerprints.corpus_fingerprint(_digests(spark, sf))


@query("fingerprint_drift", "select distinct run_id, case when run_id % 5 = 0 then 'gone' else 'changed' end as change from pg where run_id % 5 = 0 or run_id % 3 = 0")
def _(spark, sf):
    return fingerprints.drift(_digests(spark, sf), _digests(spark, sf, change=True))


@query("derivation_verify", "select distinct 'd1' as derivation_id, run_id, case when run_id % 5 = 0 then 'missing' else 'drifted' end as state from pg where run_id % 5 = 0 or run_id % 3 = 0")
def _(spark, sf):
    _, recorded = fingerprints.begin("d1", "test", _digests(spark, sf), "strict")
    return fingerprints.verify(recorded, _digests(spark, sf, change=True))


# --- sinks and lookups -------------------------------------------------------


@query("sink_upsert", "select c_custkey, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as segment from customer union all select c_custkey + 1000000, 'new' from customer where c_custkey % 2 = 0 and c_custkey < 10")
def _(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("segment"))
    return sinks.upsert(c, new.unionAll(new.where("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 1000000)), ["c_custkey"])


@query("sink_insert_absent", "select c_custkey, c_mktsegment as segment from customer union all select c_custkey + 1000000, 'new' from customer where c_custkey < 10")
def _(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.select("c_custkey", F.lit("new").alias("segment"))
    return sinks.insert_absent(c, new.where("c_custkey % 2 = 0").unionAll(new.where("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 1000000)), ["c_custkey"])


@query("sink_carry_over", "select run_id, case when run_id % 2 = 0 then 'dup-' || (run_id // 2) end as duplicate_group_id, case when run_id % 2 = 0 then is_canonical end as is_canonical from ru")
def _(spark, sf):
    prior = B.runs(spark, sf).where("run_id % 2 = 0").select("run_id", F.expr("'dup-' || (run_id div 2)").alias("duplicate_group_id"), "is_canonical")
    new = B.runs(spark, sf).select("run_id", F.lit(None).cast("string").alias("duplicate_group_id"), F.lit(None).cast("int").alias("is_canonical"))
    return sinks.carry_over(new, prior)


@query("table_counts", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in ("region", "nation", "customer", "orders", "lineitem", "events")))
def _(spark, sf):
    return tables.counts({t: B.table(spark, sf, t) for t in ("region", "nation", "customer", "orders", "lineitem", "events")})


@query("scan_events_of_runs", "select event_id, run_id, rel_ms from ev where data_type = 'click' and run_id in (select run_id from ru where is_canonical = 1)")
def _(spark, sf):
    kept = runs.RunSet.select(B.runs(spark, sf), runs.DedupePolicy.STRICT).included
    return B.events(spark, sf).where("data_type = 'click'").join(kept.select("run_id"), "run_id", "left_semi").select("event_id", "run_id", "rel_ms")


def _registry(spark):
    rows = [(0, "urgent", "1-URGENT", ["first"], [3, 5]), (1, "high", "2-HIGH", [], [7]), (2, "low", "5-LOW", ["4-not specified"], [])]
    return spark.createDataFrame(rows, "position int, key string, display_name string, aliases array<string>, encounter_ids array<long>")


@query(
    "dungeon_resolution",
    "select run_id, case when run_id % 50 in (3, 5) then 'urgent' when run_id % 50 = 7 then 'high' when dungeon_key = '1-URGENT' then 'urgent' when dungeon_key = '2-HIGH' then 'high' when dungeon_key in ('5-LOW', '4-NOT SPECIFIED') then 'low' end as dungeon_key from ru",
)
def _(spark, sf):
    r = B.runs(spark, sf).select("run_id", (F.col("run_id") % 50).alias("encounter_id"), F.col("dungeon_key").alias("zone_name"))
    return lookups.resolve_dungeons(r, _registry(spark))


@query("focus_actor", "select run_id, case when bool_or(player_id = 11) then 11 else 7 end::bigint as actor_id from ro where player_id in (7, 11) group by 1")
def _(spark, sf):
    r = B.roster(spark, sf).select("run_id", F.col("player_id").alias("actor_id"))
    names = r.withColumn("name", F.concat(F.lit("p"), F.col("actor_id").cast("string")))
    return lookups.focus_actor(names, r, ["p11", "p7"])


@query(
    "known_limitations",
    _ASSIGNED + _OVERLAPS + """, st as (select (select count(*) from ru) as runs, (select count(*) from ru where is_canonical is null) as unclassified, (select count(*) from eva where pull_id is null) as unassigned, (select count(*) from ov) as n_over, (select count(*) from ev where hostility = 'Enemies' and source_instance is null) as no_instance)
select cast(slot as integer) as slot, text from st, (values (1, 'some runs were never checked for duplicates'), (2, 'some events lie in no pull'), (3, 'some pulls overlap, and their events went to the later one'), (4, 'some enemy casts do not say which copy cast them'), (7, 'results describe what was collected, not what exists')) t(slot, text)
where (slot = 1 and unclassified > 0) or (slot = 2 and unassigned > 0) or (slot = 3 and n_over > 0) or (slot = 4 and no_instance > 0) or slot = 7""",
)
def _(spark, sf):
    a = assigned(spark, sf)
    state = B.runs(spark, sf).agg(F.count("*").alias("runs"), F.count_if(F.col("is_canonical").isNull()).alias("unclassified"))
    free = a.agg(F.count_if(F.col("pull_id").isNull()).alias("unassigned"), F.count_if((F.col("hostility") == "Enemies") & F.col("source_instance").isNull()).alias("no_instance"))
    o = intervals.overlap_pairs(B.pulls(spark, sf)).agg(F.count("*").alias("overlaps"))
    state = state.join(free, how="cross").join(o, how="cross").withColumns({"shapes": F.lit(1), "inseparable": F.lit(0)})  # one row each
    return lookups.limitations(state)


@query("rank_positions", "select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as rank from documents")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("source", "doc_id", (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("rank"))


from emberlog import registry_codecs, registry_ingest, registry_models, registry_stores, registry_views  # noqa: E402, F401  register their queries here
