"""Queries of the timeline codecs, their legends and measurements, and of settings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberlog.functions import driver
from emberlog.functions.text import salt_fingerprint
from emberlog.operators import timelines
from emberlog.registry import _DELTA, _FIRST, _RANK, SALT, _timeline, query, rounded

_NULL = "coalesce(cast({} as varchar), 'null')"
_A = "'{\"rel_ms\":' || rel_ms || ',\"type\":\"' || type || '\",\"source_id\":' || source_id || ',\"source_instance\":' || " + _NULL.format("source_instance") + " || ',\"target_id\":' || " + _NULL.format("target_id") + " || ',\"target_instance\":null,\"ability_game_id\":' || ability_game_id || ',\"amount\":' || amount || '}'"
_B = "'[' || delta || ',\"' || type || '\",' || source_id || ',' || " + _NULL.format("source_instance") + " || ',' || " + _NULL.format("target_id") + " || ',null,' || ability_game_id || ',' || amount || ']'"
_EVENTS = "select run_id as timeline, event_id as seq, rel_ms, type, source_id, source_instance, target_id, cast(null as bigint) as target_instance, ability_game_id, amount from ev"
_LETTER = "case {} when 'click' then 'C' when 'error' then 'E' when 'purchase' then 'P' when 'signup' then 'S' else 'V' end"


@query("codec_a_lines", f"select run_id as timeline, event_id as seq, {_A} as line from ev")
def _(spark, sf):
    return timelines.encode(_timeline(spark, sf), "A")


@query(
    "codec_e_lines",
    f""", d as ({_DELTA}), ty as (select type, row_number() over (order by type) - 1 as code from (select distinct type from ev))
select d.timeline, d.seq, delta || ' ' || code || ' ' || source_id || ' ' || coalesce(cast(source_instance as varchar), '_') || ' ' || coalesce(cast(target_id as varchar), '_') || ' _ ' || ability_game_id || ' ' || amount as line
from d join ev on ev.event_id = d.seq join ty using (type)""",
)
def _(spark, sf):
    t = _timeline(spark, sf)
    return timelines.encode(t, "E", timelines.Dictionary.build(t))


def _back(spark, sf, codec: str):
    t = _timeline(spark, sf)
    d = timelines.Dictionary.build(t, by_frequency=codec == "G")
    return timelines.decode(timelines.encode(t, codec, d), codec, d)


for _codec in ("A", "B", "C", "E", "G"):
    query(f"codec_{_codec.lower()}_round_trip", _EVENTS)(lambda spark, sf, codec=_codec: _back(spark, sf, codec))


@query(
    "codec_legends",
    _RANK + _FIRST + f""", e as (select timeline, string_agg('E' || appearance || '=' || actor || coalesce(':' || instance, ''), ' ' order by appearance) as t from en group by 1),
a as (select run_id as timeline, string_agg('a' || rank || '=' || ability_game_id, ' ' order by rank) as t from (select distinct run_id, ability_game_id from ev) join rk using (ability_game_id) group by 1),
t as (select run_id as timeline, string_agg({_LETTER.format('type')} || '=' || type, ' ' order by type) as t from (select distinct run_id, type from ev) group by 1)
select timeline, '#v scheme=none' || chr(10) || '#E ' || e.t || chr(10) || '#A ' || a.t || chr(10) || '#T ' || t.t as legend from e join a using (timeline) join t using (timeline)""",
)
def _(spark, sf):
    t = _timeline(spark, sf)
    return timelines.Dictionary.build(t, by_frequency=True).legends(t).select("timeline", "legend")


_TOKENS = "cast(coalesce(list_sum(list_transform(regexp_extract_all(line, '[\\p{L}\\p{N}]+'), lambda w: (length(w) + 3) // 4)), 0) + length(regexp_replace(line, '[\\p{L}\\p{N}\\s]', '', 'g')) as bigint)"


@query(
    "codec_measured",
    f""", d as (select *, rel_ms - coalesce(lag(rel_ms) over w, 0) as delta, row_number() over w as rn, count(*) over (partition by run_id) as whole from ev window w as (partition by run_id order by event_id)),
l as (select run_id as timeline, 'A' as codec, rn, whole, {_A} as line from d union all select run_id, 'B', rn, whole, {_B} from d),
m as (select timeline, codec, scale, count(*) as events, cast(sum(octet_length(encode(line))) + count(*) - 1 as bigint) as total_bytes, cast(sum({_TOKENS}) as bigint) as tokens
  from l, (values (10), (50), (0)) s(scale) where scale = 0 or rn <= scale and whole >= scale group by 1, 2, 3),
a as (select timeline, scale, tokens as of_a from m where codec = 'A')
select timeline, scale, codec, events, total_bytes, 0::bigint as legend_bytes, tokens, {rounded("total_bytes", "events", 2)} as bytes_per_event, {rounded("tokens", "events", 3)} as tokens_per_event, true as reversible, {rounded("tokens", "of_a", 3)} as ratio_to_a
from m join a using (timeline, scale)""",
)
def _(spark, sf):
    t = _timeline(spark, sf)
    both = [timelines.measured(t, codec, scales=(10, 50, None)) for codec in ("A", "B")]
    return timelines.against_a(both[0].unionAll(both[1]))


@query(
    "codec_reads_back",
    "select run_id as timeline, bool_and(target_id is not null) as reversible from ev group by 1",
)
def _(spark, sf):
    # a decoder that takes an unknown target for 0 is found out in the timelines that have one
    t = _timeline(spark, sf)
    spoilt = timelines.decode(timelines.encode(t, "B"), "B").withColumn("target_id", F.coalesce("target_id", F.lit(0)))
    return timelines.reads_back(t, spoilt)


@query("settings_read", """select c_custkey, 'v' || c_custkey as plain, c_name || ' # no comment' as quoted, case when c_custkey % 2 = 0 then '' end as empty from customer""")
def _(spark, sf):
    @arrow_udf("struct<plain:string,quoted:string,empty:string>")
    def read(text: pa.Array) -> pa.Array:
        made = [driver.parse_dotenv(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([m.get(k) for m in made], pa.string()) for k in ("PLAIN", "QUOTED", "EMPTY")], ["plain", "quoted", "empty"])

    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("# c\nexport PLAIN = v"), k, F.lit("  # comment\nQUOTED='"), F.col("c_name"), F.lit(" # no comment'\n"), F.when(F.col("c_custkey") % 2 == 0, "EMPTY=\n").otherwise("EMPTY\n"))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", read(text).alias("s")).select("c_custkey", "s.*")


@query("salt_stamp", f"select substr(sha256('{SALT}'), 1, 12) as fingerprint, r_regionkey from region")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/region.parquet").select(F.lit(salt_fingerprint(SALT)).alias("fingerprint"), "r_regionkey")
