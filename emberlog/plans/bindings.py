"""The driver's tables seen as a corpus of runs, pulls, events and rosters.

Each binding is a projection that pushes down to the Parquet scan; nulls that the
tables lack are made with expressions, so that null semantics are exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combat events: a user is a run and the source, the type is data type and event type."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        "event_id",
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("data_type"),
        F.when(F.col("k") % 3 == 1, "Enemies").when(F.col("k") % 3 == 2, "Friendlies").alias("hostility"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("rel_ms"),
        F.col("event_type").alias("type"),
        F.col("user_id").alias("source_id"),
        F.expr("nullif(k % 4, 0)").alias("source_instance"),
        F.expr("nullif(k % 11, 0)").alias("target_id"),
        F.col("k").alias("ability_game_id"),
        F.floor("value").cast("long").alias("amount"),
        F.col("value"),
        F.col("props"),
    )


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals inside a run: each purchase opens one of ``value`` minutes."""
    p = events(spark, sf_dir).where("type = 'purchase'")
    return p.select(
        F.concat_ws(":", F.col("run_id").cast("string"), F.col("event_id").cast("string")).alias("pull_id"),
        "run_id",
        F.col("rel_ms").alias("rel_start_ms"),
        (F.col("rel_ms") + F.floor(F.col("value") * 60000).cast("long")).alias("rel_end_ms"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("report_code"),
        F.expr("case when o_orderkey % 41 = 0 then null else o_orderpriority end").alias("dungeon_key"),
        F.expr("case when o_orderkey % 23 = 0 then null else 2 + o_orderkey % 18 end").alias("keystone_level"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("abs_start_ms"),
        (F.floor("o_totalprice").cast("long") * 10).alias("duration_ms"),
        F.expr("case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 0 else 1 end").alias("is_canonical"),
        F.expr("case when o_orderkey % 4 = 0 then null else array(9 + o_orderkey % 3, 10) end").alias("affixes"),
        F.expr("case o_orderstatus when 'F' then 'complete' when 'O' then 'partial-run' else 'metadata-only' end").alias("collection_status"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("player_id")).distinct()


def pull_npcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pull_id"),
        F.expr("l_partkey % 200").alias("npc_game_id"),
        F.expr("case when l_linenumber % 4 = 0 then null else cast(floor(l_quantity) as bigint) end").alias("instance_count"),
    )


def pages(spark: SparkSession, sf_dir: str, size: int = 25) -> DataFrame:
    """Event pages of ``size`` events per stream; every seventh run's streams stay open."""
    w = W.partitionBy("run_id", "data_type").orderBy("rel_ms", "event_id")
    e = events(spark, sf_dir).withColumn("page_index", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    p = e.groupBy("run_id", "data_type", "page_index").agg(F.count("*").alias("event_count"), F.min("rel_ms").alias("fetched_at_ms"), F.max("rel_ms").alias("last_ms"))
    nxt = F.lead("fetched_at_ms").over(W.partitionBy("run_id", "data_type").orderBy("page_index"))
    return p.withColumn("next_cursor_ms", F.coalesce(nxt, F.when(F.col("run_id") % 7 == 0, F.col("last_ms"))))


#: The same bindings as DuckDB common table expressions.
SQL = """
ev as (
  select event_id, user_id as run_id, event_type as data_type,
    case when k % 3 = 1 then 'Enemies' when k % 3 = 2 then 'Friendlies' end as hostility,
    date_diff('millisecond', timestamp '2024-01-01 00:00:00', ts) as rel_ms, event_type as type, user_id as source_id,
    nullif(k % 4, 0) as source_instance, nullif(k % 11, 0) as target_id, k as ability_game_id,
    cast(floor(value) as bigint) as amount, value, props
  from (select *, cast(regexp_extract(props, '[0-9]+') as bigint) as k from events)
),
pu as (
  select run_id || ':' || event_id as pull_id, run_id, rel_ms as rel_start_ms,
    rel_ms + cast(floor(value * 60000) as bigint) as rel_end_ms
  from ev where type = 'purchase'
),
ru as (
  select o_orderkey as run_id, o_custkey as report_code,
    case when o_orderkey % 41 = 0 then null else o_orderpriority end as dungeon_key,
    case when o_orderkey % 23 = 0 then null else 2 + o_orderkey % 18 end as keystone_level,
    date_diff('millisecond', timestamp '1970-01-01 00:00:00', o_orderdate) as abs_start_ms,
    cast(floor(o_totalprice) as bigint) * 10 as duration_ms,
    case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 0 else 1 end as is_canonical,
    case when o_orderkey % 4 = 0 then null else [9 + o_orderkey % 3, 10] end as affixes,
    case o_orderstatus when 'F' then 'complete' when 'O' then 'partial-run' else 'metadata-only' end as collection_status
  from orders
),
ro as (select distinct l_orderkey as run_id, l_suppkey as player_id from lineitem),
np as (
  select l_orderkey as pull_id, l_partkey % 200 as npc_game_id,
    case when l_linenumber % 4 = 0 then null else cast(floor(l_quantity) as bigint) end as instance_count
  from lineitem
),
pg0 as (
  select run_id, data_type, page_index, count(*) as event_count, min(rel_ms) as fetched_at_ms, max(rel_ms) as last_ms
  from (select *, (row_number() over (partition by run_id, data_type order by rel_ms, event_id) - 1) // 25 as page_index from ev)
  group by all
),
pg as (
  select *, coalesce(lead(fetched_at_ms) over (partition by run_id, data_type order by page_index),
    case when run_id % 7 = 0 then last_ms end) as next_cursor_ms from pg0
)
"""


def sql(body: str) -> str:
    """``body``, a select or further expressions and a select, over the bindings."""
    body = body.strip()
    return f"with recursive {SQL.strip()}{'' if body.startswith(',') else chr(10)}{body}"
