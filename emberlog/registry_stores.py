"""Queries of lists, cache keys, overlays, token counts, answers and introspected schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import connector
from emberlog.functions import text as T
from emberlog.functions.tokenizers import token_count
from emberlog.operators import costs, lookups
from emberlog.plans import bindings as B
from emberlog.plans import report
from emberlog.registry import _GAPS, query
from emberlog.registry_ingest import _folder as folder
from emberlog.sources import config, paged, rawcache, reports

@query("cache_keys", "select r_name, substr(sha256('{\"kind\":\"zones\",\"params\":{\"name\":\"' || r_name || '\"},\"query_version\":1}'), 1, 32) as key from region")
def _(spark, sf):
    names = [r["r_name"] for r in B.table(spark, sf, "region").select("r_name").collect()]  # five rows; keys are made where requests are
    return spark.createDataFrame([(n, rawcache.cache_key("zones", 1, {"name": n})) for n in names], "r_name string, key string")


@query("report_list", "select 'code' || lpad(n_nationkey::varchar, 8, '0') as report_code, row_number() over (order by n_nationkey) - 1 as rank from nation where n_nationkey % 5 > 0")
def _(spark, sf):
    rows = B.table(spark, sf, "nation").orderBy("n_nationkey").collect()  # a list of 25 lines
    text = "\n".join(f"https://x.example/reports/code{r['n_nationkey']:08}#fight=1, note" if r["n_nationkey"] % 5 else "# a comment" for r in rows)
    return reports.parse_list(spark, f"{text}\n{text}")[0]


@query("overlay_names", "select p_name as key from part group by 1 having count(*) = 1")
def _(spark, sf):
    # the overlay is text for the configuration; its keys are the dungeons that one encounter bears
    p = B.table(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").cast("long").alias("id"))
    d = p.select("key", F.col("key").alias("display_name"), F.lit(None).cast("array<string>").alias("aliases")).distinct()
    matched = lookups.match_zones(d, p.select(F.col("id").alias("zone_id"), F.col("id").alias("encounter_id"), F.col("key").alias("name")))
    import yaml

    named = yaml.safe_load(config.overlay_yaml(matched))["dungeons"]  # one entry per configured dungeon
    return spark.createDataFrame([(x["key"],) for x in named], "key string")


@query("turn_token_counts", "select conv_id, turn, len(regexp_extract_all(text, '[^ \t\n\r\v\f]+'))::bigint as tokens from conversations")
def _(spark, sf):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import WhitespaceSplit

    words = Tokenizer(WordLevel({"[U]": 0}, unk_token="[U]"))  # a vocabulary that counts words
    words.pre_tokenizer = WhitespaceSplit()
    path = folder(spark, "words.json")
    store, at = paged.open_store(path)
    with store.open_output_stream(at) as f:
        f.write(words.to_str().encode())
    return B.table(spark, sf, "conversations").select("conv_id", "turn", token_count(F.col("text"), path).alias("tokens"))


@query("report_truncated", _GAPS + "select run_id, pages, working_ms, pauses from gp order by working_ms desc, run_id limit 20")
def _(spark, sf):
    section = report.Section("w", costs.session_gaps(B.pages(spark, sf), gap_ms=43_200_000), ["-working_ms", "run_id"])
    return spark.createDataFrame([tuple(r.values()) for r in report.collect([section])["w"]], "run_id long, pages long, working_ms long, pauses long")


@query("camel_words", "select p_partkey, lower(p_brand) || ' name count' as words from part")
def _(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", T.words(F.concat(F.lower("p_brand"), F.lit("NameCount"))).alias("words"))


# --- connector ---------------------------------------------------------------


@query("answer_outcomes", "select event_id, case ability_game_id % 8 when 0 then 'ok' when 1 then 'wait' when 2 then 'again' when 3 then 'again' when 4 then 'fatal' when 5 then 'again' when 6 then 'fatal' else 'again' end as outcome from ev")
def _(spark, sf):
    k = F.col("ability_game_id") % 8
    status = F.expr("case ability_game_id % 8 when 1 then 429 when 2 then 503 when 3 then 401 when 4 then 403 when 7 then null else 200 end")
    body = F.when(k == 5, "<html>").when(k == 6, '{"data": {"a": 1}, "errors": [{"message": "no"}]}').otherwise('{"data": {"a": 1}}')
    return B.events(spark, sf).select("event_id", connector.outcome(status, body).alias("outcome"))


def _types(spark, sf):
    ref = lambda kind, name, inner=None: F.struct(F.lit(kind).alias("kind"), name.alias("name"), *([inner.alias("ofType")] if inner is not None else []))
    none = F.lit(None).cast("string")
    owner = F.struct(F.lit("owner").alias("name"), F.array().cast("array<struct<name:string>>").alias("args"), ref("NON_NULL", none, ref("LIST", none, ref("OBJECT", F.col("n_name")))).alias("type"))
    value = F.struct(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("name"), F.array(F.struct(F.lit("limit").alias("name"))).alias("args"), ref("SCALAR", F.lit("Int")).alias("type"))
    each = F.explode(F.array(F.to_json(F.struct(owner)), F.to_json(F.struct(value))))
    n = B.table(spark, sf, "nation").withColumn("part", each)
    wrapped = F.concat(F.lit('{"kind":"OBJECT","name":"T'), F.col("n_nationkey").cast("string"), F.lit('","fields":['), F.regexp_replace("part", '^\\{"col1":|\\}$', ""), F.lit("]}"))
    return n.select(wrapped.alias("type"))


@query("schema_fields", "select 'T' || n_nationkey as type, 'owner' as field, false as takes_arguments, 'OBJECT' as kind, n_name as named from nation union all select 'T' || n_nationkey, 'f' || n_regionkey, true, 'SCALAR', 'Int' from nation")
def _(spark, sf):
    return connector.type_fields(_types(spark, sf))


@query("schema_absent", "select 'T' || n_nationkey as type, 'f2' as field from nation where n_regionkey <> 2")
def _(spark, sf):
    wanted = B.table(spark, sf, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("type"), F.explode(F.array(F.lit("owner"), F.lit("f2"))).alias("field"))
    return connector.absent(wanted, connector.type_fields(_types(spark, sf)))
