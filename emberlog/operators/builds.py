"""Build dimensions out of snapshots of combatants. Planned by the analysed design, beyond its code.

Talents, equipment, trinkets and stats have a digest each, so that one can be compared
without the others; item level is a column and in none of them. Snapshots are JSON whose
shape has changed over time, so they are read as variants and what a field holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the two trinkets in the list of gear.
TRINKETS = (12, 13)


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def builds(snapshots: DataFrame, json: str = "raw", stat_bucket: int = 100) -> DataFrame:
    """``snapshots`` with spec_id, item_level, talent_hash, equipment_hash, trinket_low, trinket_high,
    trinket_hash, stat_hash and config_hash.

    A talent is a number or an object with an ``id`` and perhaps a ``rank``; their order doesn't
    matter. Gear is a list in which a place without an item is null or has the id 0. Trinkets are an unordered
    pair, stats are rounded down to ``stat_bucket``. What a snapshot doesn't tell is null, not a
    digest of nothing; text that is no JSON tells nothing.
    """
    v = F.try_parse_json(json)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    part = lambda x, path, kind: F.try_variant_get(x, path, kind)
    df = snapshots.withColumns({"own talents": get("$.talents", "array<variant>"), "own gear": get("$.gear", "array<variant>"), "own stats": get("$.stats", "map<string,variant>"), "spec_id": get("$.specID", "long"), "item_level": get("$.itemLevel", "double")})
    rank = lambda x: F.concat_ws(":", F.coalesce(part(x, "$.id", "long"), part(x, "$", "long")).cast("string"), F.coalesce(part(x, "$.rank", "long"), F.lit(1)).cast("string"))
    item = lambda x: F.coalesce(part(x, "$.id", "long"), part(x, "$", "long"))
    worn = F.transform("own gear", lambda x, i: F.struct(i.alias("slot"), item(x).alias("id"), part(x, "$.permanentEnchant", "long").alias("enchant"), F.array_sort(F.transform(F.coalesce(part(x, "$.gems", "array<variant>"), F.array().cast("array<variant>")), item)).alias("gems")))
    df = df.withColumn("own items", F.filter(worn, lambda x: F.coalesce(x["id"], F.lit(0)) != 0))
    trinkets = F.array_sort(F.transform(F.filter("own items", lambda x: x["slot"].isin(*TRINKETS)), lambda x: x["id"]))
    df = df.withColumn("own trinkets", trinkets)
    number = lambda x: F.floor(part(x, "$", "double") / stat_bucket).cast("long")
    stats = F.array_sort(F.transform(F.map_entries("own stats"), lambda e: F.struct(e["key"].alias("stat"), number(e["value"]).alias("bucket"))))
    # an item's slot tells nothing between the two trinkets
    plain = F.array_sort(F.transform("own items", lambda x: F.struct(F.when(x["slot"].isin(*TRINKETS), TRINKETS[0]).otherwise(x["slot"]).alias("slot"), x["id"].alias("id"), x["enchant"].alias("enchant"), x["gems"].alias("gems"))))
    said = lambda c: F.size(c) > 0
    df = df.withColumns({
        "talent_hash": F.when(said(F.col("own talents")), _digest(F.array_join(F.array_sort(F.transform("own talents", rank)), ","))),
        "equipment_hash": F.when(said(F.col("own items")), _digest(F.to_json(plain))),
        "trinket_low": F.get("own trinkets", F.lit(0)),
        "trinket_high": F.get("own trinkets", F.lit(1)),
        "trinket_hash": F.when(said(F.col("own trinkets")), _digest(F.array_join("own trinkets", ","))),
        "stat_hash": F.when(said(F.col("own stats")), _digest(F.to_json(stats))),
    })
    parts = [F.coalesce(c, F.lit("-")) for c in ("talent_hash", "equipment_hash", "trinket_hash", "stat_hash")]
    told = F.coalesce("talent_hash", "equipment_hash", "trinket_hash", "stat_hash").isNotNull()
    return df.withColumn("config_hash", F.when(told, _digest(F.concat_ws("|", *parts)))).drop("own talents", "own gear", "own stats", "own items", "own trinkets")
