"""Timeline codecs: ordered events as lines of text and back.

An event is (timeline, seq, rel_ms, type, source_id, source_instance, target_id,
target_instance, ability_game_id, amount). Order is always that of ``seq``. Lines
are per-row expressions over windows of one timeline; only putting a whole timeline
into one text collects, per timeline.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.numbers import ratio

VERSION = "1"
FIELDS = ["rel_ms", "type", "source_id", "source_instance", "target_id", "target_instance", "ability_game_id", "amount"]
EVENT = "timeline long, seq long, rel_ms long, type string, source_id long, source_instance long, target_id long, target_instance long, ability_game_id long, amount long"
CODECS = ("A", "B", "C", "D", "E", "G")


class CodecMismatch(ValueError):
    """Encoded with another version or dictionary."""


def delta_encode(events: DataFrame, by: str = "timeline", order: tuple = ("seq",)) -> DataFrame:
    """``delta``: the first time of a timeline, then differences."""
    w = W.partitionBy(by).orderBy(*order)
    return events.withColumn("delta", F.col("rel_ms") - F.coalesce(F.lag("rel_ms").over(w), F.lit(0)))


def delta_decode(encoded: DataFrame, by: str = "timeline", order: tuple = ("seq",)) -> DataFrame:
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return encoded.withColumn("rel_ms", F.sum("delta").over(w)).drop("delta")


def ability_ranks(events: DataFrame) -> DataFrame:
    """Abilities by frequency, then id, with their rank and symbol (a0 ...).

    Ranks run over one row per ability, after counting.
    """
    g = events.where("ability_game_id is not null").groupBy("ability_game_id").agg(F.count("*").alias("n"))
    return g.withColumn("rank", (F.row_number().over(W.orderBy(F.desc("n"), "ability_game_id")) - 1).cast("long")).withColumn("symbol", F.concat(F.lit("a"), F.col("rank").cast("string")))


def ability_symbols(events: DataFrame) -> DataFrame:
    """Abilities by id with the symbols A0 ..."""
    g = events.where("ability_game_id is not null").select("ability_game_id").distinct()
    return g.withColumn("symbol", F.concat(F.lit("A"), (F.row_number().over(W.orderBy("ability_game_id")) - 1).cast("string")))


def enemies(events: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """(timeline, actor, instance, symbol E1 ...) by first appearance, a source before the target of its event."""
    side = lambda s, k: events.where(F.col(f"{s}_id").isNotNull()).select("timeline", F.col(f"{s}_id").alias("actor"), F.col(f"{s}_instance").alias("instance"), F.struct("seq", F.lit(k).alias("side")).alias("at"))
    seen = side("source", 0).unionAll(side("target", 1))
    if players is not None:
        seen = seen.join(players.select("actor"), "actor", "left_anti")
    first = seen.groupBy("timeline", "actor", "instance").agg(F.min("at").alias("at"))
    rank = F.row_number().over(W.partitionBy("timeline").orderBy("at", "actor"))
    return first.select("timeline", "actor", "instance", rank.cast("long").alias("appearance"), F.concat(F.lit("E"), rank.cast("string")).alias("symbol"))


def type_codes(types: Iterable[str]) -> dict[str, str]:
    """One letter per type: its first free letter in upper case, then lower case, then X0 ... X9, then the type
    (with ~ behind it while another has that for a code). ``types`` come in order. Types that are their own
    code and no code of another's kind aren't listed, so the result is bounded by the alphabet."""
    codes: dict[str, str] = {}
    used: set[str] = set()
    for name in types:
        letters = [c for c in name if c.isalpha()]
        options = chain((c.upper() for c in letters), (c.lower() for c in letters), (f"X{i}" for i in range(10)), (name + "~" * i for i in count()))
        code = next(o for o in options if o not in used)
        if code != name or len(name) <= 2:
            codes[name] = code
            used.add(code)
    return codes


def type_numbers(events: DataFrame) -> DataFrame:
    """(type, number): event types in order, from 0. Numbers run over one row per type."""
    t = events.where("type is not null").select("type").distinct()
    return t.withColumn("number", (F.row_number().over(W.orderBy("type")) - 1).cast("long"))


def _table_digest(df: DataFrame) -> list[str]:
    """At most 256 digests that stand for all rows of a table, whatever their order."""
    rows = df.select(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256).alias("d"))
    for width in (4, 2):
        rows = rows.groupBy(F.substring("d", 1, width).alias("g")).agg(F.array_sort(F.collect_list("d")).alias("own"))
        rows = rows.select(F.concat("g", F.sha2(F.array_join("own", ""), 256)).alias("d"))
    return sorted(r["d"] for r in rows.collect())


class Dictionary:
    """Symbols of one encoding: types, abilities, actors by timeline, and players of all timelines."""

    def __init__(self, types: dict[str, str], numbers: DataFrame, abilities: DataFrame, actors: DataFrame, players: DataFrame | None = None):
        self.types, self.numbers, self.abilities, self.actors, self.players = types, numbers, abilities, actors, players

    @staticmethod
    def build(events: DataFrame, by_frequency: bool = False, players: DataFrame | None = None) -> Dictionary:
        """Types, abilities and actors are tables. The driver reads the distinct types in order, a part at a time,
        to deal out the letters, and keeps only those that get one. ``players``: (actor, symbol), which hold in every
        timeline and for any instance."""
        numbers = type_numbers(events)
        codes = type_codes(r["type"] for r in numbers.orderBy("number").toLocalIterator())
        a = (ability_ranks(events) if by_frequency else ability_symbols(events)).select("ability_game_id", "symbol")
        e = enemies(events, players).select("timeline", "actor", "instance", "symbol")
        return Dictionary(codes, numbers, a, e, None if players is None else players.select("actor", "symbol"))

    def code(self, name: Column) -> Column:
        """The code of a type; those without a letter stand for themselves."""
        return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(self.types.items()) for x in kv])[name], name) if self.types else name

    def type_of(self, code: Column) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for t, c in sorted(self.types.items()) for x in (c, t)])[code], code) if self.types else code

    def hash(self) -> str:
        """Digest of the legend: of each table the digests of its rows, sorted, joined in groups and those in
        groups again, so that every row counts and none can cancel another, and no list grows with the table."""
        tables = [df for df in (self.numbers, self.abilities, self.actors, self.players) if df is not None]
        return hashlib.sha256(json.dumps([self.types, *map(_table_digest, tables)], sort_keys=True).encode()).hexdigest()[:12]

    def legends(self, events: DataFrame) -> DataFrame:
        """(timeline, legend, legend_json) for the timelines of ``events``: the symbols that its events use.

        The text has a line for the scheme and one each for players (#P), enemies (#E),
        abilities (#A) and types (#T), as far as there are any; symbols in their order.
        """
        own = lambda df, *by: df.groupBy("timeline").agg(F.array_sort(F.collect_list(F.struct(*by))))
        number = F.regexp_extract("symbol", "[0-9]+$", 0).cast("long")
        used = events.where("ability_game_id is not null").select("timeline", "ability_game_id").distinct()
        abilities = used.join(self.abilities, "ability_game_id").select("timeline", number.alias("n"), "symbol", F.col("ability_game_id").cast("string").alias("name"))
        whose = F.concat_ws(":", F.col("actor").cast("string"), F.col("instance").cast("string"))
        actors = self.actors.select("timeline", number.alias("n"), "symbol", whose.alias("name"))
        named = events.where("type is not null").select("timeline", F.col("type").alias("name")).distinct()
        types = named.withColumn("n", F.row_number().over(W.partitionBy("timeline").orderBy("name")).cast("long")).select("timeline", "n", self.code(F.col("name")).alias("symbol"), "name")
        out = events.select("timeline").distinct()
        parts = [("#E", "enemies", actors), ("#A", "abilities", abilities), ("#T", "types", types)]
        if self.players is not None:
            acting = events.select("timeline", F.col("source_id").alias("actor")).unionAll(events.select("timeline", F.col("target_id").alias("actor"))).distinct()
            players = acting.join(self.players, "actor").select("timeline", F.lit(0).cast("long").alias("n"), "symbol", F.col("actor").cast("string").alias("name"))
            parts.insert(0, ("#P", "players", players))
        for _, name, df in parts:
            out = out.join(own(df, "n", "symbol", "name").toDF("timeline", name), "timeline", "left")
        spell = lambda mark: (lambda x: x["symbol"]) if mark == "#P" else (lambda x: F.concat(x["symbol"], F.lit("="), x["name"]))
        lines = [F.when(F.size(name) > 0, F.concat(F.lit(f"{mark} "), F.array_join(F.transform(name, spell(mark)), " "))) for mark, name, _ in parts]
        scheme = "group" if self.players is not None else "none"
        entries = lambda name: F.map_from_entries(F.transform(F.coalesce(name, F.array().cast("array<struct<n:long,symbol:string,name:string>>")), lambda x: F.struct(x["symbol"], x["name"])))
        whole = F.struct(F.lit(scheme).alias("player_scheme"), *[entries(F.col(name)).alias(name) for _, name, _ in parts])
        return out.select("timeline", F.concat_ws("\n", F.lit(f"#v scheme={scheme}"), *lines).alias("legend"), F.to_json(whole).alias("legend_json"))


def _symbols(events: DataFrame, d: Dictionary) -> DataFrame:
    ab = d.abilities.withColumnRenamed("symbol", "ability")
    out = events.join(ab, "ability_game_id", "left").withColumn("ability", F.coalesce("ability", F.lit("-")))
    for side in ("source", "target"):
        who = d.actors.select(F.col("timeline").alias("t2"), F.col("actor").alias("a2"), F.col("instance").alias("i2"), F.col("symbol").alias(side))
        match = (F.col("timeline") == F.col("t2")) & (F.col(f"{side}_id") == F.col("a2")) & F.col(f"{side}_instance").eqNullSafe(F.col("i2"))
        out = out.join(who, match, "left").drop("t2", "a2", "i2")
        if d.players is not None:
            named = d.players.select(F.col("actor").alias("a2"), F.col("symbol").alias("s2"))
            out = out.join(named, F.col(f"{side}_id") == F.col("a2"), "left").withColumn(side, F.coalesce("s2", side)).drop("a2", "s2")
        out = out.withColumn(side, F.coalesce(side, F.lit("?" if side == "source" else "-")))
    return out.withColumn("code", d.code(F.col("type")))


def default_targets(events: DataFrame) -> DataFrame:
    """(timeline, default_target, default_instance): the most frequent target of each timeline, of equal ones the largest as text."""
    g = events.where("target_id is not null").groupBy("timeline", "target_id", "target_instance").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("target_id", "target_instance"), F.struct("n", F.concat_ws(":", F.col("target_id").cast("string"), F.col("target_instance").cast("string"))))
    return g.groupBy("timeline").agg(best.alias("b")).select("timeline", F.col("b.target_id").alias("default_target"), F.col("b.target_instance").alias("default_instance"))


def encode(events: DataFrame, codec: str, d: Dictionary | None = None) -> DataFrame:
    """(timeline, seq, line). A: JSON objects; B: JSON arrays with time deltas; C and G: symbols;
    D: symbols that leave out the timeline's most frequent target; E: integers, null as ``_``."""
    if codec == "A":
        return events.select("timeline", "seq", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("line"))
    deltas = delta_encode(events)
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    if codec == "B":
        quoted = F.to_json(F.array("type"))
        parts = [F.col("delta").cast("string"), F.substring(quoted, F.lit(2), F.length(quoted) - 2), *map(n, FIELDS[2:])]
        return deltas.select("timeline", "seq", F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("line"))
    if d is None:
        raise ValueError(f"codec {codec} needs a dictionary")
    s = _symbols(deltas, d)
    amount = F.coalesce(F.col("amount").cast("string"), F.lit("-"))
    if codec in ("C", "G"):
        return s.select("timeline", "seq", F.concat(F.lit("+"), F.col("delta").cast("string"), F.lit(" "), "source", F.lit(" "), "code", F.lit(" "), "ability", F.lit(">"), "target", F.lit(" "), amount).alias("line"))
    if codec == "D":
        usual = default_targets(events)
        s = s.join(usual, "timeline", "left")
        is_usual = F.col("target_id").isNotNull() & F.col("target_id").eqNullSafe(F.col("default_target")) & F.col("target_instance").eqNullSafe(F.col("default_instance"))
        pair = F.when(is_usual, F.col("ability")).otherwise(F.concat("ability", F.lit(">"), "target"))
        return s.select("timeline", "seq", F.concat(F.lit("+"), F.col("delta").cast("string"), F.lit(" "), "source", F.lit(" "), "code", F.lit(" "), pair, F.lit(" "), amount).alias("line"))
    if codec == "E":
        number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
        s = s.join(d.numbers.withColumnRenamed("number", "type number"), "type", "left")
        return s.select("timeline", "seq", F.concat_ws(" ", F.col("delta").cast("string"), number("type number"), *map(number, FIELDS[2:])).alias("line"))
    raise ValueError(f"unknown codec {codec}")


def decode(lines: DataFrame, codec: str, d: Dictionary | None = None, events_default: DataFrame | None = None, expected: tuple[str, str] | None = None) -> DataFrame:
    """Events of (timeline, seq, line). ``expected`` is the (version, dictionary hash) of the encoding;
    ``events_default`` the default targets, which codec D's header declares."""
    if expected is not None and expected != (VERSION, d.hash() if d else ""):
        raise CodecMismatch(f"encoded with {expected}")
    longs = lambda df: df.select("timeline", "seq", *[F.col(c).cast("string" if c == "type" else "long").alias(c) for c in FIELDS])
    if codec == "A":
        return lines.select("timeline", "seq", F.from_json("line", ", ".join(f"{c} {'string' if c == 'type' else 'long'}" for c in FIELDS)).alias("e")).select("timeline", "seq", "e.*")
    if codec == "B":
        a = lines.withColumn("a", F.from_json("line", "array<string>"))
        a = a.select("timeline", "seq", F.get("a", F.lit(0)).cast("long").alias("delta"), *[F.get("a", F.lit(i)).alias(c) for i, c in enumerate(FIELDS) if i])
        return longs(delta_decode(a))
    p = lines.withColumn("p", F.split("line", " "))
    at = lambda i: F.get("p", F.lit(i))
    if codec == "E":
        a = p.select("timeline", "seq", at(0).cast("long").alias("delta"), F.nullif(at(1), F.lit("_")).cast("long").alias("number"), *[F.nullif(at(i), F.lit("_")).alias(c) for i, c in enumerate(FIELDS) if i > 1])
        return longs(delta_decode(a.join(d.numbers, "number", "left")))
    pair = F.split(at(3), ">")
    a = p.select("timeline", "seq", F.regexp_replace(at(0), "^\\+", "").cast("long").alias("delta"), at(1).alias("source"), d.type_of(at(2)).alias("type"), F.get(pair, F.lit(0)).alias("ability"), F.get(pair, F.lit(1)).alias("target"), F.nullif(at(4), F.lit("-")).cast("long").alias("amount"))
    a = a.join(d.abilities.withColumnRenamed("symbol", "ability"), "ability", "left")
    for side in ("source", "target"):
        who = d.actors.select("timeline", F.col("symbol").alias(side), F.col("actor").alias(f"{side}_id"), F.col("instance").alias(f"{side}_instance"))
        a = a.join(who, ["timeline", side], "left")
        if d.players is not None:
            named = d.players.select(F.col("symbol").alias(side), F.col("actor").alias("a2"))
            a = a.join(named, side, "left").withColumn(f"{side}_id", F.coalesce(f"{side}_id", "a2")).drop("a2")
    if codec == "D":
        a = a.join(events_default, "timeline", "left")
        left_out = F.col("target").isNull()
        a = a.withColumns({"target_instance": F.when(left_out, F.col("default_instance")).otherwise(F.col("target_instance")), "target_id": F.when(left_out, F.col("default_target")).otherwise(F.col("target_id"))})
    return longs(delta_decode(a))


def texts(lines: DataFrame) -> DataFrame:
    """Whole timelines: (timeline, text, events)."""
    g = lines.groupBy("timeline").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return g.select("timeline", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), F.size("l").cast("long").alias("events"))


def token_estimate(text: Column) -> Column:
    """A heuristic, not a tokenizer: a run of letters and digits costs a quarter of its length, at least 1, any other mark 1."""
    runs = F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    words = F.aggregate(runs, F.lit(0).cast("long"), lambda a, w: a + F.ceil(F.length(w) / 4).cast("long"))
    return words + F.length(F.regexp_replace(text, "[\\p{L}\\p{N}\\s]", "")).cast("long")


def measure(lines: DataFrame, scales: tuple = (10, 100, 1000, None), tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Bytes, lines and tokens of each timeline's first events, by scale (0 for all). Tokens are an
    estimate unless ``tokens`` counts them (:func:`emberlog.functions.tokenizers.token_count`), line by line."""
    w = W.partitionBy("timeline").orderBy("seq")
    numbered = lines.withColumn("rn", F.row_number().over(w)).withColumn("scale", F.explode(F.array(*[F.lit(s or 0) for s in scales])))
    part = numbered.where("scale = 0 or rn <= scale")
    return part.groupBy("timeline", "scale").agg(F.count("*").alias("lines"), (F.sum(F.octet_length("line")) + F.count("*") - 1).alias("bytes"), F.sum(tokens(F.col("line"))).alias("tokens"))


def reversible(events: DataFrame, decoded: DataFrame) -> bool:
    return reads_back(events, decoded).where("not reversible").isEmpty()


def reads_back(events: DataFrame, decoded: DataFrame) -> DataFrame:
    """(timeline, reversible): whether decoding gives the timeline's events, all of them and no others."""
    columns = ["timeline", "seq", *FIELDS]
    count = lambda df, by: df.select(*columns, F.lit(by).alias("by"))
    both = count(events, 1).unionAll(count(decoded, -1)).groupBy(*columns).agg(F.sum("by").alias("left"))
    return both.groupBy("timeline").agg((F.count_if(F.col("left") != 0) == 0).alias("reversible"))


def measured(events: DataFrame, codec: str, d: Dictionary | None = None, scales: tuple = (10, 100, 1000, None)) -> DataFrame:
    """:func:`measure` of a codec with its legend's bytes, whether it can be read back, and per-event figures.

    A scale that a timeline doesn't reach is left out. The legend counts once, in front.
    """
    lines = encode(events, codec, d)
    sizes = events.groupBy("timeline").agg(F.count("*").alias("whole"))
    m = measure(lines, scales).join(sizes, "timeline").where((F.col("scale") == 0) | (F.col("lines") == F.col("scale"))).drop("whole")
    back = reads_back(events, decode(lines, codec, d, default_targets(events) if codec == "D" else None))
    m = m.join(back, "timeline")
    if codec in ("A", "B"):
        legend = F.lit(0).cast("long")
    else:
        m, legend = m.join(d.legends(events).select("timeline", F.octet_length("legend").cast("long").alias("own")), "timeline"), F.col("own")
    m = m.withColumn("legend_bytes", legend)
    total = F.col("bytes") + F.when(F.col("legend_bytes") > 0, F.col("legend_bytes") + 1).otherwise(0)
    m = m.withColumn("total_bytes", total)
    return m.select("timeline", F.lit(codec).alias("codec"), "scale", F.col("lines").alias("events"), "total_bytes", "legend_bytes", "tokens", ratio(F.col("total_bytes"), F.col("lines"), 2).alias("bytes_per_event"), ratio(F.col("tokens"), F.col("lines"), 3).alias("tokens_per_event"), "reversible")


def against_a(measurements: DataFrame) -> DataFrame:
    """Measurements with the ratio of their tokens to those of codec A at the same scale."""
    a = measurements.where("codec = 'A'").select("timeline", "scale", F.col("tokens").alias("of_a"))
    return measurements.join(a, ["timeline", "scale"], "left").withColumn("ratio_to_a", ratio(F.col("tokens"), F.col("of_a"), 3)).drop("of_a")
