"""Runs that several reports uploaded: candidate pairs, scores, groups and the canonical one.

Pairs are not searched among all runs: a pair agrees in dungeon and key level and
its starts lie within the tolerance, so runs meet by (dungeon, level, start bucket)
and look into the bucket before. Groups need no list of all pairs: pairs that connect the
same runs do, and their number grows with the runs where that of all pairs grows with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from emberlog.session import drop_scratch, materialize

TOLERANCE_MS = 5 * 60 * 1000
MIN_CONFIDENCE, MIN_ROSTER_OVERLAP = 0.5, 0.6


def fingerprints(runs: DataFrame, roster: DataFrame) -> DataFrame:
    """Runs with their sorted roster, an empty array without one, and their affixes (null: unknown)."""
    who = roster.groupBy("run_id").agg(F.array_sort(F.collect_set("player_id")).alias("roster"))
    return _affixed(runs).join(who, "run_id", "left").withColumn("roster", F.coalesce("roster", F.array().cast(who.schema["roster"].dataType)))


def _affixed(runs: DataFrame) -> DataFrame:
    return runs if "affixes" in runs.columns else runs.withColumn("affixes", F.lit(None).cast("array<long>"))


_CELL = ("dungeon_key", "no_level", "level")
_PRINT = ("run_id", "report_code", "abs_start_ms", "duration_ms", "roster", "affixes")


def candidates(prints: DataFrame, tolerance_ms: int = TOLERANCE_MS, spanning: bool = False) -> DataFrame:
    """Pairs a < b of different reports with equal dungeon (null never matches), equal level (null matches null) and close starts.
    ``spanning``: not all, but so many that the likely ones among them connect the same runs as all likely ones do."""
    if spanning:
        return _spanning(prints, tolerance_ms)
    p = _affixed(prints).where("dungeon_key is not null").withColumn("bucket", F.floor(F.col("abs_start_ms") / (tolerance_ms + 1)))
    # null levels match each other: the flag tells them from any number
    level = [F.col("keystone_level").isNull().alias("no_level"), F.coalesce("keystone_level", F.lit(0)).alias("level")]
    side = lambda s: p.select("dungeon_key", *level, *[F.col(c).alias(f"{s}_{c}") for c in ("run_id", "report_code", "abs_start_ms", "duration_ms", "roster", "affixes")], "bucket")
    left = side("a").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    met = left.join(side("b"), ["dungeon_key", "no_level", "level", "bucket"])
    return met.where((F.col("a_run_id") < F.col("b_run_id")) & (F.col("a_report_code") != F.col("b_report_code")) & (F.abs(F.col("a_abs_start_ms") - F.col("b_abs_start_ms")) <= tolerance_ms)).drop("bucket")


def _met(rows: DataFrame, tolerance_ms: int) -> DataFrame:
    """Candidates out of runs x and y of a cell."""
    first = F.col("x.run_id") < F.col("y.run_id")
    met = rows.where((F.col("x.run_id") != F.col("y.run_id")) & (F.col("x.report_code") != F.col("y.report_code")) & (F.abs(F.col("x.abs_start_ms") - F.col("y.abs_start_ms")) <= tolerance_ms))
    met = met.select(*_CELL, F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    return met.select(*_CELL, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in _PRINT])


def _nearest(by: list[str], asked: list[tuple[str, str]], tolerance_ms: int, names: list[str]) -> Callable:
    """Over rows in order: each with the last ones of other reports before it in its stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            old = 0 if kept is None else len(kept)
            rows = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches(max_chunksize=None)[0]
            n, at = len(rows), np.arange(len(rows))
            start = rows.column("abs_start_ms").to_numpy()
            code = pc.dictionary_encode(rows.column("report_code")).indices.to_numpy()
            new = np.append(True, np.zeros(n - 1, bool))
            for key in map(rows.column, by):
                new[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(new, at, 0))
            needed, x, y = [], [], []
            for who, among in asked:
                own = rows.column(among).to_numpy(zero_copy_only=False)
                upto = np.maximum.accumulate(np.where(own, at, -1))
                last = np.append(-1, upto[:-1])
                last = np.where(last >= first, last, -1)
                other = (last >= 0) & (code[last] != code)
                # of the last one's own report: the last one of another
                turned = np.maximum.accumulate(np.where(own & other, at, -1))
                turn = np.where(turned >= first, last[turned], -1)
                near = np.where(other, last, turn)
                held = (near >= 0) & (at >= old) & rows.column(who).to_numpy(zero_copy_only=False)
                held &= np.abs(start - start[near]) <= tolerance_ms
                x.append(at[held])
                y.append(near[held])
                needed += [upto[-1] if upto[-1] >= first[-1] else -1, turn[-1]]
            kept = rows.take(pa.array(np.unique([i for i in needed if i >= 0]), pa.int64()))
            x, y = np.concatenate(x), np.concatenate(y)
            for i in range(0, len(x), n):
                take = lambda c, of: rows.column(c).take(pa.array(of[i : i + n]))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*[take(c, x) for c in _CELL], *[take(c, x) for c in _PRINT], *[take(c, y) for c in _PRINT]], names)

    return run


def _beside(rows: DataFrame, by: list[str], asked: list[tuple[str, str]], tolerance_ms: int) -> DataFrame:
    """(cell, x, y): beside each run x of the rows for which the first column of a pair of ``asked`` is true, the nearest runs y of
    other reports before and behind it, by start, among those for which the second is. Where all pairs of x and y so near
    count, they connect what all pairs do. Rows are dealt out so that those equal in ``by`` lie together."""
    names = [*_CELL, *[f"{s}_{c}" for s in "xy" for c in _PRINT]]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{n} {kinds[n if n in _CELL else n[2:]]}" for n in names)
    told = {c: f"told_{c}" for c in by if kinds[c].startswith("array")}
    keyed = rows.select(F.xxhash64(*by).alias("hash"), *[F.to_json(c).alias(t) for c, t in told.items()], *dict.fromkeys([*by, *_PRINT, *[c for pair in asked for c in pair]]))
    keys = [told.get(c, c) for c in by]
    found = [keyed.sortWithinPartitions("hash", *keys, way("abs_start_ms"), way("run_id")).drop("hash").mapInArrow(_nearest(keys, asked, tolerance_ms, names), schema) for way in (F.asc, F.desc)]
    side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in _PRINT]).alias(s)
    return found[0].unionAll(found[1]).select(*_CELL, side("x"), side("y"))


#: Stretches of time are so many tolerances long; a run near the end of one counts in the next one too.
_STRETCH = 4
#: Durations that are alike have logarithms that differ by less.
_ALIKE_LOG = 0.106


def _spanning(prints: DataFrame, tolerance_ms: int) -> DataFrame:
    """Pairs that connect what all likely pairs do. Which pairs are likely depends on the rosters:

    - equal ones that are known: all within the tolerance are, so the nearest ones in time connect them;
    - one that is unknown: those are that start nearly at once, those of equal affixes that start nearer than some
      time, and others of which the durations are alike; the nearest ones in time connect the first two kinds,
      the third is listed;
    - others: two runs share a player among some of the smaller roster's.
    """
    level = [F.col("keystone_level").isNull().alias("no_level"), F.coalesce("keystone_level", F.lit(0)).alias("level")]
    p = _affixed(prints).where("dungeon_key is not null and abs_start_ms is not null and report_code is not null")
    p = materialize(p.select("dungeon_key", *level, *_PRINT), "prints")
    unknown, start = F.size("roster") == 0, F.col("abs_start_ms")
    known = p.where(~unknown)
    equal = _beside(known.withColumn("every", F.lit(True)).repartition(*_CELL, "roster"), [*_CELL, "roster"], [("every", "every")], tolerance_ms)
    length = _STRETCH * (tolerance_ms + 1)
    part = F.floor(start / length)
    parts = F.when(start - part * length <= tolerance_ms, F.array(part, part - 1)).otherwise(F.array(part))
    # beside an unknown roster the other one counts for nothing, and isn't carried
    bare = p.withColumns({"unknown": unknown, "every": F.lit(True), "roster": F.array().cast(p.schema["roster"].dataType)})
    unknown = F.col("unknown")
    dealt = bare.withColumn("part", F.explode(parts)).repartition(*_CELL, "part")
    asked = [("every", "unknown"), ("unknown", "every")]
    # how far apart starts may lie where only so many points don't depend on them
    reach = lambda points: int(tolerance_ms * min(1, (points + 0.3 - MIN_CONFIDENCE + 0.001) / 0.3)) + 1
    at_once = _beside(dealt, [*_CELL, "part"], asked, reach(0.2))
    affixed = _beside(dealt.where("size(affixes) > 0"), [*_CELL, "part", "affixes"], asked, reach(0.3))

    whole = bare.where("duration_ms is not null").withColumns({"bucket": F.floor(start / (tolerance_ms + 1)), "scale": F.when(F.col("duration_ms") >= 1, F.floor(F.ln("duration_ms") / _ALIKE_LOG)).otherwise(-9)})
    around = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)]))
    # files are smaller than what is read from them, so no size makes one side fit the driver
    asks = whole.where(unknown).select(*_CELL, F.struct(*_PRINT).alias("x"), around("bucket").alias("bucket"), "scale").withColumn("scale", around("scale")).hint("merge")
    alike = asks.join(whole.select(*_CELL, F.struct(*_PRINT).alias("y"), (~unknown).alias("known"), "bucket", "scale"), [*_CELL, "bucket", "scale"])
    longer = F.greatest(F.lit(1), "x.duration_ms", "y.duration_ms")
    alike = alike.where((F.abs(F.col("x.duration_ms") - F.col("y.duration_ms")) <= 0.1 * longer) & (F.col("known") | (F.col("x.run_id") < F.col("y.run_id"))))

    size = F.size("roster")
    some = F.slice("roster", 1, (size - F.ceil(MIN_ROSTER_OVERLAP * size - 1e-9) + 1).cast("int"))
    posted = lambda s, players, parts: known.select(*_CELL, F.col("run_id").alias(s), F.col("abs_start_ms").alias(f"{s}_start"), size.alias(f"{s}_size"), F.xxhash64("roster").alias(f"{s}_roster"), F.explode(parts).alias("part"), players.alias("players")).withColumn("player", F.explode("players")).select(F.xxhash64(*_CELL, "part", "player").alias("at"), s, f"{s}_start", f"{s}_size", f"{s}_roster")
    smaller = posted("x", some, F.sequence(F.floor((start - tolerance_ms) / length), F.floor((start + tolerance_ms) / length)))
    larger = posted("y", F.col("roster"), F.array(part))
    shares = smaller.join(larger.hint("merge"), "at").where((F.col("x_size") <= F.col("y_size")) & (F.col("x_roster") != F.col("y_roster")) & (F.abs(F.col("x_start") - F.col("y_start")) <= tolerance_ms) & ((F.col("x_size") < F.col("y_size")) | (F.col("x") < F.col("y"))))
    named = lambda s: p.select(*_CELL, F.col("run_id").alias(f"{s}_id"), F.struct(*_PRINT).alias(s)).hint("merge")
    pairs = shares.select(F.col("x").alias("x_id"), F.col("y").alias("y_id")).distinct().join(named("x"), "x_id").join(named("y").withColumnsRenamed({c: f"y_{c}" for c in _CELL}).hint("merge"), "y_id")
    pairs = pairs.where(" and ".join(f"{c} = y_{c}" for c in _CELL))
    parts = [equal, at_once, affixed, alike, pairs]
    met = [_met(f.select(*_CELL, "x", "y"), tolerance_ms) for f in parts]
    return met[0].unionAll(met[1]).unionAll(met[2]).unionAll(met[3]).unionAll(met[4])


def scored(pairs: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """Pairs with start gap, roster overlap, confidence and reasons; unlikely ones go.

    Points: dungeon and level 0.2, start gap up to 0.3, durations 0.2, roster overlap up
    to 0.3, equal known affixes 0.1. Overlap is over the smaller roster, 0 if one is empty;
    a low overlap rejects only if both are known. Different durations only withhold points.
    """
    gap = F.abs(F.col("a_abs_start_ms") - F.col("b_abs_start_ms"))
    known = (F.size("a_roster") > 0) & (F.size("b_roster") > 0)
    shared = F.size(F.array_intersect("a_roster", "b_roster"))
    overlap = F.when(known, shared / F.least(F.size("a_roster"), F.size("b_roster"))).otherwise(0.0)
    apart = F.abs(F.col("a_duration_ms") - F.col("b_duration_ms"))
    longest = F.greatest(F.lit(1), "a_duration_ms", "b_duration_ms")
    alike = F.coalesce(apart <= 0.1 * longest, F.lit(False))
    affixed = F.coalesce((F.size("a_affixes") > 0) & (F.col("a_affixes") == F.col("b_affixes")), F.lit(False))
    points = 0.2 + 0.3 * (1 - gap / tolerance_ms) + F.when(alike, 0.2).otherwise(0.0) + 0.3 * overlap + F.when(affixed, 0.1).otherwise(0.0)
    s = pairs.withColumns({"gap_ms": gap, "overlap": overlap, "known": known, "shared": shared, "alike": alike, "affixed": affixed, "confidence": F.least(F.lit(1.0), F.round(points, 3))})
    s = s.where((~F.col("known") | (F.col("overlap") >= MIN_ROSTER_OVERLAP)) & (F.col("confidence") >= MIN_CONFIDENCE))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    reasons = [
        F.concat(F.lit("dungeon "), "dungeon_key", F.lit(" at level "), text(F.when(~F.col("no_level"), F.col("level")))),
        F.concat(F.lit("start gap "), text(F.col("gap_ms")), F.lit(" ms")),
        F.concat(F.when(F.col("alike"), "durations alike: ").otherwise("durations differ: "), text(apart), F.lit(" ms")),
        F.when(F.col("known"), F.concat(F.lit("shared players "), text(F.col("shared")))).otherwise("roster unknown"),
        F.when(F.col("affixed"), "equal affixes"),
    ]
    return s.withColumn("reason", F.concat_ws("; ", *reasons)).drop("alike", "affixed", "no_level")


def diagnostics(pairs: DataFrame) -> DataFrame:
    """Scored pairs as diagnostics of their first run; both runs stay."""
    told = F.concat(F.lit("probably the same as "), F.col("b_run_id").cast("string"), F.lit(" ("), F.col("confidence").cast("decimal(4,3)").cast("string"), F.lit("): "), "reason")
    return pairs.select(F.col("a_run_id").alias("run_id"), F.lit("duplicate_candidate").alias("kind"), F.lit("info").alias("severity"), told.alias("detail"))


def groups(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, duplicate_group_id, is_canonical) of every run: groups are what pairs connect,
    named after their smallest run, which is canonical, as is a run in no group."""
    label = connected(pairs.select(F.col("a_run_id").alias("a"), F.col("b_run_id").alias("b")))
    joined = runs.select("run_id").join(label.withColumnRenamed("member", "run_id"), "run_id", "left")
    return joined.select("run_id", F.concat(F.lit("dup-"), F.col("label").cast("string")).alias("duplicate_group_id"), F.when(F.col("label").isNull() | (F.col("label") == F.col("run_id")), 1).otherwise(0).alias("is_canonical"))


#: Links up to which one task finds what they connect.
_TOGETHER = 100_000


def _turned(c: Column) -> Column:
    """The bits of a number in reverse: numbers that follow each other come far apart. Twice is nothing."""
    for mask, by in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
        c = F.shiftleft(c.bitwiseAND(F.lit(mask)), by).bitwiseOR(F.shiftrightunsigned(c, by).bitwiseAND(F.lit(mask)))
    return F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if len(batch)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    both = pa.concat_arrays([*table["a"].chunks, *table["b"].chunks]).dictionary_encode()
    a, b = np.split(both.indices.to_numpy(), 2)
    label = np.arange(len(both.dictionary))
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    yield pa.RecordBatch.from_arrays([both.dictionary, both.dictionary.take(pa.array(label))], ["member", "label"])


def connected(links: DataFrame, together: int = _TOGETHER) -> DataFrame:
    """(member, label) of every member of a link; the label is the smallest member.

    In a round each member goes to its least neighbour's least neighbour, and links are made anew between
    the places that they go to, so the table of links shrinks by a share each round; members are compared
    in an order that has nothing to do with theirs, so no chain of them is a long way down. Up to ``together`` links
    are left to one task. Lineage is cut by a table in the shared folder each round.
    """
    kind = links.schema["a"].dataType
    if isinstance(kind, IntegralType):
        put, back = lambda c: _turned(F.col(c).cast("long")), lambda c: _turned(F.col(c)).cast(kind)
    else:
        put, back = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.col(c).cast("string")), lambda c: F.substring(c, 17, 2**31 - 1).cast(kind)
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = materialize(links.select(put("a").alias("a"), put("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while (count := edges.count()) > together:
        both = edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way")).select("way.*")
        up = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "member"), "up")
        step = materialize(up.join(up.select(F.col("member").alias("up"), F.col("up").alias("to")), "up").select("member", "to"), "steps")
        drop_scratch(up)
        steps.append(step)
        side = lambda s: step.select(F.col("member").alias(s), F.col("to").alias(f"to_{s}"))  # noqa: B023, E731
        went = edges.join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b")
        after = materialize(went.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        drop_scratch(edges)
        edges = after
    name = edges.schema["a"].dataType.simpleString()
    label = materialize(edges.coalesce(1).mapInArrow(_in_one_task, f"member {name}, label {name}"), "labels") if count else None
    for step in reversed(steps):
        was, to = label, step.withColumnRenamed("to", "label")
        if was is not None:
            to = step.join(was.withColumnRenamed("member", "to"), "to", "left").select("member", F.coalesce("label", "to").alias("label"))
            label = materialize(to, "labels")
            drop_scratch(was)
        else:
            label = to
    if label is None:
        label = edges.select(F.col("a").alias("member"), F.col("b").alias("label"))
    least = label.groupBy("label").agg(F.min(back("member")).alias("least"))
    return materialize(label.join(least, "label").select(back("member").alias("member"), F.col("least").alias("label")), "labels")
