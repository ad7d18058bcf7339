"""Points in intervals, and intervals that overlap.

Intervals are closed and lie in a run. A long run would make an equi-join on the
run quadratic, so intervals are also cut into time bins and joined by (run, bin).
An interval lies in bins of the smallest width of which it covers MOST_BINS at most
(each width is MOST_BINS times the one before, the last takes any interval), so a wrong
end, however late, makes few rows. Points look into each width that some interval has,
in data without such ends one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN_MS = 3_600_000
#: Bins that an interval covers at most, but for one at its edge.
MOST_BINS = 64
#: Events of one run and bin that go to one task; more are split.
HOT_ROWS = 1_000_000


def bin_of(at: Column, width: int) -> Column:
    """The number of the bin that a time lies in, in whole numbers throughout."""
    return _floored(at, F.lit(width))


def _floored(at: Column, width: Column) -> Column:
    below = F.when(at % width < 0, 1).otherwise(0)  # division cuts off towards 0
    return (F.call_function("div", at, width) - below).cast("long")


def _widths(width: int) -> list[int]:
    out = [width]
    while out[-1] * MOST_BINS < 1 << 62:
        out.append(out[-1] * MOST_BINS)
    return out


def _level(start: Column, end: Column, width: int) -> Column:
    """Which of the widths an interval is cut by."""
    widths = _widths(width)
    level = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        level = F.when(bin_of(end, widths[i]) - bin_of(start, widths[i]) < MOST_BINS, i).otherwise(level)
    return level


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bin of each interval: level and bin."""
    widths = F.array(*[F.lit(x).cast("long") for x in _widths(width)])
    own = F.get(widths, F.col("level"))
    number = lambda c: _floored(F.col(c), F.col("own width"))
    df = df.withColumn("level", _level(F.col(start), F.col(end), width)).withColumn("own width", own)
    return df.withColumn("bin", F.explode(F.sequence(number(start), number(end)))).drop("own width")


def _levels(intervals: DataFrame, start: str, end: str, width: int) -> list[int]:
    """The levels that occur: a few numbers, whatever the number of intervals."""
    found = intervals.select(_level(F.col(start), F.col(end), width).alias("level")).distinct()
    return sorted(r["level"] for r in found.collect())


def _looking(at: str, levels: list[int], width: int) -> Column:
    """(level, bin) of a time, for each of the levels."""
    widths = _widths(width)
    return F.array(*[F.struct(F.lit(i).alias("level"), bin_of(F.col(at), widths[i]).alias("bin")) for i in levels])


def assign(events: DataFrame, pulls: DataFrame, bin_ms: int = BIN_MS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``events`` (run_id, rel_ms, ...) with pull_id and pull_rel_ms.

    Of several pulls that contain an event the one with the greatest (start, end, id)
    takes it; an event in no pull keeps nulls. A pull that ends before it starts
    contains nothing, nor does one without a start or end. Every row is an event of its
    own, whether or not ``event_id`` repeats.

    Events meet pulls by run and bin, and the greatest pull is taken where they meet. A bin
    with more than ``hot_rows`` events is split into as many parts as its count asks for,
    and its pulls go to all of these.
    """
    kept = [c for c in events.columns if c not in ("pull_id", "pull_rel_ms")]
    good = pulls.where("rel_end_ms >= rel_start_ms").select("run_id", "rel_start_ms", "rel_end_ms", "pull_id")
    levels = _levels(good, "rel_start_ms", "rel_end_ms", bin_ms) or [0]
    e = events.select(F.struct(*kept).alias("e"), F.col("run_id"), F.col("rel_ms"), F.monotonically_increasing_id().alias("row"))
    e = e.withColumn("look", F.explode_outer(_looking("rel_ms", levels, bin_ms))).select("e", "run_id", "rel_ms", "row", "look.level", "look.bin")
    place = ["run_id", "level", "bin"]
    crowded = events.select("run_id", F.explode(_looking("rel_ms", levels, bin_ms)).alias("look")).groupBy("run_id", "look.level", "look.bin").agg(F.count("*").alias("n"))
    crowded = crowded.where(F.col("n") > hot_rows).select(*place, F.ceil(F.col("n") / hot_rows).cast("int").alias("parts"))
    e = e.join(crowded, place, "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    p = _binned(good, "rel_start_ms", "rel_end_ms", bin_ms).join(crowded, place, "left")
    p = p.select(*place, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.struct("rel_start_ms", "rel_end_ms", "pull_id").alias("p"))
    p = p.select(*[F.col(c).alias(f"p_{c}") for c in (*place, "part")], "p")
    inside = (F.col("run_id") == F.col("p_run_id")) & (F.col("level") == F.col("p_level")) & (F.col("bin") == F.col("p_bin")) & (F.col("part") == F.col("p_part")) & F.col("rel_ms").between(F.col("p.rel_start_ms"), F.col("p.rel_end_ms"))
    met = e.join(p, inside, "left").groupBy(*place, "part", "row").agg(F.first("e").alias("e"), F.max("p").alias("p"))
    if len(levels) > 1:
        met = met.groupBy("row").agg(F.first("e").alias("e"), F.max("p").alias("p"))
    return met.select("e.*", F.col("p.pull_id").alias("pull_id"), (F.col("e.rel_ms") - F.col("p.rel_start_ms")).alias("pull_rel_ms"))


def assignment_stats(assigned: DataFrame, pulls: DataFrame) -> DataFrame:
    """Per run: events assigned, and those before the first pull, after the last-starting one's end, and between."""
    edges = pulls.groupBy("run_id").agg(F.min("rel_start_ms").alias("first_ms"), F.max(F.struct("rel_start_ms", "rel_end_ms"))["rel_end_ms"].alias("last_ms"))
    free = F.col("pull_id").isNull()
    e = assigned.join(edges, "run_id", "left")
    before, after = F.col("rel_ms") < F.col("first_ms"), F.col("rel_ms") > F.col("last_ms")
    return e.groupBy("run_id").agg(
        F.count("*").alias("events"),
        F.count("pull_id").alias("assigned"),
        F.count_if(free).alias("unassigned"),
        F.count_if(free & before).alias("before_first"),
        F.count_if(free & ~before & after).alias("after_last"),
        F.count_if(free & ~F.coalesce(before | after, F.lit(False))).alias("between_pulls"),
    )


def overlap_kind(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Of intervals with a_start <= b_start <= a_end: they touch in one point, b lies in a, or they overlap in part."""
    return F.when(b_start == a_end, "touching").when(b_end <= a_end, "nested").otherwise("partial")


def overlap_pairs(pulls: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Each pair of pulls of a run with a common millisecond, once: the earlier is (start, id)-smaller.

    A pair meets in the bin, of the earlier one's width, in which the later one starts, so it is found once.
    """
    good = pulls.where("rel_end_ms >= rel_start_ms")
    levels = _levels(good, "rel_start_ms", "rel_end_ms", bin_ms) or [0]
    a = _binned(good.select("run_id", F.col("pull_id").alias("a_pull"), F.col("rel_start_ms").alias("a_start"), F.col("rel_end_ms").alias("a_end")), "a_start", "a_end", bin_ms)
    b = good.select("run_id", F.col("pull_id").alias("b_pull"), F.col("rel_start_ms").alias("b_start"), F.col("rel_end_ms").alias("b_end"))
    b = b.withColumn("look", F.explode(_looking("b_start", levels, bin_ms))).select("run_id", "b_pull", "b_start", "b_end", "look.level", "look.bin")
    met = a.join(b, ["run_id", "level", "bin"]).where("b_start <= a_end and (a_start < b_start or (a_start = b_start and a_pull < b_pull))")
    until = F.least("a_end", "b_end")
    return met.select("run_id", "a_pull", "b_pull", F.col("b_start").alias("from_ms"), until.alias("until_ms"), (until - F.col("b_start")).alias("overlap_ms"), overlap_kind(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")).alias("kind"))


def adjacent_overlaps(pulls: DataFrame) -> DataFrame:
    """Neighbours in (start, end, id) order that share a millisecond."""
    w = W.partitionBy("run_id").orderBy("rel_start_ms", "rel_end_ms", "pull_id")
    nxt = F.lead(F.struct("pull_id", "rel_start_ms")).over(w)
    return pulls.withColumn("n", nxt).where(F.col("n.rel_start_ms") <= F.col("rel_end_ms")).select("run_id", "pull_id", F.col("n.pull_id").alias("next_pull_id"), (F.col("rel_end_ms") - F.col("n.rel_start_ms")).alias("overlap_ms"))


def contested_events(overlaps: DataFrame, assigned: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Events inside each overlap, by the pull that they were assigned to. The join is followed by a
    shuffle on other keys, so adaptive execution may split a bin that is too large for a task."""
    levels = _levels(overlaps, "from_ms", "until_ms", bin_ms) or [0]
    o = _binned(overlaps.select("run_id", "a_pull", "b_pull", "kind", "from_ms", "until_ms"), "from_ms", "until_ms", bin_ms)
    e = assigned.select("run_id", "rel_ms", "pull_id", F.explode(_looking("rel_ms", levels, bin_ms)).alias("look")).select("run_id", "rel_ms", "pull_id", "look.level", "look.bin")
    met = o.join(e, ["run_id", "level", "bin"]).where("rel_ms between from_ms and until_ms")
    return met.groupBy("a_pull", "b_pull", "kind", F.coalesce("pull_id", F.lit("<unassigned>")).alias("assigned_to")).agg(F.count("*").alias("events"))


def pull_links(pulls: DataFrame) -> DataFrame:
    """Position of each pull in its run, and its neighbours."""
    w = W.partitionBy("run_id").orderBy("rel_start_ms", "pull_id")
    return pulls.select("run_id", "pull_id", (F.row_number().over(w) - 1).cast("long").alias("pull_index"), F.lag("pull_id").over(w).alias("prev_pull_id"), F.lead("pull_id").over(w).alias("next_pull_id"))
