"""Views derived from events: cast occurrences, interrupts, causes, recasts, copies. Planned by the analysed
design, beyond its code; each can be made anew from the events alone.

A cast is a start and perhaps its end, one occurrence. An actor has one open cast of an
ability at most: its last start, until an end or an interrupt of the same (group, actor,
instance, ability) takes it or another start takes its place. So a start is in one link
at most, and an interrupt takes the one start that is open. Of events of the same
millisecond a start comes first, then interrupts, then ends, each by event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.operators.stretches import STRETCH_MS, carried

START, INTERRUPT, END = 0, 1, 2


def _line(starts: DataFrame, interrupts: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    parts = [df.where("rel_ms is not null").select(*by, "rel_ms", F.lit(kind).alias("kind"), "event_id") for df, kind in ((starts, START), (interrupts, INTERRUPT), (ends, END))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def linked_interrupts(starts: DataFrame, interrupts: DataFrame, ends: DataFrame, by: list[str], window_ms: int, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Each interrupt (``by``, event_id, rel_ms) with start_id and delay_ms of the cast it stopped: the one
    open when it came, begun at most ``window_ms`` before; nulls where there is none."""
    line = _line(starts, interrupts, ends, by)
    last = carried(line, by, ["rel_ms", "kind", "event_id"], {"last": F.struct("kind", "event_id", "rel_ms")}, strict=True, stretch_ms=stretch_ms)
    took = (F.col("last.kind") == START) & (F.col("rel_ms") - F.col("last.rel_ms") <= window_ms)
    return last.where(F.col("kind") == INTERRUPT).select(*by, "event_id", "rel_ms", F.when(took, F.col("last.event_id")).alias("start_id"), F.when(took, F.col("rel_ms") - F.col("last.rel_ms")).alias("delay_ms"))


def occurrences(starts: DataFrame, interrupts: DataFrame, ends: DataFrame, by: list[str], window_ms: int, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Each start (``by``, event_id, rel_ms) with what came of it within ``window_ms``: ``outcome`` (completed,
    interrupted or incomplete), outcome_id and outcome_ms."""
    line = _line(starts, interrupts, ends, by)
    then = carried(line, by, ["rel_ms", "kind", "event_id"], {"then": F.struct("kind", "event_id", "rel_ms")}, ahead=True, strict=True, stretch_ms=stretch_ms)
    near = F.col("then.rel_ms") - F.col("rel_ms") <= window_ms
    outcome = F.when(near & (F.col("then.kind") == END), "completed").when(near & (F.col("then.kind") == INTERRUPT), "interrupted").otherwise("incomplete")
    out = then.where(F.col("kind") == START).withColumn("outcome", outcome)
    told = F.col("outcome") != "incomplete"
    return out.select(*by, "event_id", "rel_ms", "outcome", F.when(told, F.col("then.event_id")).alias("outcome_id"), F.when(told, F.col("then.rel_ms")).alias("outcome_ms"))


def causes(casts: DataFrame, deaths: DataFrame, controls: DataFrame, actor: list[str], window_ms: int, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Why each cast of :func:`occurrences` that wasn't completed stopped: ``cause`` and ``confidence``, with
    all the evidence that there is (interrupt_id, death_ms, control_ms), so the losing kind stays to be seen.

    An interrupt is a fact (high), then the actor's death in the window (high), then a control effect
    put on the actor (medium). Nothing of these is ``unknown``, never a guess. ``deaths`` and ``controls``
    are (``actor``, rel_ms); one in the millisecond of the start counts.
    """
    kinds = [(casts.where("outcome <> 'completed'"), 0), (deaths, 1), (controls, 2)]
    parts = [df.where("rel_ms is not null").select(*actor, "rel_ms", F.lit(kind).alias("kind"), *([] if kind else [F.struct(*casts.columns).alias("cast")])) for df, kind in kinds]
    line = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    when = lambda kind: F.when(F.col("kind") == kind, F.col("rel_ms"))
    seen = carried(line, actor, ["rel_ms", "kind"], {"death": when(1), "control": when(2)}, ahead=True, stretch_ms=stretch_ms).where("kind = 0")
    near = lambda c: F.when(F.col(c) - F.col("rel_ms") <= window_ms, F.col(c))
    rows = seen.select("cast.*", near("death").alias("death_ms"), near("control").alias("control_ms"))
    stopped = F.col("outcome") == "interrupted"
    cause = F.when(stopped, "interrupt").when(F.col("death_ms").isNotNull(), "death").when(F.col("control_ms").isNotNull(), "control").otherwise("unknown")
    confidence = F.when(cause.isin("interrupt", "death"), "high").when(cause == "control", "medium").otherwise("unknown")
    return rows.select(*[c for c in casts.columns if c not in ("outcome", "outcome_id", "outcome_ms")], cause.alias("cause"), confidence.alias("confidence"), F.when(stopped, F.col("outcome_id")).alias("interrupt_id"), "death_ms", "control_ms")


def recasts(casts: DataFrame, deaths: DataFrame, actor: list[str], ability: str, end: str, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """The interval that each cast (``actor``, ``ability``, event_id, rel_ms, ``end``) opens: duration_ms and
    ``ended_by``. A recast of the ability is observed; the actor's death, or else the end of the pull, cuts
    the wait short (censored), which tells only that it was longer. A cast with none of these stays open.
    Of equal times a recast counts before a death, a death before the end."""
    own = casts.where("rel_ms is not null").select(*actor, ability, "event_id", "rel_ms", F.col(end).alias("end_ms"))
    following = carried(own, [*actor, ability], ["rel_ms", "event_id"], {"next_ms": F.col("rel_ms")}, ahead=True, strict=True, stretch_ms=stretch_ms)
    line = following.withColumn("kind", F.lit(0)).unionByName(deaths.where("rel_ms is not null").select(*actor, "rel_ms", F.lit(1).alias("kind")), allowMissingColumns=True)
    met = carried(line, actor, ["rel_ms", "kind"], {"death_ms": F.when(F.col("kind") == 1, F.col("rel_ms"))}, ahead=True, stretch_ms=stretch_ms).where("kind = 0")
    until = F.least("next_ms", "death_ms", "end_ms")
    by = F.when(until.isNull(), "open").when(F.col("next_ms") == until, "recast").when(F.col("death_ms") == until, "death").otherwise("end")
    return met.select(*actor, ability, "event_id", "rel_ms", by.alias("ended_by"), F.when(until.isNotNull(), F.greatest(until - F.col("rel_ms"), F.lit(0))).alias("duration_ms"))


def survival(intervals: DataFrame, by: list[str]) -> DataFrame:
    """The product-limit curve of the waits of :func:`recasts`: for each duration at which a recast was seen,
    how many were at risk, how many recast, and the share that waits longer.

    It is made from counts by duration, so no task holds the intervals of an ability, only the
    distinct durations. Those censored at a duration are still at risk there.
    """
    counted = intervals.where("ended_by <> 'open'").groupBy(*by, "duration_ms").agg(F.count_if(F.col("ended_by") == "recast").alias("recasts"), F.count("*").alias("n"))
    later = W.partitionBy(*by).orderBy(F.col("duration_ms").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    risk = counted.withColumn("at_risk", F.sum("n").over(later)).where("recasts > 0")
    until = W.partitionBy(*by).orderBy("duration_ms").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_gone = F.max((F.col("recasts") == F.col("at_risk")).cast("int")).over(until) == 1
    step = F.when(F.col("recasts") < F.col("at_risk"), F.log(1 - F.col("recasts") / F.col("at_risk"))).otherwise(0.0)
    return risk.select(*by, "duration_ms", "at_risk", "recasts", F.round(F.when(all_gone, 0.0).otherwise(F.exp(F.sum(step).over(until))), 6).alias("waiting"))


def median_waits(curve: DataFrame, by: list[str]) -> DataFrame:
    """The first duration at which at most half still wait, by group; groups that never come so far have none."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("waiting") <= 0.5, F.col("duration_ms"))).alias("median_ms"))


def resolved_instances(events: DataFrame, copies: DataFrame, by: list[str], instance: str) -> DataFrame:
    """``events`` with ``resolved`` and ``how``: a told instance stays (told). Where none is told and ``copies``
    (``by``, min_instance_id, max_instance_id) leave one possible, it is that one (only copy); where there are
    several, or a range isn't known, it stays unknown, with the reason. No value is made up."""
    known = copies.groupBy(*by).agg(F.min("min_instance_id").alias("low"), F.max("max_instance_id").alias("high"), F.max((F.col("min_instance_id").isNull() | F.col("max_instance_id").isNull()).cast("int")).alias("open"))
    met = events.join(known, by, "left")
    how = (
        F.when(F.col(instance).isNotNull(), "told")
        .when(F.col("open").isNull(), "not listed")
        .when(F.col("open") == 1, "range unknown")
        .when(F.col("low") == F.col("high"), "only copy")
        .otherwise("several copies")
    )
    return met.select(*[events[c] for c in events.columns], F.when(how == "told", F.col(instance)).when(how == "only copy", F.col("low")).alias("resolved"), how.alias("how"))


def base_rates(events: DataFrame, context: list[str], fields: list[str]) -> DataFrame:
    """P(field = value | context) for every subset of one of ``context`` and for all of it together, in one scan:
    (context, ``context`` columns, field, value, n, of, rate). Columns outside a context are null in it;
    ``context`` names which are in. Nulls are values of their own, shown as null. Rates of a context and field sum to 1."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    rows = events.select(*[F.col(c).alias(f"in {c}") for c in context], pairs.alias("p")).select(*[f"in {c}" for c in context], "p.field", "p.value")
    sets = [*[[c] for c in context], context] if len(context) > 1 else [context]
    counted = rows.groupingSets([[F.col("field"), F.col("value"), *[F.col(f"in {c}") for c in s]] for s in sets], F.col("field"), F.col("value"), *[F.col(f"in {c}") for c in context]).agg(F.count("*").alias("n"), *[F.grouping(f"in {c}").alias(f"out {c}") for c in context])
    named = counted.withColumn("context", F.concat_ws(",", *[F.when(F.col(f"out {c}") == 0, F.lit(c)) for c in context]))
    whole = W.partitionBy("context", "field", *[f"in {c}" for c in context])
    of = F.sum("n").over(whole)
    return named.select("context", *[F.col(f"in {c}").alias(c) for c in context], "field", "value", "n", of.alias("of"), F.round(F.col("n") / of, 6).alias("rate"))


def field_entropy(rates: DataFrame) -> DataFrame:
    """The conditional entropy in bits of each field given each context: 0 where the context tells the field."""
    weight = F.col("n") / F.sum("n").over(W.partitionBy("context", "field"))
    bits = rates.withColumn("bits", -weight * F.log2(F.col("n") / F.col("of")))
    return bits.groupBy("context", "field").agg(F.round(F.abs(F.sum("bits")), 4).alias("bits"))
