"""Row pattern matching: ``A D+ U+ P``, a fall, a rise and a goal, in each key's rows by time.

A is any row with a value. D has a value below the row before it and a kind that is
known and not ``bad_kind``; U likewise, but above. P has the kind ``goal_kind`` and a
value of A's at least. D, U and P come at most ``gap_us`` after the row before them.
D and U exclude each other, so the falls of a match end where the run of D ends, and
the greedy U+ gives rows back until the row behind it is a P: of all qualifying rows
between the second U and the row behind the run, the last. Every row is tried as an A.

How it runs: the distinct rows are dealt out by ranges of (key, time, id), so that one
key may lie in any number of tasks, and sorted there. A task reads its stretch once,
in Arrow batches. It builds a max segment tree over the values of goal rows (other
rows count as minus infinity) and finds the last P inside the run bounds of every
start by descent. It keeps only the open segment between batches. What crosses the
border of a stretch is resolved by summaries: each stretch has one row for its first
key and one for its last (how its first run goes on, its last row), a fold over these
gives each border what may follow, and open starts are joined with that. In a run of
rises the last goal row is also the greatest, so a border needs two candidates at most.
Numbers within a key are numbers within a stretch plus the count of those before.

Cases: rows that repeat in all columns count once; rows without a key or time are
dropped; a null or non-finite value fits no letter and ends a run; a null kind is
neither D, U nor P; a null id comes first among equal times, and rows that tie in time
and id come in the order of value, kind and the digest of their other columns. An
empty table has no match. Further columns only tell rows apart, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import materialize

#: Value of a row that is no goal.
NONE = np.iinfo(np.int64).min
#: Rows that are scanned together, at least.
BLOCK_ROWS = 1 << 16
MATCH, OPEN, EDGE = 0, 1, 2

_EDGE = (
    "first boolean, last boolean, matches long, end_us long, end_cents long, one_us long, one_cents long, one_moves boolean, one_goal boolean, one_id long, two_goal boolean, two_cents long, two_id long, "
    "falls long, falls_sum long, rises long, rises_sum long, open string, best_at long, best_cents long, best_sum long, best_id long, tail_cents long, tail_sum long, tail_id long"
)


class MaxTree:
    """A flat max segment tree: level 0 are the leaves, a node of the next level covers two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(values) > 1:
            if len(values) % 2:
                values = np.append(values, NONE)
                self.levels[-1] = values
            values = np.maximum(values[::2], values[1::2])
            self.levels.append(values)
        self.starts = np.cumsum([0, *map(len, self.levels)])
        self.flat = np.concatenate(self.levels)

    def last(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place in low..high (inclusive) with a value of ``least`` or more, or -1."""
        out = np.full(len(low), -1, np.int64)
        who = np.flatnonzero(low <= high)
        level, node = np.zeros(len(who), np.int64), high[who].astype(np.int64)
        inside: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):  # up: nodes to the left, each as large as its place allows
            hit = self.flat[self.starts[level] + node] >= least[who]
            inside.append((who[hit], level[hit], node[hit]))
            who, level, node = who[~hit], level[~hit], node[~hit] - 1
            left = (node >= 0) & (((node + 1) << level) > low[who])
            who, level, node = who[left], level[left], node[left]
            up = (node % 2 == 1) & (level + 1 < len(self.levels))
            level, node = level + up, np.where(up, node >> 1, node)
        who, level, node = (np.concatenate(part) for part in zip(*inside)) if inside else (who, level, node)
        while (down := level > 0).any():  # down: the right child if it has one, else the left
            at, below = np.flatnonzero(down), level[down] - 1
            right = 2 * node[down] + 1
            node[at] = np.where(self.flat[self.starts[below] + right] >= least[who[down]], right, right - 1)
            level[at] = below
        kept = node >= low[who]
        out[who[kept]] = node[kept]
        return out


def _run_ends(flags: np.ndarray) -> np.ndarray:
    """For each place the last place of the run of true flags it stands in (elsewhere the place before)."""
    n = len(flags)
    stops = np.where(flags, n, np.arange(n))
    return np.minimum.accumulate(stops[::-1])[::-1] - 1


class _Block:
    """Some consecutive rows of a stretch, with the letters they may have."""

    def __init__(self, table: pa.Table, gap_us: int):
        key, n = table["key"].combine_chunks(), table.num_rows
        self.n, self.table, self.key = n, table, key
        self.us = table["us"].to_numpy().astype(np.int64)
        self.ids = table["id"]
        known = table["cents"].is_valid().to_numpy()
        self.known, self.cents = known, table["cents"].fill_null(0).to_numpy().astype(np.int64)
        self.moves, self.goal = table["moves"].to_numpy(zero_copy_only=False), table["goal"].to_numpy(zero_copy_only=False)
        self.same = np.zeros(n, bool)
        self.same[1:] = pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        near, step = np.zeros(n, bool), np.zeros(n, np.int64)
        near[1:] = self.same[1:] & (np.diff(self.us) <= gap_us)
        step[1:] = np.sign(self.cents[1:] - self.cents[:-1])
        pair = near & known
        pair[1:] &= known[:-1]
        self.falls, self.rises = pair & self.moves & (step < 0), pair & self.moves & (step > 0)
        self.goals = near & known & self.goal
        self.total = np.concatenate([[0], np.cumsum(self.cents)])

    def at(self, i: int) -> int | None:
        return self.ids[int(i)].as_py()


class _Head:
    """How the rows of a stretch's first key begin: falls from the second row on, then rises, then one more row."""

    def __init__(self, block: _Block, at: int):
        self.one = (int(block.us[at]), int(block.cents[at]) if block.known[at] else None, bool(block.moves[at]), bool(block.goal[at]), block.at(at))
        self.two: tuple | None = None
        self.falls = self.falls_sum = self.rises = self.rises_sum = 0
        self.phase, self.best, self.tail = "D", (None,) * 4, (None,) * 3

    def read(self, b: _Block, at: int, end: int) -> None:
        """Rows at..end of the key, in the order in which they come."""
        if at >= end or self.phase == "":
            return
        if self.two is None:
            self.two = (bool(b.goals[at]), int(b.cents[at]), b.at(at))
        if self.phase == "D":
            stop = int(np.argmin(np.append(b.falls[at:end], False))) + at
            self.falls += stop - at
            self.falls_sum += int(b.total[stop] - b.total[at])
            if stop == end:
                return
            self.phase, at = "U", stop
        stop = int(np.argmin(np.append(b.rises[at:end], False))) + at
        goals = np.flatnonzero(b.goals[at:stop])
        if len(goals):
            g = int(goals[-1]) + at
            self.best = (self.rises + g - at + 1, int(b.cents[g]), self.rises_sum + int(b.total[g + 1] - b.total[at]), b.at(g))
        self.rises += stop - at
        self.rises_sum += int(b.total[stop] - b.total[at])
        if stop < end:
            self.phase = ""
            if b.goals[stop]:
                self.tail = (int(b.cents[stop]), self.rises_sum + int(b.cents[stop]), b.at(stop))


def _columns(b: _Block, places: np.ndarray, named: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    return {"key": b.key.take(pa.array(places, pa.int64())), **{name: pa.array(values, pa.int64()) for name, values in named.items()}}


class _Scan:
    """Reads a stretch block by block and gives its matches, its open starts and its two edges."""

    def __init__(self, schema: pa.Schema, stretch: int, gap_us: int):
        self.schema, self.stretch, self.gap_us = schema, stretch, gap_us
        self.left: pa.Table | None = None
        self.head: _Head | None = None
        self.first_key, self.head_open, self.first_matches = None, True, 0
        self.last_matches = 0

    def _out(self, kind: int, rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        given = columns | {"kind": pa.array(np.full(rows, kind), pa.int8()), "stretch": pa.array(np.full(rows, self.stretch), pa.int32())}
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(rows, f.type) for f in self.schema], schema=self.schema)

    def _searched(self, b: _Block) -> tuple[np.ndarray, ...]:
        """Starts, the last fall and the last rise of each, its last goal or -1, and whether it is open."""
        falls = np.flatnonzero(b.falls)
        low = _run_ends(b.falls)[falls]
        high = np.where(low + 1 < b.n, _run_ends(b.rises)[np.minimum(low + 1, b.n - 1)], low)
        open_ = (low == b.n - 1) | ((high == b.n - 1) & (high > low))
        kept = open_ | (high > low)
        falls, low, high, open_ = falls[kept], low[kept], high[kept], open_[kept]
        tree = MaxTree(np.where(b.goals, b.cents, NONE))
        bound = np.where(high > low, np.minimum(high + 1, b.n - 1), low)
        goal = tree.last(low + 2, bound, b.cents[falls - 1])
        return falls - 1, low, high, goal, open_

    def block(self, table: pa.Table, final: bool):
        before = self.left.num_rows if self.left is not None else 0
        if before:
            table = pa.concat_tables([self.left, table]).combine_chunks()
        b = _Block(table, self.gap_us)
        if self.head is None:
            self.first_key, self.head = b.key[0], _Head(b, 0)
            before = 1
        if self.head_open:
            others = np.flatnonzero(~b.same[before:])
            end = before + int(others[0]) if len(others) else b.n
            self.head.read(b, before, end)
            self.head_open = not len(others)
        starts, low, high, goal, open_ = self._searched(b)
        done = ~open_ & (goal >= 0)
        s, g = starts[done], goal[done]
        begins = np.concatenate([[0], np.flatnonzero(~b.same[1:]) + 1])
        group = np.searchsorted(begins, s, side="right") - 1
        counts = np.bincount(group, minlength=len(begins))
        counts_before = np.cumsum(counts) - counts
        base = np.zeros(len(begins), np.int64)
        base[0] = self.last_matches if self.left is not None else 0
        if len(s):
            place = np.arange(len(s)) - counts_before[group] + base[group] + 1
            yield self._out(MATCH, len(s), _columns(b, s, {"place": place, "n_rows": g - s + 1, "sum_cents": b.total[g + 1] - b.total[s], "n_down": low[done] - s}) | {"first_id": b.ids.take(pa.array(s)).combine_chunks(), "last_id": b.ids.take(pa.array(g)).combine_chunks()})
        counts = counts + base
        self.last_matches = int(counts[-1])
        if b.key[0].equals(self.first_key):
            self.first_matches = int(counts[0])
        keep = int(starts[open_][0]) if open_.any() else b.n - 1
        self.left = table.slice(keep)
        if final:
            yield from self._ends(b, starts[open_], low[open_], high[open_], goal[open_])

    def _ends(self, b: _Block, s: np.ndarray, low: np.ndarray, high: np.ndarray, goal: np.ndarray):
        phase = ["U" if h > x else "D" for x, h in zip(low, high)]
        if b.known[b.n - 1]:  # the last row may be an A whose falls begin in the next stretch
            s, low, goal, phase = np.append(s, b.n - 1), np.append(low, b.n - 1), np.append(goal, -1), [*phase, "A"]
        if len(s):
            found, g = goal >= 0, np.maximum(goal, 0)
            rows = np.where(found, goal - s + 1, 0)
            named = {"place": np.arange(len(s)), "n_down": low - s, "cents": b.cents[s], "rows_end": b.n - s, "sum_end": b.total[b.n] - b.total[s], "n_rows": rows, "sum_cents": np.where(found, b.total[g + 1] - b.total[s], 0)}
            last = pc.if_else(pa.array(found), b.ids.take(pa.array(g)).combine_chunks(), None)
            yield self._out(OPEN, len(s), _columns(b, s, named) | {"first_id": b.ids.take(pa.array(s)).combine_chunks(), "last_id": last, "phase": pa.array(phase, pa.string())})
        key, head = b.key[b.n - 1], self.head
        whole = key.equals(self.first_key)
        end = {"end_us": int(b.us[-1]), "end_cents": int(b.cents[-1]) if b.known[-1] else None}
        one = dict(zip(("one_us", "one_cents", "one_moves", "one_goal", "one_id"), head.one)) | dict(zip(("two_goal", "two_cents", "two_id"), head.two or (False, None, None)))
        runs = {"falls": head.falls, "falls_sum": head.falls_sum, "rises": head.rises, "rises_sum": head.rises_sum, "open": head.phase}
        best = dict(zip(("best_at", "best_cents", "best_sum", "best_id"), head.best)) | dict(zip(("tail_cents", "tail_sum", "tail_id"), head.tail))
        edges = [(self.first_key, {"first": True, "last": whole, "matches": self.first_matches} | one | runs | best | (end if whole else {}))]
        if not whole:
            edges.append((key, {"first": False, "last": True, "matches": self.last_matches} | end))
        yield self._out(EDGE, len(edges), {"key": pa.array([k.as_py() for k, _ in edges], b.key.type), "edge": pa.array([e for _, e in edges], self.schema.field("edge").type)})


def _scanner(schema: pa.Schema, gap_us: int):
    def scan(batches):
        from pyspark import TaskContext

        run, held, rows = _Scan(schema, TaskContext.get().partitionId(), gap_us), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK_ROWS + (run.left.num_rows if run.left is not None else 0):  # a long open segment isn't read again for each batch
                yield from run.block(pa.Table.from_batches(held).combine_chunks(), False)
                held, rows = [], 0
        if held:
            yield from run.block(pa.Table.from_batches(held).combine_chunks(), True)
        elif run.left is not None:
            yield from run.block(run.left.slice(0, 0), True)

    return scan


def _follows(edges: list[dict], gap_us: int) -> list[dict]:
    """What may follow each stretch of a key, given its stretches in order: for an open start whose last
    row there is an A, a D or a U, how many falls are added and the candidates (cents, rows, sum, id)."""

    def shifted(rest: tuple[int, list], rows: int, total: int) -> list:
        return [(c, n + rows, s + total, i) for c, n, s, i in rest[1]]

    def greatest(found: list) -> list:
        """Those that no later one outbids."""
        kept = []
        for one in reversed(found):
            if not kept or one[0] > kept[-1][0]:
                kept.append(one)
        return kept[::-1]

    nothing = {p: (0, []) for p in "ADU"}
    after, out = nothing, []
    for before, e in zip(reversed(edges[:-1]), reversed(edges[1:])):
        near = e["one_us"] - before["end_us"] <= gap_us and e["one_cents"] is not None
        step = 0 if not near or before["end_cents"] is None or not e["one_moves"] else (e["one_cents"] > before["end_cents"]) - (e["one_cents"] < before["end_cents"])
        one = [(e["one_cents"], 1, e["one_cents"], e["one_id"])] if near and e["one_goal"] else []
        tail = lambda rows, total: [(e["tail_cents"], rows + 1, total + e["tail_sum"], e["tail_id"])] if e["tail_cents"] is not None else []
        best = lambda rows, total, least: [(e["best_cents"], rows + e["best_at"], total + e["best_sum"], e["best_id"])] if e["best_at"] is not None and e["best_at"] >= least else []
        now = dict(nothing)
        if step < 0:
            rows, total = 1 + e["falls"], e["one_cents"] + e["falls_sum"]
            if e["open"] == "D":
                added, rest = after["D"][0], shifted(after["D"], rows, total)
                now["A"] = now["D"] = (rows + added, greatest(rest))
            elif e["rises"]:
                found = best(rows, total, 2)
                rows_to, total_to = rows + e["rises"], total + e["rises_sum"]
                found += shifted(after["U"], rows_to, total_to) if e["open"] == "U" else tail(rows_to, total)
                now["A"] = now["D"] = (rows, greatest(found))
        elif step > 0:
            first = e["one_cents"]
            if e["falls"]:
                found = [(e["two_cents"], 2, first + e["two_cents"], e["two_id"])] if e["two_goal"] else []
            else:
                found = best(1, first, 1)
                found += shifted(after["U"], 1 + e["rises"], first + e["rises_sum"]) if e["open"] in ("D", "U") else tail(1 + e["rises"], first)
            now["D"], now["U"] = (0, greatest(found)), (0, greatest(one + found))
        else:
            now["U"] = (0, one)
        out.append({"stretch": before["stretch"]} | {p: now[p] for p in "ADU"})
        after = now
    return out


def _digest(columns: list[str]) -> Column:
    """Sixteen bytes that tell rows apart by these columns."""
    parts = [F.concat(F.length(t), F.lit(":"), t) for c in columns for t in [F.col(f"`{c}`").cast("string")]]
    return F.unhex(F.md5(F.concat_ws(",", *[F.coalesce(p, F.lit("-")) for p in parts]).cast("binary"))) if parts else F.lit(b"")


def match(
    rows: DataFrame, key_col: str = "client_id", time_col: str = "ts", id_col: str = "click_id", value_col: str = "value", kind_col: str = "kind",
    goal_kind: str = "click", bad_kind: str = "error", gap_us: int = 300_000_000, stretches: int | None = None,
) -> DataFrame:
    """One row per match: the key, match_no (from 1, by first row), first_id, last_id, n_rows, sum_cents, labels.
    ``id_col`` holds whole numbers, ``time_col`` timestamps of either kind. ``stretches`` is the number of
    ranges that the rows are dealt out to (by default the session's shuffle partitions)."""
    spark = rows.sparkSession
    n = stretches or int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = {key_col, time_col, id_col, value_col, kind_col}
    value, kind = F.col(f"`{value_col}`").cast("double"), F.col(f"`{kind_col}`")
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    narrow = rows.where(F.col(f"`{key_col}`").isNotNull() & F.col(f"`{time_col}`").isNotNull()).select(
        F.col(f"`{key_col}`").alias("key"),
        F.col(f"`{time_col}`").alias("us"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        value.alias("value"),
        kind.alias("kind"),
        F.when(finite, F.floor(100 * value + 0.5)).alias("cents"),
        F.coalesce(kind != bad_kind, F.lit(False)).alias("moves"),
        F.coalesce(kind == goal_kind, F.lit(False)).alias("goal"),
        _digest([c for c in rows.columns if c not in used]).alias("rest"),
    )
    dealt = narrow.distinct().repartitionByRange(n, "key", "us", "id").sortWithinPartitions("key", "us", "id", "value", "kind", "rest").select("key", "us", "id", "cents", "moves", "goal")
    key_type = dealt.schema["key"].dataType.simpleString()
    out = f"kind byte, key {key_type}, stretch int, place long, first_id long, last_id long, n_rows long, sum_cents long, n_down long, cents long, phase string, rows_end long, sum_end long, edge struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>"
    made = materialize(dealt.mapInArrow(_wrapped(out, gap_us), out), "valleys")
    follow = "stretch int, " + ", ".join(f"{p} struct<down:long,found:array<struct<cents:long,n:long,sum:long,id:long>>>" for p in "ADU")
    edges = made.where(F.col("kind") == EDGE).select("key", "stretch", "edge.*")
    borders = edges.groupBy("key").applyInArrow(_folded(follow, gap_us), f"key {key_type}, {follow}")

    open_ = made.where(F.col("kind") == OPEN).join(borders, ["key", "stretch"], "left")
    then = F.when(F.col("phase") == "A", F.col("A")).when(F.col("phase") == "D", F.col("D")).otherwise(F.col("U"))
    open_ = open_.withColumn("then", then).withColumn("at", F.try_element_at(F.filter("then.found", lambda x: x["cents"] >= F.col("cents")), F.lit(-1)))
    open_ = open_.where(F.col("at").isNotNull() | (F.col("n_rows") > 0)).select(
        "key", "stretch", "place", "first_id",
        F.when(F.col("at").isNotNull(), F.col("at.id")).otherwise(F.col("last_id")).alias("last_id"),
        F.coalesce(F.col("rows_end") + F.col("at.n"), "n_rows").alias("n_rows"),
        F.coalesce(F.col("sum_end") + F.col("at.sum"), "sum_cents").alias("sum_cents"),
        (F.col("n_down") + F.when(F.col("at").isNotNull() & (F.col("phase") != "U"), F.col("then.down")).otherwise(0)).alias("n_down"),
    )
    late = open_.withColumn("late", F.row_number().over(Window.partitionBy("key", "stretch").orderBy("place")).cast("long")).drop("place")
    # one row per border: how many matches of the key lie before a stretch, and in it before the late ones
    per_border = edges.select("key", "stretch", "matches").join(late.groupBy("key", "stretch").agg(F.count("*").alias("lates")), ["key", "stretch"], "left")
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_border.select("key", "stretch", "matches", F.coalesce(F.sum(F.col("matches") + F.coalesce("lates", F.lit(0))).over(earlier), F.lit(0)).alias("offset"))
    same = ["key", "stretch", "first_id", "last_id", "n_rows", "sum_cents", "n_down"]
    plain = made.where(F.col("kind") == MATCH).select(*same, F.lit(False).alias("is_late"), "place")
    both = plain.unionByName(late.select(*same, F.lit(True).alias("is_late"), F.col("late").alias("place"))).join(offsets, ["key", "stretch"], "left")
    number = F.col("place") + F.coalesce("offset", F.lit(0)) + F.when(F.col("is_late"), F.coalesce("matches", F.lit(0))).otherwise(0)
    labels = F.concat(F.lit("A"), F.expr("repeat('D', int(n_down))"), F.expr("repeat('U', int(n_rows - n_down - 2))"), F.lit("P"))
    return both.select(F.col("key").alias(key_col), number.alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", labels.alias("labels"))


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _wrapped(ddl: str, gap_us: int):
    schema = _arrow_schema(ddl)

    def scan(batches):
        def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
            us = batch.column(1).cast(pa.timestamp("us", batch.column(1).type.tz)).view(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), us, *batch.columns[2:]], ["key", "us", *batch.schema.names[2:]])

        return _scanner(schema, gap_us)(map(narrow, batches))

    return scan


def _folded(ddl: str, gap_us: int):
    schema = _arrow_schema(ddl)

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["stretch"])
        # the stretches of a key: it is the last key of all but the last, and the first of all but the first
        found = _follows(rows, gap_us)
        names = ("cents", "n", "sum", "id")
        data = [{"stretch": r["stretch"]} | {p: {"down": r[p][0], "found": [dict(zip(names, c)) for c in r[p][1]]} for p in "ADU"} for r in found]
        made = pa.Table.from_pylist(data, schema=schema)
        return made.add_column(0, "key", pa.array([rows[0]["key"]] * len(data), table.schema.field("key").type))

    return fold
