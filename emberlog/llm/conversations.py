"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A conversation's roles have to read ``(s?(ua)+)?``: perhaps a system turn, then
pairs of user and assistant. Its rows, by turn (nulls first), then role and text, are
looked at one by one; the first fault of a row counts: ``blank`` (no character but
space and tab to carriage return), ``duplicate`` (role and text stood before in the
conversation), ``truncated`` (the last such character is none of ``.!?``).

Edits: Keep a row (0), Rerole it to user or assistant (3), Delete it (4; a blank or
duplicate row has to go), Insert an empty user or assistant turn anywhere (3); a
truncated row that isn't deleted costs 3 more. Of the cheapest sequences of edits the
one whose initials are ASCII-least is taken.

How it runs: a dynamic programme over (row, state of the grammar). The rows are dealt out
by conversation once and sorted backwards; a task walks them once and gives each the
cost to go from every state behind it, as differences that fit a few bits. The same
partition is then sorted forwards, and a second walk takes, row by row, the ASCII-least
edit that loses nothing. In a given state the grammar leaves one role for an Insert or
Rerole, so a letter leads to one state and a greedy walk finds the least string. Both
walks stream: what they hold of a conversation is a state, counters, one byte an edit
and a running hash, however long it is; sorts spill. The hash of a conversation is a
hash of one text, so its rows have to pass one task in order.

Cases: nulls in ``role`` and ``text`` count as one space, so such a text is blank, and
such a role can only be deleted or changed. A conversation whose id is null is one like
any other. Rows that repeat are duplicates. A conversation without rows isn't there,
unless the caller marks rows as ``absent``: these give it a result and take no part in
it. An empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import small_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = "\\x20\\x09-\\x0D"
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads.
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one turn that can be made in a state, and where it leads.
_MADE = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
FAULTS = ("", "blank", "duplicate", "truncated")
_FAR = 1 << 20


def _with_inserts(cost: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first: two are enough to reach any state that they reach."""
    once = [min(cost[q], INSERT + cost[_MADE[q][1]]) for q in range(4)]
    return [min(once[q], INSERT + once[_MADE[q][1]]) for q in range(4)]


#: Costs to go behind the last row.
END = _with_inserts([0, _FAR, _FAR, 0])


def _row_costs(initial: str, fault: str, then: list[int]) -> list[int]:
    """Costs to go before a row, without inserts, from those behind it."""
    out = []
    for q in range(4):
        best = DELETE + then[q]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            best = min(best, REROLE + extra + then[_MADE[q][1]])
            if (to := _NEXT.get((q, initial))) is not None:
                best = min(best, extra + then[to])
        out.append(best)
    return out


def _packed(cost: list[int]) -> int:
    """Differences to the least, a byte each: every state is a few inserts from another, or out of reach."""
    least = min(cost)
    return sum(min(c - least, 255) << (8 * q) for q, c in enumerate(cost))


def _unpacked(bits: int) -> list[int]:
    return [bits >> (8 * q) & 255 for q in range(4)]


def _backward(batches):
    """Adds to each row the costs to go behind it. Rows come by conversation, last ones first."""
    key, cost, started = None, END, False
    for batch in batches:
        out = []
        for conv, absent, role, fault in zip(*(batch.column(n).to_pylist() for n in ("conv", "absent", "initial", "fault"))):
            if not started or conv != key:
                key, cost, started = conv, END, True
            out.append(_packed(cost))
            if not absent:
                cost = _with_inserts(_row_costs(role, fault, cost))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "togo"])


class _Walk:
    """The greedy walk over one conversation."""

    def __init__(self, key):
        self.key, self.state, self.cost, self.edits = key, START, 0, bytearray()
        self.digest, self.empty, self.turns = hashlib.sha256(), True, 0
        self.before: str | None = None
        self.count = dict.fromkeys(FAULTS, 0)
        self.illegal = self.distinct = 0
        self.low = self.high = None

    def _write(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False
        self.turns += 1

    def _insert(self) -> None:
        role, self.state = _MADE[self.state]
        self.edits += b"I"
        self.cost += INSERT
        self._write(role, "")

    def row(self, turn, role: str, initial: str, text: str, fault: str, then: list[int]) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.count[fault] += 1
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        while True:
            bare = _row_costs(initial, fault, then)
            best = _with_inserts(bare)[self.state]
            if DELETE + then[self.state] == best:
                self.edits += b"D"
                self.cost += DELETE
                return
            role_made, to = _MADE[self.state]
            if INSERT + _with_inserts(bare)[to] == best:
                self._insert()
                continue
            extra = TRUNCATED if fault == "truncated" else 0
            kept = _NEXT.get((self.state, initial))
            if kept is not None and extra + then[kept] == best:
                self.edits += b"K"
                self.state = kept
                self._write(role, text)
            else:
                extra += REROLE
                self.edits += b"R"
                self.state = to
                self._write(role_made, text)
            self.cost += extra
            return

    def result(self) -> dict:
        while self.state not in (START, ASSISTANT):
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        faults = {f: self.count[f] for f in FAULTS[1:]}
        return {"conv": self.key, "gaps": gaps, **faults, "illegal": self.illegal, "cost": self.cost, "audit": self.edits.decode(), "n_repaired": self.turns, "repaired_sha256": self.digest.hexdigest()}


def _forward(schema: pa.Schema):
    def walk(batches):
        now: _Walk | None = None
        for batch in batches:
            done = []
            for conv, absent, turn, role, initial, text, fault, togo in zip(*(batch.column(n).to_pylist() for n in ("conv", "absent", "turn", "role", "initial", "text", "fault", "togo"))):
                if now is None or conv != now.key:
                    done += [now.result()] if now is not None else []
                    now = _Walk(conv)
                if not absent:
                    now.row(turn, role, initial, text, fault, _unpacked(togo))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], schema=schema)

    return walk


def faults(text: Column, seen: Column) -> Column:
    """The first fault of a row: ``blank``, ``duplicate``, ``truncated`` or an empty string."""
    said = F.rtrim(F.regexp_replace(text, f"[{BLANKS}]+", " "))
    return F.when(said == "", "blank").when(seen, "duplicate").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost (whole numbers),
    audit (initials of the edits), n_repaired (turns) and repaired_sha256 (of ``role:text``, a line each)."""
    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"),
        (F.col(f"`{absent_col}`") if absent_col else F.lit(False)).alias("absent"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
    )
    # equal texts of a role meet by their digest and are told apart by their bytes
    alike = Window.partitionBy("conv", "absent", "role", F.xxhash64("text"), "text").orderBy(F.col("turn").asc_nulls_first())
    named = rows.withColumn("nth", F.row_number().over(alike))
    named = named.withColumns({"initial": F.substring("role", 1, 1), "fault": faults(F.col("text"), F.col("nth") > 1)})
    order = ("turn", "role", "text", "nth")
    back = named.repartition("conv").sortWithinPartitions("conv", *[F.col(c).desc_nulls_last() if c == "turn" else F.col(c).desc() for c in order])
    costed = back.mapInArrow(_backward, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in back.schema) + ", togo long")
    fore = costed.sortWithinPartitions("conv", *[F.col(c).asc_nulls_first() if c == "turn" else F.col(c).asc() for c in order])
    key_type = named.schema["conv"].dataType
    ddl = f"conv {key_type.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, n_repaired long, repaired_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return fore.mapInArrow(_forward(to_arrow_schema(StructType.fromDDL(ddl))), ddl).withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 marks
    the row as ``absent``, 1 empties the text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it the user's."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    kind = F.crc32(named.cast("binary")) % 20
    made = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind"))
    made = made.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("absent"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return made.drop("copy")
