"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines carry a quote level, the number of leading ``>``. Adjacent lines
of one level form a passage; blank lines and changes of level end it. Passages are
normalised (A-Z as a-z, white space as single spaces) and hashed; all that aren't
empty count, however short. A passage at
level 1 or deeper is joined to the message of its conversation that first said it
at level 0, if that came before. The latest of the messages that level-1 passages
lead to is the one a message replies to; failing that, the latest that deeper ones
lead to.

Replies form trees. The root of each message and its depth are found by doubling:
each round, every message takes over its ancestor's ancestor, so a tree of depth d
takes log2(d) rounds, and a row stays of one size. A conversation in reply order has
its trees by their roots and each tree by turns, so every message comes after the
one it replies to, without its quotes and without the line that announces one.
``position`` numbers it from 0.

Joins carry one row for each (conversation, passage), its first use, so a passage
that many messages say or quote makes no pairs, and counts are pre-aggregated. The
order is a range partitioning of all messages, so a conversation that holds a third
of them is cut too, and is never gathered in a row or a task.

Messages are identified by (conversation, turn); rows that repeat both stand at one
place of the tree and keep their own texts and positions. Turns are any longs. A null
text is empty and has no passages; a null conversation or turn can't be linked and
stays a root; null turns come last, and without a conversation there is no position.
Ties go to the smallest turn. A message never replies to itself or to a later turn.
Very long texts are arrays of lines in one row. Other columns pass through, whatever
their names, except that the result columns are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import drop_scratch, materialize

#: How mail programs announce a quote, in the four languages of the corpus.
ANNOUNCED = r"(?i)^(on|am|le|el)\b.*\b(wrote|schrieb|a écrit|escribió)\s*:\s*$"

ADDED = ("reply_to", "root_turn", "depth", "n_quotes", "n_linked", "position", "clean_text")


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the output of a generator, so that lambdas read values and don't compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def normalised(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, "[\\x20\\x09-\\x0D]+", " "))


def parsed(messages: DataFrame, text_col: str) -> DataFrame:
    """``messages``, without columns that begin with an underscore, with ``_marked``, (level, body) of each line, and ``_passages``, (level, text) of each passage."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n", -1)
    mark = "^(?:[\\x20\\x09]?>)*"
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, mark, 0), "[^>]", ""))
    body = lambda line: F.trim(F.regexp_replace(line, mark, ""))
    df = _fixed(messages, _marked=F.transform(lines, lambda x: F.struct(level(x).alias("level"), body(x).alias("body"), x.alias("line"))))
    # where a passage begins: a filled line behind a blank one, another level or nothing
    begins = lambda x, i: (x["body"] != "") & ((i == 0) | (F.get("_marked", i - 1)["level"] != x["level"]) | (F.get("_marked", i - 1)["body"] == ""))
    df = _fixed(df, _starts=F.filter(F.transform("_marked", lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull()))

    def passage(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_marked"))
        first = F.get("_marked", start)
        # up to the next start there are only lines of this passage, then blank ones
        own = F.filter(F.slice("_marked", start + 1, end - start), lambda x: x["body"] != "")
        return F.struct(first["level"].alias("level"), normalised(F.array_join(F.transform(own, lambda x: x["body"]), " ")).alias("text"))

    return _fixed(df, _passages=F.filter(F.transform("_starts", passage), lambda p: p["text"] != "")).drop("_starts")


def clean_text(marked: str = "_marked") -> Column:
    """The level-0 lines without announcements of a quote, trimmed at both ends."""
    quoted_next = lambda i: F.get(marked, i + 1)["level"] > 0
    announces = lambda x, i: x["body"].rlike(ANNOUNCED) & F.coalesce(quoted_next(i), F.lit(False))
    kept = F.transform(marked, lambda x, i: F.when((x["level"] == 0) & ~announces(x, i), x["line"]))
    return F.regexp_replace(F.array_join(F.filter(kept, lambda x: x.isNotNull()), "\n"), "^\\s+|\\s+$", "")


def _roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, up) of replies with the root they lead to and their depth below it."""
    way = materialize(parents.select("conv", "turn", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "ways")
    while True:
        above = way.select("conv", F.col("turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        joined = way.join(above, ["conv", "root"], "left")
        if joined.where("root2 is not null").isEmpty():
            return way
        longer = joined.select("conv", "turn", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        longer = materialize(longer, "ways")
        drop_scratch(way)
        way = longer


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, root, ...) with ``position``, their number in their conversation by (root, turn).

    They are range-partitioned into files; a row's number is its place among the
    file's rows of the conversation, behind those of earlier files.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("conv"), F.col("root").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("tie")]
    rows = rows.withColumn("tie", F.xxhash64("given"))
    held = materialize(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie"), "ordered")
    held = held.select("*", F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = held.groupBy("conv", "file").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("conv").alias("of"), F.col("file").alias("in_file"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start")).where("of is not null")
    placed = held.join(starts, (F.col("conv") == F.col("of")) & (F.col("file") == F.col("in_file")), "left")
    return placed.withColumn("position", F.col("row") + F.col("start"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` with reply_to, root_turn, depth, n_quotes, n_linked, position and clean_text."""
    kept = [c for c in messages.columns if c not in ADDED]
    given = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given")  # so no name of theirs meets one of ours
    df = messages.select(given, F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    df = parsed(df, "text").drop("text")
    quoted = F.size(F.filter("_passages", lambda p: p["level"] > 0)).cast("long")

    said = df.select("conv", "turn", F.explode("_passages").alias("p")).select("conv", "turn", "p.level", F.xxhash64("p.text").alias("h1"), F.md5("p.text").alias("h2"))
    said = materialize(said.where("conv is not null and turn is not null").distinct(), "passages")
    first = said.where("level = 0").groupBy("conv", "h1", "h2").agg(F.min("turn").alias("origin"))
    found = said.where("level > 0").join(first, ["conv", "h1", "h2"]).where("origin < turn")
    near, deep = F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")
    parents = found.groupBy("conv", "turn").agg(F.coalesce(near, deep).alias("up"), F.countDistinct("h1", "h2").alias("n_linked"))
    parents = materialize(parents, "parents")

    places = parents.join(_roots(parents), ["conv", "turn"])
    out = df.select("given", "conv", "turn", quoted.alias("n_quotes"), clean_text().alias("clean_text")).join(places, ["conv", "turn"], "left")
    out = _numbered(out.withColumn("root", F.coalesce("root", "turn")))
    return out.select(
        *[F.col("given").getField(c).alias(c) for c in kept],
        F.col("up").alias("reply_to"),
        F.col("root").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "position",
        "clean_text",
    )


def conversations(linked: DataFrame, conv_col: str = "conv_id", role_col: str = "role") -> DataFrame:
    """Conversations in reply order: rows (conversation, position, role, text), range-partitioned
    and sorted, so that they can be written one after another."""
    rows = linked.where(F.col("position").isNotNull()).select(conv_col, "position", role_col, F.col("clean_text").alias("text"))
    return rows.orderBy(conv_col, "position")
