"""Line dedup by content-defined chunks, with DataFrame functions only.

A text is a sequence of lines. A rolling hash over the hashes of ``window`` lines
decides after which lines a chunk ends, so boundaries move with the text: lines
put in before a shared passage do not shift the boundaries inside it. A chunk of
``min_lines`` lines or more is a passage. A passage that occurs again anywhere is
removed; the occurrence with the smallest (id, place) stays.

With ``run_words``, runs of lines of more than that many words that occur again go
too, single lines among them, wherever chunks end: for each line the shortest run of more than ``run_words``
words that begins there, and the shortest that ends there, are looked up like
chunks. Every equal run of more words is covered by such runs inside it, and
whether one is inside depends on its own lines only, so nothing of a repeated run
is missed, whatever its surroundings. Of a run that overlaps its own first
occurrence only the lines behind that go. Lines without words at the edges of a run
may stay. With ``whole``, all lines of a text together are a passage as well, so that
copies of a text go whatever its chunks and its length. ``n_removed`` counts the chunks that lost a line.

Equal hashes only nominate chunks and runs. The bytes decide: what is nominated is grouped
by its whole text, and only equal texts count as repeated.

Rows are told apart by id and text (its 128-bit digest): rows that repeat both, nulls
among them, are one document and keep alike. A null text stays null, an empty one empty; a null id sorts last among
occurrences. A text that loses nothing is returned byte for byte, whatever its
line ends; one that loses every chunk becomes empty. Very long texts are arrays of
lines in one row. All other columns pass through unchanged, whatever their names;
``n_chunks`` and ``n_removed`` are added or replaced. An empty table gives an empty result.

Groups never meet in one task: counts and first occurrences are pre-aggregated,
and the joins behind them can be split where a passage is very frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize

#: Repeated passages up to which the list of their hashes is sent to every task
#: (8 bytes each); beyond, the chunks are shuffled to it.
MAX_BROADCAST = 500_000

_WINDOW_BASE, _WINDOW_MOD = 1_000_003, (1 << 31) - 1


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the output of a generator. Expressions that use them, above all
    inside lambdas, then read a value and don't compute it again for each element."""
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(made))


def chunked(docs: DataFrame, text_col: str, window: int = 2, every: int = 2, min_lines: int = 2, run_words: int | None = None, whole: bool = False) -> DataFrame:
    """``docs`` with ``_lines``, ``_sizes`` (how many lines each chunk has, in order) and ``_units``:
    (start, size, hash) of each chunk that is a passage, with ``run_words`` of each run that isn't a
    chunk, and with ``whole`` of all lines together, if they are enough for a passage.

    A chunk ends after a line where the rolling hash is divisible by ``every``.
    """
    df = _fixed(docs, _lines=F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    hashes = F.transform("_lines", lambda line: F.xxhash64(line))
    small = F.transform(hashes, lambda h: F.pmod(h, F.lit(_WINDOW_MOD)))
    df = _fixed(df, _hash=hashes, _small=small)

    def ends(h: Column, i: Column) -> Column:
        rolled = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            rolled = F.pmod(rolled * _WINDOW_BASE + F.coalesce(F.get("_small", i - back), F.lit(0).cast("long")), F.lit(_WINDOW_MOD))
        return (F.pmod(F.shiftright(rolled, 3), F.lit(every)) == 0) | (i == F.size("_small") - 1)

    df = _fixed(df, _ends=F.filter(F.transform("_small", lambda h, i: F.when(ends(h, i), i + 1)), lambda e: e.isNotNull()))

    def unit(start: Column, size: Column) -> Column:
        return F.struct(start.alias("start"), size.alias("size"), F.xxhash64(F.slice("_hash", start + 1, size)).alias("hash"))

    started = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_ends", k - 1))
    df = _fixed(df, _sizes=F.transform("_ends", lambda e, k: e - started(k)))
    passages = F.transform("_ends", lambda e, k: F.when(e - started(k) >= min_lines, F.shiftleft(started(k).cast("long"), 32) + F.get("_sizes", k)))
    df = _fixed(df, _codes=F.filter(passages, lambda c: c.isNotNull()))
    if run_words is not None:
        df = _with_runs(df, run_words)
    if whole:
        all_lines = F.when(F.size("_lines") >= min_lines, F.array(F.size("_lines").cast("long"))).otherwise(F.array().cast("array<long>"))
        df = _fixed(df, _all=F.array_union("_codes", all_lines)).drop("_codes").withColumnRenamed("_all", "_codes")
    df = _fixed(df, _units=F.transform("_codes", lambda c: unit(F.shiftright(c, 32).cast("int"), c.bitwiseAND((1 << 32) - 1).cast("int"))))
    return df.drop("_hash", "_small", "_ends", "_codes")


def _with_runs(df: DataFrame, run_words: int) -> DataFrame:
    """``df`` with more ``_codes``, start * 2^32 + size, those of each shortest run of more than ``run_words`` words."""
    counts = F.transform("_lines", lambda line: F.least(F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(run_words + 1)))
    df = _fixed(df, _count=counts)
    # only lines with words: no run needs more than run_words + 1 of them
    df = _fixed(df, _at=F.filter(F.transform("_count", lambda w, i: F.when(w > 0, i)), lambda i: i.isNotNull()), _ahead=F.filter("_count", lambda w: w > 0))
    df = _fixed(df, _behind=F.reverse("_ahead"))
    # words * 2^32 + lines, up to the line with which the words are enough
    enough = (run_words + 1) << 32

    def held(words: str):
        add = lambda s, w: F.when(s >= enough, s).otherwise(s + F.shiftleft(w.cast("long"), 32) + 1)
        return F.transform(words, lambda w, k: F.aggregate(F.slice(words, k + 1, run_words + 1), F.lit(0).cast("long"), add))

    df = _fixed(df, _from=held("_ahead"), _to=F.reverse(held("_behind")))

    def code(s: Column, first: Column, last: Column) -> Column:
        size = F.get("_at", last) - F.get("_at", first) + 1
        return F.when(s >= enough, F.shiftleft(F.get("_at", first).cast("long"), 32) + size)

    lines = lambda s: s.bitwiseAND((1 << 32) - 1).cast("int")
    starts = F.transform("_from", lambda s, k: code(s, k, k + lines(s) - 1))
    stops = F.transform("_to", lambda s, k: code(s, k - lines(s) + 1, k))
    found = F.array_distinct(F.concat("_codes", F.filter(F.concat(starts, stops), lambda c: c.isNotNull())))
    return _fixed(df, _all=found).drop("_codes").withColumnRenamed("_all", "_codes").drop("_count", "_at", "_ahead", "_behind", "_from", "_to")


def _unit_rows(df: DataFrame, with_text: bool) -> DataFrame:
    """A row per passage or run: row key, first line, size, hash[, its text]."""
    rows = df.select("_id", "_row", *["_lines"] * with_text, F.explode("_units").alias("c"))
    text = F.array_join(F.slice("_lines", F.col("c.start") + 1, F.col("c.size")), "\n").alias("chunk")
    return rows.select("_id", "_row", F.col("c.start").alias("k"), F.col("c.size").alias("size"), F.col("c.hash").alias("hash"), *[text] * with_text)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, every: int = 2, min_lines: int = 2, run_words: int | None = None, whole: bool = False) -> DataFrame:
    """``docs`` with repeated passages removed from the text, and n_chunks and n_removed.
    Without ``run_words`` and ``whole`` only whole chunks are passages."""
    kept = [c for c in docs.columns if c not in ("n_chunks", "n_removed")]
    # the given columns are wrapped, so no name of theirs meets one of ours
    given = F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col]) if len(kept) > 1 else F.lit(None)
    keyed = docs.select(given.alias("_given"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_row"))
    cut = chunked(keyed, "_text", window, every, min_lines, run_words, whole)
    units = materialize(cut.select("_id", "_row", "_sizes", "_units"), "units")

    nominated = materialize(_unit_rows(units, False).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hashes")
    wanted = F.broadcast(nominated) if nominated.count() <= MAX_BROADCAST else nominated
    found = _unit_rows(cut, True).join(wanted, "hash", "left_semi")
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("k").alias("k"))
    texts = found.groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    equal = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.collect_list(F.when(F.col("n") > 1, F.struct(F.sha2("chunk", 256).alias("sha"), "first"))).alias("repeated")).where(F.size("repeated") > 0)
    equal = materialize(equal, "repeated")

    # one text for a hash is the rule; where a hash has several, the text tells them apart
    single = equal.where("texts = 1").select("hash", F.col("repeated")[0]["first"].alias("first"))
    clash = equal.where("texts > 1").select("hash", F.explode("repeated").alias("r")).select("hash", "r.sha", "r.first")
    again = _unit_rows(units, False).join(single, "hash").select("_id", "_row", "k", "size", "first")
    if not clash.isEmpty():
        own = found.withColumn("sha", F.sha2("chunk", 256)).join(clash, ["hash", "sha"])
        again = again.unionAll(own.select("_id", "_row", "k", "size", "first"))
    same_row = F.col("first.id").eqNullSafe(F.col("_id")) & F.col("first.row").eqNullSafe(F.col("_row"))
    # behind the first occurrence, if that is in the same text
    since = F.when(same_row, F.greatest(F.col("k"), F.col("first.k") + F.col("size"))).otherwise(F.col("k"))
    removed = again.where(place != F.col("first")).groupBy("_id", "_row").agg(F.collect_set(F.struct(since.alias("a"), (F.col("k") + F.col("size") - 1).alias("z"))).alias("_gone"))
    marks = units.select("_id", "_row", "_sizes").dropDuplicates(["_id", "_row"])
    marks = marks.join(removed.withColumnsRenamed({"_id": "_id3", "_row": "_row3"}), F.col("_id").eqNullSafe(F.col("_id3")) & F.col("_row").eqNullSafe(F.col("_row3")), "left")
    marks = marks.select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), F.size("_sizes").cast("long").alias("n_chunks"), "_gone", F.when(F.col("_gone").isNotNull(), F.col("_sizes")).alias("_sizes"))

    # the texts are shuffled once and as they are; only those that lose something are cut again
    out = keyed.join(marks, F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_row").eqNullSafe(F.col("_row2")), "left")
    affected = F.col("_gone").isNotNull()
    spelt = F.flatten(F.transform("_gone", lambda g: F.sequence(g["a"], g["z"])))
    out = _fixed(out, _lines=F.when(affected, F.split("_text", "\n", -1)), _lost=F.array_distinct(spelt), _of=F.flatten(F.transform("_sizes", lambda n, k: F.array_repeat(k, n))))
    every_line = F.sequence(F.lit(0), F.size("_lines") - 1)
    lines = F.transform(F.array_except(every_line, "_lost"), lambda i: F.get("_lines", i))
    text = F.when(affected, F.array_join(lines, "\n")).otherwise(F.col("_text"))
    lost_of = F.array_distinct(F.transform("_lost", lambda i: F.get("_of", i)))
    n_removed = F.when(affected, F.size(lost_of)).otherwise(0).cast("long").alias("n_removed")
    return out.select(*[text.alias(c) if c == text_col else F.col("_given").getField(c).alias(c) for c in kept], "n_chunks", n_removed)
