"""Benchmark decontamination with an FM-index per training shard.

A shard is a stretch of a partition: its words become symbols, an FM-index is
built over them, every window of every benchmark item is searched backwards
through wavelet-tree ranks, the occurrences are located by sampled suffix
positions, and the hit words of a document merge into removal spans. Documents
are read once, nothing is shuffled, and a lost task is simply redone.

Words that no window has can't lie in an occurrence; each stretch of them is one
separator in the index, whatever its length. All other words of all texts are indexed.

Windows reach the tasks in slices of at most ``MAX_WINDOWS`` pairs of a window and an
item, or ``MAX_BYTES`` of words; a larger benchmark takes more passes one after
another, each over the table that the last one wrote, with one broadcast at a time;
a pass's table goes when the next one is written. Windows are cut and told apart in
the benchmark's partitions.
The spans of all passes are merged at the end.

Words are the runs of ``[0-9a-z]`` and non-ASCII characters after A-Z became a-z.
A window is ``width`` consecutive words of an item; an item with fewer, but some,
is one window. A null or empty text has no words, a null or wordless item no
window; an item without id hits words but is not listed. Repeated rows and ids
are judged row by row. Very long texts are indexed whole. An empty table gives an
empty result, and with an empty benchmark nothing is hit. Other columns pass through,
whatever their names, except that the result columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import drop_scratch, enter, materialize, small_batches, trim, utf8_view
from emberlog.llm.fm_index import FMIndex

#: Pairs of a window and an item, and bytes of words, that one pass searches for; they bound what is broadcast.
MAX_WINDOWS = 200_000
MAX_BYTES = 32 << 20
#: A shard is closed when it holds this many symbols or bytes of text.
SHARD_SYMBOLS = 1_000_000
SHARD_BYTES = 32 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD_PATTERN)


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class Windows:
    """Windows of some items, as rows of word numbers (1 and up), right-aligned."""

    def __init__(self, width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        self.pairs = self.bytes = 0

    def number(self, word: bytes) -> int:
        found = self.vocabulary.get(word)
        if found is None:
            found = self.vocabulary[word] = len(self.vocabulary) + 1
            self.bytes += len(word)
        return found

    def add(self, item_id, window: list[bytes]) -> None:
        names = self.items.setdefault(tuple(map(self.number, window)), set())
        self.pairs += 1
        if item_id is not None:
            names.add(str(item_id))

    def full(self) -> bool:
        return self.pairs >= MAX_WINDOWS or self.bytes >= MAX_BYTES

    def close(self) -> tuple:
        """What a task needs: vocabulary, pattern rows, lengths, item names of each row."""
        rows = sorted(self.items)
        lengths = np.array([len(r) for r in rows], np.int64)
        patterns = np.zeros((len(rows), self.width), np.int32)
        for i, row in enumerate(rows):
            patterns[i, self.width - len(row) :] = row
        return self.vocabulary, patterns, lengths, [sorted(self.items[r]) for r in rows]


def window_pairs(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct (item, words) of the benchmark's windows, cut in its partitions."""
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = benchmark.select(F.col(id_col).cast("string").alias("item"), F.explode(F.array(F.regexp_extract_all(folded, F.lit(WORD_PATTERN), F.lit(0)))).alias("own")).where(F.size("own") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("own") - (width - 1)))
    return cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("own", i, F.lit(width)))).alias("words")).distinct()


def slices(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> Iterator[tuple]:
    """The benchmark's windows in slices of bounded size; the driver sees one partition of them at a time."""
    held = Windows(width)
    for item, own in window_pairs(benchmark, id_col, text_col, width).toLocalIterator():
        if held.full():
            yield held.close()
            held = Windows(width)
        held.add(item, [w.encode() for w in own])
    if held.items:
        yield held.close()


class Shard:
    """Documents gathered for one index."""

    def __init__(self, windows: tuple):
        self.vocabulary, self.patterns, self.lengths, self.names = windows
        self.n_words: list[int] = []
        self.symbols: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.held = self.bytes = 0

    def add(self, texts: list[bytes]) -> None:
        """Add documents: their runs of words that windows have, each ended by a 0."""
        cut = [words(t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for own in cut for w in own), np.int32, int(counts.sum()))
        doc = np.repeat(np.arange(len(cut), dtype=np.int32) + len(self.n_words), counts)
        word = np.arange(len(ids), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
        self.n_words += counts.tolist()
        self.bytes += sum(map(len, texts))
        at = np.flatnonzero(ids)
        if not len(at):
            return
        # a run goes on at the next word of the same document
        ends = np.concatenate([(at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]), [True]])
        place = np.arange(len(at)) + np.cumsum(ends) - ends  # behind each run there is room for a 0
        total = len(at) + int(ends.sum())
        symbols, docs, at_word = np.zeros(total, np.int32), np.full(total, -1, np.int32), np.zeros(total, np.int32)
        symbols[place], docs[place], at_word[place] = ids[at], doc[at], word[at]
        self.symbols.append(symbols)
        self.doc.append(docs)
        self.word.append(at_word)
        self.held += total

    def full(self) -> bool:
        return self.held >= SHARD_SYMBOLS or self.bytes >= SHARD_BYTES

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """For each document its merged word spans (end exclusive) and the items that occur."""
        spans: list[list] = [[] for _ in self.n_words]
        items: list[set] = [set() for _ in self.n_words]
        if not self.held:
            return spans, items
        text, doc, word = (np.concatenate(x) for x in (self.symbols, self.doc, self.word))
        index = FMIndex(text, len(self.vocabulary) + 1)
        low, high = index.search(self.patterns, self.lengths)
        many = high - low
        which = np.repeat(np.arange(len(many)), many)
        rows = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        at = index.locate(rows)
        edges = np.bincount(at, minlength=len(text) + 1) - np.bincount(at + self.lengths[which], minlength=len(text) + 1)
        hit = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
        if len(hit):
            new = np.concatenate([[True], (doc[hit][1:] != doc[hit][:-1]) | (word[hit][1:] != word[hit][:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            for d, a, z in zip(doc[hit][first].tolist(), word[hit][first].tolist(), word[hit][last].tolist()):
                spans[d].append((a, z + 1))
            for pair in np.unique(doc[at].astype(np.int64) * len(many) + which).tolist():
                items[pair // len(many)].update(self.names[pair % len(many)])
        return spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search_pass(df: DataFrame, windows: tuple, keep_text: bool) -> DataFrame:
    """One pass over ``df`` (given, text, n_words, spans, items): adds a slice's finds, and drops the text unless it is kept."""
    held = df.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        enter("decontaminate")
        waiting: list[pa.RecordBatch] = []
        shard = Shard(held.value)

        def flush():
            nonlocal shard
            spans, items = shard.hits()
            at = 0
            for batch in waiting:
                own, n = slice(at, at + batch.num_rows), batch.num_rows
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                columns = {c: batch.column(c) for c in batch.schema.names if c != "text" or keep_text}
                columns["n_words"] = pa.array(shard.n_words[own], pa.int64())
                columns["spans"] = pa.array([a + [{"start": s, "end": e} for s, e in b] for a, b in zip(old_spans, spans[own])], _SPANS)
                columns["items"] = pa.array([sorted({*a, *b}) for a, b in zip(old_items, items[own])], pa.list_(pa.string()))
                at += n
                yield pa.RecordBatch.from_pydict(columns)
            waiting.clear()
            shard = Shard(held.value)

        for batch in batches:
            data, off = utf8_view(batch.column("text"))
            raw = data.tobytes()
            first = 0
            for i in range(batch.num_rows):
                shard_bytes = off[i + 1] - off[first]
                if i + 1 == batch.num_rows or shard_bytes >= 4 << 20:
                    shard.add([raw[off[j] : off[j + 1]] for j in range(first, i + 1)])
                    waiting.append(batch.slice(first, i + 1 - first))
                    first = i + 1
                    if shard.full():
                        yield from flush()
        if waiting:
            yield from flush()
        trim()

    return df.mapInArrow(run, df.schema if keep_text else df.drop("text").schema)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", width: int = 13, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with n_words, n_hit, spans and items.

    ``spans`` are removal spans, merged ranges of word numbers (end exclusive);
    ``items`` are the ids, as text and sorted, of the items with an occurring window.
    Columns of ``docs`` that have these names are replaced.
    """
    small_batches(docs.sparkSession)
    added = ("n_words", "n_hit", "spans", "items")
    kept = [c for c in (docs.columns if columns is None else columns) if c not in added]
    others = [F.col(f"`{c}`") for c in kept if c != text_col]
    # the given columns are wrapped, so no name of theirs meets one of ours
    df = docs.select(
        F.struct(*others or [F.lit(0)]).alias("given"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    passes, windows = 0, None
    for following in slices(benchmark, id_col, item_text_col, width):
        if windows is not None:
            before, df = df, materialize(_search_pass(df, windows, True), "searched")
            if passes:
                drop_scratch(before)  # the texts lie in one pass's table at a time
            passes += 1
        windows = following
    df = _search_pass(df, windows or Windows(width).close(), text_col in kept)
    ordered = F.array_sort("spans") if passes else F.col("spans")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    n_hit = F.aggregate(ordered, none, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))["n"]
    back = [F.col("text").alias(c) if c == text_col else F.col("given").getField(c).alias(c) for c in kept]
    return df.select(*back, "n_words", n_hit.alias("n_hit"), ordered.alias("spans"), "items")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20) -> Column:
    """At least one word in ``share`` lies in an occurrence."""
    return (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stands between them goes too."""
    at = [m.span() for m in _WORD.finditer(text.translate({i: i + 32 for i in range(65, 91)}))]
    out, last = [], 0
    for a, z in spans:
        out.append(text[last : at[a][0]])
        last = at[z - 1][1]
    return "".join([*out, text[last:]])
