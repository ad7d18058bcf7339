"""Page files as a stream: exactly-once commits, boundary repeats as state, and density windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A page without events is one row without ``seq_in_page``, so that it arrives at all.
ROW = "stream string, page_index long, seq_in_page long, cursor_ms long, next_cursor_ms long, rel_ms long, raw string"
KEPT = "stream string, page_index long, seq_in_page long, rel_ms long, raw string, note string"
COMMITTED = "stream string, page_index long, seq_in_page long, raw string, fingerprint string, batch long"
#: Files that a batch of commits writes at most.
BUCKETS = 16
#: How long a missing page is waited for while later ones are there.
GAP_MS = 600_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ROW).json(path)


def fingerprint(raw: Column) -> Column:
    """Digest of an event as canonical JSON, keys sorted at every level; text that is no JSON stands for itself."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(raw)), raw), 256)


def commit(pages: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Write each batch into a few files, dealt out by page, and then a manifest of the pages in it.

    A batch that runs again writes the same two folders anew. What has no manifest isn't
    there for :func:`committed`, and of a page that was sent in several batches the last counts.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("stream", "page_index", "seq_in_page", "raw", fingerprint(F.col("raw")).alias("fingerprint"))
        data = f"{path}/data/batch={number}"
        rows.repartition(buckets, "stream", "page_index").write.mode("overwrite").parquet(data)
        written = rows.sparkSession.read.schema(rows.schema).parquet(data)
        written.groupBy("stream", "page_index").agg(F.count("seq_in_page").alias("events")).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The committed pages (stream, page_index, events, batch), each as last sent; empty ones too."""
    every = spark.read.schema("stream string, page_index long, events long, batch long").parquet(f"{path}/manifest")
    return every.groupBy("stream", "page_index").agg(F.max_by("events", "batch").alias("events"), F.max("batch").alias("batch"))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The events of the committed pages."""
    rows = spark.read.schema(COMMITTED).parquet(f"{path}/data").where("seq_in_page is not null")
    return rows.join(manifest(spark, path).select("stream", "page_index", "batch"), ["stream", "page_index", "batch"], "left_semi").select("stream", "page_index", "seq_in_page", "raw", "fingerprint")


#: Rows of a batch that the processor holds in memory; beyond them pages go to the state.
HELD_ROWS = 20_000
#: What the processor is given and returns, as JSON, since a frame of pandas has no null numbers.
_SENT, _TOLD = ("seq_in_page", "rel_ms", "raw", "next_cursor_ms"), "seq_in_page long, rel_ms long, raw string, note string"
_FRAME = "stream string, page_index long, row string"


class Boundaries(StatefulProcessor):
    """Events of a stream, page by page in order, without what a boundary sent again.

    State: a value with the next page, the cursor, the timer and the number of batches so far; a map of
    how many copies of each event were emitted at the cursor (a row at that time goes only while an
    emitted copy is left); and pages that came before their turn, in parts, with the number of
    each page's parts and the batch that it came in. A batch of more than ``held_rows`` rows of a stream
    goes through these too, so that a worker holds so many rows, a page and a frame at most. If a page
    stays away for ``gap_ms`` while later ones wait, a row with the note ``gap`` tells so and the
    next page that is there goes on, so what waits doesn't grow for ever.
    """

    def __init__(self, gap_ms: int, held_rows: int = HELD_ROWS):
        self.gap_ms, self.held_rows = gap_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next_page long, cursor_ms long, timer_ms long, batches long")
        self.copies = handle.getMapState("copies", "raw string", "n long")
        self.parts = handle.getMapState("parts", "page_index long", "n long, batch long")
        self.waiting = handle.getMapState("waiting", "page_index long, part long", "page string")

    def _page(self, rows: list[dict]) -> list[tuple]:
        """The new events of a page, in order; moves the cursor on."""
        left: dict[str, int] = {}
        kept = []
        for r in sorted((r for r in rows if r.get("seq_in_page") is not None), key=lambda r: r["seq_in_page"]):
            at, raw = r.get("rel_ms"), r.get("raw")
            if self.cursor is not None and at == self.cursor and raw is not None:
                if raw not in left:
                    left[raw] = self.copies.getValue((raw,))[0] if self.copies.containsKey((raw,)) else 0
                if left[raw] > 0:
                    left[raw] -= 1
                    continue
            kept.append((r["seq_in_page"], at, raw))
        after = rows[0].get("next_cursor_ms")
        if after is not None:
            if after != self.cursor:
                self.copies.clear()
            for _, at, raw in kept:
                if at == after and raw is not None:
                    n = self.copies.getValue((raw,))[0] if self.copies.containsKey((raw,)) else 0
                    self.copies.updateValue((raw,), (n + 1,))
            self.cursor = after
        return kept

    def _wait(self, pages: dict[int, list[str]]) -> None:
        """Put pages, or parts of them, into the state; one that waits since an earlier batch is there whole."""
        for index, rows in pages.items():
            n, batch = self.parts.getValue((index,)) if self.parts.containsKey((index,)) else (0, self.batches)
            if batch == self.batches:
                self.waiting.updateValue((index, n), (json.dumps(rows),))
                self.parts.updateValue((index,), (n + 1, batch))

    def _next(self, pages: dict[int, list[str]]) -> list[str] | None:
        """The rows of the page whose turn it is, out of those given or those that wait."""
        given = pages.pop(self.next_page, None)
        if not self.parts.containsKey((self.next_page,)):
            return given
        rows: list[str] = []
        for part in range(self.parts.getValue((self.next_page,))[0]):
            rows += json.loads(self.waiting.getValue((self.next_page, part))[0])
            self.waiting.removeKey((self.next_page, part))
        self.parts.removeKey((self.next_page,))
        return rows

    def _going_on(self, key: str, pages: dict[int, list[str]]) -> Iterator[pd.DataFrame]:
        """Emits all pages whose turn it is."""
        while (rows := self._next(pages)) is not None:
            index, self.next_page = self.next_page, self.next_page + 1
            if kept := self._page([json.loads(r) for r in rows]):
                yield self._frame(key, index, kept)

    def _frame(self, key: str, index: int, rows: list[tuple], note: str | None = None) -> pd.DataFrame:
        told = [json.dumps({"seq_in_page": seq, "rel_ms": at, "raw": raw, "note": note}) for seq, at, raw in rows]
        return pd.DataFrame({"stream": key, "page_index": index, "row": told})

    def _open(self) -> int | None:
        self.next_page, self.cursor, timer, self.batches = self.place.get() if self.place.exists() else (0, None, None, 0)
        return timer

    def _close(self, timer: int | None, moved: bool, now: int) -> None:
        waits = next(iter(self.parts.keys()), None) is not None if self.parts.exists() else False
        if timer is not None and (moved or not waits):
            self.handle.deleteTimer(timer)
            timer = None
        if waits and timer is None:
            timer = now + self.gap_ms
            self.handle.registerTimer(timer)
        self.place.update((self.next_page, self.cursor, timer, self.batches))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer = self._open()
        self.batches += 1
        pages: dict[int, list[str]] = {}
        held, spilled = 0, False
        for frame in rows:
            for index, row in zip(frame["page_index"].tolist(), frame["row"]):
                if index < self.next_page:
                    continue
                pages.setdefault(index, []).append(row)
                held += 1
                if held >= self.held_rows:
                    self._wait(pages)
                    pages, held, spilled = {}, 0, True
        if spilled:
            self._wait(pages)
            pages = {}
        before = self.next_page
        yield from self._going_on(key[0], pages)
        self._wait(pages)
        self._close(timer, self.next_page > before, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        there = min((k[0] for k in self.parts.keys()), default=None) if self.parts.exists() else None
        if there is not None:
            yield self._frame(key[0], self.next_page, [(None, None, None)], "gap")
            self.next_page, self.cursor = there, None
            self.copies.clear()
            yield from self._going_on(key[0], {})
        self._close(None, True, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def without_repeats(pages: DataFrame, gap_ms: int = GAP_MS, held_rows: int = HELD_ROWS) -> DataFrame:
    """A stream of pages (ROW) without the events that a page boundary sent twice, as multisets.

    A page comes whole in one batch, as a file does; one that comes again is passed over. The
    session's state store is set to one that keeps its state on disk.
    """
    pages.sparkSession.conf.set(_STORE, _ROCKS)
    sent = pages.select("stream", "page_index", F.to_json(F.struct(*_SENT)).alias("row"))
    told = sent.groupBy("stream").transformWithStateInPandas(Boundaries(gap_ms, held_rows), _FRAME, "Append", "ProcessingTime")
    return told.withColumn("row", F.from_json("row", _TOLD)).select("stream", "page_index", "row.*")


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what there is to Parquet files and end. Timers would keep batches without data going for
    ever, so those are left out here; a timer that is due fires with the next data."""
    conf = rows.sparkSession.conf
    before = conf.get(_IDLE)
    conf.set(_IDLE, "false")
    try:
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_IDLE, before)


def density(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per run and window of event time, closed once the watermark has passed. Beyond what the batch side has."""
    return events.withWatermark("at", late).groupBy("run_id", F.window("at", window).alias("w")).agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))


def sessions(events: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a run without a longer pause; the span is between its events, without the gap at the end."""
    g = events.withWatermark("at", late).groupBy("run_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("events"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return g.select("run_id", "events", "first_at", "last_at")
