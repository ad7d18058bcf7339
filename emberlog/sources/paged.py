"""A paged event source as a Spark data source: ``spark.read.format("event_pages")``.

Pages are JSON files ``<stream>/<page_index>.json`` of a folder, each with ``data``
(events) and ``nextPageTimestamp``. A stream is followed page by page until it has
no next timestamp. Batch reading makes a partition per stream; as a stream, the
offset is the number of pages read of each.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "stream string, page_index long, seq_in_page long, next_cursor_ms long, raw string"
MAX_PAGES = 2000


class PaginationStall(RuntimeError):
    """A cursor that does not move on."""


def open_store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (``file://``, ``hdfs://``, ``s3://``, ... or a plain path) and the folder in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def streams(root: str) -> list[str]:
    store, at = open_store(root)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory)


def read_page(root: str, stream: str, index: int) -> dict | None:
    store, at = open_store(root)
    try:
        with store.open_input_file(f"{at}/{stream}/{index}.json") as f:
            return json.loads(f.readall())
    except FileNotFoundError:
        return None


def follow(root: str, stream: str, start: int = 0):
    """Rows of a stream from a page on. Equal or smaller cursors stop it with an error."""
    cursor, index = None, start
    while (page := read_page(root, stream, index)) is not None:
        if index - start >= MAX_PAGES:
            raise PaginationStall(f"{stream}: more than {MAX_PAGES} pages")
        after = page.get("nextPageTimestamp")
        if cursor is not None and after is not None and (after < cursor or (after == cursor and not page["data"])):
            raise PaginationStall(f"{stream}: cursor {cursor} is followed by {after}")
        for i, event in enumerate(page["data"]):
            yield (stream, index, i, after, json.dumps(event, sort_keys=True, separators=(",", ":")))
        if after is None:
            return
        cursor, index = after, index + 1


class StreamPartition(InputPartition):
    def __init__(self, stream: str):
        self.stream = stream


class PageReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        return [StreamPartition(s) for s in streams(self.root)]

    def read(self, partition):
        yield from follow(self.root, partition.stream)


class PageStreamReader(SimpleDataSourceStreamReader):
    """For small numbers of streams: pages are listed on the driver."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self):
        return {"pages": {}}

    def _between(self, start: dict, end: dict | None):
        rows, reached = [], dict(start["pages"])
        for s in streams(self.root):
            index = reached.get(s, 0)
            until = None if end is None else end["pages"].get(s, 0)
            while (until is None or index < until) and (page := read_page(self.root, s, index)) is not None:
                rows += [(s, index, i, page.get("nextPageTimestamp"), json.dumps(e, sort_keys=True, separators=(",", ":"))) for i, e in enumerate(page["data"])]
                index += 1
            reached[s] = index
        return rows, {"pages": reached}

    def read(self, start):
        rows, end = self._between(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter(self._between(start, end)[0])

    def commit(self, end):
        pass


class EventPages(DataSource):
    @classmethod
    def name(cls):
        return "event_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options["path"])

    def simpleStreamReader(self, schema):
        return PageStreamReader(self.options["path"])
