"""Helpers shared by the operators: scratch tables, paths and text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import drop_scratch, materialize, scratch_path, shared_folder  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the batches of Arrow and of the Parquet reader have ``rows`` rows at most in this
    session. Texts are long, and the JVM and Python both hold a batch whole."""
    for batch in _BATCHES:
        if int(spark.conf.get(batch)) > rows:
            spark.conf.set(batch, str(rows))


_HELD: dict[str, object] = {}


def hold(owner: str, free) -> None:
    """Register what a worker process keeps between tasks, and how to let go of it."""
    _HELD[owner] = free


def trim() -> None:
    """Give freed memory back; glibc keeps it otherwise, and workers live on idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def enter(owner: str) -> None:
    """Called where an operator's Python begins: other operators' memory in this worker is
    freed, so a worker that serves one after another never holds the sum of them."""
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        trim()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values (nulls are empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices_by_bytes(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    out, i, n = [], 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        out.append((i, j))
        i = j
    return out


def text_groups(arr: pa.Array, most: int):
    """The values of a string array as lists of about ``most`` bytes together, made one at a time."""
    _, off = utf8_view(arr)
    for i, j in slices_by_bytes(off, most):
        yield arr.slice(i, j - i).to_pylist()
