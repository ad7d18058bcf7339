"""Packing: shortest-pack-first over the length histogram.

Each document's ids (with the end id) are cut into pieces of at most ``size``
ids. Only the histogram of piece lengths, at most ``size`` numbers, reaches the
driver: lengths are placed longest first, and packing patterns carry counts, so
the work depends on ``size`` and not on the number of documents. Pieces are then
joined back to the patterns by their rank within their length.

A piece's rank follows its place in the written table of pieces: file, stretch of
rows in it, row. Each (length, file, stretch) group numbers its own pieces and starts
at an offset summed up in two levels, over the stretches of a file and over the
files. So no length (copies may give one a third of all pieces) meets in one task,
and rows that repeat in every column are told apart.

Null and empty texts give one piece that holds the end id alone. Repeated rows
are separate documents. An empty table gives an empty result. Very long
texts give many pieces. Pieces of one length are alike to the packing; which of them goes
where is settled by their rank. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberlog.llm import word_encoder
from emberlog.llm.common import materialize, slices_by_bytes, small_batches, text_or_empty, tokenizer_path, trim, utf8_view

#: Bytes of text that are encoded together.
GROUP_BYTES = 1 << 18
#: Rows of a stretch, whose pieces of one length are numbered together.
RANKED_TOGETHER = 10_000


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) that hold every length as often as ``counts`` says.

    Lengths go longest first onto the shortest open pack that they fill exactly or,
    if there is none, onto the shortest one with room; without room a pack is opened.
    Open packs are kept by their filled length; placing splits a pack's count.
    """
    by_fill: dict[int, list[list]] = defaultdict(list)

    def put(fill: int, times: int, lengths: tuple) -> None:
        by_fill[fill].append([times, lengths])

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left = counts[length]
        while left:
            exact = size - length
            fill = exact if by_fill.get(exact) else min((f for f in by_fill if by_fill[f] and f + length <= size), default=0)
            if not fill:
                # as many of this length as fit, so that a short length doesn't open a pack each
                each = max(1, size // length)
                times, rest = divmod(left, each)
                if times:
                    put(each * length, times, (length,) * each)
                    left -= times * each
                else:
                    put(rest * length, 1, (length,) * rest)
                    left = 0
                continue
            pack = by_fill[fill][-1]
            take = min(pack[0], left)
            pack[0] -= take
            if not pack[0]:
                by_fill[fill].pop()
            put(fill + length, take, (*pack[1], length))
            left -= take
    return [(times, list(lengths)) for fill in sorted(by_fill) for times, lengths in by_fill[fill] if times]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each place in a pattern: its length, the first rank it takes, the first sequence and the offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, lengths in patterns:
        at = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, at))
            taken[length] += times
            at += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def cut_into_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc, doc_tokens, start, length, ids_crc32[, ids]) of rows (doc, text)."""

    def cut(batches):
        enc = word_encoder.encoder(path or tokenizer_path(vocabulary))
        for batch in batches:
            row, totals, starts, lengths, crcs, kept, at = [], [], [], [], [], [], 0
            data, off = utf8_view(batch.column("text"))
            for i, j in slices_by_bytes(off, GROUP_BYTES):
                flat, counts = enc.token_ids(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.cumsum(counts)
                for a, z in zip((ends - counts).tolist(), ends.tolist()):
                    ids = np.append(flat[a:z], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), size):
                        own = ids[start : start + size]
                        row.append(at)
                        totals.append(len(ids))
                        starts.append(start)
                        lengths.append(len(own))
                        crcs.append(zlib.crc32(own.tobytes()))
                        if keep_ids:
                            kept.append(own.astype(np.int32))
                    at += 1
            columns = [batch.column("doc").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (totals, starts, lengths, crcs))]
            trim()
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, ["doc", "doc_tokens", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc {kind}, doc_tokens long, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = 1, size: int = 2048, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A sequence's pieces lie at offsets without gaps from 0; what a sequence
    lacks to ``size`` is padding.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    pieces = materialize(cut_into_pieces(rows, vocabulary, end_id, size, path, keep_ids), "pieces")

    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    place = slots(pack_histogram(counts, size))

    held = pieces.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    held = held.withColumn("stretch", F.floor(F.col("row") / RANKED_TOGETHER))
    stretches = held.groupBy("length", "file", "stretch").agg(F.count("*").alias("n"))
    before = lambda of, by: F.coalesce(F.sum("n").over(W.partitionBy(*of).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = stretches.groupBy("length", "file").agg(F.sum("n").alias("n"))
    files = files.select("length", "file", before(["length"], "file").alias("files_before"))
    groups = stretches.select("length", "file", "stretch", before(["length", "file"], "stretch").alias("in_file")).join(files, ["length", "file"])
    groups = groups.select("length", "file", "stretch", (F.col("files_before") + F.col("in_file")).alias("base"))
    own = W.partitionBy("length", "file", "stretch").orderBy("row")
    ranked = held.withColumn("rn", F.row_number().over(own)).join(groups, ["length", "file", "stretch"]).withColumn("rank", F.col("base") + F.col("rn") - 1)

    @arrow_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        key = length.to_numpy(zero_copy_only=False).astype(np.int64) << 40 | rank.to_numpy(zero_copy_only=False).astype(np.int64)
        i = np.searchsorted(place["length"] << 40 | place["rank"], key, side="right") - 1
        sequence = place["sequence"][i] + (rank.to_numpy(zero_copy_only=False) - place["rank"][i])
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(place["offset"][i])], ["sequence_id", "offset"])

    out = ranked.withColumn("at", placed("length", "rank"))
    return out.select(F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *["ids"] * keep_ids)
