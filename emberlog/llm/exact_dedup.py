"""Exact dedup as a stateful stream.

A first stream reads the document files, each once and never twice, and writes of
every row its id, the digest of its normalised text and a content locator (file and
row in it). A second stream over these rows keeps one state entry per digest: the
stable identifier of the row that stays (its smallest id), its locator and the number
of rows. State lies on disk (RocksDB) in keyed partitions, never expires, and is
checkpointed, so both go on where they stopped when more files arrive, and a file
that lands during a call is left whole to the next one. Rows are pre-aggregated before
they reach the state: copies of one text cost one update per task.

A digest that has a hit is checked on full bytes: the texts at the locators of all its
rows are fetched and grouped by their bytes, again pre-aggregated. Texts that share a
digest and differ form groups of their own.

Texts are equal when identical after each run of space and \\t\\n\\v\\f\\r became one
space. A null text counts as empty. Of equal texts the row with the smallest id
stays (a null id sorts last; among rows with that id, the first in its file).
Rows that repeat id and text are rows of their own, and one stays. Very long texts
are digested whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import materialize, scratch_path, text_or_empty

#: Locators of rows with hits that are broadcast to fetch their texts (about 150 bytes each); with more, texts are shuffled.
MAX_BROADCAST = 100_000

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # commit changes, not whole snapshots; close a store behind its task, and claim no space in advance
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _run(frame: DataFrame, checkpoint: str, start) -> None:
    """Run a stream over what is there now."""
    start(frame.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)).awaitTermination()


def stream_rows(spark: SparkSession, path: str, schema, id_col: str, text_col: str, digest: Callable[[Column], Column], checkpoint: str, sink: str) -> DataFrame:
    """The rows of all files in ``path`` that were there so far: doc, digest, place (what orders rows,
    and where their bytes lie), and the text's hash where the digest isn't that."""
    reader = spark.readStream.schema(schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a stream reads folders
        files = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        files = reader.parquet(path)
    place = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = files.select(F.col(id_col).alias("doc"), place.alias("place"), normalised(text_col).alias("text"))
    hashed = [F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")] if digest is not sha256 else []
    rows = rows.select("doc", "place", digest(F.col("text")).alias("digest"), *hashed)
    _run(rows, f"{checkpoint}/rows", lambda w: w.format("parquet").start(f"{sink}/rows"))
    if not _exists(spark, f"{sink}/rows"):
        return spark.createDataFrame([], rows.schema)  # no file, no batch
    return spark.read.schema(rows.schema).parquet(f"{sink}/rows")


def stream_state(spark: SparkSession, schema, checkpoint: str, sink: str) -> DataFrame:
    """The state (digest, first, n) of all rows that :func:`stream_rows` has written to the sink so far."""
    fields = T.StructType([schema["digest"], T.StructField("first", schema["place"].dataType), T.StructField("n", T.LongType())])
    if not _exists(spark, f"{sink}/rows"):
        return spark.createDataFrame([], fields)
    rows = spark.readStream.schema(schema).parquet(f"{sink}/rows")
    held = rows.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # a batch that is run again overwrites its own folder
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{sink}/state/batch={number}")
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        _run(held, f"{checkpoint}/state", lambda w: w.outputMode("update").foreachBatch(put).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _exists(spark, f"{sink}/state"):
        return spark.createDataFrame([], fields)
    updates = spark.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType())])).parquet(f"{sink}/state")
    # a later batch replaces what an earlier one said about a digest
    return updates.groupBy("digest").agg(F.max_by("first", "n").alias("first"), F.max("n").alias("n"))


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """One row per document of the files in ``path``: the id column, keep_id, group_size, kept and text_sha256.

    With the ``checkpoint`` and ``sink`` folders of an earlier call, only new files are streamed.
    """
    checkpoint, sink = checkpoint or scratch_path(spark, "stream"), sink or scratch_path(spark, "stream-out")
    files = spark.read.parquet(path)
    rows = stream_rows(spark, path, files.schema, id_col, text_col, digest, checkpoint, sink)
    state = materialize(stream_state(spark, rows.schema, checkpoint, sink), "state")

    hits = state.where("n > 1").select(F.col("digest").alias("hit"))
    located = materialize(rows.join(hits, rows["digest"] == hits["hit"], "left_semi").select("digest", "place"), "located")
    wanted = located.select("digest", "place", F.col("place.file").alias("file"), F.col("place.row").alias("row"))
    wanted = F.broadcast(wanted) if located.count() <= MAX_BROADCAST else wanted
    there = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(text_col).alias("given"))
    fetched = there.join(wanted, ["file", "row"]).select("digest", "place", normalised("given").alias("text"))
    texts = fetched.groupBy("digest", "text").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    several = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    several = materialize(several, "clashes")

    out = rows.join(state, "digest")
    if digest is sha256:
        out = out.withColumn("text_sha256", F.lower(F.hex("digest")))
    columns = ["doc", "place", "text_sha256", "first", "n"]
    if not several.isEmpty():
        apart = fetched.join(several, "digest", "left_semi").join(texts, ["digest", "text"])
        apart = apart.select(F.col("place.id").alias("doc"), "place", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "first", "n")
        out = out.join(several, "digest", "left_anti").select(columns).unionAll(apart.select(columns))
    return out.select(F.col("doc").alias(id_col), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.struct("place.file", "place.row") == F.struct("first.file", "first.row")).alias("kept"), "text_sha256")
