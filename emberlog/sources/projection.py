"""A projection of a table into partitioned Parquet files, held to a logical fingerprint.
Planned by the analysed design, beyond its code.

What has to be equal between two builds are the rows, their types and their partitions, not
the bytes of the files, which change with the writer. So the fingerprint is a hash over
canonically spelt, typed rows and never sees a file. Row digests are combined by their
beginnings, level by level, so a partition of any size has short lists only; repeated
rows count as often as they are there.

A build has a folder of its own, and a manifest that is written last says which folder
counts. Readers go by the manifest, so they never see half a build, and a build that
would give what is there already writes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators.fingerprints import combine, field
from emberlog.sources.tables import _exists, _path

VERSION = 1


def canonical(column: Column, kind: T.DataType) -> Column:
    """A value as text that depends on the value alone: instants as microseconds since 1970, binary in hex, maps by
    sorted entries, negative zero as zero. Null stays null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(column == 0, F.lit("0.0")).otherwise(column.cast("string"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.MapType):
        return canonical(F.array_sort(F.map_entries(column)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(column, lambda x: field(canonical(x, kind.elementType)))
        return F.when(column.isNotNull(), F.array_join(inner, ""))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.concat(F.lit(""), *[field(canonical(column[f.name], f.dataType)) for f in kind.fields]))
    return column.cast("string")


def logical_fingerprints(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """(``partition_by``, rows, fingerprint) of each partition. The order of columns doesn't count, their names and types do."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    kinds = dict(sorted(kinds.items()))
    stamp = ";".join(f"{n}:{t.simpleString()}" for n, t in kinds.items())
    digest = F.sha2(F.concat(F.lit(stamp), F.lit("|"), *[field(canonical(F.col(f"`{n}`"), t)) for n, t in kinds.items()]), 256)
    level = df.select(*partition_by, digest.alias("digest of row")).groupBy(*partition_by, F.substring("digest of row", 1, 5).alias("start of digest")).agg(F.count("*").alias("rows"), combine(F.col("digest of row")).alias("fingerprint"))
    for size in (2, 0):
        level = level.groupBy(*partition_by, F.substring("start of digest", 1, size).alias("start of digest")).agg(F.sum("rows").alias("rows"), combine(F.col("fingerprint")).alias("fingerprint"))
    return level.drop("start of digest")


def whole(fingerprints: DataFrame, partition_by: list[str]) -> DataFrame:
    """One row: partitions, rows and the fingerprint over all of them."""
    each = F.sha2(F.concat(*[field(F.col(c).cast("string")) for c in [*partition_by, "rows", "fingerprint"]]), 256)
    f = fingerprints.select("rows", each.alias("d")).groupBy(F.substring("d", 1, 3).alias("g")).agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), combine(F.col("d")).alias("d"))
    return f.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("partitions"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), combine(F.col("d")).alias("fingerprint"))


def build(df: DataFrame, root: str, partition_by: list[str], order: list[str], source_fingerprint: str | None = None) -> str:
    """Write ``df`` below ``root``, by ``partition_by`` and sorted by ``order``, and give its fingerprint.

    Rows are dealt out by ranges of partition and order, so a partition with a third of all
    rows lies in many tasks and files, and a small one in one. Partition values of null are kept.
    """
    spark = df.sparkSession
    prints = logical_fingerprints(df, partition_by)
    total = whole(prints, partition_by).first()  # one row
    before = manifest(spark, root)
    layout = {"version": VERSION, "schema": json.loads(df.schema.json()), "partition_by": partition_by, "order": order, "source_fingerprint": source_fingerprint, "rows": total["rows"], "partitions": total["partitions"], "fingerprint": total["fingerprint"]}
    if before and all(before.get(k) == v for k, v in layout.items()):
        return total["fingerprint"]
    name = f"build-{hashlib.sha256(json.dumps(layout, sort_keys=True).encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}"
    copies = {f"partition_{c}": F.col(c) for c in partition_by}
    if clashing := set(copies) & set(df.columns):
        raise ValueError(f"columns {sorted(clashing)} are named like the folders")
    dealt = df.withColumns(copies).repartitionByRange(*copies, *order).sortWithinPartitions(*copies, *order)
    dealt.write.partitionBy(*copies).parquet(f"{root}/{name}/rows")
    prints.write.parquet(f"{root}/{name}/fingerprints")
    _put(spark, root, {**layout, "folder": name})
    return total["fingerprint"]


def _put(spark: SparkSession, root: str, said: dict) -> None:
    """Manifests are numbered; a new one is written beside its place and renamed, so it is there whole or not at all."""
    fs, at = _path(spark, f"{root}/manifests")
    fs.mkdirs(at)
    number = max([int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")], default=0) + 1
    half = _path(spark, f"{root}/manifests/{uuid.uuid4().hex}.part")[1]
    out = fs.create(half)
    out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
    out.close()
    if not fs.rename(half, _path(spark, f"{root}/manifests/{number:08d}.json")[1]):
        raise RuntimeError("another build was published meanwhile")


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest; None where nothing was built."""
    if not _exists(spark, f"{root}/manifests"):
        return None
    fs, at = _path(spark, f"{root}/manifests")
    names = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
    return json.loads(spark.read.text(names[-1], wholetext=True).first()[0]) if names else None


def read(spark: SparkSession, root: str, **equal) -> DataFrame:
    """The rows that the manifest names, with the columns and types they had; ``equal`` are values of partition
    columns (None for null) and prune folders."""
    said = manifest(spark, root)
    if said is None:
        raise FileNotFoundError(f"no projection at {root}")
    schema = T.StructType.fromJson(said["schema"])
    kept = [T.StructField(f"partition_{c}", schema[c].dataType) for c in said["partition_by"]]
    df = spark.read.schema(T.StructType([*schema.fields, *kept])).parquet(f"{root}/{said['folder']}/rows")
    for column, value in equal.items():
        if column not in said["partition_by"]:
            raise ValueError(f"{column} is no partition column")
        # an empty text lies in the folder of null, so the folder prunes and the column decides
        folder, own = F.col(f"partition_{column}"), F.col(f"`{column}`")
        df = df.where((folder.isNull() if value in (None, "") else folder == value) & (own.isNull() if value is None else own == value))
    return df.select(*[f"`{f.name}`" for f in schema.fields])


def drifted(spark: SparkSession, root: str) -> DataFrame:
    """(partition columns, state) of partitions whose files don't give what was recorded: changed, missing or added."""
    said = manifest(spark, root)
    by = said["partition_by"]
    side = lambda df, n: df.select(*by, F.lit(n).alias("side"), F.struct("rows", "fingerprint").alias("v"))
    both = side(spark.read.parquet(f"{root}/{said['folder']}/fingerprints"), "old").unionByName(side(logical_fingerprints(read(spark, root), by), "new"))
    g = both.groupBy(*by).agg(F.max(F.when(F.col("side") == "old", F.col("v"))).alias("old"), F.max(F.when(F.col("side") == "new", F.col("v"))).alias("new"))
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").otherwise("changed")
    return g.where(~F.col("old").eqNullSafe(F.col("new"))).select(*by, state.alias("state"))
