"""A corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a
DataFrame, which is written as Parquet and read again for the next one. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from emberlog.llm.common import documents, drop_scratch, materialize

#: Posterior probability under which a language is not accepted.
MIN_SCORE = 0.5


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _shielded(stage):
    """The stage with further columns wrapped in one, so that no name of theirs meets one of an operator."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest = [c for c in docs.columns if c not in DOCUMENT]
        if not rest:
            return stage(spark, docs, sf_dir)
        wrapped = docs.select(*DOCUMENT, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
        out = stage(spark, wrapped, sf_dir)
        return out.select(*[F.col("rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns])

    return run


@_shielded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has a score under MIN_SCORE, go.
    A missing ``lang`` is filled with the prediction. Rows without an id are predicted, but nothing is
    learned from them; rows that repeat are judged alike."""
    found = language_id.identify(docs)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@_shielded
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; ``n_chars`` follows. A document that loses all its words goes.
    A row without an id comes last among those that share a passage; rows that repeat id and text lose alike."""
    found = line_dedup.dedup(docs, run_words=50, whole=True)
    changed = F.col("n_removed") > 0
    left = found.where(~changed | (F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")) != ""))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


@_shielded
def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 connect, the one with the smallest id stays
    (an id before none); of rows that repeat id and text (its 128-bit digest), one. Documents without words are linked with nothing."""
    keyed = docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text")))
    found = materialize(ngram_join.join(keyed, "_key", width=5, num=80, den=100), "near")
    gone = found.where("_key != component_id").select("_key").distinct()
    repeated = materialize(found.where("n_shingles > 0").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "repeated")
    left = keyed.join(gone, "_key", "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        left = left.join(repeated, "_key", "left_anti").unionByName(once)
    return left.select(docs.columns)


@_shielded
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go; others stay as they are,
    those without words among them. Every row is judged on its own text, whatever its id."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated()).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, one row each. A null or empty text is the end id alone;
    rows that repeat are documents of their own. A very long text is cut over as many sequences as it fills."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

#: Hashes of n-grams, tokenizers and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if at:
            drop_scratch(before)  # what a stage read goes once its output is written
    return STAGES[-1][1](spark, docs, sf_dir)
