"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at safe boundaries (see :mod:`emberlog.llm.tokens`), the pieces
new to a worker are encoded in batches of even byte size, and a text's count is
the sum over its pieces. There is no shuffle, and only counts leave Python.

Null and empty texts have no tokens and no bytes. A very long text without a
safe boundary is encoded whole. Repeated rows give repeated results, other
columns pass through untouched, an empty table gives an empty table; a column
that is named like a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberlog.llm import tokens
from emberlog.llm.common import small_batches, text_groups, text_or_empty, tokenizer_path, trim

#: Bytes of text that are cut and encoded together.
GROUP_BYTES = 4 << 20


def with_token_counts(df: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, path: str | None = None) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit. ``path`` overrides the place of the vocabulary file."""

    small_batches(df.sparkSession)

    @arrow_udf("long")
    def n_tokens(text: pa.Array) -> pa.Array:
        enc = tokens.counter(path or tokenizer_path(vocabulary))
        counts = [enc.count_tokens(group) for group in text_groups(text, GROUP_BYTES)]
        trim()
        return pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    return df.withColumns({"n_bytes": F.octet_length(text_or_empty(text_col)).cast("long"), "n_tokens": n_tokens(text_or_empty(text_col))}).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
