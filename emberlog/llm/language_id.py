"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows (``sample_per_label``
rows of each label, about, chosen by a hash of the row's key). The log-probability
matrix is broadcast, ``BUCKETS`` float32 a label. Labels are taken ``TOGETHER`` at a
time, which bounds a broadcast: more labels take more passes, each of which keeps
every text's best label so far and the sum for its posterior, in a table between
passes. Scoring gathers matrix cells for the n-grams of many texts at once in numpy
and sums them by text.

Text is lower-cased, whatever isn't a letter becomes one separator. A null text,
an empty one or one without a letter is ``und`` with score 0, as is every text
when nothing could be learned. Very long texts are scored whole. Ties go to the
label that sorts first. Null labels are not learned from; repeated rows repeat
their result; other columns pass through, whatever their names, except that the
result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberlog.llm import tokens
from emberlog.llm.common import drop_scratch, enter, materialize, small_batches, trim

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Labels up to which the table of their shares, a short row each, is sent to every task.
BROADCAST_LABELS = 10_000
#: Labels of which a broadcast matrix holds the columns (256 KB each).
TOGETHER = 64
UNKNOWN = "und"
GROUP_CHARS = 1 << 20

_STEPS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each led by a separator; where each begins (and the
    end of the last); whether each has a letter. Runs of other characters are one separator."""
    lowered = [" " + t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[begin[:-1]] = True
    held = np.concatenate([[0], np.cumsum(keep)])
    has = np.concatenate([[0], np.cumsum(is_letter)])
    points = np.where(is_letter, points, np.uint32(32))[keep]
    return points, held[begin], has[begin[1:]] > has[begin[:-1]]


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Buckets of the n-grams that begin at each point (fewer by order - 1)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    mixed = np.full(n, np.uint32(order * 40503), np.uint32)
    for k in range(order):
        mixed += points[k : k + n] * _STEPS[k]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(2246822519)
    return (mixed >> np.uint32(16)).astype(np.uint16)


def gram_ranges(begin: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First n-gram of each text and how many lie wholly inside it."""
    return begin[:-1], np.maximum(0, np.diff(begin) - order + 1)


def counted(texts: list[str]) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for group in tokens.groups(texts, GROUP_CHARS):
        points, begin, _ = normalised(group)
        for order in ORDERS:
            found = grams(points, order)
            first, many = gram_ranges(begin, order)
            # n-grams that run over the end of a text are left out
            inside = np.zeros(len(found) + 1, np.int64)
            np.add.at(inside, first[many > 0], 1)
            np.add.at(inside, (first + many)[many > 0], -1)
            total += np.bincount(found[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
    return total


def totals(texts: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best label number (-1 without a letter), its log-likelihood, and the sum of all likelihoods relative to it."""
    best, top, rest = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
    for group in tokens.groups(texts, GROUP_CHARS):
        points, begin, has = normalised(group)
        total = np.tile(prior, (len(group), 1))
        for order in ORDERS:
            found = grams(points, order)
            first, many = gram_ranges(begin, order)
            some = many > 0
            if not some.any():
                continue
            edges = np.empty(2 * int(some.sum()), np.int64)
            edges[0::2], edges[1::2] = first[some], (first + many)[some]
            for label in range(matrix.shape[0]):
                cells = np.append(matrix[label][found], np.float32(0))
                total[some, label] += np.add.reduceat(cells, edges, dtype=np.float64)[0::2]
        own = total.max(axis=1)
        best.append(np.where(has, total.argmax(axis=1), -1))
        top.append(own)
        rest.append(np.exp(total - own[:, None]).sum(axis=1))
    return np.concatenate(best), np.concatenate(top), np.concatenate(rest)


def scored(texts: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best label number (-1 without a letter) and its posterior probability."""
    best, _, rest = totals(texts, matrix, prior)
    return best, np.where(best >= 0, 1 / rest, 0.0)


_STATE = pa.struct([("label", pa.string()), ("top", pa.float64()), ("rest", pa.float64())])


class Model:
    """Labels in order, log priors, and the log-probabilities by slices of TOGETHER labels."""

    def __init__(self, labels: list[str], prior: np.ndarray, matrix: Callable[[int, int], np.ndarray]):
        self.labels, self.prior, self.matrix = labels, prior, matrix

    @staticmethod
    def fit(rows: DataFrame, key: Column, label_col: str, text_col: str, sample_per_label: int = 2000, smoothing: float = 0.3) -> Model:
        """Fit on about ``sample_per_label`` rows of each label, chosen by ``key``."""
        spark = rows.sparkSession
        small_batches(spark)
        known = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(1_000_000)).alias("draw"))
        sizes = dict(sorted(known.groupBy("label").agg(F.count("*").alias("n")).collect()))  # a row for each label
        names = list(sizes)
        if not names:
            return Model([], np.zeros(0), lambda a, z: np.zeros((0, BUCKETS), np.float32))
        shares = spark.createDataFrame([(x, i, min(1_000_000, -(-sample_per_label * 1_000_000 // n))) for i, (x, n) in enumerate(sizes.items())], "label string, number int, share int")
        sample = known.join(F.broadcast(shares) if len(names) <= BROADCAST_LABELS else shares, "label").where("draw < share").select("number", "text")
        sample = sample.repartition(max(1, sum(min(n, sample_per_label) for n in sizes.values()) // 500))

        def count(batches):
            enter("language_id")
            for batch in batches:
                number, text = batch.column("number").to_numpy(), batch.column("text").to_pylist()
                for label in np.unique(number).tolist():
                    total = counted([text[i] for i in np.flatnonzero(number == label).tolist()])
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["number", "bucket", "n"])

        table = sample.mapInArrow(count, "number int, bucket int, n long").groupBy("number", "bucket").agg(F.sum("n").alias("n"))
        if len(names) > TOGETHER:
            table = materialize(table, "ngrams")

        def matrix(a: int, z: int) -> np.ndarray:
            """Log-probabilities of the labels from a up to z."""
            own = table.where((F.col("number") >= a) & (F.col("number") < z)).toArrow()  # at most TOGETHER x BUCKETS cells
            cells = np.zeros((z - a, BUCKETS))
            cells[own["number"].to_numpy() - a, own["bucket"].to_numpy()] = own["n"].to_numpy()
            return np.log((cells + smoothing) / (cells.sum(axis=1, keepdims=True) + smoothing * BUCKETS)).astype(np.float32)

        weight = np.array(list(sizes.values()), float)
        return Model(names, np.log(weight / weight.sum()), matrix)

    def _pass(self, df: DataFrame, a: int, z: int) -> DataFrame:
        """``df`` (given, text, state) with the labels from a up to z taken into the state."""
        held = df.sparkSession.sparkContext.broadcast((self.labels[a:z], self.prior[a:z], self.matrix(a, z)))

        @arrow_udf("struct<label:string,top:double,rest:double>")
        def taken(text: pa.Array, before: pa.Array) -> pa.Array:
            enter("language_id")
            labels, prior, matrix = held.value
            best, top, rest = totals([t or "" for t in text.to_pylist()], matrix, prior)
            names = np.array([*labels, None], object)[best]
            old, old_top, old_rest = (before.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            if before.null_count < len(before):
                keep = before.is_valid().to_numpy(zero_copy_only=False) & ~(top > old_top)
                high = np.where(keep, old_top, top)
                both = rest * np.exp(top - high) + np.where(np.isnan(old_top), 0, old_rest * np.exp(old_top - high))
                names, top, rest = np.where(keep, old, names), high, both
            trim()
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(top), pa.array(rest)], fields=list(_STATE))

        return df.withColumn("state", taken("text", "state"))

    def predict(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with lang_pred and score."""
        small_batches(df.sparkSession)
        kept = [c for c in df.columns if c not in ("lang_pred", "score")]
        # the given columns are wrapped, so no name of theirs meets one of ours
        now = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given"), F.col(text_col).alias("text"), F.lit(None).cast("struct<label:string,top:double,rest:double>").alias("state"))
        for a in range(0, len(self.labels), TOGETHER):
            if a:
                before, now = now, materialize(now, "language-pass")
                if a > TOGETHER:
                    drop_scratch(before)
            now = self._pass(now, a, min(a + TOGETHER, len(self.labels)))
        label = F.col("state.label")
        score = F.when(label.isNotNull(), 1 / F.col("state.rest")).otherwise(0.0)
        return now.select(*[F.col("given").getField(c).alias(c) for c in kept], F.coalesce(label, F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_per_label: int = 2000) -> DataFrame:
    """Fit on the rows that aren't held out (and have an id), then predict every row: adds held_out, lang_pred, score."""
    train = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    model = Model.fit(train, F.col(id_col).cast("string"), label_col, text_col, sample_per_label)
    return model.predict(docs.withColumn("held_out", held_out(id_col)), text_col)
