"""Quality by regularised quadratic discriminant analysis.

Every class of labelled documents has a mean and a covariance over transformed
statistics of the text; covariances are shrunk towards what the classes share
and towards the identity.  A document's score comes from the difference of two
log densities, which are Mahalanobis distances through Cholesky factors that are
worked out once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartfold.llm.linecrf import IS_DIGIT, IS_LOWER, IS_POINT, IS_SYMBOL, IS_UPPER
from chartfold.llm.textbatch import SPACE, Texts, Words, column, slices, span_hashes, spans_total

#: text whose statistics are worked out together: they take some hundred bytes of memory for each
PART_BYTES = 1 << 19

FEATURES = (
    "log_words", "word_length", "symbols", "exclaims", "pipes", "capitals", "digits", "stops", "commas",
    "line_words", "different_words", "repeated_lines", "long_words", "symbol_words",
)


def statistics(texts: Texts) -> np.ndarray:
    """One row of :data:`FEATURES` per text.

    Shares are smoothed by a few imagined characters or words and then put on a
    log or root scale, so that short texts do not look extreme.
    """
    data, words = texts.data, Words(texts)
    n = words.counts
    solid = ~SPACE[data]
    chars = texts.per_text(IS_POINT[data] & solid)
    upper, lower = texts.per_text(IS_UPPER[data]), texts.per_text(IS_LOWER[data])
    breaks = data == ord("\n")

    def count(byte: str) -> np.ndarray:
        return texts.per_text(data == ord(byte))

    def share(part: np.ndarray, whole: np.ndarray, smooth: float = 20.0) -> np.ndarray:
        return np.sqrt(part / (whole + smooth))

    total = np.concatenate([[0], np.cumsum(IS_POINT[data])])
    lengths = total[words.end] - total[words.begin]
    marked = np.concatenate([[0], np.cumsum(IS_SYMBOL[data])])
    with_symbol = (marked[words.end] - marked[words.begin]) > 0
    hashes = span_hashes(data, words.begin, words.end)
    # how many different words a text has, against what its length lets expect
    text_of = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((hashes, text_of))
    h, t = hashes[order], text_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    different = np.bincount(t[new], minlength=len(texts))
    # lines that occur again
    begin = np.sort(np.concatenate([texts.at[:-1], np.flatnonzero(breaks) + 1]), kind="stable")
    end = np.sort(np.concatenate([texts.at[1:], np.flatnonzero(breaks)]), kind="stable")
    line_of = np.repeat(np.arange(len(texts)), texts.per_text(breaks) + 1)
    filled = end > begin
    line_hash, line_of = span_hashes(data, begin[filled], end[filled]), line_of[filled]
    order = np.lexsort((line_hash, line_of))
    h, t = line_hash[order], line_of[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    lines = np.bincount(line_of, minlength=len(texts))
    return np.stack([
        np.log1p(n),
        np.log1p(spans_total(lengths, words.first) / np.maximum(n, 1)),
        share(texts.per_text(IS_SYMBOL[data]), chars), share(count("!"), chars), share(count("|"), chars),
        share(upper, upper + lower), share(texts.per_text(IS_DIGIT[data]), chars),
        share(count("."), n, 5), share(count(","), n, 5),
        np.log1p(n / np.maximum(lines, 1)),
        np.log1p(different) - np.log1p(n),
        share(np.bincount(t[again], minlength=len(texts)), lines, 3),
        share(spans_total(lengths > 12, words.first), n, 5),
        share(spans_total(with_symbol, words.first), n, 5),
    ], axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log terms of class 0 and class 1."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def fit(n: np.ndarray, first: np.ndarray, second: np.ndarray, shared: float, ridge: float) -> "Discriminant":
        """From counts, sums and sums of products of both classes."""
        means = first / n[:, None]
        inner = second / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (inner * n[:, None, None]).sum(0) / n.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        spread = np.outer(scale, scale)
        whiten, offsets = [], []
        for c in (0, 1):
            shrunk = (1 - shared - ridge) * inner[c] + shared * pooled + ridge * np.eye(len(scale)) * spread
            factor = np.linalg.cholesky(shrunk)
            whiten.append(np.linalg.inv(factor))
            offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
        return Discriminant(means, np.array(whiten), np.array(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        logs = [
            self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


@dataclass(frozen=True)
class Constant:
    """Where there are not labels of both classes to learn from."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def held_out(id: Column) -> Column:
    """The third of the documents that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    shared: float = 0.3,
    ridge: float = 0.05,
) -> Discriminant | Constant:
    """Learns from all labelled documents that are not held out.

    Each task sums up its documents; one row per class comes to the driver.  A
    document with several labels counts with the least one.  Documents held out
    do not even reach the tasks.
    """
    kind = docs.schema[id].dataType.simpleString()
    known = labels.filter(F.col(quality).isin(0, 1) & F.col(id).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(F.col(id).cast(kind).alias("id")).agg(F.min(quality).cast("int").alias("label"))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(~held_out(F.col("id")))
    d = len(FEATURES)

    def measure(batches):
        for batch in slices(batches, "text", PART_BYTES):
            x = statistics(Texts(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([*x])], ["id", "x"])

    measured = rows.mapInArrow(measure, f"id {kind}, x array<double>").join(known, "id")

    def sums(batches):
        n, first, second = np.zeros(2, np.int64), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = column(batch, "x").flatten().to_numpy().reshape(-1, d)
            label = column(batch, "label").to_numpy()
            for c in (0, 1):
                mine = x[label == c]
                n[c] += len(mine)
                first[c] += mine.sum(axis=0)
                second[c] += mine.T @ mine
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(n), pa.array([*first]), pa.array([*second.reshape(2, d * d)])],
            ["label", "n", "first", "second"],
        )

    parts = measured.select("label", "x").mapInArrow(
        sums, "label int, n bigint, first array<double>, second array<double>"
    )
    flat = [F.sum(F.col("first")[i]).alias(f"f{i}") for i in range(d)]
    flat += [F.sum(F.col("second")[i]).alias(f"s{i}") for i in range(d * d)]
    found = {r["label"]: r for r in parts.groupBy("label").agg(F.sum("n").alias("n"), *flat).collect()}
    n = np.array([found[c]["n"] if c in found else 0 for c in (0, 1)], float)
    if not n.all():
        return Constant(0.5 if not n.any() else float(n[1] > 0))
    first = np.array([[found[c][f"f{i}"] for i in range(d)] for c in (0, 1)])
    second = np.array([[found[c][f"s{i}"] for i in range(d * d)] for c in (0, 1)]).reshape(2, d, d)
    return Discriminant.fit(n, first, second, shared, ridge)


def score_quality(docs: DataFrame, model: Discriminant | Constant, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score`` from 0 to 1, ``predicted``.

    Only the text decides a score.  A null text scores as an empty one; equal
    texts score alike.  Other columns are not looked at, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text", PART_BYTES):
            score = model.score(statistics(Texts(column(batch, "text"))))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["id", "score", "predicted"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, score double, predicted int")
    return scored.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Discriminant | Constant, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, unchanged.

    Only the text decides: a null text scores as an empty one, copies and
    repeated rows stay or go together, a score equal to ``least`` stays, and
    other columns, whatever they are called or hold, are passed on.  An empty
    table gives an empty one.
    """

    def run(batches):
        for batch in slices(batches, text, PART_BYTES):
            yield batch.filter(pa.array(model.score(statistics(Texts(column(batch, text)))) >= least))

    return docs.mapInArrow(run, docs.schema)
