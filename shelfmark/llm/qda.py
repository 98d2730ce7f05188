"""Quality classifier: regularised quadratic discriminant over document statistics (operator 7)."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, packed, utf8, whole_text

FEATURES = ("words", "marks", "digits", "capitals", "echoes", "variety", "word_size", "stops", "repeated_lines", "line_size", "bare_lines")
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_STOPS = b".,;:?!"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS + b"'\"()-")
_LETTERS = _UPPER + _LOWER + bytes(range(128, 256))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes) -> list[float]:
    """FEATURES of one text, brought to a bell-like shape by logs and square roots; an empty text has zeros and ones that stand for "nothing odd".

    Marks are ASCII signs outside of usual punctuation; bare lines have letters in less
    than half of their bytes, and any byte outside of ASCII is part of a letter.
    """
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = _count(text, _UPPER), _count(text, _LOWER)
    echoes = sum(map(operator.eq, words[1:], words))
    bare = sum(2 * _count(x, _LETTERS) < len(x) for x in lines)
    return [
        np.log1p(len(words)),
        (_count(text, _MARKS) / size) ** 0.5,
        (_count(text, _DIGITS) / size) ** 0.5,
        ((upper + 0.5) / (upper + lower + 1)) ** 0.5,
        (echoes / n) ** 0.5,
        np.log1p(len(set(words))) / np.log1p(n) if words else 1.0,
        np.log1p(sum(map(len, words)) / n),
        (_count(text, _STOPS) / n) ** 0.5,
        ((len(lines) - len(set(lines))) / max(len(lines), 1)) ** 0.5,
        np.log1p(n / max(len(lines), 1)),
        (bare / max(len(lines), 1)) ** 0.5,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, th, x): statistics of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = utf8(batch.column(2))
            raw = body.tobytes()
            x = [statistics(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "th", "x"])

    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("th"), whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, x array<double>")


def held_out(column: str = "doc_id"):
    """Rows of the evaluation fold; a null id is in the training fold, where it finds no label."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


class Discriminant:
    """Gaussian class densities with shrunk covariances; scores come from Cholesky factors that are computed once."""

    def __init__(self, moments: dict[int, np.ndarray], shrink: float = 0.15, ridge: float = 0.02):
        d = len(FEATURES)
        count = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        self.prior = np.log((count[1] + 1) / (count[0] + 1))
        self.parts = None
        if min(count.values()) < 2:
            return
        mean = {c: moments[c][1 : d + 1] / count[c] for c in (0, 1)}
        cov = {c: moments[c][d + 1 :].reshape(d, d) / count[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (cov[0] * count[0] + cov[1] * count[1]) / (count[0] + count[1])
        between = mean[0] - mean[1]
        scale = np.sqrt(np.diag(pooled) + 0.25 * between**2 + 1e-9)
        self.parts = []
        for c in (0, 1):
            s = ((1 - shrink) * cov[c] + shrink * pooled) / np.outer(scale, scale) + ridge * np.eye(d)
            lower = np.linalg.cholesky(s)
            inverse = np.linalg.inv(lower) / scale
            self.parts.append((mean[c], inverse, np.log(np.diag(lower)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        odds = np.full(len(x), self.prior)
        if self.parts is not None and len(x):
            density = [-0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - logdet for mean, inverse, logdet in self.parts]
            odds += density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column(0).flatten().to_numpy().reshape(-1, d)
        y = batch.column(1).to_numpy()
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    n = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(total.ravel())], ["label", "at", "value"])


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Class moments over all labelled rows of the training fold; label rows without a 0 or 1 are passed over, and of several for one id each counts."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and l_id is not null")
    training = rows.where(~held_out()).join(known, F.col("doc_id") == F.col("l_id")).select("x", "y")
    sums = training.mapInArrow(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    d = len(FEATURES)
    moments = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in sums:
        moments[r.label][r.at] = r.value
    return Discriminant(moments)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, th, held_out, score, predicted) for every document row.

    Scores depend on the text alone. With fewer than two labelled rows of a class the
    score is the smoothed share of label 1.
    """
    rows = materialise(features(docs), "statistics")
    model = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(model.scores(x))], ["doc_id", "th", "held_out", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "th", held_out().alias("held_out"), "x").mapInArrow(run, f"doc_id {kind}, th long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with the columns they came with."""
    rows = quality_scores(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).distinct()
    return packed(docs).join(rows, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left_anti").select("row.*")


def op7_quadratic_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")
