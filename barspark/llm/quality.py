"""A quality classifier learned from trusted positives and unlabelled text.

The risk of a linear score over features of a text's make-up is estimated without
negatives: that of the positives, weighted by the class prior, plus that of all
unlabelled texts taken as negative less what the positives among them contribute.
That last difference cannot be negative in truth, so it is not let below zero:
where it would be, a step raises it instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import raw
from barspark.llm.textnum import NON_BLANK, U64, mix64, prefix_hashes, span_hashes, word_spans


@dataclass(frozen=True)
class QualityConfig:
    """``positives`` and ``unlabelled`` bound, in expectation, the rows that the classifier is fitted on.

    ``shapes`` is the number of hashed features of three adjacent kinds of bytes.
    ``penalty`` is that of the squared weights; ``threshold`` parts good from poor.
    """

    positives: int = 12_000
    unlabelled: int = 24_000
    shapes: int = 192
    steps: int = 400
    rate: float = 0.05
    penalty: float = 1e-4
    threshold: float = 0.3


def _kinds() -> np.ndarray:
    """Kind of each byte: capitals, small letters, digits, parts of other letters, blanks, and each sign by itself."""
    kind = np.arange(256)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[0x80:] = 0x41, 0x61, 0x30, 0x80
    kind[[9, 11, 12, 13]] = 0x20
    return kind


_KIND = _kinds()
#: Features that are not hashed.
PLAIN = ("letters", "capitals", "digits", "signs", "line_ends", "word_length", "repeated_next", "distinct_words", "repeated_lines", "length")


class Features:
    """Shares of hashed kinds of three adjacent bytes, and measures of the words and lines of a whole text."""

    def __init__(self, shapes: int):
        self.shapes, self.size = shapes, shapes + len(PLAIN)
        self.tables = [(mix64(_KIND.astype(U64) + U64(1 + 1000 * place)) % U64(shapes)).astype(np.uint16) for place in range(3)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        if not text:
            return out
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        if n > 2:
            first, second, third = (t[data] for t in self.tables)
            code = (first[:-2].astype(np.int64) + second[1:-1] + third[2:]) % self.shapes
            out[: self.shapes] = np.sqrt(np.bincount(code, minlength=self.shapes) / len(code))
        kinds = np.bincount(_KIND[data], minlength=256)
        letters, blanks = kinds[[0x41, 0x61, 0x80]].sum(), kinds[[0x20, 0x0A]].sum()
        start, end = word_spans(data, NON_BLANK)
        prefix = prefix_hashes(data)
        words = span_hashes(prefix, start, end)
        edge = np.flatnonzero(np.concatenate([[True], data == 0x0A, [True]]))
        low, high = edge[:-1], np.minimum(edge[1:], n)
        some = high > low
        lines = span_hashes(prefix, low[some], high[some])
        out[self.shapes :] = (
            letters / n,
            kinds[0x41] / max(1, letters),
            kinds[0x30] / n,
            (n - letters - blanks - kinds[0x30]) / n,
            kinds[0x0A] / n,
            min(1.0, float(np.mean(end - start)) / 20) if len(words) else 0.0,
            float(np.mean(words[1:] == words[:-1])) if len(words) > 1 else 0.0,
            np.log1p(len(np.unique(words))) / np.log1p(len(words)) if len(words) else 0.0,
            1 - len(np.unique(lines)) / len(lines) if len(lines) else 0.0,
            np.log1p(n) / 20,
        )
        return out


@dataclass
class QualityModel:
    config: QualityConfig
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the logistic risk and their gradients: of positives, and of negatives, which may come out below zero."""
    zp, zu = positive @ weights, unlabelled @ weights
    as_good, as_poor = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    of_positives = prior * np.logaddexp(0, -zp).mean()
    of_negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up = prior * positive.T @ (as_good - 1) / len(positive)
    down = unlabelled.T @ as_poor / len(unlabelled) - prior * positive.T @ as_good / len(positive)
    return of_positives, of_negatives, up, down


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, config: QualityConfig) -> QualityModel:
    """Weights that minimise the non-negative risk, by gradient steps over all rows with a rate for each weight (Adam).

    Without positives or unlabelled rows the score is the prior for every text.
    """
    size = config.shapes + len(PLAIN)
    if not len(positive) or not len(unlabelled):
        bias = np.append(np.zeros(size), np.log(prior / (1 - prior)))
        return QualityModel(config, prior, np.zeros(size), np.ones(size), bias)
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    model = QualityModel(config, prior, mean, scale, np.zeros(size + 1))
    p, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w = np.append(np.zeros(size), np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, config.steps + 1):
        _, of_negatives, up, down = risk(w, p, u, prior)
        shrink = config.penalty * np.append(w[:-1], 0)
        gradient = up + down + shrink if of_negatives >= 0 else shrink - down
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        pace = config.rate * (1 - step / (config.steps + 1))
        w = w - pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents by checksum of the id; never learned from.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(config: QualityConfig):
    features = Features(config.shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("order"), pa.array([features(t).tobytes() for t in raw(batch)], pa.binary())], ["good", "order", "x"])

    return run


def _share(limit: int, count: int, *key: Column) -> Column:
    """About ``limit`` of ``count`` rows, by the hash of their key, the same on every run."""
    fine = 1 << 30
    return F.pmod(F.xxhash64(*key), F.lit(fine)) < int(fine * min(1.0, limit / max(1, count)))


def train(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Fit on a bounded sample of trusted positives (quality 1) and of unlabelled documents, none of them held out.

    The class prior is the share of quality 1 among all labels that may be learned
    from, smoothed by one of each.  Labels of null id or quality teach nothing; a
    label repeated counts once; unlabelled are all documents, whatever their label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total, good = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.lit(0))).first()
    prior = (good + 1) / (total + 2)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = known.where((F.col("quality") == 1) & _share(config.positives, good, F.lit(1), F.col("doc_id"))).select("doc_id").withColumn("good", F.lit(True))
    # the chosen labels are few whatever the tables: about ``positives`` ids, in expectation
    positive = docs.join(F.broadcast(some), "doc_id")
    unlabelled = docs.where(_share(config.unlabelled, docs.count(), F.lit(2), F.col("doc_id"))).withColumn("good", F.lit(False))
    rows = positive.unionByName(unlabelled).withColumn("order", F.xxhash64("doc_id", "text"))
    table = rows.select("good", "order", "text").mapInArrow(_vectors(config), "good boolean, order long, x binary").toArrow()
    order = np.lexsort((table.column("order").to_numpy(), table.column("good").to_numpy()))
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(order), -1) if len(order) else np.zeros((0, config.shapes + len(PLAIN)), np.float32)
    x, is_good = x[order].astype(np.float64), table.column("good").to_numpy()[order].astype(bool)
    return fit(x[is_good], x[~is_good], prior, config)


def _scores(model: QualityModel):
    features = Features(model.config.shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([features(t) for t in raw(batch)]) if len(batch) else np.zeros((0, features.size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x.astype(np.float64)))], ["doc_id", "score"])

    return run


def predict(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: good likelier) and predicted (1 if the score reaches the threshold) of every row.

    Null and empty texts have the score of a text without any feature.  Repeated
    rows and null ids are scored like any other; only doc_id and text are read.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= model.config.threshold).cast("int"))
