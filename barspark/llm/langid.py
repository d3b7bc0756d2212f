"""Hierarchical language identification.

A linear classifier over hashed byte n-grams decides the language family; inside
the family, one-versus-one linear support vector machines separate the related
languages.  Models are fitted on a bounded sample of labelled documents and are
small (``dims`` weights per machine), so they travel to the tasks; every whole
text is scored where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import raw
from barspark.llm.textnum import U64, mix64

#: Families of common ISO 639-1 codes.  Other codes form a family of their own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
}
UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    """``per_language`` bounds the labelled rows that the models are fitted on.

    A text is rejected whose likeness to its language falls below ``slack`` times
    the least one met among labelled texts of about its length.
    """

    slack: float = 0.9
    dims: int = 2048
    per_language: int = 600
    steps: int = 150
    penalty: float = 1e-4


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), f"own:{lang}")


def _tables(dims: int) -> list[np.ndarray]:
    """Per n-gram place and byte, the hash part that is combined by exclusive or."""
    fold = np.arange(256)
    fold[(fold < 0x41) | ((fold > 0x5A) & (fold < 0x61)) | ((fold > 0x7A) & (fold < 0x80))] = 0x20  # digits, signs and blanks are all a blank
    fold[0x41:0x5B] += 0x20
    return [(mix64(fold.astype(U64) + U64(1 + 1000 * place)) % U64(dims)).astype(np.uint16) for place in range(3)]


class Features:
    """Square roots of hashed trigram and bigram shares, scaled to length one."""

    def __init__(self, dims: int):
        self.dims, self.tables = dims, _tables(dims)

    def __call__(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        first, second, third = (t[data] for t in self.tables)
        pairs = first[:-1] ^ second[1:]
        counts = np.bincount(pairs, minlength=self.dims) + np.bincount(pairs[:-1] ^ third[2:], minlength=self.dims)
        out = np.sqrt(counts.astype(np.float32))
        norm = float(np.sqrt(counts.sum()))
        return out / norm if norm else out


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int, penalty: float) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated full-batch gradient steps.

    ``y`` is -1 or 1; both classes weigh the same.  The last weight is the bias.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (2 * 2 * share.sum() + penalty)  # rows have squared length 2
    w = v = np.zeros(x.shape[1])
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = penalty * v - 2 * x.T @ (share * y * slack)
        new = v - rate * gradient
        v = new + step / (step + 3) * (new - w)
        w = new
    return w


#: Bytes of text from which the next band of lengths begins.
BANDS = np.array([32, 128, 512, 2048])


@dataclass
class LangModel:
    """``langs`` are those learned; machines map a pair or a family to weights.

    ``centres`` are the languages' mean directions and ``least``, by band of text
    length, the smallest cosine to the own language's among labelled texts.
    """

    config: LangConfig
    langs: list[str]
    families: dict[str, list[str]]
    by_family: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    centres: dict[str, np.ndarray] = field(default_factory=dict)
    least: np.ndarray = field(default_factory=lambda: np.zeros(len(BANDS) + 1))

    def accepts(self, x: np.ndarray, size: int, lang: str) -> bool:
        """Whether a text of ``size`` bytes is as like its language as labelled texts of its length are."""
        return float(x @ self.centres[lang]) >= self.config.slack * self.least[np.searchsorted(BANDS, size, "right")]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        names = list(self.families)
        x = np.append(x, 1.0)
        if len(names) == 1:
            family, sure = names[0], 1.0
        else:
            margins = np.exp(4 * np.clip(self.by_family @ x, -8, 8))
            best = int(margins.argmax())
            family, sure = names[best], float(margins[best] / margins.sum())
        members = self.families[family]
        if len(members) == 1:
            return members[0], sure
        votes = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            p = 1 / (1 + np.exp(-4 * float(np.clip(self.pairs[a, b] @ x, -8, 8))))
            votes[a] += p
            votes[b] += 1 - p
        best = max(members, key=lambda m: (votes[m], m))
        return best, sure * votes[best] / (len(members) - 1)


def fit(rows: list[tuple[str, bytes, int]], config: LangConfig) -> LangModel:
    """Fit the hierarchy on labelled features: (language, packed float32 vector, bytes of text)."""
    langs = sorted({lang for lang, *_ in rows})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    model = LangModel(config, langs, dict(sorted(families.items())))
    if not rows:
        return model
    label = np.array([lang for lang, *_ in rows])
    x = np.stack([np.frombuffer(v, np.float32) for _, v, _ in rows])
    for lang in langs:
        centre = x[label == lang].mean(0)
        model.centres[lang] = centre / (np.linalg.norm(centre) or 1.0)
    like = np.einsum("ij,ij->i", x, np.stack([model.centres[lang] for lang in label]))
    band = np.searchsorted(BANDS, [size for *_, size in rows], "right")
    lowest = np.array([like[band == b].min(initial=1.0) for b in range(len(BANDS) + 1)])
    # longer texts are no less like their language; a band without labelled texts takes what the next longer ones have, the last none
    model.least = np.minimum.accumulate(np.where(lowest == 1.0, np.inf, lowest)[::-1])[::-1]
    model.least[np.isinf(model.least)] = 0.0
    group = np.array([family_of(lang) for lang in label])
    if len(families) > 1:
        model.by_family = np.stack([fit_svm(x, np.where(group == f, 1.0, -1.0), config.steps, config.penalty) for f in model.families])
    for members in model.families.values():
        for a, b in combinations(members, 2):
            own = (label == a) | (label == b)
            model.pairs[a, b] = fit_svm(x[own], np.where(label[own] == a, 1.0, -1.0), config.steps, config.penalty)
    return model


def _vectors(config: LangConfig):
    features = Features(config.dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [len(t) for t in raw(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([features(t).tobytes() for t in raw(batch)], pa.binary()), pa.array(size, pa.int64())], ["lang", "x", "size"])

    return run


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _scores(model: LangModel):
    features = Features(model.config.dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, accepted = [], [], []
            for text in raw(batch):
                known = bool(text) and bool(model.langs) and has_letter(text)
                x = features(text) if known else None
                lang, score = model.predict(x) if known else (UNKNOWN, 0.0)
                langs.append(lang)
                scores.append(min(1.0, max(0.0, score)))
                accepted.append(known and model.accepts(x, len(text), lang))
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "accepted"])

    return run


def train(documents: DataFrame, learn_from: Column, config: LangConfig = LangConfig()) -> LangModel:
    """Fit on at most ``per_language`` documents of each language among ``learn_from``.

    Those with the smallest hashed ids are taken, the same on every run, first
    inside shares of each language, so that no task ranks a whole language.  Null
    texts and null languages teach nothing; without any labelled text the model
    knows no language and names every text ``und``.
    """
    rows = documents.where(learn_from).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null and text <> ''")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    share = Window.partitionBy("lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(64))).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("at", F.row_number().over(share)).where(F.col("at") <= config.per_language)
    chosen = chosen.withColumn("at", F.row_number().over(order)).where(F.col("at") <= config.per_language).select("doc_id").distinct()
    # bounded by per_language times the languages, so it may be broadcast; the cap holds against repeated ids
    picked = rows.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("at", F.row_number().over(order)).where(F.col("at") <= config.per_language)
    vectors = picked.select("lang", "text").mapInArrow(_vectors(config), "lang string, x binary, size long").collect()
    return fit(sorted((r.lang, bytes(r.x), r["size"]) for r in vectors), config)


def predict(documents: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and accepted of every row.

    A null, empty or letterless text is ``und`` with score 0 and not accepted; nor
    is one that is less like its predicted language than labelled texts are.  Repeated rows and
    null ids are scored like any other; only doc_id and text are read.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scores(model), "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(doc_id: Column) -> Column:
    """A third of the documents by checksum of the id; never learned from.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_unidentified(documents: DataFrame, config: LangConfig = LangConfig()) -> DataFrame:
    """Documents that the model accepts as texts of a learned language, with all their columns.

    Texts that are null, empty, without letters or unlike their predicted
    language go.  Where no labelled document is left to learn from, nothing can
    be judged and all rows stay.
    """
    model = train(documents, ~held_out(F.col("doc_id")), config)
    if not model.langs:
        return documents
    accepted = _accepted(model)
    return documents.where(accepted(F.col("text").cast("string")))


def _accepted(model: LangModel):
    """Acceptance of a text column as a vectorised function, so that all other columns stay as they are."""
    features = Features(model.config.dims)

    @F.pandas_udf("boolean")
    def accepted(text):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(value) -> bool:
            data = value.encode("utf-8", "replace") if isinstance(value, str) else b""
            if not data or not has_letter(data):
                return False
            x = features(data)
            return model.accepts(x, len(data), model.predict(x)[0])

        return pd.Series([one(v) for v in text], dtype="bool")

    return accepted
