"""Quality classifier by compression: two zstandard dictionaries, from good and from bad text.

A text's only feature is how much smaller the good dictionary makes it than the bad one, by its length; a logistic curve
fitted on labelled texts that built no dictionary turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import documents, text_of

#: Bound of the fit: so many labelled rows, the first by hash of doc_id, with their whole texts.
SAMPLE_ROWS = 8_000
#: Bytes added to a text's length, so that the difference of a very short text is not blown up.
OFFSET = 64
DICTIONARY = 65_536
LEVEL = 3
CUT = 0.7


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the calibration, a logistic curve of the size difference. Without dictionaries: a constant."""

    good: bytes
    bad: bytes
    intercept: float
    slope: float = 0.0

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Per text: size with the bad dictionary less size with the good one, by length."""
        squeeze = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (self.good, self.bad)]
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            good, bad = (len(s.compress(raw)) for s in squeeze)
            out[i] = (bad - good) / (len(raw) + OFFSET)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.intercept)
        return _logistic(self.intercept + self.slope * self.differences(texts))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: their text itself is the dictionary
        return b"\n".join(samples)[-DICTIONARY:]


def train(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries from every other row, calibration from the rest. rows: (text, 1 for good or 0 for bad)."""
    share = sum(q for _, q in rows) / len(rows) if rows else 0.5
    build, rest = rows[::2], rows[1::2]
    parts = [[t for t, q in build if q == kind] for kind in (1, 0)]
    y = np.array([q for _, q in rest], float)
    if not all(any(p) for p in parts) or not 0 < y.sum() < len(y):
        return Model(b"", b"", share)
    bare = Model(_dictionary(parts[0]), _dictionary(parts[1]), 0.0)
    x = bare.differences([t for t, _ in rest])
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.stack((np.ones(len(x)), (x - mean) / spread), axis=1)
    w = np.zeros(2)
    for _ in range(50):  # Newton steps of a lightly penalised logistic regression
        p = _logistic(z @ w)
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), z.T @ (p - y) + 0.01 * w)
    return Model(bare.good, bare.bad, float(w[0] - w[1] * mean / spread), float(w[1] / spread))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents: at most `rows` of them, chosen by hash of doc_id, with texts of any length.

    A repeated label counts as the highest. Labels without a doc_id, or neither 0 nor 1, and documents without a label are left out; without labelled
    documents of both kinds every score is the share of good ones (one half if there are none).
    """
    order = F.xxhash64("doc_id")
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = marked.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(order, "doc_id", F.xxhash64("text")).limit(rows)
    return train([(r.text or "", int(r.label)) for r in found.select("text", "label").collect()])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted, in place of columns of those names.

    Null text is scored as empty, a very long one whole; every row gets a score, repeated rows the same. An empty table gives an
    empty result.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))

    out = docs.withColumn("score", score(text_of("text")))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = documents(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
