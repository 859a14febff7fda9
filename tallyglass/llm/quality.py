"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Tokens are runs of letters and digits, or runs of other visible characters. A text's features are
its hashed tokens and token pairs, weighted by the square root of their counts and scaled to unit
length; equal tokens next to each other, or with one between them, are a feature of their own. A
score is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import fold, map_batches

BITS = 18
#: The classifier is fitted on at most this many labelled rows.
TRAIN_ROWS = 5000
THRESHOLD = 0.3
#: Hashes of tokens kept in a worker before its cache starts anew.
CACHED_TOKENS = 500_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME_PAIR, _SAME_NEXT_BUT_ONE = np.uint32(0x51ED270B), np.uint32(0xA3B19C55)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_TOKENS:
            self.clear()
        h = zlib.crc32(token.encode())
        if len(token) <= 48:
            self[token] = h
        return h


_hashes = _Hashes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (ascending) and values of a whole text; none for a text without tokens."""
    found = _TOKEN.findall(text or "")
    h = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint32, count=len(found))
    mixed = h * np.uint32(0x9E3779B1)
    pairs = (mixed[:-1] ^ (h[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE35)
    pairs[h[:-1] == h[1:]] = _SAME_PAIR
    echoes = np.full(int((h[:-2] == h[2:]).sum()), _SAME_NEXT_BUT_ONE)
    at, count = np.unique(np.concatenate([mixed, pairs, echoes]) >> np.uint32(32 - BITS), return_counts=True)
    value = np.sqrt(count.astype(np.float64))
    return at, value / np.sqrt((value * value).sum()) if len(at) else value


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, value = features(text)
        z = self.bias + float((self.weights[at] * value).sum())
        return float(1 / (1 + np.exp(-min(max(z, -35.0), 35.0))))


def train(
    samples: list[tuple[np.ndarray, np.ndarray, int]],
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, rounds: int = 4,
) -> Model:
    """FTRL-proximal over (features, values, label), in the order given, with a bias of its own."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(own) <= l1] = 0
        return w

    bias = np.array([1 << BITS])
    for _ in range(rounds):
        for at, value, label in samples:
            at, value = np.concatenate([at.astype(np.int64), bias]), np.append(value, 0.3)
            w = weights(at)
            p = 1 / (1 + np.exp(-min(max(float((w * value).sum()), -35.0), 35.0)))
            g = (p - label) * value
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]) * 0.3)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold.

    Rows are chosen by a hash of the id; at most TRAIN_ROWS ids are broadcast and as many feature
    vectors reach the driver. Rows with a NULL id or label teach nothing; without labels every score is 0.5.
    """
    ids = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(doc_id)) != 0))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .withColumn("h", F.xxhash64("doc_id", F.lit(13)))
        .orderBy("h", "doc_id")
        .limit(TRAIN_ROWS)
    )
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(2).to_pylist()]
            cols = (
                batch.column(0), batch.column(1),
                pa.array([a.astype("<u4").tobytes() for a, _ in made], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary()),
            )
            yield pa.RecordBatch.from_arrays(list(cols), ["h", "label", "at", "value"])

    sampled = map_batches(chosen.select("h", "label", "text"), to_features, "h long, label int, at binary, value binary")
    rows = sampled.orderBy("h", "label", "at", "value").limit(TRAIN_ROWS).collect()  # bounded
    return train([(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["value"], "<f4"), r["label"]) for r in rows])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the text alone decides.

    NULL and empty texts get the score of a text without features (the bias alone); repeated rows
    get the same score; an empty table gives no rows; long texts are read whole. Only doc_id and
    text are read, so other columns cannot clash.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "score"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = map_batches(src, predict, f"doc_id {dict(src.dtypes)['doc_id']}, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
