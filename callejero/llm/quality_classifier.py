"""Operator 10: quality score by logistic regression on hashed word n-grams, trained by FTRL-proximal.

Tokens are lower-cased runs of letters and digits, or runs of other signs. Features are hashed tokens,
hashed pairs of neighbours and one for a token that repeats its neighbour; a text's features are the square
roots of their counts, scaled to length 1. A score is the sigmoid of a sparse dot product.

Training takes about `max_train` labelled rows at most (picked by the hash of doc_id), deals them by hash
to `shards`, runs follow-the-regularised-leader updates in each shard over `epochs` passes in the order of
the hash, and averages the shards' weights. The weights (2**BITS numbers) are broadcast; every whole text
is scored in one pass over the documents.

Null and empty texts have the bias alone. Without labels all scores are 0.5. Repeated label rows for one
doc_id count repeatedly. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table, with_broadcast_if_small
from ._tokens import _BYTE, _LOWER, _PRIME, Sums, mix, slices

BITS = 18
MAX_TRAIN, SHARDS, EPOCHS = 20_000, 4, 10
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.0002, 0.00002

_KIND = np.array([0 if b in b" \t\n\v\f\r" else 1 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 2 for b in range(256)], np.int8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, and where each text's begin (and the end). Number 0 is the bias."""
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    kind = _KIND[buf]
    change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    start = change[kind[change] > 0]
    after = np.append(change[1:], len(buf))
    end = after[kind[change] > 0]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(begin, start, "right") - 1
    token = Sums(_BYTE[buf], _PRIME).range(start, end)
    pair = mix(token[:-1] * np.uint64(3) + token[1:])
    pair[token[:-1] == token[1:]] = 1
    inside = owner[:-1] == owner[1:]
    n = np.arange(len(texts))
    number = np.concatenate([token, pair[inside], np.zeros(len(n), np.uint64)]) >> np.uint64(64 - BITS)
    number = np.maximum(number.astype(np.int64), 1)
    number[len(number) - len(n) :] = 0
    who = np.concatenate([owner, owner[:-1][inside], n])
    key, count = np.unique((who.astype(np.int64) << BITS) | number, return_counts=True)
    who = key >> BITS
    first = np.searchsorted(who, np.arange(len(texts) + 1))
    value = np.sqrt(count)
    value = value / np.sqrt(np.add.reduceat(value * value, first[:-1]))[who]
    number = key & ((1 << BITS) - 1)
    value[number == 0] = 1.0
    return number, value, first


class Ftrl:
    """Follow-the-regularised-leader state of a logistic regression."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("_h", "ascending"), ("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")]).combine_chunks()
    model = Ftrl()
    parts = [(features(texts), part.column("label").to_pylist()) for part, texts in slices(iter(rows.to_batches()))]
    for _ in range(EPOCHS):
        for (at, x, first), labels in parts:
            for d, label in enumerate(labels):
                model.update(at[first[d] : first[d + 1]], x[first[d] : first[d + 1]], label)
    return pa.table({"weights": pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()), "n": [rows.num_rows]})


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, shards: int = SHARDS) -> np.ndarray:
    """Weights from documents (doc_id, text) and labels (doc_id, label 0 or 1)."""
    labels = labels.where("label is not null and doc_id is not null")
    n = labels.count()
    h = F.xxhash64("doc_id")
    sample = labels.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_train / max(n, 1)))).select("doc_id", F.col("label").cast("int").alias("label"))
    sample = with_broadcast_if_small(stored(sample))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "label", h.alias("_h"))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_h"), F.lit(shards)))
    models = rows.groupBy("_shard").applyInArrow(_train, "weights binary, n long").collect()
    total = sum(m["n"] for m in models)
    weights = np.zeros(1 << BITS, np.float64)
    for m in sorted(models, key=lambda m: (m["n"], m["weights"])):
        weights += np.frombuffer(m["weights"], np.float32) * (m["n"] / total)
    return weights.astype(np.float32)


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for part, texts in slices(batches):
            at, x, first = features(texts)
            dot = np.add.reduceat(weights[at] * x, first[:-1])
            scores = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
