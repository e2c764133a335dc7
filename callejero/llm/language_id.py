"""Operator 1: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from a hash of its code point). A letter n-gram is bound by
multiplying the letters' vectors, each permuted (rotated) by its place; a document is the sum of its
n-grams' vectors, a language the sum of its training documents', each scaled to length 1. A document gets
the language of the greatest cosine. Texts are lower-cased letters with one blank for anything between.

The prototypes are learnt from about `max_train` labelled documents at most, picked by the hash of doc_id,
by one sum per task and language; there are no more languages than training documents, and their vectors
are broadcast.
Every whole text is scored. A task keeps bound vectors of the n-grams it has met, up to `CACHE`, and then
starts anew.

Null texts and texts without letters get `und` and score 0; so do all if nothing can be learnt. The score
is the cosine cut to 0 to 1. Ties go to the first language by code point. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table
from ._tokens import _mix_one, mix, slices

DIM, N = 1024, 3
#: Unit vectors are rounded to multiples of 1 / SCALE, so that sums do not depend on their order.
SCALE = 1 << 20
#: Most labelled documents learnt from, most n-grams whose vectors a task keeps.
MAX_TRAIN, CACHE = 20_000, 40_000

_fold: np.ndarray | None = None


def folded() -> np.ndarray:
    """Code point -> lower-case letter, or blank for all that is no letter."""
    global _fold
    if _fold is None:
        table_ = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table_[c] = ord(low) if len(low) == 1 else c
        _fold = table_
    return _fold


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts with single blanks between words, and each one's text."""
    joined = "\n".join([t.decode("utf-8", "replace").replace("\n", " ") for t in texts]) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    owner = np.cumsum(raw == 10)
    owner[raw == 10] -= 1
    code = folded()[raw]
    blank = code == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[1:] &= ~(blank[1:] & (owner[1:] != owner[:-1]))
    return code[keep], owner[keep]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (21 bits a letter) of all texts and the text of each; n-grams of a blank alone are none."""
    code, owner = letters(texts)
    code = np.concatenate(([32] * (N - 1), code)).astype(np.uint64)
    owner = np.concatenate((np.full(N - 1, -1), owner))
    n = len(code) - N + 1
    packed = np.zeros(n, np.uint64)
    for k in range(N):
        same = owner[k : k + n] == owner[N - 1 :]
        packed = (packed << np.uint64(21)) | np.where(same, code[k : k + n], 32).astype(np.uint64)
    blank = np.uint64(32 | 32 << 21 | 32 << 42)
    has = packed != blank
    return packed[has], owner[N - 1 :][has]


_letter: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    if code not in _letter:
        if len(_letter) > CACHE:
            _letter.clear()
        bits = mix(np.arange(DIM // 64, dtype=np.uint64) + np.uint64(_mix_one(code) >> 8)).view(np.uint8)
        _letter[code] = (np.unpackbits(bits).astype(np.int8) * 2 - 1).astype(np.float32)
    return _letter[code]


def gram_vector(packed: int) -> np.ndarray:
    """The letters' vectors, rotated by their distance from the end, multiplied."""
    out = np.ones(DIM, np.float32)
    for k in range(N):
        out *= np.roll(letter_vector((packed >> (21 * k)) & 0x1FFFFF), k)
    return out


class Encoder:
    """Vectors of texts; keeps the vectors of the n-grams met."""

    def __init__(self):
        self.known = np.empty(0, np.uint64)
        self.row = np.empty(0, np.int64)
        self.matrix = np.empty((0, DIM), np.float32)

    def _learn(self, packed: np.ndarray) -> None:
        if len(self.known) + len(packed) > CACHE:
            self.__init__()
        self.matrix = np.concatenate((self.matrix, np.array([gram_vector(p) for p in packed.tolist()], np.float32).reshape(-1, DIM)))
        known = np.concatenate((self.known, packed))
        row = np.concatenate((self.row, np.arange(len(self.row), len(known))))
        order = np.argsort(known)
        self.known, self.row = known[order], row[order]

    def _find(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, packed), max(len(self.known) - 1, 0))
        return at, (self.known[at] == packed if len(self.known) else np.zeros(len(packed), bool))

    def encode(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), DIM), np.float32)
        packed, owner = grams(texts)
        if not len(packed):
            return out
        # Count each text's n-grams first: one key per (text, n-gram).
        distinct, which = np.unique(packed, return_inverse=True)
        found = self._find(distinct)[1]
        for lost in np.array_split(distinct[~found], max(1, -(-int((~found).sum()) // (CACHE // 2)))):
            self._learn(lost)
        at, found = self._find(distinct)
        n = len(distinct)
        step = max(1, 4_000_000 // n)
        for lo in range(0, len(texts), step):
            hi = min(len(texts), lo + step)
            a, b = np.searchsorted(owner, [lo, hi])
            counts = np.bincount((owner[a:b] - lo) * n + which[a:b], minlength=(hi - lo) * n).reshape(hi - lo, n).astype(np.float32)
            out[lo:hi] = counts[:, found] @ self.matrix[self.row[at[found]]]
            for j in np.flatnonzero(~found).tolist():  # more n-grams than are kept
                out[lo:hi] += counts[:, j : j + 1] * gram_vector(int(distinct[j]))
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, sums = Encoder(), {}
    for part, texts in slices(batches):
        vectors = _unit(encoder.encode(texts))
        for lang, v in zip(part.column("lang").to_pylist(), vectors, strict=True):
            sums[lang] = sums.get(lang, 0) + np.round(v * SCALE).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])


def learn(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from about max_train labelled documents (doc_id, text, lang) at most."""
    rows = docs.where("lang is not null")
    n = rows.select("doc_id").count()
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_train / max(n, 1))))
    by_task = sample.select("text", "lang").mapInArrow(_bundle, "lang string, v array<bigint>")
    sums = by_task.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = stored(sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")))
    # At most one language a training document; the vectors travel as flat arrays.
    found = vectors.select("lang", F.transform("v", lambda p: p["x"]).alias("v")).toArrow().sort_by("lang")
    prototypes = np.asarray(found.column("v").combine_chunks().flatten(), np.float64).reshape(-1, DIM)
    return found.column("lang").to_pylist(), _unit(prototypes)


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = model.value
        encoder = Encoder()
        for part, texts in slices(batches):
            vectors = encoder.encode(texts)
            found, score = ["und"] * len(texts), np.zeros(len(texts))
            if langs:
                cosines = np.round(_unit(vectors.astype(np.float64)) @ prototypes.T, 6)
                best = cosines.argmax(axis=1)
                some = vectors.any(axis=1)
                found = [langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = learn(docs.where(~held_out))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
