"""Operator 6: removal of repeated passages by fixed-block anchors.

A window is `size` consecutive words of one text; every word in a window that also starts elsewhere, in the
same text or another, is removed. Windows are judged on the input, not on what is left.

Every window holds one whole reference block, the non-overlapping blocks of (size + 1) // 2 words counted
from the text's begin. So a repeated window shows as a rolling run of block length that equals some text's
reference block and occurs twice or more. (1) The blocks are indexed and probed with every rolling run of
every text. (2) Each hit is extended to the windows around it, and the windows that occur twice or more
are the repeats; their union is the maximal exact repeats of at least `size` words. Nothing is paired, so
a passage that a third of all texts share costs no more than another.

Texts are dealt by hash to chunks of about `chunk_bytes`, and a chunk sends the distinct hashes it holds,
packed by bucket of the hash, together with which of them it holds twice. A frequent run thus travels once
a chunk. Chunks and buckets are sized by the corpus; a task holds one chunk or one bucket. Hashes of
windows have 64 bits: among n windows that contain a hit, a false repeat has a chance of n * n / 2**65.

Null texts have no words. Repeated rows repeat their windows. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._tokens import NOT_SPACE, Words, covered, windows, words

CHUNK, BUCKET = 2 << 20, 32 << 20


def _texts(rows: pa.Table) -> tuple[pa.Table, Words]:
    """A chunk's rows in an order that does not depend on the shuffle, and their words."""
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    texts = pc.fill_null(rows.column("text").cast(pa.binary()), b"").to_pylist()
    return rows, words(texts, NOT_SPACE)


def _runs(w: Words, block: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling runs of block words in the texts that have a window."""
    at, h = windows(w, block)
    long = np.diff(w.first)[w.text[at]] >= size
    return at[long], h[long]


def _lists(values: np.ndarray, bucket: np.ndarray, buckets: int, kind: pa.DataType) -> pa.ListArray:
    """values, ordered by bucket, as one list a bucket."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(bucket, np.arange(buckets + 1)), pa.int32()), pa.array(values, kind))


def _bits(buckets: int) -> np.uint64:
    return np.uint64(64 - (buckets.bit_length() - 1))


def _packed(chunk: int, groups: list[np.ndarray], buckets: int, short: bool) -> pa.Table:
    """One row a bucket with the parts of each sorted array of hashes that fall into it."""
    arrays = []
    for h in groups:
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if short else h.view(np.int64)
        arrays.append(_lists(low, (h >> _bits(buckets)).astype(np.int64) if buckets > 1 else np.zeros(len(h), int), buckets, pa.int32() if short else pa.int64()))
    names = ["probes", "twice", "blocks"][: len(groups)]
    packed = pa.table([pa.array(np.arange(buckets), pa.int32()), pa.array(np.full(buckets, chunk), pa.int32()), *arrays], names=["bucket", "chunk", *names])
    return packed.filter(pc.greater(pc.list_value_length(packed.column("probes")), 0))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    column = column.combine_chunks()
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def _often(probes: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Values that occur at least twice: in two chunks, or twice in one."""
    distinct, n = np.unique(probes, return_counts=True)
    return np.union1d(distinct[n > 1], twice)


def _answer(rows: pa.Table, often: np.ndarray) -> pa.Table:
    """What a bucket tells each chunk: those of its hashes that are in often."""
    probes, row = _flat(rows.column("probes"))
    hit = np.isin(probes, often)
    hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[hit], np.arange(rows.num_rows + 1)), pa.int32()), pa.array(probes[hit]))
    told = pa.table([rows.column("chunk"), rows.column("bucket"), hits], names=["chunk", "bucket", "hits"])
    return told.filter(pc.greater(pc.list_value_length(told.column("hits")), 0))


def _told(answers: pa.Table, short: bool, buckets: int) -> np.ndarray:
    """The hashes that a chunk's answers name; of short ones the bucket's bits and the low 32."""
    values, row = _flat(answers.column("hits"))
    if not short:
        return values.astype(np.int64).view(np.uint64)
    bucket = answers.column("bucket").to_numpy()[row].astype(np.uint64) if len(row) else np.empty(0, np.uint64)
    return (bucket << np.uint64(32)) | values.astype(np.int32).view(np.uint32).astype(np.uint64)


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    bucket = h >> _bits(buckets) if buckets > 1 else np.zeros(len(h), np.uint64)
    return (bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def remove_repeats(docs: DataFrame, size: int = 35, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words joined by one blank) for every row of docs."""
    block = (size + 1) // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, -(-total // chunk_bytes))
    buckets = 1 << max(6, (total // bucket_bytes).bit_length())
    texts = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def send_runs(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py()
        _, w = _texts(rows)
        at, h = _runs(w, block, size)
        distinct, n = np.unique(h, return_counts=True)
        own = np.unique(h[(at - w.first[w.text[at]]) % block == 0])
        return _packed(chunk, [distinct, distinct[n > 1], own], buckets, True)

    def match_blocks(rows: pa.Table) -> pa.Table:
        probes, twice, blocks = (_flat(rows.column(c))[0] for c in ("probes", "twice", "blocks"))
        return _answer(rows, np.intersect1d(_often(probes, twice), blocks))

    def send_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _packed(0, [np.empty(0, np.uint64)] * 2, buckets, False)
        _, w = _texts(rows)
        at, h = _runs(w, block, size)
        anchors = at[np.isin(_short(h, buckets), _told(answers, True, buckets))]
        start, full = windows(w, size)
        near = np.zeros(len(w.hash) + 1, bool)
        near[anchors] = True
        upto = np.concatenate(([0], np.cumsum(near)))
        held = upto[start + size - block + 1] > upto[start]  # windows with an anchor inside
        distinct, n = np.unique(full[held], return_counts=True)
        return _packed(rows.column("chunk")[0].as_py(), [distinct, distinct[n > 1]], buckets, False)

    def match_windows(rows: pa.Table) -> pa.Table:
        probes, twice = (_flat(rows.column(c))[0] for c in ("probes", "twice"))
        return _answer(rows, _often(probes, twice))

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        rows, w = _texts(rows)
        gone = np.zeros(len(w.hash), bool)
        if answers.num_rows:
            start, full = windows(w, size)
            gone = covered(len(w.hash), start[np.isin(full, _told(answers, False, buckets))], size)
        n = np.diff(w.first)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first])
        kept = [b" ".join([w.word(i) for i in (np.flatnonzero(~gone[a:b]) + a).tolist()]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string())})

    answer = "chunk int, bucket int, hits array<{}>"
    runs = texts.groupBy("chunk").applyInArrow(send_runs, "bucket int, chunk int, probes array<int>, twice array<int>, blocks array<int>")
    hits = runs.groupBy("bucket").applyInArrow(match_blocks, answer.format("int"))
    found = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, "bucket int, chunk int, probes array<bigint>, twice array<bigint>")
    repeats = found.groupBy("bucket").applyInArrow(match_windows, answer.format("bigint"))
    return texts.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT row, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT row, w, unnest(generate_series(1, len(w) - 34)) AS i FROM split WHERE len(w) >= 35)),
twice AS (SELECT row, i FROM wins WHERE g IN (SELECT g FROM wins GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT row, unnest(generate_series(i, i + 34)) AS at FROM twice),
each AS (SELECT row, unnest(w) AS word, unnest(generate_series(1, len(w))) AS at FROM split WHERE len(w) > 0),
kept AS (
  SELECT e.row, string_agg(e.word, ' ' ORDER BY e.at) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON e.row = g.row AND e.at = g.at
  WHERE g.at IS NULL GROUP BY e.row)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(len(s.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.row = k.row
"""
