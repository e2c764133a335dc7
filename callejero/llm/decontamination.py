"""Operator 2: benchmark decontamination by a broadcast hash set of n-grams.

Words are lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII. Each test item
gives its windows of `size` words (a shorter item gives itself). The hash set of one block of items, of at
most `block_bytes` of test text, is broadcast; every document is scanned for all block windows by rolling
hashes, and hits are verified word by word. A larger benchmark is scanned block after block, the hits so
far riding along with the document in a written table, so memory is bounded and no text is shuffled.

Null or empty texts have no words and no hits; items without words have no windows; items with equal
windows are all reported, and items without an id count as one. An empty benchmark leaves all documents clean. Extra columns pass through; the
operator's own columns are `_hits` (struct of n_words, n_hit, items, spans), which replaces one of that
name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import apart, stored, table
from ._tokens import ALNUM, covered, slices, windows, words

#: Most bytes of test text in one broadcast hash set.
BLOCK_BYTES = 8 << 20

_HITS = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<bigint>>"
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])


class WindowIndex(NamedTuple):
    """Windows of one length: sorted hashes, and of each its words in the byte pool and its item's number."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    item: np.ndarray


class Block(NamedTuple):
    """The windows of one block of items: the items' words joined by blanks, item ids, and an index for each length."""

    pool: bytes
    items: list[str | None]
    lengths: dict[int, WindowIndex]


def window_index(items: list[tuple[str | None, bytes]], size: int) -> Block:
    """The index of every window of the items, in flat arrays: about 28 bytes a window beside the text."""
    parts: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
    pools, ids, used = [], [], 0
    for item, text in items:
        w = words([text], ALNUM, lower=True)
        n = min(size, len(w.hash))
        if not n:
            continue
        at, found = windows(w, n)
        begin = used + np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
        parts[n].append((found, begin[at], begin[at + n] - 1, np.full(len(at), len(ids))))
        pools.append(b" ".join(w.word(k) for k in range(len(w.hash))) + b" ")
        ids.append(item)
        used += len(pools[-1])
    lengths = {}
    for n, own in parts.items():
        found, start, end, item = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(found, kind="stable")
        lengths[n] = WindowIndex(found[order], start[order].astype(np.uint32), end[order].astype(np.uint32), item[order].astype(np.uint32))
    return Block(b"".join(pools), ids, lengths)


def _in_order(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def _scan(blocks, keep: list[str]):
    """A function over record batches that adds the hits of a broadcast block to those before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks.value
        tables = {}
        for n, index in block.lengths.items():
            seen = np.zeros(1 << 20, bool)
            seen[index.hashes >> np.uint64(44)] = True
            tables[n] = seen
        for part, texts in slices(batches):
            w = words(texts, ALNUM, lower=True)
            spans, items = defaultdict(list), defaultdict(set)
            for n, seen in tables.items():
                index = block.lengths[n]
                at, found = windows(w, n)
                maybe = np.flatnonzero(seen[found >> np.uint64(44)])
                lo, hi = (np.searchsorted(index.hashes, found[maybe], side) for side in ("left", "right"))
                for k, first, last in zip(*(x[lo < hi].tolist() for x in (maybe, lo, hi)), strict=True):
                    i = int(at[k])
                    here = b" ".join(w.word(j) for j in range(i, i + n))
                    hit = {block.items[index.item[m]] for m in range(first, last) if block.pool[index.start[m] : index.end[m]] == here}
                    if hit:
                        doc = int(w.text[i])
                        items[doc].update(hit)
                        spans[doc].append((i - int(w.first[doc]), n))
            before = part.column("_hits").to_pylist() if "_hits" in part.schema.names else [None] * part.num_rows
            count = np.diff(w.first)
            hits = []
            for d, old in enumerate(before):
                if old:
                    items[d].update(old["items"])
                    spans[d].extend(zip(old["spans"][0::2], old["spans"][1::2], strict=True))
                n = int(count[d])
                own = sorted(set(spans[d])) if d in spans else []
                inside = covered(n, np.array([s for s, _ in own], int), np.array([k for _, k in own], int)) if own else np.zeros(0, bool)
                hits.append({"n_words": n, "n_hit": int(inside.sum()), "items": _in_order(items[d]) if d in items else [], "spans": [x for s in own for x in s]})
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(hits, _HITS_ARROW)], names=[*keep, "_hits"])

    return scan


def find_hits(docs: DataFrame, items: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with `_hits`: words, hit words, items with a window in the text, and (first word, length) of hits."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != "_hits"]
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-total // block_bytes))
    found = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + f", `_hits` {_HITS}"
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        index = spark.sparkContext.broadcast(window_index([(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()], size))
        found = found.mapInArrow(_scan(index, keep), schema)
        if block + 1 < n_blocks:  # the next block's scan starts from a table, and this block's index can go
            found = stored(found)
            index.unpersist()
    return found


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, min_hit: int = 1) -> DataFrame:
    """docs without those that have at least min_hit words inside a test window."""
    docs, back = apart(docs, "_hits")
    return find_hits(docs, items, size).where(F.col("_hits.n_hit") < min_hit).select(*back)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        F.col("_hits.n_hit").alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_hits.items"), ","), 256).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, lengths WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, d.k, d.i, t.item_id FROM doc_windows d JOIN item_windows t ON d.g = t.g AND d.k = t.k),
hit_words AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS at FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words h ON w.doc_id = h.doc_id LEFT JOIN hit_items t ON w.doc_id = t.doc_id
"""
