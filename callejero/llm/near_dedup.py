"""Operator 9: near-duplicate components by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the distinct shingles of `width` words (the whole sequence if it is shorter). Equal
sets are one class. One permutation scatters a set's shingles over 2**32 places; a second one, shifted by
1, 2, 3, ... places, gives all signature coordinates: coordinate k is the least second(first(s) + k).
Bands of `rows` coordinates are keys of buckets. At similarity 0.8 two sets miss all 48 bands of 6 with a
chance of 5e-7.

Links are found without writing all pairs of a bucket. First every bucket compares its members with one
leader only, the one that meets most others in all its buckets; pairs are confirmed on the full sets of shingle hashes, and two star rounds contract what is
linked. Members of a bucket that are in one component by then need no further test. Members of buckets
that still hold several components are compared across components by an exact prefix-filtered join, which
leaves out pairs that cannot link; a shingle that many of them share is split by the size of their sets.
Components grow by alternating large-star and small-star steps, each written to the shared folder. Classes
are named by the row number of their least document, so joins and stars move 8-byte keys; sets are cut once,
for the classes of shared buckets only. Scratch tables are deleted when the last step is written.

Documents without words, or null ones, have an empty set and link with nothing. Repeated rows and equal
texts share a class. Null ids count as the largest; ids need not be unique, a document is told by a 128-bit
hash of its id and text. The kept document of a component is the least by id, then class. Repeated rows of
one id and text are one document; which of them `deduplicate` keeps is left open. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, apart, stored, table
from ._tokens import NOT_SPACE, mix, slices, windows, words

BANDS, ROWS = 48, 6

_STEP = np.uint32(0x9E3779B1)


def _second(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit integers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_minhash(shingles: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n coordinates (rows) of each set; set i is shingles[begin[i]:begin[i + 1]], none empty."""
    first = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(begin) - 1), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat(_second(first + np.uint32(k)), begin[:-1])
    return out


def sets_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (and the end)."""
    w = words(texts, NOT_SPACE, lower=True)
    at, found = windows(w, width)
    owner = w.text[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):  # the whole sequence is the one shingle
        whole = [windows(words([texts[d]], NOT_SPACE, lower=True), int(n[d]))[1][0] for d in short.tolist()]
        owner = np.concatenate([owner, short])
        found = np.concatenate([found, mix(np.array(whole, np.uint64))])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found = owner[fresh], found[fresh]
    return found, np.searchsorted(owner, np.arange(len(texts) + 1))


def class_keys(found: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """128-bit keys of the sets: two sums of mixed shingle hashes; b"" for an empty set."""
    sums = np.zeros((len(found) + 1, 2), np.uint64)
    np.cumsum(mix(found), out=sums[1:, 0])
    np.cumsum(mix(found ^ np.uint64(0xD6E8FEB86659FD93)), out=sums[1:, 1])
    keys = np.ascontiguousarray(sums[begin[1:]] - sums[begin[:-1]]).tobytes()
    return [keys[16 * i : 16 * i + 16] if begin[i + 1] > begin[i] else b"" for i in range(len(begin) - 1)]


def _sign(width: int, bands: int, rows: int, keep: list[str]):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found, begin = sets_of(texts, width)
            size = np.diff(begin)
            full = np.flatnonzero(size)
            keys: list[list[int] | None] = [None] * len(texts)
            if len(full):
                edges = np.append(begin[full], len(found))
                coordinates = circulant_minhash(found, edges, bands * rows).astype(np.uint64)
                band = np.empty((bands, len(full)), np.uint64)
                for b in range(bands):
                    h = np.full(len(full), b, np.uint64)
                    for r in range(rows):
                        h = mix(h ^ coordinates[b * rows + r])
                    band[b] = h
                for i, row in zip(full.tolist(), band.T.view(np.int64), strict=True):
                    keys[i] = row.tolist()
            arrays = [pa.array(class_keys(found, begin), pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *arrays], names=[*keep, "_class", "_size", "_bands"])

    return sign


def _shingle(width: int):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found, begin = sets_of(texts, width)
            sets = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("_c"), sets], names=["_c", "_set"])

    return shingle


def _similar(percent: int):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (a, b) whose sets `_left` and `_right` are similar enough."""
        for batch in batches:
            left, right = batch.column("_left"), batch.column("_right")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return similar


def _may_link(m: Column, n: Column, percent: int) -> Column:
    """Whether sets of m and n shingles can be that similar."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes that are similar enough on their full sets."""
    both = pairs.join(sets.select(F.col("_c").alias("a"), F.col("_set").alias("_left")), "a")
    both = both.join(sets.select(F.col("_c").alias("b"), F.col("_set").alias("_right")), "b")
    return both.select("a", "b", "_left", "_right").mapInArrow(_similar(percent), "a long, b long")


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b); the outcome has a > b."""
    # Large star: each node passes its larger neighbours on to its least neighbour.
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # Small star: each node passes its smaller neighbours, and itself, on to the least.
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    passed = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.union(least).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the least node of each connected component, for the nodes of links (a, b)."""
    edges, before = links, None
    while True:
        seen = Observation()
        told = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))]
        edges = scratch.stored(_star(edges).observe(seen, *[c.alias(f"_{i}") for i, c in enumerate(told)]))
        if seen.get == before:
            break
        before = seen.get
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _key() -> Column:
    """128 bits that tell a document by its id (null or not) and text (null or not)."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return _judged(docs, width, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicates with `_key` of the row, and `_one`: whether the row is its component's one document."""
    docs = docs.select("doc_id", "text").withColumn("_key", _key())
    schema = "doc_id long, _key binary, _class binary, _size long, _bands array<long>"
    signed = docs.mapInArrow(_sign(width, bands, rows, ["doc_id", "_key"]), schema)
    signed = stored(signed.withColumn("_row", F.monotonically_increasing_id()))
    with Scratch(docs.sparkSession) as scratch:
        one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "_row")).alias("_one")
        classes = signed.where("_size > 0").groupBy("_class").agg(one, F.first("_size").alias("_size"), F.first("_bands").alias("_bands"))
        classes = scratch.stored(classes.select(F.col("_one._row").alias("_c"), "_class", F.col("_one.doc_id").alias("_doc"), "_one._key", "_size", "_bands"))
        entries = classes.select(F.explode("_bands").alias("_bucket"), "_c", "_size")
        crowd = entries.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1")
        entries = scratch.stored(entries.join(crowd, "_bucket"))
        central = entries.groupBy("_c").agg(F.sum("_n").alias("_met"))
        best = F.max(F.struct("_met", (-F.col("_c")).alias("_minus"), "_size")).alias("_best")
        leads = entries.join(central, "_c").groupBy("_bucket").agg(best)
        leads = leads.select("_bucket", (-F.col("_best._minus")).alias("_lead"), F.col("_best._size").alias("_other"))
        shared = entries.select("_c").distinct().join(classes.select("_c", "_key"), "_c")
        texts = docs.join(shared, "_key").select("_c", "text")
        sets = scratch.stored(texts.mapInArrow(_shingle(width), "_c long, _set array<long>").dropDuplicates(["_c"]))

        led = entries.join(leads, "_bucket").where((F.col("_c") != F.col("_lead")) & _may_link(F.col("_size"), F.col("_other"), percent))
        pairs = led.select(F.col("_c").alias("a"), F.col("_lead").alias("b")).distinct()
        edges = scratch.stored(_star(scratch.stored(_star(_confirmed(pairs, sets, percent)))))
        open_ = scratch.stored(_open(entries, edges))
        pairs = _prefix_pairs(scratch.stored(_prefixes(open_, sets, percent)), percent)
        found = scratch.stored(_confirmed(pairs, sets, percent))
        root = components(edges.select("a", "b").union(found.select("a", "b")), scratch)

        named = classes.select("_c", "_class", "_doc", "_key").join(root.withColumnRenamed("node", "_c"), "_c", "left")
        named = named.withColumn("root", F.coalesce("root", "_c"))
        least = named.groupBy("root").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "_class", "_key")).alias("_least"))
        named = stored(named.select("_class", "root").join(least, "root").select("_class", "_least"))
    result = signed.select("doc_id", F.col("_size").alias("n_shingles"), "_class", "_key").join(named, "_class", "left")
    empty = F.col("n_shingles") == 0
    kept = empty | (F.col("doc_id").eqNullSafe(F.col("_least._doc")) & (F.col("_class") == F.col("_least._class")))
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("_least._doc"))
    one = kept & (empty | (F.col("_key") == F.col("_least._key")))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "_key", one.alias("_one"))


def _open(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """_c, _size, _root of the classes of buckets that still hold more than one component of edges (a, b)."""
    root = edges.groupBy(F.col("a").alias("_c")).agg(F.min("b").alias("_root"))
    named = entries.select("_bucket", "_c", "_size").join(root, "_c", "left").withColumn("_root", F.coalesce("_root", "_c"))
    mixed = named.groupBy("_bucket").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo != _hi").select("_bucket")
    return named.join(mixed, "_bucket", "left_semi").select("_c", "_size", "_root").distinct()


def _prefixes(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The shingles (_h) of each class that are among its first, ranked by how few classes hold them."""
    held = sets.join(classes, "_c").select("_c", "_size", "_root", F.explode("_set").alias("_h"))
    common = held.groupBy("_h").agg(F.count("*").alias("_df"))
    rank = F.row_number().over(Window.partitionBy("_c").orderBy("_df", "_h"))
    ranked = held.join(common, "_h").withColumn("_rank", rank)
    return ranked.where((100 * F.col("_rank") <= (100 - percent) * F.col("_size") + 100) & (F.col("_df") > 1))


def _prefix_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of classes in different components that can be similar enough, by prefix filtering.

    Sets of m and n shingles that overlap in at least k have their first common shingle among the first
    m - k + 1 of the one and n - k + 1 of the other. Sizes are cut into steps by the factor within which sets
    can link, so that a shingle's classes meet only those of their own or the next step.
    """
    step = F.floor(F.log("_size") / (math.log(100 / percent) + 1e-9)) if percent < 100 else F.col("_size")
    prefix = prefix.withColumn("_step", step)
    a = prefix.select("_h", "_step", F.col("_c").alias("a"), F.col("_size").alias("_m"), F.col("_root").alias("_r"), F.col("_rank").alias("_i"))
    b = prefix.select("_h", F.explode(F.array(F.col("_step"), F.col("_step") - 1)).alias("_step"), F.col("_c").alias("b"), F.col("_size").alias("_n"), F.col("_root").alias("_s"), F.col("_rank").alias("_j"))
    least = F.ceil(percent * (F.col("_m") + F.col("_n")) / (100 + percent) - 1e-9)
    fits = (F.col("_i") <= F.col("_m") - least + 1) & (F.col("_j") <= F.col("_n") - least + 1) & (least <= F.col("_m"))
    smaller = (F.col("_m") < F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("a") < F.col("b")))
    met = a.join(b, (a["_h"] == b["_h"]) & (a["_step"] == b["_step"]) & (F.col("_r") != F.col("_s")) & smaller & fits)
    return met.select("a", "b").distinct()


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document (the least doc_id) of each group; repeated rows of it are one."""
    docs, back = apart(docs, "_kept")
    keep = _judged(docs, **options).where("_one").select(F.col("_key").alias("_kept"))
    kept = docs.join(keep, _key() == F.col("_kept"))
    return kept.dropDuplicates(["_kept"]).select(*back)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
