"""Operator 3: mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the words of the corpus;
no target exceeds `cap` times its source's words, and the excess goes to the others by weight until none is
above. That is target = min(cap * words, weight * level) for the one level at which the targets add up.

Each document of a source is taken target / words times on average: the whole part always, the fraction p
by the pivotal method. Two documents with fractions p and q pass mass between them at random until one is
0 or 1; the other goes on to meet the next. Documents are met in order of size, so mass moves between
documents of like size and the words taken stay near the target. The reduction is a tree: leaves are
(source, size class, hash bucket), streamed in sorted order with one open document in memory; the open
documents of all leaves meet by (source, size class). Every document goes this way, whatever its size. What
is left at the root of a source is one open document a size class, of unlike sizes: a draw there could miss
the target by one of the largest, so they are rounded, largest first, to the side that keeps the source's
words nearer its target. A hot source is spread over all its classes and buckets.

Draws are hashes of the ids involved, so reruns agree. Null texts have size 0. Repeated rows are separate
documents that share their draws' ids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import apart, stored, table, with_broadcast_if_small

SEED = "mix-1"
EPS = 1e-9


def size_of(text: Column) -> Column:
    """Words, counted as the places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, target: one row a source, by windows over the aggregated sources."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    first = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # With the sources before this one at their caps, the level that uses up the rest; the true one is the first that fits.
    per = per.withColumn("_rest", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(first), F.lit(0.0)))
    per = per.withColumn("_level", F.col("_rest") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(first), F.lit(0.0))))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    return per.select("source", "source_size", F.least("_cap", F.col("_w") * F.coalesce(level, F.lit(0.0))).alias("target"))


def _draw(*ids: object) -> float:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, (SEED, *ids))).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(p: float, q: float, u: float) -> tuple[float, float]:
    """One meeting: mass moves at random until p or q is 0 or 1; p + q and both means are kept."""
    if p + q <= 1:
        return (p + q, 0.0) if u * (p + q) < p else (0.0, p + q)
    return (1.0, p + q - 1) if u * (2 - p - q) < 1 - q else (p + q - 1, 1.0)


def _reducer(level: int):
    """A function over sorted rows that lets the documents of each leaf meet; one open document is held.

    Decided documents get _p 0 or 1, the open one keeps a fraction. At the root (level 2) `_off`, the words
    by which the source is above its target so far, decides in place of meetings and draws.
    """

    def settle(row: dict, off: float) -> float:
        up, down = row["size"] * (1 - row["_p"]), -row["size"] * row["_p"]
        row["_p"] = 1.0 if abs(off + up) < abs(off + down) else 0.0
        return off + (up if row["_p"] else down)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, off = None, None, 0.0
        schema = None
        for batch in batches:
            schema = batch.schema
            out = []
            keys = list(zip(*[batch.column(k).to_pylist() for k in ("_source", "_class", "_bucket")[: 3 - level]], strict=True))
            for key, row in zip(keys, batch.to_pylist(), strict=True):
                if key != leaf:
                    if held:
                        out.append(held)
                    leaf, held, off = key, None, row["_off"]
                if row["_p"] < EPS or row["_p"] > 1 - EPS:
                    row["_p"] = float(round(row["_p"]))
                    out.append(row)
                elif level == 2:
                    off = settle(row, off)
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    held["_p"], row["_p"] = pivot(held["_p"], row["_p"], _draw(level, held["_id"], row["_id"]))
                    meeting, held = (held, row), None
                    for r in meeting:
                        if EPS <= r["_p"] <= 1 - EPS:
                            held = r
                        else:
                            r["_p"] = float(round(r["_p"]))
                            out.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    return reduce


def off_target(parts: list[DataFrame]) -> DataFrame:
    """_source and _off: expected words of all documents, as decided so far, above the target."""
    words = F.sum(F.col("size") * F.col("_p"))
    first = [F.first(c).alias(c) for c in ("source_size", "target", "_whole")]
    sums = [p.groupBy("_source").agg(words.alias("_part"), *first) for p in parts]
    every = sums[0]
    for s in sums[1:]:
        every = every.unionByName(s)
    above = F.sum("_part") + F.first("_whole") * F.first("source_size") - F.first("target")
    return stored(every.groupBy("_source").agg(above.alias("_off")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, bucket_rows: int = 200_000) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs; buckets grow in number with the rows."""
    sized = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    buckets = max(64, -(-sized.count() // bucket_rows))
    targets = stored(source_targets(sized, weights, cap)).withColumnRenamed("source", "_s")
    rows = sized.join(with_broadcast_if_small(targets), sized["source"].eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + EPS)
    rows = rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        whole.cast("long").alias("_whole"),
        F.greatest(rate - whole, F.lit(0.0)).alias("_p"),
        F.xxhash64("source").alias("_source"),
        F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int").alias("_class"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("_bucket"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        F.lit(0.0).alias("_off"),
    )
    done: list[DataFrame] = []
    for level, keys in enumerate((["_source", "_class", "_bucket"], ["_source", "_class"], ["_source"])):
        if level == 2:
            off = off_target([*done, rows])
            rows = rows.drop("_off").join(with_broadcast_if_small(off), "_source").select(*rows.columns)
        order = [*keys, F.col("size").desc() if level == 2 else F.col("size"), "_id"]
        met = stored(rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_reducer(level), rows.schema))
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        done.append(met.where(~open_))
        rows = met.where(open_)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select("doc_id", "source", "size", "source_size", "target", (F.col("_whole") + F.col("_p").cast("long")).alias("copies"))


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """docs, each row repeated as often as the mix takes it; rows are matched by doc_id, source and size.

    Rows that agree in these are numbered by a hash of all their columns, so reruns agree.
    """
    docs, back = apart(docs, "_d", "_s", "_z", "copies", "_n", "_size", "_copy", "_i")
    taken = mix(docs, **options).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies")
    taken = taken.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_s", "_z").orderBy("copies")))
    rows = docs.withColumn("_size", size_of(F.col("text")))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64(*docs.columns))))
    on = rows["doc_id"].eqNullSafe(taken["_d"]) & rows["source"].eqNullSafe(taken["_s"]) & (rows["_size"] == taken["_z"]) & (rows["_copy"] == taken["_n"])
    joined = rows.join(taken.where("copies > 0"), on)
    return joined.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
