"""Operator 12: the exact Jaccard self-join of shingle sets, with skips by the relations between sets.

A document's set holds the distinct shingles of `width` words (the whole sequence if it is shorter). Equal
sets are one class; classes are joined, documents only carry their class's component.

Two sets that link share a shingle among the first few of each, in any one order of all shingles (prefix
filter). The first order is by how often shingles of one cell of a hash table occur (saturated
counters, summed over the tasks and sent to all), then by hash: passages that many documents share come
late. There are about as many counters as shingles, up to `MOST_CELLS` (64 MB); counts that are too high by
other shingles of the cell cost time, never a link. A counter of 1 tells a shingle that no other set
holds: it keeps its place in the prefix but isn't listed. What is left of each class's prefix (and of a copy's, once a
partition) is dealt by shingle once, and shingles that two classes list make the lists of an index. The set of a list that meets most
others, its leader, is compared with the list's other sets, so that a list of n sets costs n comparisons,
and stars contract what links.

What is left are lists that hold several components.

* Index skipping: a list is cut into blocks of one component, one range of sizes and one range of places of
  the shingle in its set, about `BLOCK` sets a block at most. Blocks are joined, not sets: a block pair of one
  component, or whose least places leave too few shingles for any of its sets, is skipped whole.
* Answer skipping: a set that has a leader in common with most of its shingles keeps what it adds to the
  leader and what it lacks. A set's overlap with the leader is computed once. Its overlap with the followers
  lies between that answer minus what the follower lacks and plus what the follower adds: mostly that decides
  the link, else the answer is corrected by the two small differences, which the comparison with the leader
  left behind. The followers' sets are never read.

Sets are never stored or shuffled: the texts of what is compared are (half the bytes), and are cut where they meet.

The result is exact but for hashes: shingles are 64-bit hashes, classes 128-bit ones. Documents without
words, or null ones, have an empty set and link with nothing. Null ids count as the largest. Repeated rows and
equal texts share a class; all get one row each. An empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Scratch, stored, table
from ._tokens import mix, slices
from .near_dedup import _key, _may_link, _star, class_keys, components, sets_of

#: Sets in one block of a long index list, on average at most.
BLOCK = 64
#: Least and most counters of the first order, one byte each; one row carries SLICE of them.
LEAST_CELLS, MOST_CELLS, SLICE = 1 << 20, 1 << 26, 1 << 16
#: Keys of texts that are sent to all tasks; of more, one bit of MARKS each (8 MB).
FEW, MARKS = BROADCAST_ROWS, 1 << 26

_SET = "array<long>"


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set meet a shingle among the first ones of every set that it links with."""
    return size - (percent * size + 99) // 100 + 1


def _cells(found: np.ndarray, cells: int) -> np.ndarray:
    """Each shingle's counter, of a power of two of them."""
    return (mix(found) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _packed(cells: np.ndarray) -> bytes:
    """Counters, of which most are 0, compressed by runs and Huffman codes alone: half of what Spark's own codec leaves."""
    packer = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return packer.compress(cells.tobytes()) + packer.flush()


def _count(width: int, n_cells: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's counters, in compressed slices that hold any."""
        cells, held, n = np.zeros(n_cells, np.uint8), [], 0

        def flush() -> None:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            cells[at] = np.minimum(255, cells[at] + times)
            held.clear()

        for _, texts in slices(batches):
            held.append(_cells(sets_of(texts, width)[0], n_cells))
            n += len(held[-1])
            if n > 4_000_000:
                flush()
                n = 0
        if held:
            flush()
        for k, piece in enumerate(cells.reshape(-1, SLICE)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([_packed(piece)])], names=["_slice", "_cells"])

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of one place, which follow each other, added up."""
    at, total = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([_packed(total.astype(np.uint8))])], names=["_slice", "_cells"])

    for batch in batches:
        for k, cells in zip(batch.column("_slice").to_pylist(), batch.column("_cells").to_pylist(), strict=True):
            if k != at:
                if at is not None:
                    yield done()
                at, total = k, np.zeros(SLICE, np.uint16)
            total = np.minimum(255, total + np.frombuffer(zlib.decompress(cells), np.uint8))
    if at is not None:
        yield done()


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """The counters over all texts: one a letter to eight, at most MOST_CELLS bytes, whatever the size of docs."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // 8).bit_length()))
    parts = docs.select("text").mapInArrow(_count(width, n_cells), "_slice long, _cells binary")
    parts = parts.repartition("_slice").sortWithinPartitions("_slice").mapInArrow(_summed, "_slice long, _cells binary")
    cells = np.zeros(n_cells, np.uint8)
    for row in parts.toLocalIterator():
        cells[row["_slice"] * SLICE : (row["_slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["_cells"]), np.uint8)
    return cells


def _sign(width: int, percent: int, counts: Broadcast):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class, size and, for the first of a class in the partition, the prefix in the order of counts and mixed hashes.

        A counter is never too low but where it is full: shingles of a counter of 1 are in no other set. They come first and are only counted (`_alone`).
        """
        cells, seen = np.frombuffer(zlib.decompress(counts.value), np.uint8), set()
        for part, texts in slices(batches):
            found, begin = sets_of(texts, width)
            size = np.diff(begin)
            owner = np.repeat(np.arange(len(texts)), size)
            times = cells[_cells(found, len(cells))]
            order = np.lexsort((mix(found), times, owner))
            place = np.arange(len(found)) - begin[owner]
            keys = class_keys(found, begin)
            fresh = np.array([not (key in seen or seen.add(key)) for key in keys], bool)
            first = (place < prefix_length(size, percent)[owner]) & fresh[owner]
            shared = times[order] > 1
            alone = np.bincount(owner[first & ~shared], minlength=len(texts))
            first &= shared
            cuts = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(texts))))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found[order][first].view(np.int64)))
            arrays = [part.column("doc_id"), part.column("_key"), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(alone, pa.int32()), prefix]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_key", "_class", "_size", "_alone", "_prefix"])

    return sign


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, without copies."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _shingled(ids: pa.Array, texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sets of texts; texts of one id are cut once."""
    _, first, which = np.unique(ids.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    found, begin = sets_of([texts[i] for i in first.tolist()], width)
    found = found.view(np.int64)
    return [found[begin[k] : begin[k + 1]] for k in which.tolist()]


def _compare(width: int, percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The size of the overlap of a's and b's sets; if they link, what a adds to b and what it lacks."""
        for part, left in slices(batches, "_left"):
            right = pc.fill_null(part.column("_right").cast(pa.binary()), b"").to_pylist()
            both, adds, lacks = [], [], []
            for x, y in zip(_shingled(part.column("a"), left, width), _shingled(part.column("b"), right, width), strict=True):
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                link = 100 * both[-1] >= percent * (len(x) + len(y) - both[-1])
                adds.append(np.setdiff1d(x, y, assume_unique=True) if link else None)
                lacks.append(np.setdiff1d(y, x, assume_unique=True) if link else None)
            arrays = [*[part.column(c) for c in ("a", "b", "_m", "_n")], pa.array(both, pa.int64()), *[pa.array(d, pa.list_(pa.int64())) for d in (adds, lacks)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "_m", "_n", "_both", "_adds", "_lacks"])

    return compare


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap of a with b from its overlap with b's leader and the two differences."""
    for batch in batches:
        base = batch.column("_base").to_numpy(zero_copy_only=False)
        sets, adds, lacks = (_lists(batch.column(c)) for c in ("_set", "_adds", "_lacks"))
        both = [n + np.isin(p, s).sum() - np.isin(m, s).sum() for n, s, p, m in zip(base, sets, adds, lacks, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.array(both, np.int64))], names=["a", "b", "_both"])


def _correct(width: int):
    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """_corrected, from a's text."""
        for part, texts in slices(batches):
            sets = pa.array(_shingled(part.column("a"), texts, width), pa.list_(pa.int64()))
            yield from _corrected(iter([part.append_column("_set", sets)]))

    return correct


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (a, b, _m, _n) with _both and, if they link, _adds and _lacks."""
    both = pairs.join(texts.select(F.col("_c").alias("a"), F.col("text").alias("_left")), "a")
    both = both.join(texts.select(F.col("_c").alias("b"), F.col("text").alias("_right")), "b").select("a", "b", "_m", "_n", "_left", "_right")
    return both.mapInArrow(_compare(width, percent), f"a long, b long, _m long, _n long, _both long, _adds {_SET}, _lacks {_SET}")


def _links(both: Column, m: Column, n: Column, percent: int) -> Column:
    return 100 * both >= percent * (m + n - both)


def _need(m: Column, n: Column, percent: int) -> Column:
    """The least overlap of linked sets of m and n shingles."""
    return F.ceil(percent * (m + n) / (100 + percent) - 1e-9)


def _reach(m: Column, i: Column, n: Column, j: Column) -> Column:
    """The most that two sets share if a common shingle at places i and j is the first one."""
    return F.least(m - i, n - j) + 1


def _leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: each set of a list (_h, _c, _size, _rank; _k: sets in it) and the list's leader, the set that meets most others in all its lists.

    Pairs whose places in a list leave too few shingles are left out there: if they link, an earlier list has them.
    """
    met = entries.groupBy("_c").agg(F.sum("_k").alias("_met"))
    best = F.max(F.struct("_met", (-F.col("_c")).alias("_minus"), "_size", "_rank")).over(Window.partitionBy("_h")).alias("_best")
    led = entries.join(met, "_c").select("_c", "_size", "_rank", best)
    led = led.select("_c", "_size", "_rank", (-F.col("_best._minus")).alias("b"), F.col("_best._size").alias("_n"), F.col("_best._rank").alias("_j"))
    m, n = F.col("_size"), F.col("_n")
    led = led.where((F.col("_c") != F.col("b")) & _may_link(m, n, percent) & (_reach(m, F.col("_rank"), n, F.col("_j")) >= _need(m, n, percent)))
    return led.select(F.col("_c").alias("a"), "b", F.col("_size").alias("_m"), "_n").distinct()


def _marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The docs whose _key may be among keys: those whose bit, of MARKS, a key has set. The bits are sent to all."""
    at = F.pmod(F.xxhash64("_key"), F.lit(MARKS))
    bits = keys.select(at.alias("_at")).groupBy(F.expr("_at div 32768").alias("_bucket")).agg(F.bitmap_construct_agg(F.expr("_at % 32768")).alias("_bits"))
    held = docs.withColumn("_at", at).withColumn("_bucket", F.expr("_at div 32768")).join(F.broadcast(bits), "_bucket")
    byte = "cast(conv(hex(substring(_bits, cast(_at % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return held.where(F.expr(f"getbit({byte}, cast(_at % 8 as int)) = 1")).select(*docs.columns)


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """_c and text of the classes in keys (_c, _key); of many keys, no other text is shuffled but by chance."""
    if keys.limit(FEW + 1).count() <= FEW:
        keys = F.broadcast(keys)
    else:
        docs = _marked(docs, keys)
    return docs.join(keys, "_key").select("_c", "text").dropDuplicates(["_c"])


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (_c, ...) with `_root`, the least set known to be in their component."""
    root = edges.groupBy(F.col("a").alias("_c")).agg(F.min("b").alias("_root"))
    return nodes.join(root, "_c", "left").withColumn("_root", F.coalesce("_root", "_c"))


def _open(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """The entries (_h, _c, _size, _rank, _root) of lists that still hold more than one component."""
    named = _rooted(entries, edges)
    each = Window.partitionBy("_h")
    mixed = named.withColumns({"_lo": F.min("_root").over(each), "_hi": F.max("_root").over(each)}).where("_lo != _hi")
    return mixed.select("_h", "_c", "_size", "_rank", "_root")


def _block_pairs(index: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b (sizes _m, _n): sets of different components that may link, by joining blocks of the index lists."""
    step = F.floor(F.log("_size") / (math.log(100 / percent) + 1e-9)) if percent < 100 else F.col("_size")
    index = index.withColumns({"_step": step.cast("long"), "_range": F.floor(F.log2("_rank")).cast("long")})
    key = ["_h", "_step", "_range", "_root"]
    long = index.groupBy(*key).agg(F.expr(f"count(*) div {block} + 1").alias("_parts")).where("_parts > 1")
    index = index.join(long, key, "left").withColumn("_part", F.pmod(F.xxhash64("_c"), F.coalesce("_parts", F.lit(1))))
    entry = F.struct("_c", "_size", "_rank")
    sums = [F.min("_rank").alias("_least"), F.min("_size").alias("_low"), F.max("_size").alias("_high"), F.collect_list(entry).alias("_sets")]
    blocks = index.groupBy(*key, "_part").agg(*sums)

    a = blocks.select("_h", "_step", F.col("_root").alias("_r"), F.col("_least").alias("_i"), F.col("_low").alias("_ml"), F.col("_high").alias("_mh"), F.col("_sets").alias("_a"))
    b = blocks.select("_h", F.explode(F.array(F.col("_step"), F.col("_step") - 1)).alias("_step"), F.col("_step").alias("_own"), F.col("_root").alias("_s"), F.col("_least").alias("_j"), F.col("_low").alias("_nl"), F.col("_high").alias("_nh"), F.col("_sets").alias("_b"))
    fits = _reach(F.col("_mh"), F.col("_i"), F.col("_nh"), F.col("_j")) >= _need(F.col("_ml"), F.col("_nl"), percent)
    # Within one step both orders of two blocks meet; the one with the lesser component first is taken.
    once = (F.col("_r") != F.col("_s")) & ((F.col("_step") != F.col("_own")) | (F.col("_r") < F.col("_s")))
    met = a.join(b, ["_h", "_step"]).where(once & fits)

    def good(x: Column, y: Column) -> Column:
        enough = _reach(x["_size"], x["_rank"], y["_size"], y["_rank"]) >= _need(x["_size"], y["_size"], percent)
        return _may_link(x["_size"], y["_size"], percent) & enough

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x["_c"].alias("a"), x["_size"].alias("_m"), y["_c"].alias("b"), y["_size"].alias("_n"))

    found = F.flatten(F.transform("_a", lambda x: F.transform(F.filter("_b", lambda y: good(x, y)), lambda y: pair(x, y))))
    return met.select(F.explode(found).alias("_p")).select("_p.a", "_p._m", "_p.b", "_p._n").distinct()


def _led(pairs: DataFrame, follows: DataFrame) -> DataFrame:
    """pairs (a, _m, b, _n) with b's leader (b itself if it follows none) and how much b adds to it and lacks; follows: _c, _leader, _own (size), _adds, _lacks."""
    led = follows.select(F.col("_c").alias("b"), "_leader", "_own", F.size("_adds").alias("_plus"), F.size("_lacks").alias("_minus"))
    nothing = F.lit(0)
    named = [F.coalesce("_leader", "b").alias("_leader"), F.coalesce("_own", "_n").alias("_own")]
    return pairs.join(led, "b", "left").select("a", "_m", "b", "_n", *named, F.coalesce("_plus", nothing).alias("_plus"), F.coalesce("_minus", nothing).alias("_minus"))


def _answered(pairs: DataFrame, follows: DataFrame, known: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The linked ones of pairs, as _led gives them, with the answers of b's leader; known: a, b, _both; texts: those of all a and leaders."""
    asked = pairs.where("a != _leader").select("a", F.col("_leader").alias("b"), "_m", F.col("_own").alias("_n")).distinct()
    told = asked.join(known, ["a", "b"], "left_anti")
    answers = _compared(told, texts, width, percent).select("a", "b", "_both").union(asked.select("a", "b").join(known.select("a", "b", "_both"), ["a", "b"]))
    own = pairs.where("a = _leader").select("a", F.col("a").alias("b"), F.col("_m").alias("_both")).distinct()
    answers = scratch.stored(answers.union(own).select("a", F.col("b").alias("_leader"), F.col("_both").alias("_base")))
    judged = scratch.stored(pairs.join(answers, ["a", "_leader"]))
    sure = judged.where(_links(F.col("_base") - F.col("_minus"), F.col("_m"), F.col("_n"), percent)).select("a", "b")
    may = _links(F.least(F.col("_base") + F.col("_plus"), F.col("_m"), F.col("_n")), F.col("_m"), F.col("_n"), percent)
    rest = judged.where(may & ~_links(F.col("_base") - F.col("_minus"), F.col("_m"), F.col("_n"), percent))
    rest = rest.join(follows.select(F.col("_c").alias("b"), "_adds", "_lacks"), "b").join(texts.withColumnRenamed("_c", "a"), "a")
    fixed = rest.select("a", "b", "_base", "text", "_adds", "_lacks").mapInArrow(_correct(width), "a long, b long, _both long")
    fixed = fixed.join(judged.select("a", "b", "_m", "_n"), ["a", "b"])
    return sure.union(fixed.where(_links(F.col("_both"), F.col("_m"), F.col("_n"), percent)).select("a", "b"))


def similar_sets(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of docs (doc_id, text); class_id tells equal sets (null: empty)."""
    docs = docs.select("doc_id", "text").withColumn("_key", _key())
    counts = docs.sparkSession.sparkContext.broadcast(zlib.compress(shingle_counts(docs, width).tobytes(), 1))
    signed = docs.mapInArrow(_sign(width, percent, counts), f"doc_id long, _key binary, _class binary, _size long, _alone int, _prefix {_SET}")
    signed = stored(signed.withColumn("_row", F.monotonically_increasing_id()))
    with Scratch(docs.sparkSession) as scratch:
        # The least row of a class is its partition's first one of it and has the prefix.
        one, least = F.min(F.struct("_row", "_key")).alias("_one"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("_least")
        classes = signed.where("_size > 0").groupBy("_class").agg(one, least, F.first("_size").alias("_size"))
        classes = scratch.stored(classes.select("_class", F.col("_one._row").alias("_c"), F.col("_least.doc_id").alias("_doc"), F.col("_one._key").alias("_key"), "_size"))
        entries = signed.select(F.col("_row").alias("_c"), "_alone", F.posexplode("_prefix").alias("_at", "_h")).select("_c", "_h", F.expr("_alone + _at + 1").alias("_rank"))
        entries = entries.withColumn("_k", F.count("*").over(Window.partitionBy("_h"))).where("_k > 1")
        entries = scratch.stored(entries.join(classes.select("_c", "_size"), "_c"))
        keys = classes.select("_c", "_key")
        both = lambda p, a, b: p.select(F.explode(F.array(a, b)).alias("_c")).distinct()
        pairs = scratch.stored(_leader_pairs(entries, percent))
        texts = _texts(docs, scratch.stored(both(pairs, "a", "b").join(keys, "_c")))
        known = scratch.stored(_compared(pairs, texts, width, percent))
        close = known.where("_adds IS NOT NULL")
        edges = scratch.stored(_star(scratch.stored(_star(close.select("a", "b")))))
        pairs = scratch.stored(_block_pairs(scratch.stored(_open(entries, edges)), percent, block))
        asked = pairs.select(F.col("b").alias("a")).distinct()
        best = F.max_by(F.struct("b", "_n", "_adds", "_lacks"), F.struct("_both", "b")).alias("_best")
        best = close.join(asked, "a", "left_semi").groupBy(F.col("a").alias("_c")).agg(best)
        follows = scratch.stored(best.select("_c", F.col("_best.b").alias("_leader"), F.col("_best._n").alias("_own"), "_best._adds", "_best._lacks"))
        pairs = scratch.stored(_led(pairs, follows))
        texts = scratch.stored(_texts(docs, scratch.stored(both(pairs, "a", "_leader").join(keys, "_c"))))
        found = scratch.stored(_answered(pairs, follows, known.select("a", "b", "_both"), texts, width, percent, scratch))
        root = components(edges.select("a", "b").union(found), scratch)

        named = classes.join(root.withColumnRenamed("node", "_c"), "_c", "left").withColumn("root", F.coalesce("root", "_c"))
        lowest = named.groupBy("root").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc")).alias("_least"))
        named = stored(named.join(lowest, "root").select("_class", "_c", F.col("_least._doc").alias("_component")))
    found = signed.select("doc_id", F.col("_size").alias("n_shingles"), "_class").join(named, "_class", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_component"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("_c").alias("class_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents")).drop("class_id")


OP12_SQL = """
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS h
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
links AS (
  SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.id != b.id JOIN sizes m ON m.id = a.id JOIN sizes n ON n.id = b.id
  GROUP BY a.id, b.id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
reach AS (SELECT id, id AS other FROM docs UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM docs d LEFT JOIN sizes s ON s.id = d.id JOIN (SELECT r.id, min(o.doc_id) AS component_id FROM reach r JOIN docs o ON o.id = r.other GROUP BY r.id) c ON c.id = d.id
"""
