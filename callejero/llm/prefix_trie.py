"""Operator 11: the prefix tree of conversations, all prefixes aggregated together by ROLLUP.

A turn's id is 128 bits of the SHA-256 of its role and text. A conversation's turn ids stand in blocks of
`WIDTH` positional columns, one row a block; a block is keyed by the node where the block before ended. One
SQL `GROUP BY block, node before, ROLLUP (t0, t1, ...)` gives all prefixes of all blocks, and `grouping_id()`
tells a prefix's depth. A node's name is its depth and the xor of two 64-bit hashes of (turn id, position)
over its turns; so the node before a block is known without walking from block to block, from xors over
blocks and over stretches of blocks, and a very long conversation is never held by one task.

Sums over subtrees are sums over members. The least member of a node owns it, and owns all nodes below on its
own path, so one number a conversation, the depth of its top node, tells what it owns. A first ROLLUP finds
owners; in a second one every member brings the bytes that it does not own, and whether it owns a leaf.

Turns are ordered by turn (null first), ties by role, then by turn id. Rows with a null conv_id belong to no
conversation and are left out. Null roles and texts are empty. Repeated rows are turns of their own. An
empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ._common import Scratch, stored, table

#: Positional turn columns of one block, and blocks of one stretch.
WIDTH, STRETCH = 8, 1024

_NAME = ["_depth", "_x", "_y"]


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, _pos (from 1), _id, _bytes of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn_id = F.substring(F.unhex(F.sha2(F.encode(told, "UTF-8"), 256)), 1, 16)
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("_role"), turn_id.alias("_id"), F.octet_length(text).cast("long").alias("_bytes"))
    turns = numbered(scratch.stored(turns), ["turn", "_role", "_id"], by=["conv_id"], name="_pos", paths=scratch.paths)
    return scratch.stored(turns.select("conv_id", "_pos", "_id", "_bytes"))


def lengths(turns: DataFrame) -> DataFrame:
    """conv_id and _len of every conversation that has turns."""
    return turns.groupBy("conv_id").agg(F.max("_pos").alias("_len"))


def rebuild(turns: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths where each conversation c begins with the first h turns of c - c % share, h = crc32(c) % most."""

    def lead(c: Column) -> Column:
        return F.crc32(c.cast("string")) % most

    convs = lengths(turns).withColumn("_h", lead(F.col("conv_id")))
    first = convs.select(F.col("conv_id").alias("_base"), F.col("_len").alias("_has"))
    convs = convs.join(first, F.col("conv_id") - F.col("conv_id") % share == F.col("_base"), "left")
    taken = F.least("_h", F.coalesce("_has", F.lit(0)))
    convs = convs.select("conv_id", "_h", taken.alias("_taken"), (taken + F.greatest(F.lit(0), F.col("_len") - F.col("_h"))).alias("_len"))
    own = F.array(F.struct(F.col("conv_id").alias("_to"), F.lit(True).alias("_own")))
    to = [F.try_add("conv_id", F.lit(k)) for k in range(1 - share, share)]
    given = F.filter(F.array(*to), lambda c: (c - c % share == F.col("conv_id")) & (lead(c) >= F.col("_pos")))
    given = F.when((F.col("conv_id") % share == 0) & (F.col("_pos") < most), F.transform(given, lambda c: F.struct(c.alias("_to"), F.lit(False).alias("_own"))))
    own = F.when(F.col("_pos") > lead(F.col("conv_id")), own)
    nobody = F.array().cast("array<struct<_to: bigint, _own: boolean>>")
    sent = turns.select("_pos", "_id", "_bytes", F.explode(F.concat(F.coalesce(own, nobody), F.coalesce(given, nobody))).alias("_sent"))
    sent = sent.select(F.col("_sent._to").alias("conv_id"), "_sent._own", "_pos", "_id", "_bytes").join(convs, "conv_id")
    place = F.when(F.col("_own"), F.col("_pos") - F.col("_h") + F.col("_taken")).otherwise(F.col("_pos"))
    return sent.select("conv_id", place.alias("_pos"), "_id", "_bytes"), convs.select("conv_id", "_len")


def _hashes(turn_id: Column, place: Column) -> tuple[Column, Column]:
    return F.xxhash64(turn_id, place), F.xxhash64(F.lit(1), place, turn_id)


def _blocks(turns: DataFrame, convs: DataFrame, width: int, stretch: int, scratch: Scratch) -> DataFrame:
    """One row a block: conv_id, _len, _block, the node before it (_p, _q, _pb bytes), _t0.. (id, bytes) and the node at its end."""
    x, y = _hashes(F.col("_id"), F.col("_pos"))
    place = (F.col("_pos") - 1) % width
    slots = [F.max(F.when(place == i, F.struct("_id", "_bytes"))).alias(f"_t{i}") for i in range(width)]
    both = turns.withColumn("_block", F.expr(f"(_pos - 1) div {width}")).groupBy("conv_id", "_block")
    blocks = both.agg(*slots, F.bit_xor(x).alias("_bx"), F.bit_xor(y).alias("_by"), F.sum("_bytes").alias("_bb"))
    blocks = scratch.stored(blocks.withColumn("_stretch", F.expr(f"_block div {stretch}")))

    def before(w: Window) -> list[Column]:
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(f.over(w), F.lit(0).cast("long")) for f in (F.bit_xor("_bx"), F.bit_xor("_by"), F.sum("_bb"))]

    inside = Window.partitionBy("conv_id", "_stretch").orderBy("_block")
    blocks_in = blocks.withColumns(dict(zip(("_p", "_q", "_pb"), before(inside), strict=True)))
    sums = blocks.groupBy("conv_id", "_stretch").agg(F.bit_xor("_bx").alias("_bx"), F.bit_xor("_by").alias("_by"), F.sum("_bb").alias("_bb"))
    sums = sums.withColumns(dict(zip(("_sp", "_sq", "_sb"), before(Window.partitionBy("conv_id").orderBy("_stretch")), strict=True)))
    sums = sums.where("_stretch > 0").select("conv_id", "_stretch", "_sp", "_sq", "_sb")
    blocks = blocks_in.join(sums, ["conv_id", "_stretch"], "left")
    zero = F.lit(0).cast("long")
    p, q = (F.col(a).bitwiseXOR(F.coalesce(b, zero)) for a, b in (("_p", "_sp"), ("_q", "_sq")))
    blocks = blocks.select("conv_id", "_block", p.alias("_p"), q.alias("_q"), (F.col("_pb") + F.coalesce("_sb", zero)).alias("_pb"), *[f"_t{i}" for i in range(width)], "_bx", "_by", "_bb")
    rows = convs.join(blocks, "conv_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("_block", "_p", "_q", "_pb", "_bx", "_by", "_bb")})
    return rows.withColumns({"_ex": F.col("_p").bitwiseXOR(F.col("_bx")), "_ey": F.col("_q").bitwiseXOR(F.col("_by")), "_eb": F.col("_pb") + F.col("_bb")}).drop("_bx", "_by", "_bb")


def _nodes(rows: DataFrame, width: int, told: str) -> DataFrame:
    """Every prefix once: its name, its parent's (_px, _py), _before and _last (bytes before and of its last turn) and what is told."""
    keys = [f"_t{i}" for i in range(width)]
    text = f"SELECT _block, _p, _q, _pb, {', '.join(keys)}, grouping_id() AS _g, {told} FROM {{rows}} GROUP BY _block, _p, _q, _pb, ROLLUP ({', '.join(keys)})"
    found = rows.sparkSession.sql(text, rows=rows)
    found = found.withColumn("_level", F.lit(width) - F.bit_count("_g")).withColumn("_t", F.try_element_at(F.array(*keys), F.greatest(F.lit(1), F.col("_level"))))
    root = (F.col("_level") == 0) & (F.col("_block") == 0)
    found = found.where(root | ((F.col("_level") > 0) & F.col("_t").isNotNull()))
    zero = F.lit(0).cast("long")

    def over(k: int, base: str) -> Column:
        hashes = [F.when(F.col(f"_t{i}").isNotNull(), _hashes(F.col(f"_t{i}._id"), F.col("_block") * width + (i + 1))[k]) for i in range(width)]
        return reduce(lambda a, b: a.bitwiseXOR(F.coalesce(b, zero)), hashes, F.col(base))

    depth = F.col("_block") * width + F.col("_level")
    found = found.withColumns({"_depth": depth, "_x": over(0, "_p"), "_y": over(1, "_q"), "_last": F.when(F.col("_level") > 0, F.col("_t._bytes")).otherwise(zero)})
    hx, hy = _hashes(F.col("_t._id"), F.col("_depth"))
    taken = reduce(lambda a, b: a + b, [F.coalesce(f"_t{i}._bytes", zero) for i in range(width)])
    found = found.withColumns({"_px": F.col("_x").bitwiseXOR(hx), "_py": F.col("_y").bitwiseXOR(hy), "_before": F.col("_pb") + taken - F.col("_last")})
    return found.drop(*keys, "_t", "_g", "_level", "_block", "_p", "_q", "_pb")


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of each node, whose rows follow each other."""
    name, state = None, None

    def done() -> pa.RecordBatch:
        arrays = [pa.array([v], pa.int64()) for v in name]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([state.hexdigest()])], names=[*_NAME, "ends_sha256"])

    for batch in batches:
        for row in batch.to_pylist():
            here = tuple(row[c] for c in _NAME)
            if here == name:
                state.update(b",")
            else:
                if name is not None:
                    yield done()
                name, state = here, hashlib.sha256()
            state.update(row["_text"].encode())
    if name is not None:
        yield done()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """The hash of the ascending conv_ids of each node (conv_id, and the node's name).

    Ids are dealt by ranges, and each range writes one text a node; a node's texts, in order, then run through one
    hash, so that no task holds all ids of a node.
    """
    parts = ends.repartitionByRange("conv_id").withColumn("_part", F.spark_partition_id())
    ids = F.array_sort(F.collect_list("conv_id"))
    parts = parts.groupBy("_part", *_NAME).agg(F.min("conv_id").alias("_from"), F.concat_ws(",", ids.cast("array<string>")).alias("_text"))
    parts = parts.select(*_NAME, "_from", "_text").repartition(*_NAME).sortWithinPartitions(*_NAME, "_from")
    return parts.mapInArrow(_stream_hashes, "_depth long, _x long, _y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, stretch: int = STRETCH) -> DataFrame:
    """The nodes over conversations: turns (conv_id, _pos from 1 without gaps, _id, _bytes), convs (conv_id, _len; 0 allowed)."""
    with Scratch(turns.sparkSession) as scratch:
        rows = scratch.stored(_blocks(turns, convs, width, stretch, scratch))
        first = scratch.stored(_nodes(rows, width, "min(conv_id) AS _owner, max(_len) AS _longest").select("_depth", "_owner", "_longest", "_before"))
        owners = first.groupBy(F.col("_owner").alias("conv_id")).agg(F.min(F.struct("_depth", "_before")).alias("_top"), F.max((F.col("_longest") == F.col("_depth")).cast("long")).alias("_leaf"))
        last = rows.where(f"_block = greatest(0, _len - 1) div {width}")
        spared = F.coalesce("_top._before", "_eb")
        members = last.join(owners, "conv_id", "left").select("conv_id", spared.alias("_spared"), F.coalesce("_leaf", F.lit(0).cast("long")).alias("_leaf"))
        told = "count(*) AS n_convs, min(struct(conv_id, _spared)) AS _own, sum(_spared) AS _spared, sum(_leaf) AS n_leaves"
        nodes = scratch.stored(_nodes(rows.drop("_ex", "_ey", "_eb").join(members, "conv_id"), width, told))
        ends = ends_hashes(last.select("conv_id", F.col("_len").alias("_depth"), F.col("_ex").alias("_x"), F.col("_ey").alias("_y")))
        parent = [(F.col("_depth") - 1).alias("_depth"), F.col("_px").alias("_x"), F.col("_py").alias("_y")]
        children = nodes.where("_depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
        found = nodes.join(children, _NAME, "left").join(ends, _NAME, "left")
        above = nodes.select(F.col("_depth").alias("_ad"), F.col("_x").alias("_ax"), F.col("_y").alias("_ay"), F.col("_own.conv_id").alias("parent_conv_id"))
        on = (F.col("_depth") - 1 == F.col("_ad")) & (F.col("_px") == F.col("_ax")) & (F.col("_py") == F.col("_ay"))
        found = found.join(above, on, "left")
        saved = F.col("_spared") - F.col("_own._spared") - (F.col("n_convs") - 1) * F.col("_before")
        nothing = F.lit(hashlib.sha256().hexdigest())
        told = [F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")]
        return stored(found.select(F.col("_own.conv_id").alias("conv_id"), F.col("_depth").alias("depth"), "parent_conv_id", "n_convs", *told))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree over conversations rebuilt with the first turns of their neighbours."""
    with Scratch(spark) as scratch:
        turns, convs = rebuild(ordered_turns(table(spark, sf_dir, "conversations"), scratch))
        return prefix_trie(scratch.stored(turns), scratch.stored(convs))


#: Each byte is put in with 256 added, then shifted out in eight steps of the polynomial.
_SQL_CRC = """(4294967295 - list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
  lambda x: [CAST(256 + ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))]), lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_SQL_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, 0 AS part, b.pos, b.r, b.t FROM convs v JOIN turns b ON b.c = v.c - v.c % 5 AND b.pos <= v.h
  UNION ALL SELECT v.c, 1, o.pos, o.r, o.t FROM convs v JOIN turns o ON o.c = v.c AND o.pos > v.h),
lists AS (SELECT c, list(struct_pack(r := r, t := t) ORDER BY part, pos) AS s FROM rebuilt GROUP BY c),
seqs AS (SELECT v.c, coalesce(s, []) AS s, coalesce(len(s), 0) AS n FROM convs v LEFT JOIN lists l ON l.c = v.c),
paths AS (SELECT c, n, d, s[1:d] AS k, s[1:d - 1] AS pk, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS b FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM seqs)),
nodes AS (
  SELECT d, k, any_value(pk) AS pk, any_value(b) AS b, min(c) AS conv_id, count(*) AS n_convs, max(n) AS longest,
    coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM paths GROUP BY d, k),
sums AS (
  SELECT a.d, a.k, count(*) FILTER (x.longest = x.d) AS n_leaves, sum((x.n_convs - 1) * x.b) AS saved, count(*) FILTER (x.d = a.d + 1) AS n_children
  FROM nodes x JOIN paths a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.d, a.k)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, s.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums s ON s.d = x.d AND s.k = x.k LEFT JOIN nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.k = x.pk
"""
