"""Operator 4: shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of a ring of 2**32 positions. A document stands at the hash of
its text, so equal texts stand together, and goes to the shard that owns the next point clockwise. A
shard has room for `load` times the mean of all bytes; what no longer fits goes on clockwise to the next
shard with room. A document goes where its first byte falls, so a shard can exceed its room by the largest
document for each stretch of the ring that it takes. Law: `bytes`.

Only the bytes of each arc between two points are gathered (shards * virtual_nodes numbers, whatever the
input). The walk over these arcs fixes, for each arc, which stretch of its bytes goes to which shard. A
document finds its place in its arc by prefix sums in two steps: over small cells (arc, part of the arc,
hash of the id), then within a cell. A text that a third of all rows share is dealt over many cells, one
for every `cell_rows` rows of the table at least, so no task sees a whole group.

Null texts count as empty for the size and stand together; their CRC is null. Ties in doc_id are ordered
by CRC and size, after which rows are interchangeable. An empty table gives an empty result. Columns
besides doc_id and text are ignored by `shard_plan`; `with_shards` keeps them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import apart, stored, table, with_broadcast_if_small

RING = 1 << 32


def ring_points(shards: int, virtual_nodes: int, seed: str = "ring") -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order; a shard's points do not depend on the others."""
    points = [
        (int.from_bytes(hashlib.md5(f"{seed}/{s}/{v}".encode()).digest()[:4], "big"), s)
        for s in range(shards)
        for v in range(virtual_nodes)
    ]
    return sorted(points)


def walk(demand: dict[int, int], owners: list[int], room: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Stretches (arc, from, to, shard) of the arcs' bytes, each arc served clockwise from its owner on."""
    room, plan = dict(room), []
    for arc in range(len(owners)):
        at, end, k = 0, demand.get(arc, 0), 0
        while at < end:
            shard = owners[(arc + k) % len(owners)]
            take = min(end - at, room[shard])
            if take:
                if plan and plan[-1][0] == arc and plan[-1][3] == shard:
                    plan[-1] = (arc, plan[-1][1], at + take, shard)
                else:
                    plan.append((arc, at, at + take, shard))
                at += take
                room[shard] -= take
            k += 1
    return plan


def _arc_by_cells(df: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """Add the arc of each row: an equi-join on the ring's cell of 2**20 positions, then the last point passed."""
    bits = 20
    marks = [(0, 0)] + [((p + 1), (i + 1) % len(points)) for i, (p, _) in enumerate(points)]
    cells = RING >> bits
    k = 0
    rows = []
    for cell in range(cells):
        begin = cell << bits
        while k + 1 < len(marks) and marks[k + 1][0] <= begin:
            k += 1
        inside, j = [(begin, marks[k][1])], k + 1
        while j < len(marks) and marks[j][0] < begin + (1 << bits):
            inside.append(marks[j])
            j += 1
        rows.append((cell, [{"begin": b, "arc": a} for b, a in inside]))
    side = df.sparkSession.createDataFrame(rows, "_cell long, _inside array<struct<begin: long, arc: int>>")
    joined = df.withColumn("_cell", F.shiftright("_position", bits)).join(F.broadcast(side), "_cell")
    last = F.element_at(F.filter("_inside", lambda x: x["begin"] <= F.col("_position")), -1)["arc"]
    return joined.withColumn("_arc", last).drop("_cell", "_inside")


def shard_plan(
    docs: DataFrame,
    shards: int = 16,
    virtual_nodes: int = 64,
    load: float = 1.001,
    parts: int = 16,
    cell_rows: int = 500_000,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    points = ring_points(shards, virtual_nodes)
    owners = [s for _, s in points]
    spread = max(64, -(-docs.count() // cell_rows))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 32).alias("_position"),
        F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("_salt"),
    )
    # All copies of a text share a part and are salted within it.
    part = F.pmod(F.xxhash64("_position"), F.lit(parts))
    rows = _arc_by_cells(rows, points).withColumn("_at", (part * spread + F.col("_salt")).cast("int"))
    rows = stored(rows.drop("_salt", "_position"))

    cells = stored(rows.groupBy("_arc", "_at").agg(F.sum("size").alias("_bytes")))
    demand = {r["_arc"]: r["b"] for r in cells.groupBy("_arc").agg(F.sum("_bytes").alias("b")).collect()}
    total = sum(demand.values())
    room = -(-int(total * load * 1000) // (1000 * shards)) + 1
    plan = walk(demand, owners, dict.fromkeys(range(shards), room))
    by_arc: dict[int, list[dict[str, int]]] = {}
    for arc, lo, hi, shard in plan:
        by_arc.setdefault(arc, []).append({"lo": lo, "hi": hi, "shard": shard})
    stretches = spark.createDataFrame(list(by_arc.items()), "_arc int, _plan array<struct<lo: long, hi: long, shard: int>>")

    before = Window.partitionBy("_arc").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_arc", "_at", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"))
    # A cell is joined with its rows by key; both sides are spread over all cells.
    within = Window.partitionBy("_arc", "_at").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(with_broadcast_if_small(cells), ["_arc", "_at"])
    placed = placed.withColumn("_start", F.col("_base") + F.col("_inner")).join(F.broadcast(stretches), "_arc")
    stretch = F.get(F.filter("_plan", lambda p: (p["lo"] <= F.col("_start")) & (F.col("_start") < p["hi"])), F.lit(0))
    placed = stored(placed.withColumn("shard", stretch["shard"]).drop("_plan", "_base", "_inner"))

    # Slots: offsets of (shard, arc), then of (shard, arc, cell), then the row's number within it.
    counts = stored(placed.groupBy("shard", "_arc", "_at").agg(F.count("*").alias("_n")))
    arcs = counts.groupBy("shard", "_arc").agg(F.sum("_n").alias("_m"))
    over = Window.partitionBy("shard").orderBy("_arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = arcs.select("shard", "_arc", F.coalesce(F.sum("_m").over(over), F.lit(0)).alias("_skip"))
    over = Window.partitionBy("shard", "_arc").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_arc", "_at", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    offsets = offsets.join(F.broadcast(arcs), ["shard", "_arc"])  # at most shards * arcs rows
    number = F.row_number().over(Window.partitionBy("shard", "_arc", "_at").orderBy("_start"))
    result = placed.withColumn("_number", number).join(offsets, ["shard", "_arc", "_at"])
    return result.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_skip") + F.col("_before") + F.col("_number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shards(docs: DataFrame, **options) -> DataFrame:
    """docs with shard and slot (columns of these names are replaced); rows are matched by doc_id, CRC of the text and their number among such rows."""
    docs, back = apart(docs.drop("shard", "slot"), "_crc", "_copy", "_of_doc_id", "_of__crc", "_of__copy")
    plan = shard_plan(docs, **options)
    key = ["doc_id", "_crc", "_copy"]
    copy = F.row_number().over(Window.partitionBy("doc_id", "_crc").orderBy(F.xxhash64(*docs.columns)))
    places = plan.select(F.col("doc_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    places = places.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_crc").orderBy("slot", "shard")))
    keyed = docs.withColumn("_crc", F.crc32("text")).withColumn("_copy", copy)
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key]
    joined = keyed.join(places.withColumnsRenamed({k: f"_of_{k}" for k in key}), on[0] & on[1] & on[2])
    return joined.select(*back, "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(table(spark, sf_dir, "documents"))
