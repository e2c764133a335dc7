"""Operator 13: a Merkle tree over the rows of a dataset, with proofs and folding by kept SHA-256 states.

A row's leaf is the SHA-256 of its fields. Leaves of one group (source) ascend by id; runs of three are hashed
to a parent until one node is left, the group's subroot; subroots ascend by group and are hashed likewise to
the root. Digests go into their parent as 64 hex letters.

A parent keeps a copy of its hash state before each child's slot. Folding a changed child takes the state of
its slot, adds the new digest and the siblings to the right, and goes on at the parent; what stands to the
left is never hashed again. Spark places the rows: they are numbered within their group by ranges, and a
task takes stretches of 3**8 = 6561 neighbours at a time, lifts each by eight levels and passes its top on to
the next round; a group of n rows takes log(n) / log(6561) rounds. On the way down every node is told the
siblings on its path, one level of stretches after the other, and the rows fold in the last one. So a task
holds one stretch, whatever the size of a group.

Null groups come first, then groups in the order of their UTF-8 bytes. Rows with null ids come first in their
group; rows that tie by id are ordered by leaf, and of equal rows each has its own place. A null field is
`-`, an empty one `0:`. An empty table gives an empty result. Columns other than the hashed ones and the
group play no part; of `docs` none is returned but the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ._common import Scratch, stored, table

ARITY = 3
#: Levels that one task lifts a stretch of neighbours by.
LEVELS = 8

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<left: array<string>, right: array<string>>"


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as `-` or byte count, colon and value."""
    told = []
    for f in fields:
        value = f.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.encode(F.concat(*told), "UTF-8"), 256)


class Parent:
    """The hash states of one parent before each of its slots, and its children's digests."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for c in children:
            self.states.append(state.copy())
            state.update(c.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, child: str) -> str:
        """The parent's digest with another child in that slot."""
        state = self.states[slot].copy()
        state.update((child + "".join(self.children[slot + 1 :])).encode())
        return state.hexdigest()


def lift(digests: list[str], levels: int) -> tuple[str, list[list[Parent]]]:
    """The top over a stretch of neighbours after so many levels, and the parents of each level."""
    tree = []
    for _ in range(levels):
        parents = [Parent(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
        tree.append(parents)
        digests = [p.digest for p in parents]
    if len(digests) != 1:
        raise ValueError("a stretch does not end in one node")
    return digests[0], tree


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that follow each other in one stretch (`_group`, `_stretch`), in order of `_n`."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["_group"], row["_stretch"]) != (held[0]["_group"], held[0]["_stretch"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _stretches(batches):
        top, _ = lift([r["_digest"] for r in rows], rows[0]["_levels"])
        r = rows[0]
        arrays = [pa.array([v], t) for v, t in ((r["_group"], pa.int64()), (r["_height"], pa.int32()), (r["_stretch"], pa.int64()), (top, pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["_group", "_height", "_n", "_digest"])


def _own_path(tree: list[list[Parent]], at: int) -> Iterator[tuple[Parent, int]]:
    for parents in tree:
        yield parents[at // ARITY], at % ARITY
        at //= ARITY


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Siblings on the path from every node of a stretch to the root."""
    kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
    for rows in _stretches(batches):
        _, tree = lift([r["_digest"] for r in rows], rows[0]["_levels"])
        above = rows[0]["_above"] or []
        paths = []
        for at in range(len(rows)):
            paths.append([{"left": p.children[:slot], "right": p.children[slot + 1 :]} for p, slot in _own_path(tree, at)] + above)
        arrays = [pa.array([r["_group"] for r in rows], pa.int64()), pa.array([r["_n"] for r in rows], pa.int64()), pa.array(paths, kind)]
        yield pa.RecordBatch.from_arrays(arrays, names=["_group", "_n", "_path"])


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof and folded root of every row of a stretch."""
    for rows in _stretches(batches):
        _, tree = lift([r["_digest"] for r in rows], rows[0]["_levels"])
        # One parent a level above the stretch, whose states serve all its rows; the slot's child is replaced.
        above = [(Parent([*s["left"], "", *s["right"]]), len(s["left"])) for s in rows[0]["_above"] or []]
        rest = "".join(d for p, slot in above for k, d in enumerate(p.children) if k != slot)
        proofs, roots = [], []
        for at, row in enumerate(rows):
            siblings, digest = [], row["_changed"]
            for p, slot in _own_path(tree, at):
                siblings += p.children[:slot] + p.children[slot + 1 :]
                digest = p.fold(slot, digest)
            for p, slot in above:
                digest = p.fold(slot, digest)
            proofs.append(hashlib.sha256(("".join(siblings) + rest).encode()).hexdigest())
            roots.append(digest)
        ids = pa.array([r["_row"] for r in rows], pa.int64())
        arrays = [ids, pa.array([r["_digest"] for r in rows]), pa.array([r["_group"] for r in rows], pa.int64()), pa.array(proofs), pa.array(roots)]
        yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_leaf", "_group", "_proof", "_folded"])


def _in_stretches(nodes: DataFrame, done: int) -> DataFrame:
    """Nodes (_group, _height, _n, _digest) after `done` levels, dealt by stretch and sorted within."""
    left = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.col("_height") - done)).cast("int")
    nodes = nodes.withColumn("_levels", left).withColumn("_stretch", F.expr(f"_n div {ARITY**LEVELS}"))
    return nodes.repartition("_group", "_stretch").sortWithinPartitions("_group", "_stretch", "_n")


def _height(n: Column) -> Column:
    """Levels over n nodes: the least h with 3**h >= n, in whole numbers."""
    h = F.lit(0)
    for k in range(40):
        if ARITY**k < 1 << 63:
            h = F.when(n > F.lit(ARITY**k), k + 1).otherwise(h)
    return h.cast("int")


class _Tree:
    """One tree a group over nodes (_group, _height, _n from 0, _digest), built up and told down in rounds."""

    def __init__(self, nodes: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.rounds = [nodes]
        height = nodes.agg(F.max("_height")).first()[0] or 0
        schema = "_group long, _height int, _n long, _digest string"
        for done in range(0, height, LEVELS):
            up = _in_stretches(self.rounds[-1], done).select("_group", "_height", "_stretch", "_levels", "_n", "_digest").mapInArrow(_tops, schema)
            self.rounds.append(scratch.stored(up))
        self.tops = self.rounds[-1].select("_group", "_digest")

    def above(self, top_paths: DataFrame | None) -> DataFrame | None:
        """_group, _n, _path of the stretches of the lowest round, given _group, _path of the tops."""
        paths = None if top_paths is None else top_paths.select("_group", F.lit(0).cast("long").alias("_n"), "_path")
        for k in range(len(self.rounds) - 2, 0, -1):
            told = self.joined(self.rounds[k], k * LEVELS, paths)
            told = told.select("_group", "_stretch", "_levels", "_n", "_digest", "_above")
            paths = self.scratch.stored(told.mapInArrow(_paths, f"_group long, _n long, _path array<{_STEP}>"))
        return paths

    @staticmethod
    def joined(nodes: DataFrame, done: int, paths: DataFrame | None) -> DataFrame:
        """The nodes dealt by stretch; the first of each stretch is told the path above it."""
        nothing = F.lit(None).cast(f"array<{_STEP}>")
        if paths is None:
            return _in_stretches(nodes.withColumn("_above", nothing), done)
        width = ARITY**LEVELS
        up = paths.select("_group", (F.col("_n") * width).alias("_n"), F.col("_path").alias("_above"))
        heads = nodes.where(F.col("_n") % width == 0).join(up, ["_group", "_n"]).select(*nodes.columns, "_above")
        return _in_stretches(heads.union(nodes.where(F.col("_n") % width != 0).withColumn("_above", nothing)), done)


def manifest(docs: DataFrame, group: str = "source", leaf: Column | None = None, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id and the group).

    leaf: a row's digest (of the five columns of documents unless told); changed: the digest that is folded in its
    place, by default the leaf itself. verified tells whether the fold ends in the root.
    """
    leaf = leaf_of([F.col(c) for c in FIELDS]) if leaf is None else leaf
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = docs.select(F.col("doc_id").alias("_doc"), F.col(group).alias("_name"), leaf.alias("_digest"), (leaf if changed is None else changed).alias("_changed"))
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
        names = scratch.stored(numbered(rows.groupBy("_name").agg(F.count("*").alias("_rows")), ["_name"], name="_group", start=0, paths=scratch.paths))
        names = names.withColumn("_height", _height(F.col("_rows")))
        placed = numbered(rows, ["_doc", "_digest"], by=["_name"], name="_n", start=0, paths=scratch.paths)
        small = F.broadcast(names) if names.limit(100_001).count() <= 100_000 else names
        placed = placed.join(small, placed["_name"].eqNullSafe(names["_name"])).select("_group", "_height", "_n", "_digest", "_changed", "_row")
        placed = scratch.stored(placed)
        lower = _Tree(placed, scratch)
        groups = names.count()
        over = scratch.stored(lower.tops.select(F.lit(0).cast("long").alias("_group"), _height(F.lit(groups)).alias("_height"), F.col("_group").alias("_n"), "_digest"))
        upper = _Tree(over, scratch)
        told = upper.joined(over, 0, upper.above(None)).select("_group", "_stretch", "_levels", "_n", "_digest", "_above")
        told = scratch.stored(told.mapInArrow(_paths, f"_group long, _n long, _path array<{_STEP}>"))
        stretches = lower.above(told.select(F.col("_n").alias("_group"), "_path"))
        folded = lower.joined(placed, 0, stretches).select("_group", "_stretch", "_levels", "_n", "_digest", "_changed", "_row", "_above")
        folded = folded.mapInArrow(_folds, "_id long, _leaf string, _group long, _proof string, _folded string")
        root = upper.tops.select(F.col("_digest").alias("root"))
        tops = lower.tops.select("_group", F.col("_digest").alias("subroot"))
        tops = F.broadcast(tops) if groups <= 100_000 else tops
        folded = stored(folded.join(tops, "_group").join(F.broadcast(root)))
    found = rows.select("_row", F.col("_doc").alias("doc_id")).join(folded, F.col("_row") == F.col("_id"))
    told = [F.col("_leaf").alias("leaf"), "subroot", "root", F.col("_proof").alias("proof_sha256"), F.col("_folded").alias("folded_root"), (F.col("_folded") == F.col("root")).alias("verified")]
    return found.select("doc_id", *told)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of even crc32 are folded with the text's line feeds deleted."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, changed=leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]))


def _sql_tree(name: str, nodes: str) -> str:
    """Levels of the trees over nodes (g, pos, h, n), one row a node and level."""
    return f"""{name} AS (
  SELECT g, CAST(0 AS BIGINT) AS lvl, CAST(pos AS BIGINT) AS pos, h, CAST(n AS BIGINT) AS n FROM {nodes}
  UNION ALL
  SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3, n)"""


def _sql_told(*columns: str) -> str:
    return " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


#: Each byte is put in with 256 added, then shifted out in eight steps of the polynomial.
_SQL_CRC = """(4294967295 - list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [CAST(256 + ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))]), lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""

OP13_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, source, sha256({_sql_told("doc_id", "source", "lang", "n_chars", "text")}) AS h,
    CASE WHEN {_SQL_CRC} % 2 = 0 AND doc_id IS NOT NULL AND text IS NOT NULL THEN replace(text, chr(10), '') ELSE text END AS text, lang, n_chars FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM docs),
{_sql_tree("tree", "placed")},
tops AS (SELECT g, h FROM tree WHERE n = 1),
subroots AS (SELECT 0 AS g, g AS pos, h, (SELECT count(*) FROM tops) AS n FROM tops),
{_sql_tree("crown", "subroots")},
nodes AS (SELECT 0 AS part, * FROM tree UNION ALL SELECT 1 AS part, * FROM crown),
steps AS (
  SELECT part, lvl, g, pos, coalesce((SELECT string_agg(b.h, '' ORDER BY b.pos) FROM nodes b WHERE b.part = a.part AND b.lvl = a.lvl AND b.g = a.g AND b.pos // 3 = a.pos // 3 AND b.pos < a.pos), '') AS lft,
    coalesce((SELECT string_agg(b.h, '' ORDER BY b.pos) FROM nodes b WHERE b.part = a.part AND b.lvl = a.lvl AND b.g = a.g AND b.pos // 3 = a.pos // 3 AND b.pos > a.pos), '') AS rgt
  FROM nodes a WHERE n > 1),
fold AS (
  SELECT id, 0 AS part, CAST(0 AS BIGINT) AS lvl, CAST(g AS BIGINT) AS g, CAST(pos AS BIGINT) AS pos, sha256({_sql_told("doc_id", "source", "lang", "n_chars", "text")}) AS h, '' AS proof, g AS own FROM placed
  UNION ALL
  SELECT f.id, CASE WHEN s.lvl IS NULL THEN f.part + 1 ELSE f.part END, CASE WHEN s.lvl IS NULL THEN 0 ELSE f.lvl + 1 END, CASE WHEN s.lvl IS NULL THEN 0 ELSE f.g END,
    CASE WHEN s.lvl IS NULL THEN f.own ELSE f.pos // 3 END, CASE WHEN s.lvl IS NULL THEN f.h ELSE sha256(s.lft || f.h || s.rgt) END, f.proof || coalesce(s.lft || s.rgt, ''), f.own
  FROM fold f LEFT JOIN steps s ON s.part = f.part AND s.lvl = f.lvl AND s.g = f.g AND s.pos = f.pos WHERE f.part < 2)
SELECT p.doc_id, p.h AS leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN tops t ON t.g = p.g JOIN crown r ON r.n = 1 JOIN fold f ON f.id = p.id AND f.part = 2
"""
