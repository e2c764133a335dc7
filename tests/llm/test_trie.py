"""The prefix tree against plain Python and against its SQL."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from callejero.llm import prefix_trie
from callejero.llm.prefix_trie import OP11_SQL, op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def tree(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed=2):
    r = random.Random(seed)
    found = []
    for c in [*range(-12, 60), 1 << 40, (1 << 63) - 1, -(1 << 63)]:
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([1, 2, 3, 5, 8, 11, 30])):
            found.append((c, r.choice([turn, turn, turn, None, 1]), r.choice(["user", "assistant", None]) if turn > 2 else "user", r.choice(["", None, "a", "é", "same words"]) if turn > 2 else "same opening"))
    found += [(7, i, "user", f"long {i}") for i in range(300)] + [(9, i, "user", f"long {i}") for i in range(300)]
    return [*found, *found[:4], (None, 1, "user", "no conversation")]


@pytest.mark.parametrize("shape", [(8, 1024), (3, 2), (1, 7)])
def test_against_plain_tree(spark, tmp_path, monkeypatch, shape):
    monkeypatch.setattr(prefix_trie.prefix_trie, "__defaults__", shape)
    data = spark.createDataFrame(rows(), SCHEMA).withColumn("_pos", F.lit("x")).withColumn("depth", F.lit(1))
    data.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op11_prefix_trie(spark, str(tmp_path))
    want = tree(rows())
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    if shape[0] == 8:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({OP11_SQL})").fetchall(), key=str) == want


def test_empty_and_tiny_tables(spark, tmp_path):
    for k, data in enumerate(([], [(None, 1, "user", "x")], [(3, None, None, None)])):
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        assert sorted((tuple(r) for r in op11_prefix_trie(spark, f"{tmp_path}/{k}").collect()), key=str) == tree(data)
