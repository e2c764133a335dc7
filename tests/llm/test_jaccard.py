"""The Jaccard join against all pairs in plain Python, and against its SQL."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callejero.llm import jaccard_join
from callejero.llm.jaccard_join import OP12_SQL, similar_sets

from .test_corpus import SCHEMA, SPACE, corpus, lower


def rows():
    """Chains of near copies that lose their likeness step by step, and passages that many texts share."""
    r = random.Random(11)
    found = list(corpus())
    common = " ".join(f"c{i}" for i in range(40))
    for g in range(6):
        words = [f"g{g}x{r.randint(0, 400)}" for _ in range(r.randint(60, 200))]
        for k in range(14):
            found.append((1000 + 20 * g + k, " ".join([*words, common] if g % 2 else words), "en", "s1", 1))
            words = list(words)
            for _ in range(r.choice([1, 1, 2, 5])):
                words[r.randrange(len(words))] = f"n{r.randint(0, 10**6)}"
            if k % 4 == 3:
                words = words[: len(words) * 9 // 10]
    found += [(None, found[70][1], "en", "s1", 1), (None, "only these few words", None, None, 1), (5, "two texts of one id in this table", "en", "s1", 1), (1000, "ONLY These FEW words", "en", "s1", 1)]
    found += [found[71], found[71]]
    return found


def brute(data, width, percent):
    def shingles(t):
        w = re.findall(SPACE, lower(t))
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(x[1]) for x in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(data):
        if x[0] is not None:
            least[find(i)] = min(x[0], least.get(find(i), x[0]))
    return sorted(((x[0], len(s), least.get(find(i))) for i, (x, s) in enumerate(zip(data, sets, strict=True))), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("jaccard"))
    docs = spark.createDataFrame(rows(), SCHEMA).withColumn("_c", F.lit(1)).withColumn("_key", F.lit("x"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("case", [(5, 80, 64), (2, 80, 1), (3, 60, 2)])
def test_all_pairs(spark, folder, case):
    width, percent, block = case
    found = similar_sets(spark.read.parquet(f"{folder}/documents.parquet"), width, percent, block)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == brute(rows(), width, percent)


def test_sql_and_empty(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(OP12_SQL).fetchall(), key=str) == brute(rows(), 5, 80)
    assert similar_sets(spark.read.parquet(f"{folder}/documents.parquet").limit(0)).count() == 0


def test_answers_of_the_leader_suffice():
    r = np.random.default_rng(1)
    lists = lambda sets: pa.array([np.array(sorted(s), np.int64) for s in sets], pa.list_(pa.int64()))
    a, leader, b = ([set(r.integers(0, 60, 40).tolist()) for _ in range(50)] for _ in range(3))
    base = [len(x & y) for x, y in zip(a, leader, strict=True)]
    columns = [pa.array(range(50)), pa.array(range(50)), pa.array(base), lists(a), lists([y - x for x, y in zip(leader, b, strict=True)]), lists([x - y for x, y in zip(leader, b, strict=True)])]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "_base", "_set", "_adds", "_lacks"])
    (out,) = jaccard_join._corrected(iter([batch]))
    assert out.column("_both").to_pylist() == [len(x & y) for x, y in zip(a, b, strict=True)]


def test_blocks_skip(spark):
    """Lists of one component are skipped whole; what is joined is blocks, not sets."""
    index = [(7, c, 100, 1 if c < 500 else 2, 3) for c in range(600)] + [(8, c, 100, 1, 2) for c in range(500)]
    index = spark.createDataFrame(index, "_h long, _c long, _size long, _root long, _rank long")
    assert jaccard_join._block_pairs(index.where("_h = 8"), 80, 64).count() == 0
    assert jaccard_join._block_pairs(index.where("_h = 7"), 80, 64).count() == 500 * 100
    far = index.where("_h = 7").withColumn("_rank", F.when(F.col("_root") == 2, 90).otherwise(3).cast("long"))
    assert jaccard_join._block_pairs(far, 80, 64).count() == 0


def test_lone_shingles_are_only_counted(spark):
    """Shingles that no other set holds aren't listed, copies in a partition list none, and places stay those in the whole order."""
    texts = [f"{' '.join(f't{i}w{k}' for k in range(100))} same tail of these words" for i in range(3)]
    rows = [(i, texts[i % 3]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("_key", jaccard_join._key())
    counts = jaccard_join.shingle_counts(docs.limit(3), 5)
    assert counts.max() == 3 and (counts > 0).sum() == 3 * 100 + 1
    packed = spark.sparkContext.broadcast(zlib.compress(counts.tobytes()))
    signed = docs.mapInArrow(jaccard_join._sign(5, 0, packed), "doc_id long, _key binary, _class binary, _size long, _alone int, _prefix array<long>")
    found = {r["doc_id"]: (r["_size"], r["_alone"], len(r["_prefix"])) for r in signed.collect()}
    assert found == {i: (101, 100, 1) if i < 3 else (101, 0, 0) for i in range(6)}


def test_many_keys_shuffle_few_other_texts(spark, folder, monkeypatch):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).withColumn("_key", jaccard_join._key())
    keys = docs.where("doc_id % 10 = 3").select(F.col("doc_id").alias("_c"), "_key")
    left = {r["doc_id"] for r in jaccard_join._marked(docs, keys).collect()}
    assert left >= set(range(3, 5000, 10)) and len(left) < 510
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    assert sorted(tuple(r) for r in jaccard_join._texts(docs.union(docs), keys).collect()) == [(i, f"text {i}") for i in range(3, 5000, 10)]
    monkeypatch.setattr(jaccard_join, "LEAST_CELLS", 1 << 16)
    monkeypatch.setattr(jaccard_join, "MOST_CELLS", 1 << 16)
    found = similar_sets(spark.read.parquet(f"{folder}/documents.parquet"), 2, 80, 1)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == brute(rows(), 2, 80)
