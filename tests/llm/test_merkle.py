"""The manifest against a tree in plain Python that keeps no states, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from callejero.llm import merkle_manifest
from callejero.llm.merkle_manifest import OP13_SQL, Parent, lift, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return H(told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text))


def levels(digests):
    tree = [digests]
    while len(tree[-1]) > 1:
        tree.append([H(*tree[-1][i : i + 3]) for i in range(0, len(tree[-1]), 3)])
    return tree


def siblings(tree, at):
    for level in tree[:-1]:
        run = at - at % 3
        yield level[run:at], level[at + 1 : run + 3]
        at //= 3


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = levels([leaf(r, r[1]) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            digest = leaf(r, r[1].replace("\n", "") if changed else r[1])
            for a, b in path:
                digest = H(*a, digest, *b)
            proof = H(*[x for a, b in path for x in [*a, *b]])
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=str)


def rows(n, seed=1):
    r = random.Random(seed)
    found = []
    for i in range(n):
        text = r.choice([None, "", "plain", f"two\nlines {i}", "été\n\nÑ 中 " * 3])
        source = r.choice(["s1", "s1", "s1", None, "", "Z", "é", f"t{i % 17}"])
        found.append((r.choice([i, i, i, None, 5, -i]), text, r.choice([None, "en"]), source, r.choice([None, i])))
    return [*found, *found[:3]]


@pytest.mark.parametrize("shape", [(8, 300), (1, 100), (8, 0)])
def test_against_plain_tree(spark, tmp_path, monkeypatch, shape):
    # Levels of 1 and 2 make many rounds of small stretches, as a corpus of billions of rows would.
    monkeypatch.setattr(merkle_manifest, "LEVELS", shape[0])
    data = rows(shape[1]) if shape[1] > 1 else rows(1)[:1] if shape[1] else []
    docs = spark.createDataFrame(data, SCHEMA).withColumn("_digest", F.lit(1)).withColumn("root", F.lit("x"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_merkle_manifest(spark, str(tmp_path))
    want = manifest(data)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ", ".join(found.columns)
    assert sorted(con.execute(f"SELECT {columns} FROM ({OP13_SQL})").fetchall(), key=str) == want


def test_fold_resumes_the_state():
    a, b, c, d = (H(x) for x in "abcd")
    for children in ([a], [a, b], [a, b, c]):
        parent = Parent(children)
        assert parent.digest == H(*children)
        for slot in range(len(children)):
            assert parent.fold(slot, d) == H(*children[:slot], d, *children[slot + 1 :])
    assert lift([a], 0) == (a, []) and lift([a], 2)[0] == H(H(a))
    with pytest.raises(ValueError):
        lift([a, b], 0)
