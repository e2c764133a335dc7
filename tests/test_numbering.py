import random

from pyspark.sql import functions as F

from callejero.operators.numbering import numbered


def rows():
    r = random.Random(5)
    return [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.randint(0, 300) if i % 9 else None, f"x{i}") for i in range(2000)]


def test_dense_numbers_by_group(spark):
    df = spark.createDataFrame(rows(), "g string, v long, n string").repartition(7)
    found = numbered(df, ["v"], by=["g"], name="place").collect()
    assert len(found) == 2000 and {r["n"] for r in found} == {x for _, _, x in rows()}
    for g in ("a", "b", None, "hot"):
        own = sorted((r["place"], r["v"] is not None, r["v"] or 0) for r in found if r["g"] == g)
        assert [p for p, *_ in own] == list(range(1, len(own) + 1))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_dense_numbers_of_all(spark):
    df = spark.createDataFrame(rows(), "g string, v long, n string").repartition(7)
    found = sorted((r["n"], r["v"] is not None, r["v"] or 0) for r in numbered(df, ["v", F.col("g").desc()], start=0).collect())
    assert [n for n, *_ in found] == list(range(2000)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
    assert numbered(df.limit(0), ["v"]).count() == 0 and numbered(df.limit(0), ["v"], by=["g"]).count() == 0


def test_no_single_partition_window(spark):
    df = spark.createDataFrame(rows(), "g string, v long, n string")
    for by in ([], ["g"]):
        plan = numbered(df, ["v"], by=by)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
