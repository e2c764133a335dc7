import glob

import pytest
from pyspark.sql import functions as F

from callejero.functions.text import sanitize
from callejero.operators import match as mt
from callejero.sources.generations import Conflict, KeyedTable, Manifest, commit_tables, live_tables, vacuum_tables
from callejero.streaming.continuous import continuous, current, progress_by_cycle, read_steps, rejected, replay

SCHEMA = "src_schema string, src_table string, src_row_id long, raw_text string, seen int"


def batches(spark, folder):
    """Three files, one a trigger: new rows, the same again with a later text, and one row that can't be used."""
    files = [
        [("s", "t", 1, "AV. BALTA 5", 1), ("s", "t", 1, "AV. BALTA 7", 0), ("s", "t", None, "CALLE REAL 1", 1), ("s", "t", None, "CALLE REAL 2", 1)],
        [("s", "t", 1, "AV. BALTA 9", 2), ("s", "t", None, "CALLE REAL 1", 1), ("s", "t", 2, None, 1)],
        [("s", "t", None, None, 1)],
    ]
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def texts(spark, target):
    rows = current(spark, target, order="seen")
    return sorted((r["src_row_id"] or 0, r["clean"]) for r in rows.select("src_row_id", "clean").collect())


def clean(df):
    return df.withColumn("clean", sanitize(F.col("raw_text")))


def test_replay_changes_nothing_and_bad_rows_do_not_stop(spark, tmp_path):
    stream = batches(spark, str(tmp_path / "in"))
    want = [(0, "CALLE REAL 1"), (0, "CALLE REAL 2"), (1, "AV. BALTA 9"), (2, "")]
    target = str(tmp_path / "out")
    continuous(stream, clean, target, str(tmp_path / "a"), order="seen").awaitTermination()
    assert texts(spark, target) == want
    assert [r["errors"] for r in rejected(spark, target).collect()] == [["neither text nor id"]]
    first = spark.read.parquet(*glob.glob(f"{target}/rows/part-1-*")).where("src_row_id = 1").collect()
    assert [r["raw_text"] for r in first] == ["AV. BALTA 5"]
    version = Manifest(spark, f"{target}/rows").version()
    continuous(stream, clean, target, str(tmp_path / "a"), order="seen").awaitTermination()  # nothing new
    assert Manifest(spark, f"{target}/rows").version() == version
    continuous(stream, clean, target, str(tmp_path / "b"), order="seen").awaitTermination()  # all of it again
    assert texts(spark, target) == want


def test_keyed_table(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=3, parts=2)
    assert table.current() is None
    rows = lambda ks, v: spark.createDataFrame([(k, v, None) for k in ks], "k long, v string, other string")
    want = {}
    for batch in range(6):
        keys = range(batch, batch + 20)
        assert table.put(rows(keys, f"b{batch}"), batch) and not table.put(rows(keys, "again"), batch)
        want |= {k: f"b{batch}" for k in keys}
        assert {r["k"]: r["v"] for r in table.current().collect()} == want
        assert all(len(parts) <= 2 for parts in table.manifest.read()["parts"].values())

    def crash(*_):
        raise RuntimeError("between write and swap")

    with monkeypatch.context() as m:  # what was written is not seen, and the batch can come again
        m.setattr(Manifest, "swap", crash)
        with pytest.raises(RuntimeError):
            table.put(rows(range(100), "lost"), 6)
    assert {r["k"]: r["v"] for r in table.current().collect()} == want
    assert table.put(rows([3], "b6"), 6)
    want[3] = "b6"
    live = {f for parts in table.manifest.read()["parts"].values() for f in parts}
    files = table.current().inputFiles()
    assert files and all(any(f"/{f}/" in x for f in live) for x in files)
    assert table.vacuum() and {r["k"]: r["v"] for r in table.current().collect()} == want
    assert {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("part")} == live
    with pytest.raises(Conflict):
        table.manifest.swap(table.manifest.version() - 1, {})
    with pytest.raises(Exception, match="null k"):
        table.put(rows([None], "x"), 7)
    assert {r["k"]: r["v"] for r in table.current().collect()} == want
    assert KeyedTable(spark, str(tmp_path / "t"), "k", buckets=99).buckets == 3


def test_tables_become_visible_together(spark, tmp_path):
    path = str(tmp_path / "g")
    one, two = spark.range(3).withColumnRenamed("id", "a"), spark.range(4).withColumnRenamed("id", "b")
    assert live_tables(spark, path) == {} and commit_tables(spark, path, {"one": one, "two": two}) == 1
    bad = two.withColumn("b", F.when(F.col("b") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="broken"):
        commit_tables(spark, path, {"one": one.limit(1), "two": bad})
    assert {n: t.count() for n, t in live_tables(spark, path).items()} == {"one": 3, "two": 4}
    assert commit_tables(spark, path, {"one": live_tables(spark, path)["one"].where("a > 0")}) == 2
    assert {n: t.count() for n, t in live_tables(spark, path).items()} == {"one": 2, "two": 4}
    assert len(vacuum_tables(spark, path)) >= 2 and live_tables(spark, path)["two"].count() == 4


TEXTS = "src_schema string, src_table string, src_row_id string, raw_text string, seen string, answer string"


def test_unreadable_rows_are_kept_and_tried_again(spark, tmp_path):
    rows = [("s", "t", str(i), f"CALLE REAL {i}", "2024-05-01 10:00:00", '{"zona": "SOL"}') for i in range(5)]
    rows += [("s", "t", "7", "CALLE SOL 7", "2024-05-01 10:00:00", '{"zona": '), ("s", "t", "8", "CALLE SOL 8", "31/31/2024", None), ("s", "t", "9" * 25, "CALLE SOL 9", None, "broken too"), ("s", "t", None, None, None, None)]
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TEXTS).parquet(str(tmp_path / "in"))
    steps, target = read_steps(dates=["seen"], numbers=["src_row_id"], answers=["answer"]), str(tmp_path / "out")
    continuous(stream, clean, target, str(tmp_path / "c"), order="seen", steps=steps).awaitTermination()
    assert sorted(r["src_row_id"] for r in current(spark, target).collect()) == [0, 1, 2, 3, 4]
    found = sorted((tuple(e.split(":")[0] for e in r["errors"]), r["attempts"], r["resolved"]) for r in rejected(spark, target).collect())
    assert found == [(("answer answer",), 1, False), (("neither text nor id",), 1, False), (("number src_row_id", "answer answer"), 1, False), (("time seen",), 1, False)]
    assert tuple(replay(spark, target, TEXTS, clean, "seen", steps).first()) == (0, 4)
    # With another reader of times the third passes; the others have one attempt more.
    other = [s for s in steps if s[1] != "seen"] + [("time seen", "seen", F.coalesce(F.try_to_timestamp("seen"), F.to_timestamp(F.lit("2024-12-31"))))]
    assert tuple(replay(spark, target, TEXTS, clean, "seen", other).first()) == (1, 3)
    assert sorted(r["src_row_id"] for r in current(spark, target).collect()) == [0, 1, 2, 3, 4, 8]
    assert sorted((r["attempts"], r["resolved"]) for r in rejected(spark, target).collect()) == [(3, False), (3, False), (3, False), (3, True)]
    assert tuple(replay(spark, target, TEXTS, clean, "seen", steps, most=3).first()) == (0, 0)


def test_progress_on_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    schema = "at timestamp, status string"
    out, folder, checkpoint = (str(tmp_path / x) for x in ("out", "in", "c"))

    def run(*rows):
        data = spark.createDataFrame([(t, s) for t, s in rows], "at string, status string").select(F.to_timestamp("at").alias("at"), "status")
        data.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        counts = progress_by_cycle(stream, "at", "status", late="2 hours")
        counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        return sorted((str(r["day"]), r["status"], r["n"], r["inside"]) for r in spark.read.parquet(out).collect())

    # The cycle of 1 May runs from 06:00 to 06:00; 05:00 and 23:00 are inside its hours. Each call is a restart.
    assert run(("2024-05-01 07:00:00", "ok"), ("2024-05-01 23:00:00", "ok"), ("2024-05-02 05:00:00", "bad")) == []
    assert run(("2024-05-02 07:30:00", "ok"), ("2024-05-01 22:30:00", "ok")) == []  # watermark 05:30: the cycle is open
    assert run(("2024-05-02 05:45:00", "bad"), ("2024-05-02 09:00:00", "ok")) == [("2024-05-01", "bad", 2, 2), ("2024-05-01", "ok", 3, 2)]
    done = run(("2024-05-01 08:00:00", "ok"), ("2024-05-03 09:00:00", "ok"))  # too late for its cycle, which is final
    assert done == [("2024-05-01", "bad", 2, 2), ("2024-05-01", "ok", 3, 2), ("2024-05-02", "ok", 2, 0)]
    table = progress_by_cycle(spark.read.parquet(folder), "at", "status")
    assert sorted((str(r["day"]), r["status"], r["n"], r["inside"]) for r in table.collect()) == [("2024-05-01", "bad", 2, 2), ("2024-05-01", "ok", 4, 2), ("2024-05-02", "ok", 2, 0), ("2024-05-03", "ok", 1, 0)]


def test_a_city_is_a_candidate_only_with_a_type(spark):
    zonas = spark.createDataFrame([(1, 6, "LA VICTORIA", "S1")], "zona_id long, id_tipo_zona int, nom_zona string, sector string")
    names = spark.createDataFrame([("LA VICTORIA", None), ("LA VICTORIA", 6)], "name string, type_hint int")
    found = mt.fuzzy_candidates(names, zonas, "zone", "zona_id", "nom_zona").collect()
    assert [(r["type_hint"], r["zona_id"]) for r in found] == [(6, 1)]
