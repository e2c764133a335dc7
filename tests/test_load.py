"""Maps of ids, dense ids and commits of tables."""

import pytest
from pyspark.sql import functions as F

from callejero.operators import load as ld
from callejero.operators.views import flat_export
from callejero.plans.load import child_tables, load_normalized
from callejero.sources.generations import live_tables


def test_chains_and_cycles(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (11, 12), (12, 10), (20, 10), (30, 30), (40, None), (50, 6), (7, 9), (7, 8)]
    rows += [(1000 + i, 1001 + i) for i in range(100)]
    ends, cycles = ld.resolve_map(spark.createDataFrame(rows, "old_id long, new_id long"))
    want = {1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 50: 6, 7: 8} | {1000 + i: 1100 for i in range(100)}
    assert {r["old_id"]: r["new_id"] for r in ends.collect()} == want
    assert sorted(tuple(r) for r in cycles.collect()) == [(10, 11), (11, 12), (12, 10), (20, 10)]
    none = spark.createDataFrame([], "old_id long, new_id long")
    assert [df.count() for df in ld.resolve_map(none)] == [0, 0]


def test_duplicates_follow_an_explicit_chain(spark):
    catalog = spark.createDataFrame([(i, 1, n) for i, n in [(1, "REAL"), (2, "réal"), (3, "GRAU"), (4, "GRAU "), (5, "LIMA"), (6, "LIMA"), (7, "CUSCO")]], "id long, t int, n string")
    explicit = spark.createDataFrame([(4, 6), (6, 7), (1, 2)], "old_id long, new_id long")
    got = {r["old_id"]: r["new_id"] for r in ld.duplicate_map(catalog, "id", "t", "n", explicit).collect()}
    # 4 to 6 to 7; 6 is mapped away, so 5 and 6 keep 5 as the least of LIMA only for 5 itself; 1 and 2 meet in 2; 3 stays.
    assert got == {4: 7, 6: 7, 1: 2}
    assert {r["old_id"]: r["new_id"] for r in ld.duplicate_map(catalog, "id", "t", "n").collect()} == {2: 1, 4: 3, 6: 5}


def test_types_align(spark):
    existing = spark.createDataFrame([(1, "PROPIA"), (2, "CALLE"), (3, "OTRA"), (9, "RARA")], "id int, nombre string")
    official = spark.createDataFrame([(1, "CALLE"), (2, "AVENIDA"), (3, "JIRÓN")], "id int, nombre string")
    catalog, id_map = ld.align_types(existing, official)
    assert sorted(tuple(r) for r in catalog.collect()) == [(1, "CALLE"), (2, "AVENIDA"), (3, "JIRÓN"), (9, "RARA"), (10, "PROPIA"), (11, "OTRA")]
    assert {r["old_id"]: r["new_id"] for r in id_map.collect()} == {1: 10, 2: 1, 3: 11, 9: 9}


DONE = "dire_id long, es_procesado boolean, zona_id long, referencia string, at string, vias array<struct<via_id:long,divi_numero:string>>, manzana string, lote string, slote string, piso string, block string, modulos array<struct<timo_id:int,ditm_nombre:string>>"


def test_load_is_one_commit(spark, tmp_path, monkeypatch):
    central = spark.createDataFrame([(i, None, None, None, None) for i in range(1, 5)], "dire_id long, zona_id long, dire_referencia string, dire_es_procesado boolean, update_at string")
    first = [(1, True, 7, "PARQUE", "t1", [(10, "5"), (11, "S/N"), (None, "1")], " a ", "3", None, None, None, [(2, "201"), (2, " 201 "), (3, None)]), (2, False, 8, "X", "t1", [(12, "1")], "b", None, None, None, None, None)]
    path = str(tmp_path / "w1")
    assert load_normalized(spark, path, spark.createDataFrame(first, DONE), central) == 1
    told = lambda: {n: sorted(tuple(r) for r in t.collect()) for n, t in live_tables(spark, path).items()}
    one = told()
    assert one["address"] == [(1, 7, "PARQUE", True, "t1"), (2, None, None, False, "t1"), (3, None, None, None, None), (4, None, None, None, None)]
    assert one["address_via"] == [(1, 10, "5", 1), (1, 11, "S/N", 2)]
    assert one["address_comp"] == [(1, 1, "A", 1), (1, 2, "3", 2)] and one["address_mod"] == [(1, 2, "201", 2)]
    second = spark.createDataFrame([(1, True, 9, None, "t2", [(10, "6")], None, "4", None, None, None, [(5, "1")]), (3, True, 9, "R", "t2", None, None, None, None, "2", None, None)], DONE)

    def broken(done):
        tables = child_tables(done)
        return tables | {"address_mod": tables["address_mod"].withColumn("ditm_nombre", F.raise_error(F.lit("unit table fails")).cast("string"))}

    with monkeypatch.context() as m:
        m.setattr("callejero.plans.load.child_tables", broken)
        with pytest.raises(Exception, match="unit table fails"):
            load_normalized(spark, path, second)
    assert told() == one
    assert load_normalized(spark, path, second) == 2
    two = told()
    assert two["address"][0] == (1, 9, None, True, "t2") and two["address"][2] == (3, 9, "R", True, "t2")
    assert two["address_via"] == [(1, 10, "6", 1), (1, 11, "S/N", 2)] and two["address_comp"] == [(1, 1, "A", 1), (1, 2, "4", 1), (3, 4, "2", 1)]
    assert two["address_mod"] == [(1, 2, "201", 2), (1, 5, "1", 1)]
    with pytest.raises(ValueError):
        load_normalized(spark, str(tmp_path / "other"), second)


def test_flat_export_holds_all_streets(spark):
    streets = "array<struct<via_nombre:string,divi_numero:string>>"
    fields = f"dire_id long, dire_es_procesado boolean, dire_referencia string, vias {streets}, componentes array<struct<codi_id:int,diti_valor:string>>, modulos array<struct<timo_id:int,ditm_nombre:string>>"
    rows = [(1, True, None, [(f"V{k}", str(k)) for k in range(5)], [], []), (2, None, "R", [], [(1, "A")], [])]
    flat = flat_export(spark.createDataFrame(rows, fields))
    got = {r["dire_id"]: r for r in flat.collect()}
    assert [got[1][f"via_{k}"] for k in range(1, 6)] == ["V0", "V1", "V2", "V3", "V4"] and got[1]["numero_5"] == "4" and got[2]["via_1"] is None
    assert "via_3" in flat_export(spark.createDataFrame(rows[1:], fields)).columns


def test_chains_end_outside_a_catalogue_that_stops_within_a_six(spark):
    from callejero.queries import chained

    for n, last in ((8, (8, 11, False)), (26, (26, None, True))):
        rows = {r["old_id"]: (r["old_id"], r["new_id"], r["cycle"]) for r in chained(spark.range(1, n + 1).withColumnRenamed("id", "via_id")).collect()}
        assert rows[n] == last and rows[6] == (6, 11, False) and set(rows) <= set(range(1, n + 1))
