"""The whole job by distinct text: cleaned once, not moved for its names, and every row stays."""

import pytest

from callejero.operators import roles as ro
from callejero.plans import normalize as nm


def test_texts_are_not_moved_for_their_names(spark):
    vias = spark.createDataFrame([(1, 2, "GRAU", "S1", "F")], "via_id long, id_tipo_via int, nom_via string, sector string, condicion string")
    zonas = spark.createDataFrame([(7, 6, "LOS FICUS", "S1")], "zona_id long, id_tipo_zona int, nom_zona string, sector string")
    columns = "clean string, nom_via string, nom_zona string, num_via string, referencia string"
    df = spark.createDataFrame([("LOS FICUS, GRAU 5", "LOS FICUS", "GRAU", None, None), ("CA GRAU", "GRAU", None, None, None)], columns)
    done = ro.swap_roles(df, vias, zonas)
    assert {(r["nom_via"], r["nom_zona"], r["num_via"]) for r in done.collect()} == {("GRAU", "LOS FICUS", "5"), ("GRAU", None, None)}
    assert "Exchange hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()  # two exchanges by text before


def test_a_text_is_cleaned_once_and_every_row_stays(spark, monkeypatch):
    vias = spark.createDataFrame([(1, 2, "GRAU", "S1", "F")], "via_id long, id_tipo_via int, nom_via string, sector string, condicion string")
    zonas = spark.createDataFrame([(7, 6, "LOS FICUS", "S1")], "zona_id long, id_tipo_zona int, nom_zona string, sector string")
    given = ["CALLE GRAU 12", "calle  grau 12", "CALLE GRAU 12", None, None, "  ", "", "\u200b", "\t", "CA. NADA 5"]
    raw = spark.createDataFrame([("s", "t", i, x) for i, x in enumerate(given)], "src_schema string, src_table string, src_row_id long, raw_text string")
    assert nm.clean_texts(raw.union(raw)).where("clean != ''").count() == 3
    done = {r["src_row_id"]: (r["clean"], r["es_procesado"], r["metodo"], r["via_id"]) for r in nm.normalize(raw, vias, zonas, fuzzy=False, check=False, route=False).collect()}
    assert len(done) == len(given) and done[0] == done[1] == done[2] and done[0][1:] == (True, "HEURISTICA", 1)
    assert {done[i] for i in range(3, 9)} == {("", False, "VACIA", None)} and done[9][1] is False


@pytest.mark.parametrize("risk", [True, False])
def test_fields_without_risk_are_the_same(spark, risk):
    df = spark.createDataFrame([("CALLE GRAU N° 12 - CHICLAYO",)], "clean string")
    row = nm.extract_fields(df, risk=risk).first()
    assert ("risk" in row.asDict()) is risk and row["num_via"] == "12" and row["metodo"] == "HEURISTICA"


def test_texts_are_dealt_over_all_cores(spark):
    raw = spark.createDataFrame([(f"CALLE GRAU {i}",) for i in range(200)], "raw_text string")
    assert nm.addresses(nm.clean_texts(raw)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one where bytes decided
