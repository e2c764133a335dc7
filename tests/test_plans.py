"""Plans of the registered queries, and catalogues as inputs."""

import re

import pytest
from pyspark.sql import functions as F

from callejero.operators import match as mt
from callejero.plans.normalize import match_fields, normalize
from callejero.queries import QUERIES

SF = "/root/testdata/sf0.001"


#: Queries that number rows, or read the tables that do.
NUMBERED = ["c4_name_index", "u6_duplicate_map", "u9_align_types", "u13_add_entries", "q5_overview"]


@pytest.mark.parametrize("name", NUMBERED)
def test_no_window_over_all_rows(spark, name):
    """Each window has a partition."""
    whole = re.compile(r"windowspecdefinition\([^(),]+ (?:ASC|DESC) NULLS")
    assert whole.search(spark.range(3).selectExpr("row_number() OVER (ORDER BY id)")._jdf.queryExecution().analyzed().toString())
    assert not whole.search(QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString())


def test_aliases_settle_exactly(spark):
    vias = spark.createDataFrame([(1, 2, "ALEJANDRO HUMBOLDT", "S1", "F"), (2, 2, "PORCULLA", "S1", "F"), (3, 1, "QUIÑONES", "S1", "F")], "via_id long, id_tipo_via int, nom_via string, sector string, condicion string")
    zonas = spark.createDataFrame([(7, 6, "LOS FICUS", "S1")], "zona_id long, id_tipo_zona int, nom_zona string, sector string")
    aliases = spark.createDataFrame([("HUMBOLT", "VON HUMBOLDT"), ("VON HUMBOLDT", "Alejandro  Humboldt"), ("porcuya", "PORCULLA"), ("CAPITAN", "QUINONES"), ("PORCULLA", "QUIÑONES"), ("A", "B"), ("B", "A"), ("CHICLAYO", "PORCULLA"), (None, "PORCULLA")], "alias string, target string")
    index = {(r["key"], r["via_id"]) for r in mt.name_index(vias, "via_id", "nom_via", aliases=aliases).collect()}
    assert index == {("ALEJANDRO HUMBOLDT", 1), ("PORCULLA", 2), ("QUIÑONES", 3), ("QUINONES", 3), ("HUMBOLT", 1), ("VON HUMBOLDT", 1), ("PORCUYA", 2), ("CAPITAN", 3)}
    raw = spark.createDataFrame([("s", "t", 2, "CALLE PORCUYA N° 7")], "src_schema string, src_table string, src_row_id long, raw_text string")
    done = normalize(raw, vias, zonas, fuzzy=False, check=False, via_aliases=aliases)
    assert [r["via_id"] for r in done.collect()] == [2]
    # Cleaning takes the LT of 'HUMBOLT 5' for a lot, so this name reaches the catalogue where nothing follows it.
    fields = spark.createDataFrame([("HUMBOLT", 2, None, None)], "nom_via string, tipo_via int, nom_zona string, tipo_zona int")
    assert [r["via_id"] for r in match_fields(fields, vias, zonas, fuzzy=False, via_aliases=aliases).collect()] == [1]


@pytest.mark.parametrize("name", ["via_catalog", "raw_addresses"])
def test_demo_tables_are_written_once(spark, name):
    from callejero.plans.demo import demo_tables

    first, again = demo_tables(spark, SF)[name], demo_tables(spark, SF)[name]
    assert first.inputFiles() == again.inputFiles() and "Exchange" not in again.select(F.col(again.columns[0]))._jdf.queryExecution().executedPlan().toString()
