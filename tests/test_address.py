from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from callejero.functions import extract as ex
from callejero.functions import lexicon as lx
from callejero.functions import text as tx
from callejero.functions.risk import with_complexity
from callejero.functions.similarity import seq_ratio
from callejero.operators import ingest as ig
from callejero.operators import load as ld
from callejero.operators import match as mt
from callejero.operators import views as vw
from callejero.plans.normalize import normalize
from callejero.sources import tables as st


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, part",
    [
        ("CHICLAYO-ELIAS AGUIRRE00305DPTO. 201", "ELIAS AGUIRRE"),
        ("CRISTOBAL COLON Nª 442", "N° 442"),
        ("MIRAFLORES II ETAPA-JUDAMZ.LLOTE 11", "MZ L LOTE 11"),
        ("CHICLAYOALFREDO LAPOINT 882  INT- I", "CHICLAYO ALFREDO"),
        ("CHICLAYOALFREDO LAPOINT 882  INT- I", "INT-I"),
        ("JR. SAENZ PEÑA340", "PEÑA 340"),
    ],
)
def test_sanitize(spark, raw, part):
    assert part in one(spark, tx.sanitize(F.col("t")), t=raw)


def test_sanitize_null_and_blank(spark):
    assert one(spark, tx.sanitize(F.col("t")), t=None) == ""
    assert one(spark, tx.sanitize(F.col("t")), t=" \t ") == ""


def test_numbers_and_units(spark):
    assert one(spark, tx.clean_number(F.col("t")), t="00839 - 00841") == "839-841"
    assert one(spark, tx.split_units(F.col("t")), t="1, 2 Y 3") == ["1", "2", "3"]
    assert one(spark, tx.split_units(F.col("t")), t="INT. B-C") == ["B", "C"]
    units = one(spark, ex.units(F.col("t")), t="CALLE REAL 5 INT. 17-19 DPTO 201")
    assert [(u["timo_id"], u["ditm_nombre"]) for u in units] == [(1, "17"), (1, "19"), (2, "201")]


def test_type_ids(spark):
    for word, id_ in {"MZ": 1, "LT": 2, "PISO": 4, "PREDIO": 5, "VALLE": 6, "BLOCK": 11}.items():
        assert one(spark, mt.match_type(F.col("t"), lx.COMPONENT_TYPES), t=word) == id_
    for word, id_ in {"INT": 1, "DPTO": 2, "PTA": 3, "STAND": 4, "TIENDA": 5, "BLOCK": None, "PUERTA.": 3, "TIENDA.": 5}.items():
        assert one(spark, mt.match_type(F.col("t"), lx.UNIT_TYPES), t=word) == id_


@pytest.mark.parametrize(
    "raw, trigger",
    [("CALLE REAL (EX CALLE LIMA) 5", "ALIAS_VIA_HISTORICA"), ("CALLE / AV. GRAU 3", "DOBLE_VIA_DISYUNTIVA"), ("BALTA 5 TIENDAS 3, 4, 5 Y 6", "MODULOS_MASIVOS_EN_LISTA"), ("AV. BALTA N° 500 URB. LOS FICUS", None)],
)
def test_risk(spark, raw, trigger):
    row = with_complexity(spark.createDataFrame([(raw,)], "t string"), "t").first()["risk"]
    assert row["triggers"] == ([trigger] if trigger else [])
    assert row["complex"] is bool(trigger)


def test_ratio_is_difflibs(spark):
    pairs = [("PORCUYA", "PORCULLA"), ("", ""), ("A", ""), ("SAN JOSE", "SAN JUAN"), (None, "A")]
    got = spark.createDataFrame(pairs, "a string, b string").select(seq_ratio("a", "b").alias("r")).collect()
    assert [g["r"] for g in got] == [None if a is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_ingest_twice_is_once(spark):
    src = spark.createDataFrame([("1", "A 1"), ("2", "B 2"), (None, "C 3"), (None, " ")], "id string, direccion string")
    first = ig.ingest(src, "s", "t", "id", "direccion")
    assert first.count() == 4
    assert ig.ingest_missing(src, first, "s", "t", "id", "direccion").count() == 0
    report = ig.ingest_report(src, first.limit(0), "s", "t", "id", "direccion").first()
    assert (report["total"], report["migrated"], report["remaining"]) == (4, 4, 0)


def test_consolidation(spark):
    catalog = spark.createDataFrame([(723, 2, "SAN LUCAS"), (1095, 4, "SAN LUCAS"), (1269, 4, "SAN  LUCAS ")], "via_id long, t int, n string")
    moves = ld.duplicate_map(catalog, "via_id", "t", "n")
    assert [tuple(r) for r in moves.collect()] == [(1269, 1095)]
    children = spark.createDataFrame([(1001, 1269), (1001, 1095), (1002, 1269)], "dire_id long, via_id long")
    assert sorted(tuple(r) for r in ld.repoint(children, moves, "via_id", "dire_id").collect()) == [(1001, 1095), (1002, 1095)]


def test_day_cycle_crosses_midnight(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-05-02 01:30:00' AS t").select(vw.day_cycle(F.col("t"), "22:00", "06:00").alias("c"))
    assert tuple(df.first()["c"]) == ("cycle_2024-05-01_22:00", True)


def test_source_columns():
    assert st.resolve_columns(["Predio_ID", "Domicilio"])["text"] == "Domicilio"
    assert st.resolve_columns(["x_id", "direccion_a"]) == {"id": "x_id", "text": "direccion_a", "status": None, "note": None}


def test_normalize_end_to_end(spark):
    vias = spark.createDataFrame([(1, 1, "BALTA", "S1", "F"), (2, 2, "SAN JOSE", "S1", "F")], "via_id long, id_tipo_via int, nom_via string, sector string, condicion string")
    zonas = spark.createDataFrame([(7, 6, "LOS FICUS", "S1")], "zona_id long, id_tipo_zona int, nom_zona string, sector string")
    raw = spark.createDataFrame([("s", "t", 1, "AV. BALTA N° 500 URB. LOS FICUS - CHICLAYO"), ("s", "t", 2, " "), ("s", "t", 3, "CALLE NADIE N° 5")], "src_schema string, src_table string, src_row_id long, raw_text string")
    rows = {r["src_row_id"]: r for r in normalize(raw, vias, zonas, fuzzy=False).collect()}
    assert rows[1]["es_procesado"] and (rows[1]["via_id"], rows[1]["zona_id"], rows[1]["num_via"]) == (1, 7, "500")
    assert not rows[2]["es_procesado"] and not rows[3]["es_procesado"] and rows[3]["via_id"] is None


def test_outside_district_keys(spark):
    none = F.lit(None).cast("string")
    keys = list(ex.OUTSIDE)
    assert len(keys) == 20
    texts = [f"AV. BALTA N° 5 - {k}" for k in keys] + ["CALLE PIMENTEL N° 5", "URB. LA VICTORIA MZ A", "AV. BALTA N° 5 - SANTA ROSA"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = ex.outside_district(F.col("t"), F.lit("BALTA"), none)
    got = [r["x"] for r in table.select("i", found.alias("x")).orderBy("i").collect()]
    want = [ex.OUTSIDE[k] for k in keys]
    assert got == [*want[:13], "ETEN", "ETEN", *want[15:], None, None, None]
    row = table.limit(1).select(
        ex.outside_district(F.lit("AV. BALTA 5 - JLO"), F.lit("BALTA"), none, none, F.lit("7")).alias("zone"),
        ex.outside_district(F.lit("AV. BALTA 5 JLO - CHICLAYO"), F.lit("BALTA"), none, F.lit("1"), none).alias("street"),
        ex.outside_district(F.lit("AV. BALTA 5 JLO - CHICLAYO"), F.lit("BALTA"), none, none, none).alias("neither"),
    ).first()
    assert tuple(row) == (None, None, "JOSE LEONARDO ORTIZ")
