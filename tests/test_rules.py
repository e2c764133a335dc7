"""Rules of references, date streets, zones that are none, conflicts and pages."""

from pyspark.sql import functions as F

from callejero.functions import extract as ex
from callejero.operators import ingest, select
from callejero.operators import validate as va
from callejero.plans.normalize import normalize

UNITS = "array<struct<timo_id:int,ditm_nombre:string>>"


def test_date_street_with_number_and_letter(spark):
    cases = {
        "CALLE 7 DE ENERO 152 B": ("7 DE ENERO", "152", "B"), "INT 9 28 DE JULIO PISO 2 N° 410-C": ("28 DE JULIO", "410", "C"),
        "28 DE JULIO": ("28 DE JULIO", None, None), "CALLE REAL 5": (None, None, None), "": (None, None, None),
    }
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "t string").withColumn("p", ex.date_street_parts(F.col("t"), F.lit("URB LIMA")))
    got = {r["t"]: tuple(r["p"]) for r in df.collect()}
    assert got.pop(None) == (None, None, None) and got == cases


def test_references(spark):
    cases = {
        "AV. BALTA N° 5 ENTRE GRAU Y LORA, CHICLAYO": "ENTRE GRAU Y LORA", "BALTA CRUCE CON GRAU": "CRUCE CON GRAU", "BALTA 5 REF: CRUCE GRAU": "CRUCE GRAU",
        "ENTRE GRAU": None, "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["r"] for r in df.select("t", ex.reference(F.col("t")).alias("r")).collect()} == cases


def test_no_street(spark):
    names = {"CHICLAYO": True, "MZ B": True, "LOTE 4": True, "BALTA": False, "MZAREZ": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: bool(r["x"]) for r in df.select("n", ex.is_no_street(F.col("n")).alias("x")).collect()} == names


def test_zones_that_are_none(spark):
    # clean, nom_zona, zona_id, num_via, via_id, manzana, referencia -> nom_zona, num_via, referencia
    cases = [
        (("BALTA 120 - 0130", "0130", None, "120", 1, None, None), (None, "120-130", None)),
        (("BALTA 120 - 120", "120", None, "120", 1, None, None), (None, "120", None)),
        (("REAL PLAZA", "REAL PLAZA", None, "120", 1, None, "FRENTE"), (None, "120", "FRENTE - C.C. REAL PLAZA")),
        (("STAND AZUL", "STAND AZUL", None, None, None, None, None), (None, None, None)),
        (("BALTA 120 LAS LOMAS", "LAS LOMAS", None, "120", 1, None, None), (None, "120", "SECTOR: LAS LOMAS")),
        (("BALTA 120 URB. LAS LOMAS", "LAS LOMAS", None, "120", 1, None, None), ("LAS LOMAS", "120", None)),
        (("BALTA 120 LAS LOMAS MZ A", "LAS LOMAS", None, "120", 1, "A", None), ("LAS LOMAS", "120", None)),
        (("REAL PLAZA", "REAL PLAZA", 3, "120", 1, None, None), ("REAL PLAZA", "120", None)),
        (("", None, None, None, None, None, None), (None, None, None)),
    ]
    schema = "k int, clean string, nom_zona string, zona_id int, num_via string, via_id int, manzana string, referencia string"
    df = spark.createDataFrame([(k, *c[0]) for k, c in enumerate(cases)], schema).withColumn("lote", F.lit(None).cast("string")).withColumn("tipo_via", F.lit(None).cast("int"))
    df = df.withColumn("nom_via", F.lit("BALTA")).withColumn("esquinas", F.array().cast("array<string>"))
    got = {r["k"]: (r["nom_zona"], r["num_via"], r["referencia"]) for r in va.settle_zone(df).collect()}
    assert got == {k: c[1] for k, c in enumerate(cases)}


def test_two_streets_and_warning(spark):
    vias = spark.createDataFrame([(1, 3, "BALTA", None), (2, 3, "GRAU", None)], "via_id long, id_tipo_via int, nom_via string, sector string")
    zonas = spark.createDataFrame([(7, 6, "LOS FICUS", "S1")], "zona_id long, id_tipo_zona int, nom_zona string, sector string")
    texts = ["BALTA - GRAU", "CALLE BALTA N° 5 NO USAR LA VIA PUBLICA", "CALLE BALTA N° 5"]
    raw = spark.createDataFrame([("s", "t", str(i), x) for i, x in enumerate(texts)], "src_schema string, src_table string, src_row_id string, raw_text string")
    got = {r["src_row_id"]: r for r in normalize(raw, vias, zonas, fuzzy=False, check=False, route=False).collect()}
    assert any(x.startswith("CONFLICTO DE VIAS: BALTA / GRAU") for x in got["0"]["reasons"])
    assert "ADVERTENCIA: NO USAR LA VIA PUBLICA" in got["1"]["reasons"] and got["2"]["es_procesado"]


def test_pages_and_decoupling(spark):
    df = spark.range(10).repartition(3)
    assert [r["id"] for r in select.page_at(df, "id", 4, 3).collect()] == [4, 5, 6] and select.page_at(df, "id", 10, 3).count() == 0
    src = spark.createDataFrame([(1, "x")], "id int, dir string")
    report = lambda total, left: spark.createDataFrame([(total, left)], "total long, remaining long")
    assert ingest.decouple_source(src, report(1, 0), "dir").columns == ["id"]
    assert ingest.decouple_source(src, report(1, 1), "dir").columns == ingest.decouple_source(src, report(0, 0), "dir").columns == ["id", "dir"]
