import pytest
from pyspark.sql import functions as F

from callejero.operators import load as ld
from callejero.operators import roles as ro
from callejero.plans.normalize import normalize, settle_roles


@pytest.fixture(scope="module")
def catalogues(spark):
    vias = [(1, 1, "BALTA", "S1", "F"), (2, 2, "SAN JOSE", "S1", "F"), (3, 1, "LAS AMERICAS", "S2", "F"), (4, 2, "LUIS GONZALES", "S1", "F")]
    zonas = [(7, 6, "LOS FICUS", "S1"), (8, 6, "SAN NICOLAS", "S2"), (9, 6, "REMIGIO SILVA", "S2")]
    return (
        spark.createDataFrame(vias, "via_id long, id_tipo_via int, nom_via string, sector string, condicion string").cache(),
        spark.createDataFrame(zonas, "zona_id long, id_tipo_zona int, nom_zona string, sector string").cache(),
    )


def rows(spark, *found):
    return spark.createDataFrame(list(found), "clean string, nom_via string, nom_zona string, num_via string, referencia string")


def result(df, *columns):
    return {r["clean"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_pair_is_settled_by_number_then_catalogue(spark, catalogues):
    texts = {
        "SAN NICOLAS - LAS AMERICAS 705": ("LAS AMERICAS", "SAN NICOLAS", "705", None),
        "LAS AMERICAS 705 - SAN NICOLAS": ("LAS AMERICAS", "SAN NICOLAS", "705", None),
        "SAN NICOLAS - LAS AMERICAS": ("LAS AMERICAS", "SAN NICOLAS", None, None),
        "LAS AMERICAS - SAN NICOLAS": ("LAS AMERICAS", "SAN NICOLAS", None, None),
        "BALTA - SAN JOSE": ("BALTA", None, None, ["BALTA", "SAN JOSE"]),
        "NADIE - NINGUNA 3": ("NINGUNA", "NADIE", "3", None),
        "CHICLAYO - BALTA 5": (None, None, None, None),
        "": (None, None, None, None),
    }
    df = rows(spark, *[(t, None, None, None, None) for t in texts])
    assert result(ro.settle_pair(df, *catalogues), "nom_via", "nom_zona", "num_via", "cruce") == texts


def test_pieces(spark, catalogues):
    want = {"1": ("SAN JOSE", "LOS FICUS", None), "2": ("BALTA", "LOS FICUS", None), "3": ("BALTA", None, ["BALTA", "SAN JOSE"]), "4": ("BALTA Y NADIE", None, None), "5": ("BALTA", None, ["BALTA", "SAN JOSE", "LAS AMERICAS"]), "6": ("SAN JOSE", None, None)}
    names = ["LOS FICUS - SAN JOSE", "BALTA CON LOS FICUS", "BALTA Y SAN JOSE", "BALTA Y NADIE", "BALTA CRUCE SAN JOSE CON LAS AMERICAS", "SAN JOSE"]
    df = rows(spark, *[(str(i + 1), n, None, None, None) for i, n in enumerate(names)]).withColumn("cruce", F.lit(None).cast("array<string>"))
    assert result(ro.settle_pieces(df, *catalogues), "nom_via", "nom_zona", "cruce") == want


def test_swap(spark, catalogues):
    cases = {
        ("LOS FICUS, BALTA 12", "LOS FICUS", "BALTA", None, None): ("BALTA", "LOS FICUS", "12", None),
        ("AV. BALTA URB. LOS FICUS", "BALTA", "LOS FICUS", None, None): ("BALTA", "LOS FICUS", None, None),
        ("AV. LOS FICUS URB. BALTA", "LOS FICUS", "BALTA", None, None): ("LOS FICUS", "BALTA", None, None),
        ("BALTA 5 ESQ SAN JOSE", "BALTA", "SAN JOSE", "5", None): ("BALTA", None, "5", "ESQ. SAN JOSE"),
        ("REMIGIO SILVA 2 - LUIS GONZALES 00370", "REMIGIO SILVA", None, None, None): ("LUIS GONZALES", "REMIGIO SILVA", "370", None),
        ("REMIGIO SILVA", "REMIGIO SILVA", None, None, "SAN JOSE 8"): ("SAN JOSE", "REMIGIO SILVA", "8", None),
        ("REMIGIO SILVA - CHICLAYO", "REMIGIO SILVA", None, None, None): ("REMIGIO SILVA", None, None, None),
        ("BALTA", None, "BALTA", None, None): ("BALTA", None, None, None),
        ("NADIE EN NINGUNA", "NADIE", "NINGUNA", "1", "X"): ("NADIE", "NINGUNA", "1", "X"),
    }
    got = result(ro.swap_roles(rows(spark, *cases), *catalogues), "nom_via", "nom_zona", "num_via", "referencia")
    assert got == {k[0]: v for k, v in cases.items()}


def test_roles_of_no_rows(spark, catalogues):
    df = rows(spark).withColumn("slote", F.lit(None).cast("string"))
    assert settle_roles(df, *catalogues).count() == 0


def test_corner_is_loaded_as_two_streets(spark, catalogues):
    raw = [("s", "t", 1, "AV. BALTA N° 500 ESQ. SAN JOSE - CHICLAYO"), ("s", "t", 2, "SAN NICOLAS - LAS AMERICAS 705"), ("s", "t", 3, "CALLE NADIE N° 5"), ("s", "t", 4, None)]
    raw = spark.createDataFrame(raw, "src_schema string, src_table string, src_row_id long, raw_text string")
    done = normalize(raw, *catalogues, fuzzy=False)
    streets = ld.flatten_children(done, "vias", "src_row_id", {"via_id": "via_id", "divi_numero": "divi_numero"}, "divi_orden")
    assert sorted(tuple(r) for r in streets.collect()) == [(1, 1, "500", 1), (1, 2, "S/N", 2), (2, 3, "705", 1)]
    zone = {r["src_row_id"]: r["zona_id"] for r in done.collect()}
    assert zone == {1: None, 2: 8, 3: None, 4: None}
