import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from callejero.functions import text as tx
from callejero.operators import answers as an
from callejero.operators import match as mt
from callejero.operators import validate as va
from callejero.sources import tables as st


def test_answers(spark):
    asked = [
        {"vias": [{"nombre": "Balta", "tipo_via": "Avenida", "numero": "5"}, {"via": "Grau"}, {"nombre": "Chiclayo"}], "confianza": "0.5"},
        {"via": "Chiclayo", "zona": "Pimentel", "componentes": [{"nombre": "Sub Lote", "valor": "slt"}, {"nombre": "SUBLOTE", "valor": "2do PISO"}, {"nombre": "Torre", "valor": "D"}], "block": "TORRE E"},
        {"via": "Chiclayo", "tipo via": "calle", "slote": "INT. B-C", "modulos": [{"tipo_modulo": "STAND", "valor": "METRO"}, {"tipo_modulo": "STAND", "valor": "[81]"}, {"tipo_modulo": "PTA", "valor": None}]},
        {"slote": "2DO. PISO ESQ. LIBERTAD", "ref": "1 PISO"},
    ]
    df = spark.createDataFrame([*[(i, json.dumps(a)) for i, a in enumerate(asked)], (4, "no json"), (5, None), (6, "[1]"), (7, "{}")], "i int, answer string")
    got = {r["i"]: r.asDict(True) for r in an.parse_answers(df, "answer").collect()}
    assert [(v["nombre"], v["tipo_via"], v["numero"]) for v in got[0]["vias"]] == [("BALTA", "AVENIDA", "5"), ("GRAU", None, None)]
    assert (got[0]["nom_via"], got[0]["num_via"], got[0]["confianza"]) == ("BALTA", "5", 0.5)
    assert got[1]["nom_via"] is None and got[1]["nom_zona"] is None and got[1]["piso"] == "2" and got[1]["block"] == "E"
    assert [(c["nombre"], c["valor"]) for c in got[1]["componentes"]] == [("PISO", "2"), ("BLOCK", "D")]
    assert got[2]["nom_via"] == "CHICLAYO" and got[2]["slote"] is None
    assert [(m["timo_id"], m["ditm_nombre"]) for m in got[2]["modulos"]] == [(4, "81"), (1, "B"), (1, "C")]
    assert (got[3]["piso"], got[3]["referencia"], got[3]["slote"]) == ("1", None, None)
    for i in (4, 5, 6, 7):
        assert (got[i]["nom_via"], got[i]["vias"], got[i]["componentes"], got[i]["modulos"]) == (None, [], [], [])


def test_align_lists_twice_is_once(spark):
    schema = f"id int, manzana string, lote string, slote string, piso string, block string, referencia string, componentes {an.COMPONENTS}, modulos {an.UNITS}"
    rows = [(1, "A", None, "PISO 3 FRENTE AL PARQUE", None, None, "X", [(2, "7"), (3, "slt")], None), (2, None, None, None, None, None, None, None, None), (3, None, "1", "DPTO 4", " ", "T", None, [(11, "S")], [])]
    once = an.align_lists(spark.createDataFrame(rows, schema))
    got = {r["id"]: r.asDict(True) for r in once.collect()}
    assert (got[1]["lote"], got[1]["piso"], got[1]["slote"], got[1]["referencia"]) == ("7", "3", None, "X FRENTE AL PARQUE")
    assert sorted((c["codi_id"], c["diti_valor"]) for c in got[1]["componentes"]) == [(1, "A"), (2, "7"), (4, "3")]
    assert got[2]["componentes"] == [] and got[2]["referencia"] is None
    assert got[3]["block"] == "T" and [(m["timo_id"], m["ditm_nombre"]) for m in got[3]["modulos"]] == [(2, "4")]
    assert {r["id"]: r.asDict(True) for r in an.align_lists(once).collect()} == got


def test_aliases_excuse_words(spark):
    fields = "id int, clean string, nom_via string, nom_zona string, zona_id int, esquinas array<string>, rebuilt string"
    rows = [(1, "AV. SANTA VICTORIA 5", "SESQUICENTENARIO", None, None, None, "AVENIDA SESQUICENTENARIO 5"), (2, "CALLE PORCUYA 5", "NADA", None, None, None, "CALLE NADA 5"), (3, "BALTA 5 QUIÑONES", "BALTA", "CAP. FAP JOSÉ QUIÑONES GONZALES - I ETAPA", 7, [], "BALTA 5")]
    got = {r["id"]: (r["coverage"], r["unmatched"]) for r in va.coverage(spark.createDataFrame(rows, fields)).collect()}
    assert got[1] == (1.0, []) and got[3] == (1.0, []) and got[2][1] == ["PORCUYA"]


@pytest.mark.parametrize("kind", ["street", "zone"])
def test_candidates_by_brute_force(spark, kind):
    """Every pair that shares a telling word or four leading letters, scored in Python by the same rule."""
    names = ["SAN JOSE", "SAN JOSE OBRERO", "SAN JUAN", "LOS ALAMOS", "PORCULLA", "9 DE OCTUBRE", "3 DE OCTUBRE", "LAS BRISAS", "LAS FRESAS", "MIRAFLORES II ETAPA", "BALTA"]
    asked = ["SAN JOSÉ OBREROS", "PORCUYA", "BALTAS", "9 DE OCTUBRES", "LAS BRISAS", "MIRAFLORES", "NADIE", "CHICLAYO", None]
    catalog = spark.createDataFrame(list(enumerate(names)), "id long, nombre string")
    queries = spark.createDataFrame([(n,) for n in asked], "name string")
    told = lambda df, c: {r[c]: (r["n"], set(r["t"])) for r in df.where(f"{c} is not null").select(c, tx.normalize_variants(F.col(c)).alias("n"), tx.sig_tokens(tx.normalize_variants(F.col(c)), kind).alias("t")).collect()}
    q, c = told(queries, "name"), told(catalog, "nombre")
    want = {}
    for name, (qn, qt) in q.items():
        for i, other in enumerate(names):
            cn, ct = c[other]
            one = len(qt) == len(ct) == 1
            letters = one and next(iter(qt))[:4] == next(iter(ct))[:4]
            numbers = [{t for t in s if t.isdigit()} for s in (qt, ct)]
            if not qt or not ct or qn == "CHICLAYO" or not (qt & ct or letters) or (all(numbers) and not numbers[0] & numbers[1]) or ("BRISAS" in qn and "FRESAS" in cn) or ("FRESAS" in qn and "BRISAS" in cn):
                continue
            ratio, share = SequenceMatcher(None, qn, cn).ratio(), len(qt & ct) / len(qt)
            if share == 0 and one and ratio >= 0.75:
                score = 0.5 + 0.5 * ratio if letters and len(next(iter(qt))) >= 4 and ratio >= 0.8 else 0.4 * ratio
            elif share >= 1:
                score = 0.82 + 0.18 * ratio - (0.05 * max(0, len(ct) - len(qt)) if kind == "zone" and "ETAPA" not in qn else 0)
            else:
                score = 0.5 * share + 0.5 * ratio if share >= 0.5 else 0.55 * ratio
            if score >= 0.55:
                want.setdefault(name, []).append((-round(score, 9), i))
    want = {n: [i for _, i in sorted(v)[:5]] for n, v in want.items()}
    got = {}
    for r in mt.fuzzy_candidates(queries, catalog, kind, "id", "nombre").orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append(r["id"])
    assert got == want and "PORCUYA" in got


def test_files_and_database(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "s", "t"), (2, None, "s", "u")], "id int, nombre string, dire_esquema string, dire_tabla string")
    st.write_normalized({"address": df, "kind": df.select("id")}, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n/address")).where("dire_tabla = 'u'").count() == 1
    st.write_csv_report(df, str(tmp_path / "c"))
    back = st.load_csv(spark, str(tmp_path / "c"), df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    assert sorted(r["id"] for r in back.collect()) == [1, 2]
    (tmp_path / "k.json").write_text('[{"id": 1, "nombre": "CALLE", "sinonimos": ["CA", "CL"]}]')
    assert st.load_catalog(spark, str(tmp_path / "k.json")).first()["sinonimos"] == ["CA", "CL"]
    st.write_json_report(df, str(tmp_path / "j"), st.metadata(df, "M", "1", F.max("id")))
    assert spark.read.json(str(tmp_path / "j/metadata")).first()["total_registros"] == 2
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    st.write_jdbc({"kind": df.select("id", "nombre")}, url)
    st.write_jdbc({"kind": df.select("id", "nombre").where("id = 2")}, url)
    assert sorted(r[0] for r in spark.read.jdbc(url, "kind").select("ID").collect()) == [1, 2, 2]
