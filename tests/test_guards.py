"""Patterns and aliases are looked at only where they can matter, and lose nothing by it."""

from pyspark.sql import functions as F

from callejero.functions import extract as ex
from callejero.functions import text as tx
from callejero.operators import validate as va

#: Every word that a pattern needs, alone, glued and in a sentence.
WORDS = [
    "URB", "URB.POP", "PUEBLO JOVEN", "P.J.", "PJ", "PP.JJ.", "A.H.", "AH", "AA.HH.", "ASENTAMIENTO HUMANO", "UPIS", "COOP.", "SECTOR", "CONDOMINIO", "RESIDENCIAL", "ASOC", "C.P.M", "CENTRO POBLADO", "CERCADO", "H.U.", "CONJ. HAB", "AV", "AVDA", "CALLE", "JIRÓN",
    "PSJ", "CRTA", "PRLG", "MALECÓN", "PLAZUELA", "MZ", "MZA", "MANZANA", "LT", "LOTE", "REF", "CERCA DE", "FRENTE AL", "AL COSTADO DEL", "A ESPALDAS DE", "A LA ALTURA DE", "A MEDIA CUADRA DE", "ENTRE", "CRUCE", "REAL PLAZA", "MALL AVENTURA", "BOULEVARD",
    "PISO", "BLOCK", "TORRE", "INT", "DPTO", "DEP", "PUERTA", "PTA", "STAND", "TDA", "OFICINA", "OF", "PTO", "LOCALES", "LC", "COCHERA", "ESTACIONAMIENTO", "CON", "ESQ.", "S/N", "N°", "PIMENTEL", "J.L.O.", "ETEN", "DISTRITO DE SANTA ROSA", "9 DE OCTUBRE", "28 DE JULIO",
]


def texts(spark):
    forms = [f for w in WORDS for f in (w, f"AV. GRAU {w} 12", f"CHICLAYO - {w} B 3 Y LIMA", f"X{w}9", f"LIMA - {w}", f"({w} BALTA), {w}5 - CHICLAYO")]
    return spark.createDataFrame([(x,) for x in [*forms, "", None]], "t string")


def fields():
    t, name = F.col("t"), ex.street_name(F.col("t"))
    zone = ex.zone_name(t)
    whole = [ex.street_type(t), name, zone, ex.zone_type(t), ex.reference(t), ex.house_number(t, name), ex.block(t), ex.lot(t), ex.floor_number(t), ex.tower(t), ex.units(t), ex.corner_names(t)]
    whole += [ex.date_street(t, zone), ex.formal_zone(t), ex.unclear_unit(t), ex.outside_district(t, name, zone), ex.outside_district(t, name, zone, F.lit(1), F.lit(None).cast("long"))]
    return [c.alias(f"c{i}") for i, c in enumerate(whole)]


def test_a_pattern_matches_only_where_its_words_are_written(spark, monkeypatch):
    df = texts(spark)
    got = df.select("t", *fields()).collect()
    monkeypatch.setattr(ex, "written", lambda text, words: F.lit(True))  # every pattern runs on every text
    want = df.select("t", *fields()).collect()
    assert got == want and all(any(r[i] not in (None, False, []) for r in got) for i in range(1, len(got[0])))


def test_steps_give_the_words_that_all_rules_give(spark):
    odd = ["1RA 2DA 3ER 10MO 5TA5 PPJJ P.J P. P. JJ AAHH A.H. CP C.P. U.R.B URB AV.GRAU12 12GRAU Ñ5 ÑÑ5 5ÑÑ Mz.B", "jirón ÁÉ́ 5º ª P J A H", "N° 5 ٣RA ٣AB AB٣", ""]
    df = spark.createDataFrame([(x,) for x in odd], "t string").union(texts(spark))
    rules = [r for _, step in tx.CANONICAL_STEPS for r in step]
    plain = lambda c: F.regexp_replace(F.translate(c, tx._MARKED, tx._PLAIN), r"\p{M}", "")
    rows = df.select(tx.squeeze(tx.apply_steps(F.upper(tx.remove_accents(F.col("t"))), tx.CANONICAL_STEPS)).alias("a"), tx.squeeze(tx.apply_rules(F.upper(plain(F.col("t"))), rules)).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"].startswith("1 2 3 10 5 TA 5 PUEBLO JOVEN")


def test_aliases_of_a_name_are_those_of_all_looked_through(spark):
    names = ["CUGLIEVAN", "JUAN CUGLIEVAN SUR", "AV. FRANCISCO BOLOGNESI", "BOLOGNESI", "NADA", "", None, "A"]
    df = spark.createDataFrame([(x,) for x in names], "n string")
    aliases = {"NICOLAS CUGLIEVAN": "JUAN CUGLIEVAN", "BOLOGNESI VIEJO": "AV. FRANCISCO BOLOGNESI"}
    got = [r["a"] for r in df.select(va._alias_words(F.array("n"), aliases).alias("a")).collect()]
    one, two = ["NICOLAS", "CUGLIEVAN"], ["BOLOGNESI", "VIEJO"]
    assert got == [one, one, two, two, [], [], [], one + two]
