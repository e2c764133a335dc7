"""Rules run once a text, and only where they can match."""

from pyspark.sql import functions as F

from callejero import queries as qs
from callejero.functions import risk as rk
from callejero.functions import text as tx
from callejero.plans.demo import demo_tables

TEXTS = [
    "PISO3 AV BALTAMZ B LT.12", "MZA.CLT 5", "İNT.5-K 3İNT", "Km. 5 N°S/N NRO. 0012", "PORVENİRSIMON LORENZOPEDRO", "MCDO.CENTRAL STA.ROSA ESTA 3STD", "BALTA00123 CDRA.5", "CA BALTA-5 -", "- AV GRAU\t\n N", "SAGA I-RUN RİPLEY ESTILOS",
    "EX CALLE REAL, TİENDAS 3, 4, 5 Y 6", "U.C. N° 5 FUNDO", "CHICLAYOBALTA 5DPTO 3", "A 5 METROS DE CALLE/AV", "LOCAL A1-B22-C33", "", None,
]


def test_steps_give_what_all_rules_in_a_row_give(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    rules = [r for _, step in tx.SANITIZE_STEPS for r in step]
    printable = F.regexp_replace(F.coalesce("x", F.lit("")), r"[\p{C}\p{Z}&&[^ ]]", "")
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    rows = df.select(tx.sanitize(F.col("x")).alias("a"), plain(tx.apply_rules(F.upper(plain(printable)), rules)).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"] == "PISO 3 AV BALTA MZ B LT.12"


def test_what_a_trigger_needs_is_written_wherever_it_matches(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS if x], "x string")
    said = [F.array(*[F.upper("x").rlike(f"(?iU){p}") for p in patterns]) for _, patterns in rk.TRIGGERS.values()]
    rows = df.select(rk._found(F.upper("x"))["hits"].alias("h"), *[F.array_contains(c, True).alias(f"t{i}") for i, c in enumerate(said)]).collect()
    assert all(list(r["h"]) == list(r[1:]) for r in rows) and any(any(r["h"]) for r in rows)


def test_texts_are_cleaned_once_before_their_names_are_read(spark):
    for name in ("l2_evidence", "l2_evidence_aliases", "l1_parse_extraction"):
        plan = qs.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") < 120, name  # 476 where the filter and each rule cleaned the text anew


def test_words_are_looked_up_once(spark):
    df = spark.createDataFrame([("AV. PRIMERA DOS 007 MZ X 3RA BALTA",)], "x string").select(tx.canonical_tokens(F.col("x")).alias("t"))
    assert df.first()["t"] == ["AVENIDA", "1", "2", "7", "MANZANA", "10", "3", "BALTA"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("element_at(") == 2  # 3 where the second map read the first one twice


def test_a_text_that_no_rule_changes_is_cleaned_once(spark):
    df = spark.createDataFrame([(x,) for x in [*TEXTS, "uno\tdos  tres\u00a0\u2003x\u0000", " \u200b ", "PROSA SIN REGLAS", "\U0001f600 \u0149 \u01c5 \u00df"]], "x string")
    rows = df.select(tx.sanitize(tx.sanitize(F.col("x"))).alias("a"), tx.sanitize_twice(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    plan = lambda c: df.select(c.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tx.sanitize_twice(F.col("x"))).count("[^ -~]") == 1 and r"\s{2,}" not in plan(tx.sanitize(F.col("x")))  # each pass looked up every letter's category once and its white space twice


def test_what_a_family_needs_is_written_wherever_it_matches(spark):
    df = spark.createDataFrame([(x,) for x in [*TEXTS, "P\u0130SO 3 N\u0130VEL", "BLOC\u212a B", "REAL  PLAZA C.C", "LT. 5", "MZA B", "TORRE \u0130NTER\u0130OR", "C.C.", "S/N"] if x], "x string")
    said = [F.array(*[F.upper("x").rlike(f"(?iU){p}") for p in patterns]) for patterns in rk.FAMILIES]
    rows = df.select(rk._found(F.upper("x"))["families"].alias("n"), *[F.array_contains(c, True).cast("int").alias(f"f{i}") for i, c in enumerate(said)]).collect()
    assert [r["n"] for r in rows] == [sum(r[1:]) for r in rows] and sum(r["n"] for r in rows) > 8
    plan = df.select(rk._found(F.upper("x"))["families"].alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "BLOQUE)" in plan  # looked for before its pattern runs


def test_addresses_are_read_by_all_cores(spark):
    raw = demo_tables(spark, "/root/testdata/sf0.01")["raw_addresses"]
    assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one where one file of orders gave one file of addresses
