"""Queries of the address operators over the derived tables, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract as ex
from .functions import lexicon as lx
from .functions import text as tx
from .functions.aliases import STREET_ALIASES
from .functions.risk import with_complexity
from .functions.similarity import seq_ratio
from .operators import answers as an
from .operators import ingest as ig
from .operators import load as ld
from .operators import match as mt
from .operators import roles as ro
from .operators import select as sl
from .operators import validate as va
from .operators import views as vw
from .plans.demo import demo_tables, with_views
from .plans.fuzzy_sql import candidates_sql
from .plans.load import child_tables
from .plans.normalize import extract_fields, normalize
from .session import cut
from .sources import tables as st
from .streaming.continuous import counts_by_window, progress_by_cycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the derived tables under a name, with its SQL."""

    def add(f: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(demo_tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


# ---- SQL pieces ----------------------------------------------------------------------------------------


def _nested(expr: str, rules: list[tuple[str, str]], options: str = "g") -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', '{options}')"
    return expr


_K = "MZ|MZA|LT|LOTE|INT|DPTO|KM|CDRA|CUADRA"
_RE2_RULES = [
    (r"([A-Z0-9])-([A-Z0-9])", r"\1 - \2"),
    *[(rf"\b{k}\.([A-Z])", rf"{v} \1") for k, v in list(lx.EXPANSIONS.items())[:3]],
    *[(rf"\b{k}(?:\.|\b)", v) for k, v in lx.EXPANSIONS.items()],
    (r"(\d+)(DPTO|DEP|DEPARTAMENTO|INT|INTERIOR|TDA|TIENDA|STAND|STD|PTO|PUESTO|LOCAL|LOC|OF|OFICINA|BLOCK|BLQ|PISO|PLANTA|MZ|MZA|LT|LOTE)\b", r"\1 \2"),
    (r"([A-Z]{2,})(MZ|MZA|LOTE)\b", r"\1 \2"),
    (r"([A-Z]{2,})(LT)([0-9.\s])", r"\1 \2\3"),
    (r"\b(MZ|MZA)\.?\s*([A-Z0-9])\s*(LT|LOTE)\b", r"\1 \2 \3"),
    (r"([A-Z]{3,})(0\d{2,5})", r"\1 \2"),
    (r"^(CHICLAYO|LAMBAYEQUE|FERRENAFE|PIMENTEL|LA VICTORIA|JLO|REQUE|MONSEFU)([A-Z])", r"\1 \2"),
    (rf"\b({_K})(\d{{1,6}})\b", r"\1 \2"),
    (r"\b([A-Z]{2,})0{0,5}([1-9]\d{0,5})\b", r"\1 \2"),
    (r"\b([A-Z]{2,})(\d{1,6})\b", r"\1 \2"),
    (r"\bINT\s*[-.]\s*([A-Z0-9]+)", r"INT-\1"),
    (r"\bDPTO\s*[-.]\s*([A-Z0-9]+)", r"DPTO-\1"),
    (r"\b(?:N|NUM|NRO)[°ºª.]*\s*(\d+)", r"N° \1"),
    (r"\b(?:N|NUM|NRO)[°ºª.]*\s*S/?N\b", "S/N"),
    *[(rf"^{t}\s+([A-Z])", rf"{t}. \1") for t in ("AV", "CA", "JR", "PJE")],
    (r"^\s*-\s*", ""),
    (r"\s*-\s*$", ""),
]


def _sane(expr: str) -> str:
    start = f"upper(trim(regexp_replace(coalesce({expr}, ''), '\\s+', ' ', 'g')))"
    return f"trim(regexp_replace({_nested(start, _RE2_RULES)}, '\\s+', ' ', 'g'))"


_CLEAN = f"clean AS (SELECT *, {_sane('raw_text')} AS clean FROM raw_addresses)"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_map = lambda pairs: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"
_null = lambda expr: f"nullif(trim({expr}), '')"
_get = lambda pattern, group=1: _null(f"regexp_extract(clean, '{pattern}', {group})")


def clean(t: dict[str, DataFrame]) -> DataFrame:
    return t["raw_addresses"].withColumn("clean", tx.sanitize(F.col("raw_text")))


def named(t: dict[str, DataFrame]) -> DataFrame:
    """src_row_id, raw_text and the written street of the addresses that have one; stored, or a filter would clean each text anew."""
    return cut(clean(t).select("src_row_id", "raw_text", tx.let(F.col("clean"), ex.street_name).alias("name"))).where("name is not null")


# ---- ingest and sources --------------------------------------------------------------------------------

_STORED = "src_schema AS dire_esquema, src_table AS dire_tabla, 'direccion' AS dire_columna, src_row_id AS dire_tabla_id, CASE WHEN trim(raw_text) <> '' THEN raw_text END AS dire_valor_origen, CAST(NULL AS BOOLEAN) AS dire_es_procesado, 'A' AS dire_estado"


@query("i1_ingest", f"SELECT {_STORED} FROM raw_addresses")
def _(t):
    src = t["raw_addresses"].withColumn("direccion", F.col("raw_text"))
    return ig.ingest(src, F.col("src_schema"), F.col("src_table"), "src_row_id", "direccion").drop("create_at")


_SOURCE = "src AS (SELECT CASE WHEN src_row_id % 19 = 0 THEN 'x' || CAST(src_row_id AS VARCHAR) ELSE CAST(src_row_id AS VARCHAR) END AS id_licencia, raw_text AS direccion FROM raw_addresses WHERE src_schema = 'licencias')"
_THERE = "there AS (SELECT dire_tabla_id, dire_valor_origen FROM central WHERE dire_esquema = 'licencias' AND dire_es_procesado IS NOT NULL)"
_FRESH = """fresh AS (
  SELECT try_cast(id_licencia AS BIGINT) AS dire_tabla_id, CASE WHEN trim(direccion) <> '' THEN direccion END AS dire_valor_origen FROM src)"""
_MISSING = """missing AS (
  SELECT * FROM fresh f WHERE (dire_tabla_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM there t WHERE t.dire_tabla_id = f.dire_tabla_id))
     OR (dire_tabla_id IS NULL AND NOT EXISTS (SELECT 1 FROM there t WHERE t.dire_tabla_id IS NULL AND t.dire_valor_origen IS NOT DISTINCT FROM f.dire_valor_origen)))"""


def _source(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    src = t["raw_addresses"].where("src_schema = 'licencias'")
    row = F.col("src_row_id").cast("string")
    src = src.select(F.when(F.col("src_row_id") % 19 == 0, F.concat(F.lit("x"), row)).otherwise(row).alias("id_licencia"), F.col("raw_text").alias("direccion"))
    return src, t["central"].where("dire_es_procesado is not null")


@query("i2_ingest_missing", f"WITH {_SOURCE}, {_THERE}, {_FRESH}, {_MISSING} SELECT dire_tabla_id, dire_valor_origen FROM missing")
def _(t):
    src, central = _source(t)
    return ig.ingest_missing(src, central, "licencias", "orders", "id_licencia", "direccion").select("dire_tabla_id", "dire_valor_origen")


@query("i3_ingest_report", f"""WITH {_SOURCE}, {_THERE}, {_FRESH}, {_MISSING},
n AS (SELECT (SELECT count(*) FROM src) AS total, (SELECT count(*) FROM there) AS before, (SELECT count(*) FROM missing) AS fresh),
m AS (SELECT *, CASE WHEN before >= total THEN 0 ELSE fresh END AS migrated FROM n)
SELECT total, before, migrated, before + migrated AS after, greatest(0, total - before - migrated) AS remaining FROM m""")
def _(t):
    src, central = _source(t)
    return ig.ingest_report(src, central, "licencias", "orders", "id_licencia", "direccion")


@query("s1_read_source", "SELECT src_row_id, raw_text, status, CAST(NULL AS VARCHAR) AS note FROM raw_addresses")
def _(t):
    src = t["raw_addresses"].select(F.col("src_row_id").alias("Predio_ID"), F.col("raw_text").alias("Domicilio"), F.col("status").alias("PROCESADO"))
    return st.read_source(src)


@query("s2_insert_missing", "SELECT src_row_id, raw_text FROM raw_addresses WHERE src_row_id % 2 = 0 UNION ALL SELECT src_row_id, upper(raw_text) FROM raw_addresses WHERE src_row_id % 2 <> 0")
def _(t):
    raw = t["raw_addresses"].select("src_row_id", "raw_text")
    return st.insert_missing(raw.withColumn("raw_text", F.upper("raw_text")), raw.where("src_row_id % 2 = 0"), ["src_row_id"])


@query("s6_metadata", "SELECT 'MUNICIPALIDAD' AS institucion, '2.0' AS version, count(*) AS total_registros, max(create_at) AS generado FROM central")
def _(t):
    return st.metadata(t["central"], "MUNICIPALIDAD", "2.0", F.max("create_at"))


@query("s7_preview", "SELECT src_row_id, coalesce(dire_valor_origen, '(Migrado)') AS direccion FROM (SELECT src_row_id FROM raw_addresses WHERE src_schema = 'rentas' ORDER BY src_row_id LIMIT 10) r LEFT JOIN central c ON c.dire_esquema = 'rentas' AND c.dire_tabla_id = r.src_row_id")
def _(t):
    src = t["raw_addresses"].where("src_schema = 'rentas'").select("src_row_id")
    return st.preview(src, t["central"], "rentas", "orders", "src_row_id", "direccion")


# ---- selection -----------------------------------------------------------------------------------------

for _mode, _where in (("pending", "IS NULL"), ("observed", "= FALSE"), ("valid", "= TRUE"), ("processed", "IS NOT NULL")):
    query(f"p1_status_{_mode}", f"SELECT dire_id, dire_valor_origen FROM central WHERE dire_es_procesado {_where}")(lambda t, m=_mode: sl.filter_status(t["central"], m).select("dire_id", "dire_valor_origen"))


@query("p2_origin", "SELECT dire_id, dire_esquema FROM central WHERE dire_esquema = 'rentas' AND dire_tabla = 'orders'")
def _(t):
    return sl.filter_origin(t["central"], "rentas", "orders").select("dire_id", "dire_esquema")


@query("p3_next_batch", "SELECT dire_id, dire_valor_origen FROM central WHERE dire_es_procesado IS NULL AND dire_id > 500 ORDER BY dire_id LIMIT 50")
def _(t):
    return sl.next_batch(sl.filter_status(t["central"], "pending"), "dire_id", 500, 50).select("dire_id", "dire_valor_origen")


@query("p3_page_at", "SELECT dire_id, dire_valor_origen FROM central WHERE dire_es_procesado IS NULL ORDER BY dire_id LIMIT 50 OFFSET 100")
def _(t):
    return sl.page_at(sl.filter_status(t["central"], "pending"), "dire_id", 100, 50).select("dire_id", "dire_valor_origen")


@query("p4_empty", "SELECT src_row_id FROM raw_addresses WHERE raw_text IS NULL OR trim(raw_text) = ''")
def _(t):
    return t["raw_addresses"].where(sl.is_empty(F.col("raw_text"))).select("src_row_id")


# ---- text functions ------------------------------------------------------------------------------------


@query("t1_sanitize", f"WITH {_CLEAN} SELECT src_row_id, clean FROM clean")
def _(t):
    return clean(t).select("src_row_id", "clean")


@query("t2_remove_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def _(t):
    return t["documents"].select("doc_id", F.md5(tx.remove_accents(F.col("text"))).alias("plain"))


_VARIANTS = [
    *[(rf"\b(?:{n}\s*(?:{s})|{r}|{n})\s+ETAPA\b|\bETAPA\s+(?:{n}(?:{s})|{r}|{n})\b", f"{w} ETAPA") for n, (w, r, s) in lx.STAGES.items()],
    (r"\b0+(\d+)\b", r"\1"),
    *[(rf"\b{w}\b", d) for w, d in lx.NUMBER_WORDS.items()],
]
_STAGED = "CASE src_row_id % 6 WHEN 0 THEN ' II ETAPA' WHEN 1 THEN ' ETAPA 3' WHEN 2 THEN ' 1RA ETAPA' WHEN 3 THEN ' NUEVE DE OCTUBRE' WHEN 4 THEN ' 007' ELSE '' END"


@query("t3_normalize_variants", f"WITH named AS (SELECT src_row_id, {_sane('raw_text || ' + _STAGED)} AS clean FROM raw_addresses) SELECT src_row_id, trim(regexp_replace({_nested('clean', _VARIANTS)}, '\\s+', ' ', 'g')) AS variant FROM named")
def _(t):
    staged = F.expr(f"raw_text || {_STAGED}")
    return t["raw_addresses"].select("src_row_id", tx.normalize_variants(staged).alias("variant"))


def _tokens_sql(name: str, stop: list[str]) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({name}, '[A-Z0-9]+'), lambda w: (len(w) > 1 OR regexp_matches(w, '^\\d+$')) AND NOT list_contains({_list(stop)}, w)))), ' ')"


@query("t4_sig_tokens", f"SELECT src_row_id, {_tokens_sql('upper(raw_text)', lx.STREET_STOPWORDS)} AS street, {_tokens_sql('upper(raw_text)', lx.ZONE_STOPWORDS)} AS zone FROM raw_addresses")
def _(t):
    joined = lambda kind: F.array_join(F.array_sort(tx.sig_tokens(F.col("raw_text"), kind)), " ")
    return t["raw_addresses"].select("src_row_id", joined("street").alias("street"), joined("zone").alias("zone"))


_CANON = [
    (r"\b(\d+)(?:ER|ERO|RO|RA|DO|DA|TO|TA|VO|VA|MO|MA)\b", r"\1"),
    (r"\b(?:P\.?P\.?\s*J\.?J\.?|P\.?J\.?)\b", " PUEBLO JOVEN "),
    (r"\b(?:A\.?A\.?\s*H\.?H\.?|A\.?H\.?)\b", " ASENTAMIENTO HUMANO "),
    (r"\bC\.?P\.?\b", " CENTRO POBLADO "),
    (r"\bU\.?R\.?B\.?\b", " URBANIZACION "),
    (r"[.,;:_/\-()\[\]#°]+", " "),
    (r"([A-Z]{2,})(\d+)", r"\1 \2"),
    (r"(\d+)([A-Z]{2,})", r"\1 \2"),
]
_CANON_SQL = f"""list_transform(list_filter(string_split(trim(regexp_replace({_nested("upper(coalesce(raw_text, ''))", _CANON)}, '\\s+', ' ', 'g')), ' '),
  lambda w: w <> '' AND NOT list_contains({_list(lx.TOKEN_NOISE + lx.TOKEN_STOPWORDS)}, w)),
  lambda w: CASE WHEN regexp_matches(w, '^\\d+$') THEN regexp_replace(w, '^0+(\\d)', '\\1')
            ELSE coalesce({_map(lx.TOKEN_FORMS)}[coalesce({_map(lx.TOKEN_ORDINALS)}[w], w)], coalesce({_map(lx.TOKEN_ORDINALS)}[w], w)) END)"""


@query("t5_canonical_tokens", f"SELECT src_row_id, array_to_string({_CANON_SQL}, '|') AS tokens FROM raw_addresses")
def _(t):
    return t["raw_addresses"].select("src_row_id", F.array_join(tx.canonical_tokens(F.col("raw_text")), "|").alias("tokens"))


@query("t6_common_prefix", "SELECT a.via_id, CAST(len(list_filter(generate_series(1, least(len(a.nom_via), len(b.nom_via))), lambda i: a.nom_via[1:i] = b.nom_via[1:i])) AS INT) AS n FROM via_catalog a JOIN via_catalog b ON b.via_id = a.via_id + 1")
def _(t):
    a, b = t["via_catalog"], t["via_catalog"].select((F.col("via_id") - 1).alias("via_id"), F.col("nom_via").alias("other"))
    return a.join(b, "via_id").select("via_id", tx.common_prefix_length(F.col("nom_via"), F.col("other")).alias("n"))


_UNITS_OF = "CASE src_row_id % 5 WHEN 0 THEN 'INT. B-C' WHEN 1 THEN '17-' || CAST(src_row_id AS STRING) WHEN 2 THEN '1, 2 Y 3' WHEN 3 THEN 'DPTO 201' ELSE 'A-LARGO' END"


@query("t7_split_units", f"""WITH v AS (SELECT src_row_id, regexp_replace(upper({_UNITS_OF}), '^(?:INT(?:ERIOR)?|DPTO|DEP(?:ARTAMENTO)?|TIENDAS?|TDA|STANDS?|STD|OF(?:ICINA)?|LOCAL(?:ES)?|PUESTO|PTO|PUERTA|PTA)[.\\s-]*', '') AS u FROM raw_addresses),
p AS (SELECT src_row_id, u, list_filter(string_split_regex(u, '\\s*(?:,|-|\\bY\\b)\\s*'), lambda x: x <> '') AS parts FROM v)
SELECT src_row_id, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda x: NOT regexp_full_match(x, '\\d+|[A-Z0-9]{{1,3}}'))) = 0 THEN array_to_string(parts, ',') ELSE u END AS units FROM p""")
def _(t):
    return t["raw_addresses"].select("src_row_id", F.array_join(tx.split_units(F.expr(_UNITS_OF)), ",").alias("units"))


@query("t8_clean_sublot", "SELECT src_row_id, CASE WHEN v NOT IN ('', '-', 'S/N') AND NOT regexp_matches(v, '\\b(DPTO|PISO)\\b') THEN v END AS slote FROM (SELECT src_row_id, CASE src_row_id % 6 WHEN 0 THEN 'A' || CAST(src_row_id AS VARCHAR) WHEN 1 THEN 'S/N' WHEN 2 THEN 'DPTO 3' WHEN 3 THEN '-' WHEN 4 THEN '2 PISO' ELSE 'B' END AS v FROM raw_addresses)")
def _(t):
    value = F.expr("CASE src_row_id % 6 WHEN 0 THEN 'sub lote: a' || CAST(src_row_id AS STRING) WHEN 1 THEN ' s/n ' WHEN 2 THEN 'DPTO 3' WHEN 3 THEN '-' WHEN 4 THEN '2 PISO' ELSE 'SLT. B' END")
    return t["raw_addresses"].select("src_row_id", tx.clean_sublot(value).alias("slote"))


@query("t9_clean_number", "SELECT src_row_id, CASE src_row_id % 5 WHEN 0 THEN CAST(src_row_id AS VARCHAR) || '-' || CAST(src_row_id + 2 AS VARCHAR) WHEN 1 THEN 'S/N' WHEN 2 THEN CAST(src_row_id AS VARCHAR) WHEN 3 THEN CAST(src_row_id AS VARCHAR) END AS num_via, CASE WHEN src_row_id % 5 = 3 THEN 'B' END AS letter FROM raw_addresses")
def _(t):
    value = F.expr("CASE src_row_id % 5 WHEN 0 THEN '00' || CAST(src_row_id AS STRING) || ' - 0' || CAST(src_row_id + 2 AS STRING) WHEN 1 THEN 's / n' WHEN 2 THEN 'N° 0' || CAST(src_row_id AS STRING) || ' INT 5' WHEN 3 THEN CAST(src_row_id AS STRING) || '-B' ELSE 'INT 7' END")
    return t["raw_addresses"].select("src_row_id", tx.clean_number(value).alias("num_via"), tx.number_letter(value).alias("letter"))


@query("t10_kilometre", "SELECT src_row_id, CASE WHEN src_row_id % 7 = 0 THEN 'KM ' || CAST(src_row_id AS VARCHAR) END AS km FROM raw_addresses")
def _(t):
    return t["raw_addresses"].select("src_row_id", tx.kilometre(F.expr("CASE WHEN src_row_id % 7 = 0 THEN 'Carretera Pimentel km ' || CAST(src_row_id AS STRING) || ' fundo' ELSE 'AV. KMARA 5' END")).alias("km"))


@query("t11_clean_reference", "SELECT src_row_id, CASE WHEN src_row_id % 3 = 0 THEN 'FRENTE AL PARQUE' END AS referencia FROM raw_addresses")
def _(t):
    value = F.expr("CASE src_row_id % 3 WHEN 0 THEN 'Frente al parque 2DO PISO' WHEN 1 THEN 'INT 5 3 PISO' ELSE 'OTRO LUGAR' END")
    return t["raw_addresses"].select("src_row_id", tx.clean_reference(value, F.lit("CALLE REAL 5 FRENTE AL PARQUE 2DO PISO")).alias("referencia"))


@query("t12_capped", "SELECT src_row_id, trim(left(raw_text, 20)) AS manzana, trim(left(raw_text, 50)) AS num_via FROM raw_addresses")
def _(t):
    return t["raw_addresses"].select("src_row_id", tx.capped(F.col("raw_text"), "manzana").alias("manzana"), tx.capped(F.col("raw_text"), "num_via").alias("num_via"))


@query("t13_record_state", "SELECT dire_id, CASE WHEN dire_id % 4 IN (1, 2) THEN 'I' ELSE 'A' END AS estado FROM central")
def _(t):
    value = F.expr("CASE dire_id % 4 WHEN 0 THEN 'ACT' WHEN 1 THEN 'ina' WHEN 2 THEN 'I' END")
    return t["central"].select("dire_id", tx.record_state(value).alias("estado"))


# ---- field extraction ----------------------------------------------------------------------------------


def field(name: str, column: Callable[[], F.Column], sql: str):
    query(name, f"WITH {_CLEAN} SELECT src_row_id, {sql} AS field FROM clean")(lambda t: clean(t).select("src_row_id", column().alias("field")))


_T = lambda: F.col("clean")
field("e1_street_type", lambda: ex.street_type(_T()), r"CASE WHEN regexp_matches(clean, '\b(AV|AVENIDA|AVDA)\b') THEN 1 WHEN regexp_matches(clean, '\b(CALLE|CA|CL)\b') THEN 2 WHEN regexp_matches(clean, '\b(JR|JIRON)\b') THEN 3 WHEN regexp_matches(clean, '\b(PJE|PASAJE|PSJ)\b') THEN 4 WHEN regexp_matches(clean, '\bAL\b') THEN 5 END")
_NAME_SQL = rf"""coalesce({_get(r"(?:^|\s)(?:AV\.|CA\.|JR\.|PJE\.|AL)\s+([A-Z .]+?)(?:\s+(?:N°|NUM|NRO|S/N|\d|\(|MZ|LT|,|-)|\s*$|\s*,|\s*-)")}, {_get(r"^CHICLAYO\s*-\s*([A-Z .-]+?)\s+(?:N°\s*)?(?:\d+|S/N)")})"""
field("e2_street_name", lambda: ex.street_name(_T()), _NAME_SQL)
_AFTER = rf"nullif(regexp_extract(substr(clean, strpos(clean, {_NAME_SQL}) + len({_NAME_SQL})), '^\s+(?:N°?\s*)?(\d+)\b', 1), '')"
field("e6_house_number", lambda: ex.house_number(_T(), ex.street_name(_T())), rf"CASE WHEN {_NAME_SQL} IS NOT NULL THEN CASE WHEN regexp_matches(clean, '\bS/N\b') THEN 'S/N' ELSE coalesce({_get(r'\bN°\s*(\d+)\b')}, {_AFTER}) END END")
field("e7_block", lambda: ex.block(_T()), _get(r"\bMZ\b\.?\s*([A-Z0-9]+)\b"))
field("e7_lot", lambda: ex.lot(_T()), _get(r"\bLT\b\.?\s*([A-Z0-9]+)\b"))
field("e8_zone_type", lambda: ex.zone_type(_T()), r"CASE WHEN regexp_matches(clean, '\bURB\b') THEN 6 END")
field("e9_zone_name", lambda: ex.zone_name(_T()), rf"""regexp_replace({_null("regexp_extract(clean, 'URB\\.?\\s+(SECTOR [A-Z]+ [0-9]+(?: FRENTE)?)', 1)")}, '\s+CHICLAYO$', '')""")
field("e10_reference", lambda: ex.reference(_T()), rf"coalesce({_get(r'\(([^)]+)\)')}, {_get(r'\b(FRENTE\s+AL?\s+[^,;()]+)')})")
field("e11_floor", lambda: ex.floor_number(_T()), _get(r"\b(\d+)\s*PISO\b"))
field("e12_tower", lambda: ex.tower(F.replace(_T(), F.lit("MZ B"), F.lit("TORRE B-2"))), r"CASE WHEN contains(clean, 'MZ B') THEN 'B-2' END")
field("e13_units", lambda: F.array_join(F.transform(ex.units(_T()), lambda u: F.concat_ws(":", u["timo_id"].cast("string"), u["ditm_nombre"])), ","), r"""coalesce(array_to_string(list_filter([
  CASE WHEN regexp_matches(clean, '\bINT-17 - 19\b') THEN '1:17,1:19' END, CASE WHEN regexp_matches(clean, '\bDPTO-201\b') THEN '2:201' END,
  CASE WHEN regexp_matches(clean, 'TIENDAS 3, 4, 5 Y 6') THEN '5:3,5:4,5:5,5:6' END], lambda x: x IS NOT NULL), ','), '')""")
field("e16_is_shop", lambda: ex.is_shop(F.replace(_T(), F.lit("TIENDAS 3"), F.lit("MERCADO MODELO 3"))), "contains(clean, 'TIENDAS 3')")
field("e18_unclear_unit", lambda: ex.unclear_unit(F.regexp_replace(_T(), "INT-17 - 19", "TIENDA METROPOLIS")), r"regexp_matches(clean, 'INT-17 - 19')")


@query("e4_zone_and_street")
def _(t):
    part = ex.zone_and_street(F.regexp_replace("clean", " - CHICLAYO$", ""))
    return clean(t).select("src_row_id", part["first"].alias("first"), part["second"].alias("second"), part["number"].alias("number"))


@query("e5_date_street", "SELECT src_row_id, CASE src_row_id % 4 WHEN 0 THEN '7 DE ENERO' WHEN 1 THEN '28 DE JULIO' END AS via FROM raw_addresses")
def _(t):
    text = F.expr("CASE src_row_id % 4 WHEN 0 THEN 'CALLE 7 DE ENERO 5' WHEN 1 THEN 'JR. 28 DE JULIO N° 9' WHEN 2 THEN 'URB. 9 DE OCTUBRE MZ A' ELSE 'CALLE REAL 5' END")
    return t["raw_addresses"].select("src_row_id", ex.date_street(text, F.lit("9 DE OCTUBRE")).alias("via"))


_DATE = r"concat_ws(' ', CASE substr(clean, 1, 1) WHEN 'C' THEN 'CALLE 7 DE ENERO' ELSE '28 DE JULIO' END, clean)"
_REST = f"substr({_DATE}, CASE substr(clean, 1, 1) WHEN 'C' THEN 17 ELSE 12 END)"
_BOTH = [r"\b(?:N°|NUM°?|NRO\.?|N)\s*(\d+)\b", r"\b(\d+)\b"]


@query("e5_date_street_parts", rf"""WITH {_CLEAN}, rest AS (SELECT src_row_id, clean, {_REST} AS r FROM clean)
SELECT src_row_id, CASE substr(clean, 1, 1) WHEN 'C' THEN '7 DE ENERO' ELSE '28 DE JULIO' END AS via,
  coalesce(nullif(regexp_extract(r, '{_BOTH[0]}', 1), ''), nullif(regexp_extract(r, '{_BOTH[1]}', 1), '')) AS numero,
  CASE WHEN regexp_matches(r, '{_BOTH[0]}') THEN nullif(regexp_extract(r, '{_BOTH[0]}\s*[-/]?\s*([A-Z])\b', 2), '')
    ELSE nullif(regexp_extract(r, '{_BOTH[1]}\s*[-/]?\s*([A-Z])\b', 2), '') END AS letra FROM rest""")
def _(t):
    df = clean(t).withColumn("clean", F.expr(_DATE))
    part = ex.date_street_parts(F.col("clean"), F.lit(None).cast("string"))
    return df.select("src_row_id", part["street"].alias("via"), part["number"].alias("numero"), part["letter"].alias("letra"))


@query("e14_corner_names", "SELECT src_row_id, CASE src_row_id % 3 WHEN 0 THEN 'BALTA' WHEN 1 THEN 'BALTA,GRAU' ELSE '' END AS esquinas FROM raw_addresses")
def _(t):
    text = F.expr("CASE src_row_id % 3 WHEN 0 THEN 'CALLE REAL ESQ. CON AV. BALTA 5' WHEN 1 THEN 'REAL CON BALTA N° 3 CRUCE GRAU' ELSE 'CALLE REAL 5' END")
    return t["raw_addresses"].select("src_row_id", F.array_join(ex.corner_names(text), ",").alias("esquinas"))


@query("e15_street_pieces", "SELECT via_id, nom_via || '|GRAU' AS piezas FROM via_catalog")
def _(t):
    return t["via_catalog"].select("via_id", F.array_join(ex.street_pieces(F.concat("nom_via", F.lit(" CON GRAU"))), "|").alias("piezas"))


@query("e19_outside_district", "SELECT src_row_id, CASE src_row_id % 3 WHEN 0 THEN 'PIMENTEL' END AS distrito FROM raw_addresses")
def _(t):
    text = F.expr("CASE src_row_id % 3 WHEN 0 THEN 'AV. BALTA N° 120 - PIMENTEL' WHEN 1 THEN 'CARRETERA PIMENTEL N° 5' ELSE 'AV. BALTA 5' END")
    return t["raw_addresses"].select("src_row_id", ex.outside_district(text, F.lit("BALTA"), F.lit(None).cast("string")).alias("distrito"))


# ---- risk ----------------------------------------------------------------------------------------------

_RISK = rf"""SELECT src_row_id, CAST(least(100, 40 * ex + 35 * lst + CASE WHEN n >= 135 THEN 40 WHEN n >= 110 THEN 25 WHEN n >= 95 THEN 10 ELSE 0 END
  + CASE WHEN fam >= 5 THEN 35 WHEN fam >= 4 THEN 20 ELSE 0 END + CASE WHEN del >= 5 THEN 15 ELSE 0 END) AS DOUBLE) AS score, ex + lst > 0 AS complex
FROM (SELECT src_row_id, CAST(regexp_matches(clean, '\bEX[-\s]+CALLE\b') AS INT) AS ex, CAST(regexp_matches(clean, '\bTIENDAS\s+[A-Z0-9]{{1,8}}(\s*(,|Y)\s*[A-Z0-9]{{1,8}}){{2,}}') AS INT) AS lst, len(clean) AS n,
  CAST(regexp_matches(clean, '\bN°\s*\d+\b|\bN\s*\d+\b|\bS/N\b') AS INT) + CAST(regexp_matches(clean, '\b(MZ|LT)\b') AS INT) + CAST(regexp_matches(clean, '\bPISO\b') AS INT)
  + CAST(regexp_matches(clean, '\b(INT|DPTO|TIENDA|LOCAL)\b') AS INT) AS fam, len(regexp_replace(clean, '[^-/(),]', '', 'g')) AS del FROM
  (SELECT src_row_id, {_sane('clean')} AS clean FROM clean))"""


@query("r1_complexity", f"WITH {_CLEAN} {_RISK}")
def _(t):
    return with_complexity(t["raw_addresses"], "raw_text").select("src_row_id", "risk.score", "risk.complex")


@query("r1_complexity_documents")
def _(t):
    return with_complexity(t["documents"].select("doc_id", "text"), "text").select("doc_id", "risk.score", "risk.complex", F.array_join("risk.triggers", ",").alias("triggers"))


@query("r2_route_complex", f"WITH {_CLEAN} SELECT complex, count(*) AS n FROM ({_RISK}) GROUP BY complex")
def _(t):
    return with_complexity(t["raw_addresses"], "raw_text").groupBy(F.col("risk.complex").alias("complex")).agg(F.count("*").alias("n"))


# ---- catalogue joins -----------------------------------------------------------------------------------

_word_types = lambda types: "CASE w " + " ".join(f"WHEN '{s}' THEN {i}" for i, t in types.items() for s in t[-1]) + " END"


def _type_query(name: str, types: dict, words: list[str]):
    case = "CASE src_row_id % " + f"{len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"
    query(name, f"SELECT src_row_id, w AS palabra, {_word_types(types)} AS id FROM (SELECT src_row_id, {case} AS w FROM raw_addresses)")(
        lambda t: t["raw_addresses"].select("src_row_id", F.expr(case).alias("palabra")).select("src_row_id", "palabra", mt.match_type(F.col("palabra"), types).alias("id"))
    )


_type_query("c1_street_type", lx.STREET_TYPES, ["AV.", "CALLE", "JR", "PSJ.", "NADA"])
_type_query("c2_component_type", lx.COMPONENT_TYPES, ["MZ", "LT", "PISO", "PREDIO", "VALLE", "BLOCK", "X"])
_type_query("c3_unit_type", lx.UNIT_TYPES, ["INT", "DPTO", "PTA", "STAND", "TIENDA", "BLOCK"])


@query("c4_name_index", "SELECT nom_via AS key, count(*) AS n, min(via_id) AS first FROM via_catalog GROUP BY nom_via")
def _(t):
    return mt.name_index(t["via_catalog"], "via_id", "nom_via").groupBy("key").agg(F.count("*").alias("n"), F.min("via_id").alias("first"))


# Each name has an alias, which has an alias, which has one; a fourth runs in a cycle with a fifth.
_ALIAS_CHAIN = """SELECT DISTINCT nom_via || ' UNO' AS alias, nom_via AS target FROM via_catalog UNION ALL SELECT DISTINCT nom_via || ' DOS', lower(nom_via) || '  uno' FROM via_catalog
UNION ALL SELECT DISTINCT nom_via || ' TRÉS', nom_via || ' DOS' FROM via_catalog UNION ALL SELECT DISTINCT nom_via || ' X', nom_via || ' Y' FROM via_catalog
UNION ALL SELECT DISTINCT nom_via || ' Y', nom_via || ' X' FROM via_catalog"""


@query("c4_alias_closure", """SELECT nom_via || s AS key, n, first FROM (SELECT nom_via, count(*) AS n, min(via_id) AS first FROM via_catalog GROUP BY nom_via), (VALUES (''), (' UNO'), (' DOS'), (' TRÉS'), (' TRES')) v(s)""")
def _(t):
    aliases = t["part"].sparkSession.sql(_ALIAS_CHAIN.replace("FROM via_catalog", "FROM {v}"), v=t["via_catalog"])
    return mt.name_index(t["via_catalog"], "via_id", "nom_via", aliases=aliases).groupBy("key").agg(F.count("*").alias("n"), F.min("via_id").alias("first"))


_RANKED = """SELECT q.name, q.sector_hint, v.via_id, row_number() OVER (PARTITION BY q.name, q.sector_hint ORDER BY
    CASE WHEN v.sector = q.sector_hint THEN 0 ELSE 1 END, CASE WHEN v.id_tipo_via = 1 THEN 0 ELSE 1 END, CASE WHEN v.condicion = 'F' THEN 0 ELSE 1 END, v.via_id) AS k
  FROM (SELECT DISTINCT 'AV. ' || nom_via AS name, nom_via, 'S1' AS sector_hint FROM via_catalog) q JOIN via_catalog v ON v.nom_via = q.nom_via"""


@query("c5_c6_exact_street", f"SELECT name, sector_hint, via_id FROM ({_RANKED}) WHERE k = 1")
def _(t):
    names = t["via_catalog"].select(F.concat(F.lit("AV. "), "nom_via").alias("name"), F.lit("S1").alias("sector_hint")).distinct()
    return mt.match_exact(names, mt.name_index(t["via_catalog"], "via_id", "nom_via"), "via_id", hint=None)


def _misspelt(t: dict[str, DataFrame], catalog: str, id_col: str, name_col: str) -> DataFrame:
    return t[catalog].select(F.concat(name_col, F.lit("S")).alias("name")).distinct()


def _scores(found: DataFrame, id_col: str) -> DataFrame:
    return found.select("name", id_col, F.col("rank").cast("long").alias("rank"), F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


@query("c7_zone_candidates", candidates_sql("SELECT DISTINCT replace(nom_zona, 'SECTOR', 'SECTORES') || ' NORTE' AS name FROM zona_catalog", "SELECT zona_id, nom_zona AS nom FROM zona_catalog", "zona_id", "zone", 5, 0.55))
def _(t):
    names = t["zona_catalog"].select(F.concat(F.replace("nom_zona", F.lit("SECTOR"), F.lit("SECTORES")), F.lit(" NORTE")).alias("name")).distinct()
    return _scores(mt.fuzzy_candidates(names, t["zona_catalog"], "zone", "zona_id", "nom_zona"), "zona_id")


@query("c8_street_candidates", candidates_sql("SELECT DISTINCT nom_via || 'S' AS name FROM via_catalog", "SELECT via_id, nom_via AS nom FROM via_catalog", "via_id", "street", 5, 0.55))
def _(t):
    return _scores(mt.fuzzy_candidates(_misspelt(t, "via_catalog", "via_id", "nom_via"), t["via_catalog"], "street", "via_id", "nom_via"), "via_id")


#: Names of three long words from every document; noisy: each word has lost its fifth letter, so none is shared.
_NOISY_SQL = """SELECT min(doc_id) AS via_id, nom FROM (SELECT doc_id, array_to_string(list_slice(list_transform(regexp_extract_all(text, '[A-Za-z]{6,9}'), lambda w: upper(w)), 1, 3), ' ') AS nom FROM documents) WHERE nom LIKE '% % %' GROUP BY nom"""


def long_names(documents: DataFrame) -> DataFrame:
    """via_id (the least document) and nom of every distinct name."""
    words = F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,9})"), F.lit(1)), 1, 3)
    return documents.select("doc_id", F.upper(F.array_join(words, " ")).alias("nom")).where("nom LIKE '% % %'").groupBy("nom").agg(F.min("doc_id").alias("via_id"))


def noisy(name: str) -> Column:
    return F.regexp_replace(name, "([A-Z]{4})[A-Z]([A-Z]*)", "$1$2")


@query("c8_noisy_names", candidates_sql(f"SELECT DISTINCT regexp_replace(nom, '([A-Z]{{4}})[A-Z]([A-Z]*)', '\\1\\2', 'g') AS name FROM ({_NOISY_SQL})", _NOISY_SQL, "via_id", "street", 5, 0.5))
def _(t):
    names = cut(long_names(t["documents"]))
    return _scores(mt.fuzzy_candidates(names.select(noisy("nom").alias("name")), names, "street", "via_id", "nom", min_score=0.5), "via_id")


@query("c9_accept_street", "SELECT name, via_id FROM (SELECT nom_via AS name, min(via_id) AS via_id FROM via_catalog GROUP BY nom_via)")
def _(t):
    names = t["via_catalog"].select(F.col("nom_via").alias("name")).distinct()
    return mt.accept_match(mt.fuzzy_candidates(names, t["via_catalog"], "street", "via_id", "nom_via"), "via_id").select("name", "via_id")


@query("c10_lookup_name", "SELECT dire_id, a.via_id, coalesce(v.nom_via, 'DESCONOCIDO') AS nom_via FROM address_via a LEFT JOIN via_catalog v ON v.via_id = a.via_id + 500")
def _(t):
    df = t["address_via"].withColumn("other", F.col("via_id") + 500)
    return mt.lookup_name(df, "other", t["via_catalog"], "via_id", "nom_via").select("dire_id", "via_id", "nom_via")


@query("c11_remap_ids", "SELECT dire_id, CASE WHEN via_id <= 100 THEN via_id + 5000 ELSE via_id END AS via_id FROM address_via")
def _(t):
    id_map = t["via_catalog"].where("via_id <= 100").select(F.col("via_id").alias("old_id"), (F.col("via_id") + 5000).alias("new_id"))
    return mt.remap_ids(t["address_via"], "via_id", id_map).select("dire_id", "via_id")


@query("c12_extend_catalog", "SELECT via_id, nom_via FROM via_catalog UNION ALL SELECT via_id + 100000, nom_via || ' NUEVA' FROM via_catalog WHERE via_id % 7 = 0")
def _(t):
    base = t["via_catalog"].select("via_id", "nom_via")
    new = base.where("via_id % 7 = 0").select((F.col("via_id") + 100000).alias("via_id"), F.concat("nom_via", F.lit(" NUEVA")).alias("nom_via"))
    return mt.extend_catalog(base, new.unionByName(base.where("via_id % 7 = 1")), "via_id", unique=False)


@query("c13_expand_synonyms", "SELECT via_id, array_to_string(list_sort([t || nom_via, s || nom_via]), '|') AS sinonimos FROM (SELECT *, CASE id_tipo_via WHEN 1 THEN 'AVENIDA ' WHEN 2 THEN 'CALLE ' WHEN 3 THEN 'JIRON ' ELSE 'PASAJE ' END AS t, CASE id_tipo_via WHEN 1 THEN 'AV. ' WHEN 2 THEN 'CA. ' WHEN 3 THEN 'JR. ' ELSE 'PJE. ' END AS s FROM via_catalog)")
def _(t):
    return mt.expand_synonyms(t["via_catalog"], "nom_via", "id_tipo_via").select("via_id", F.array_join("sinonimos", "|").alias("sinonimos"))


@query("c14_apply_choice", "SELECT nom_via AS name, max(via_id) AS via_id FROM via_catalog GROUP BY nom_via")
def _(t):
    names = t["via_catalog"].groupBy("nom_via").agg(F.max("via_id").alias("via_id")).withColumnRenamed("nom_via", "name")
    found = mt.fuzzy_candidates(names.select("name"), t["via_catalog"], "street", "via_id", "nom_via", k=100_000)
    return mt.apply_choice(found, names, "via_id").select("name", "via_id")


@query("h_seq_ratio", "SELECT via_id, 1.0 AS same, 0.0 AS none FROM via_catalog")
def _(t):
    return t["via_catalog"].select("via_id", seq_ratio("nom_via", "nom_via").alias("same"), seq_ratio("nom_via", F.translate("nom_via", "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "abcdefghijklmnopqrstuvwxyz_")).alias("none"))


# ---- rules and validation ------------------------------------------------------------------------------


def _normal(t: dict[str, DataFrame], **options) -> DataFrame:
    return normalize(t["raw_addresses"].drop("status", "create_at"), t["via_catalog"], t["zona_catalog"], **options)


@query("w1_normalize")
def _(t):
    df = _normal(t)
    return df.select("src_row_id", "es_procesado", "metodo", "via_id", "zona_id", "num_via", F.array_join("reasons", "; ").alias("motivos"))


@query("w1_load")
def _(t):
    return ld.flatten_children(_normal(t), "vias", "src_row_id", {"via_id": "via_id", "divi_numero": "divi_numero"}, "divi_orden")


def _extracted_children(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Components and units that extraction finds in each address, as W1 loads them."""
    rows = cut(clean(t)).where("clean != ''")
    found = cut(extract_fields(rows.select("clean").distinct()).withColumn("vias", F.lit(None).cast("array<struct<via_id:bigint,divi_numero:string>>")))
    return child_tables(rows.select(F.col("src_row_id").alias("dire_id"), "clean").join(found, "clean"))


_PARTS = rf"[{{'codi_id': 1, 'v': {_get(r'\bMZ\b\.?\s*([A-Z0-9]+)\b')}}}, {{'codi_id': 2, 'v': {_get(r'\bLT\b\.?\s*([A-Z0-9]+)\b')}}}, {{'codi_id': 4, 'v': {_get(r'\b(\d+)\s*PISO\b')}}}]"


@query("w1_load_components", f"""WITH {_CLEAN}, found AS (SELECT src_row_id, list_filter({_PARTS}, lambda x: x.v IS NOT NULL) AS parts FROM clean WHERE clean <> '')
SELECT src_row_id AS dire_id, parts[i].codi_id AS codi_id, parts[i].v AS diti_valor, CAST(i AS INT) AS diti_orden FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM found)""")
def _(t):
    return _extracted_children(t)["address_comp"]


@query("w1_load_units", f"""WITH {_CLEAN}, found AS (SELECT src_row_id, list_concat(list_concat(
  CASE WHEN regexp_matches(clean, '\\bINT-17 - 19\\b') THEN [{{'t': 1, 'v': '17'}}, {{'t': 1, 'v': '19'}}] ELSE [] END,
  CASE WHEN regexp_matches(clean, '\\bDPTO-201\\b') THEN [{{'t': 2, 'v': '201'}}] ELSE [] END),
  CASE WHEN regexp_matches(clean, 'TIENDAS 3, 4, 5 Y 6') THEN [{{'t': 5, 'v': '3'}}, {{'t': 5, 'v': '4'}}, {{'t': 5, 'v': '5'}}, {{'t': 5, 'v': '6'}}] ELSE [] END) AS units FROM clean WHERE clean <> '')
SELECT src_row_id AS dire_id, units[i].t AS timo_id, units[i].v AS ditm_nombre, CAST(i AS INT) AS ditm_orden FROM (SELECT *, unnest(range(1, len(units) + 1)) AS i FROM found)""")
def _(t):
    return _extracted_children(t)["address_mod"]


# Zones of the demo end in digits, which 'A - B n' takes for the number: here they are spelt with letters.
_LETTERED = "translate(nom_zona, '0123456789', 'ABCDEFGHIJ')"
_PAIRED = f"SELECT r.src_row_id, replace(r.name, ' LT', 'LT') AS name, z.zone, CAST(1 + r.src_row_id % 900 AS STRING) AS num FROM named r JOIN (SELECT zona_id, {_LETTERED} AS zone FROM zona_catalog) z ON z.zona_id = 1 + r.src_row_id % 25"
_KNOWN = "name IN (SELECT nom_via FROM via_catalog)"


def _named(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The written street of each address with a zone of the catalogue beside it, and that catalogue."""
    zonas = t["zona_catalog"].withColumn("nom_zona", F.expr(_LETTERED))
    pairs = t["zona_catalog"].sparkSession.sql(_PAIRED.replace("FROM named", "FROM {named}").replace("FROM zona_catalog", "FROM {zonas}"), named=named(t), zonas=t["zona_catalog"])
    return cut(pairs), zonas


def _by_text(t: dict[str, DataFrame], columns: dict[str, str], settle: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The pairs with the given columns; settle runs once per distinct text (`clean`)."""
    pairs, zonas = _named(t)
    pairs = pairs.select("src_row_id", *[F.expr(e).alias(c) for c, e in columns.items()])
    done = settle(cut(pairs.drop("src_row_id").distinct()), t["via_catalog"], zonas)
    return pairs.select("src_row_id", "clean").join(done, "clean")


@query("e4_settle_pair", f"""WITH {_CLEAN}, named AS (SELECT src_row_id, {_NAME_SQL} AS name FROM clean WHERE {_NAME_SQL} IS NOT NULL), pairs AS ({_PAIRED}), f AS (SELECT *, src_row_id % 4 AS form, {_KNOWN} AS known FROM pairs)
SELECT src_row_id, CASE WHEN form IN (1, 3) AND NOT known THEN zone ELSE name END AS nom_via, CASE WHEN form IN (1, 3) AND NOT known THEN name ELSE zone END AS nom_zona, CASE WHEN form < 2 THEN num END AS num_via FROM f""")
def _(t):
    none = "CAST(NULL AS STRING)"
    text = "CASE src_row_id % 4 WHEN 0 THEN zone || ' - ' || name || ' ' || num WHEN 1 THEN name || ' ' || num || ' - ' || zone WHEN 2 THEN zone || ' - ' || name ELSE name || ' - ' || zone END"
    return _by_text(t, {"clean": text, "nom_via": none, "nom_zona": none, "num_via": none}, ro.settle_pair).select("src_row_id", "nom_via", "nom_zona", "num_via")


@query("e15_settle_pieces", f"""WITH {_CLEAN}, named AS (SELECT src_row_id, {_NAME_SQL} AS name FROM clean WHERE {_NAME_SQL} IS NOT NULL), pairs AS ({_PAIRED}), f AS (SELECT *, src_row_id % 4 AS form, {_KNOWN} AS known FROM pairs)
SELECT src_row_id, CASE WHEN form = 3 OR (known AND form < 2) THEN name WHEN form = 0 THEN zone || ' - ' || name WHEN form = 1 THEN name || ' CON ' || zone WHEN known THEN name ELSE name || ' Y ' || name END AS nom_via,
  CASE WHEN known AND form < 2 THEN zone END AS nom_zona FROM f""")
def _(t):
    street = "CASE src_row_id % 4 WHEN 0 THEN zone || ' - ' || name WHEN 1 THEN name || ' CON ' || zone WHEN 2 THEN name || ' Y ' || name ELSE name END"
    columns = {"clean": street, "nom_via": street, "nom_zona": "CAST(NULL AS STRING)", "cruce": "CAST(NULL AS ARRAY<STRING>)"}
    return _by_text(t, columns, ro.settle_pieces).select("src_row_id", "nom_via", "nom_zona")


@query("e17_swap", f"""WITH {_CLEAN}, named AS (SELECT src_row_id, {_NAME_SQL} AS name FROM clean WHERE {_NAME_SQL} IS NOT NULL), pairs AS ({_PAIRED}), f AS (SELECT *, src_row_id % 4 AS form, {_KNOWN} AS known FROM pairs)
SELECT src_row_id, CASE WHEN form < 2 OR known THEN name WHEN form = 2 THEN NULL ELSE name END AS nom_via, CASE WHEN form = 2 THEN CASE WHEN known THEN NULL ELSE name END ELSE zone END AS nom_zona, CASE WHEN form = 3 OR (form = 0 AND known) THEN num END AS num_via FROM f""")
def _(t):
    columns = {
        "clean": "name || ', ' || zone || ' ' || num || CASE src_row_id % 4 WHEN 1 THEN ' A' WHEN 2 THEN ' B' WHEN 3 THEN ', ' || name || ' ' || num ELSE '' END",
        "nom_via": "CASE src_row_id % 4 WHEN 0 THEN zone WHEN 1 THEN name WHEN 3 THEN zone END", "nom_zona": "CASE src_row_id % 4 WHEN 0 THEN name WHEN 1 THEN zone WHEN 2 THEN name END",
        "num_via": "CAST(NULL AS STRING)", "referencia": "CASE src_row_id % 4 WHEN 3 THEN name || ' ' || num END",
    }
    return _by_text(t, columns, ro.swap_roles).select("src_row_id", "nom_via", "nom_zona", "num_via")


@query("w1_normalize_exact", f"""WITH {_CLEAN},
named AS (SELECT src_row_id, clean, {_NAME_SQL} AS name, CASE WHEN regexp_matches(clean, '\\b(AV|AVENIDA|AVDA)\\b') THEN 1 WHEN regexp_matches(clean, '\\b(CALLE|CA|CL)\\b') THEN 2 WHEN regexp_matches(clean, '\\b(JR|JIRON)\\b') THEN 3 WHEN regexp_matches(clean, '\\b(PJE|PASAJE|PSJ)\\b') THEN 4 WHEN regexp_matches(clean, '\\bAL\\b') THEN 5 END AS type,
  {_null("regexp_extract(clean, 'URB\\.?\\s+(SECTOR [A-Z]+ [0-9]+(?: FRENTE)?)', 1)")} AS zone FROM clean WHERE clean <> ''),
hinted AS (SELECT n.*, z.zona_id, z.sector AS hint FROM named n LEFT JOIN zona_catalog z ON z.nom_zona = n.zone),
keyed AS (SELECT DISTINCT name, type, hint FROM hinted WHERE name IS NOT NULL),
ranked AS (SELECT k.*, v.via_id, row_number() OVER (PARTITION BY k.name, k.type, k.hint ORDER BY CASE WHEN v.sector = k.hint THEN 0 ELSE 1 END, CASE WHEN v.id_tipo_via = k.type THEN 0 ELSE 1 END,
  CASE WHEN v.condicion = 'F' THEN 0 ELSE 1 END, v.via_id) AS k FROM keyed k JOIN via_catalog v ON v.nom_via = k.name)
SELECT h.src_row_id, h.zona_id, r.via_id FROM hinted h LEFT JOIN ranked r ON r.k = 1 AND r.name = h.name AND r.type IS NOT DISTINCT FROM h.type AND r.hint IS NOT DISTINCT FROM h.hint""")
def _(t):
    from .plans.normalize import match_fields

    rows = cut(clean(t)).where("clean != ''")
    df = match_fields(cut(extract_fields(rows.select("clean").distinct())), t["via_catalog"], t["zona_catalog"], fuzzy=False)
    return rows.join(df.select("clean", "zona_id", "via_id"), "clean").select("src_row_id", "zona_id", "via_id")


_FIELDS = """CASE WHEN src_row_id % 2 = 0 THEN 'REAL' END AS nom_via, CASE WHEN src_row_id % 3 = 0 THEN 6 ELSE 2 END AS tipo_via, CASE WHEN src_row_id % 4 = 0 THEN src_row_id END AS via_id,
  CASE WHEN src_row_id % 5 = 0 THEN '12' END AS num_via, CASE WHEN src_row_id % 7 = 0 THEN 'SECTOR A' END AS nom_zona, CAST(NULL AS INT) AS tipo_zona, CASE WHEN src_row_id % 14 = 0 THEN src_row_id END AS zona_id,
  CASE WHEN src_row_id % 11 = 0 THEN 'B' END AS manzana, CAST(NULL AS STRING) AS lote, CAST(NULL AS STRING) AS slote, CAST(NULL AS STRING) AS piso, CAST(NULL AS STRING) AS block, CAST(NULL AS STRING) AS referencia"""
_WHY = """array_to_string(list_filter([
  CASE WHEN nom_via IS NOT NULL AND via_id IS NULL THEN 'VIA NO CATALOGADA: REAL' END,
  CASE WHEN nom_zona IS NOT NULL AND zona_id IS NULL AND via_id IS NULL AND num_via IS NULL THEN 'ZONA NO CATALOGADA: SECTOR A' END,
  CASE WHEN manzana IS NOT NULL AND nom_zona IS NULL AND nom_via IS NULL THEN 'MANZANA O LOTE SIN ZONA' END,
  CASE WHEN tipo_via = 6 AND num_via IS NULL AND manzana IS NULL THEN 'CARRETERA SIN NUMERO' END,
  CASE WHEN nom_via IS NULL AND nom_zona IS NULL AND manzana IS NULL THEN 'NADA RECONOCIDO' END,
  CASE WHEN nom_via IS NULL AND (nom_zona IS NOT NULL OR manzana IS NOT NULL) AND NOT (zona_id IS NOT NULL AND manzana IS NOT NULL AND num_via IS NULL) THEN 'SIN VIA' END,
  CASE WHEN nom_via IS NOT NULL AND num_via IS NULL AND manzana IS NULL THEN 'INCOMPLETA' END], lambda x: x IS NOT NULL), '; ')"""


def _fields(t: dict[str, DataFrame]) -> DataFrame:
    df = t["raw_addresses"].selectExpr("src_row_id AS id", "'TEXTO' AS clean", *_split(_FIELDS))
    return df.withColumn("modulos", F.lit(None).cast("array<struct<timo_id:int,ditm_nombre:string>>")).withColumn("esquinas", F.lit(None).cast("array<string>"))


def _split(select: str) -> list[str]:
    """The items of a select list without nested commas."""
    return [x.strip() for x in select.replace("\n", " ").split(",")]


@query("v1_reasons", f"SELECT src_row_id AS id, {_WHY} AS motivos FROM (SELECT src_row_id, {_FIELDS} FROM raw_addresses)")
def _(t):
    df = _fields(t)
    return df.select("id", F.array_join(va.reasons(df), "; ").alias("motivos"))


@query("v2_settle", f"SELECT src_row_id AS id, m = '' AS es_procesado, CASE WHEN m = '' THEN via_id END AS via_id FROM (SELECT *, {_WHY} AS m FROM (SELECT src_row_id, {_FIELDS} FROM raw_addresses))")
def _(t):
    df = _fields(t)
    return va.settle(df.withColumn("reasons", va.reasons(df))).select("id", "es_procesado", "via_id")


@query("v3_rebuilt_text", f"""SELECT src_row_id AS id, concat_ws(' ', CASE WHEN nom_via IS NOT NULL THEN concat_ws(' ', CASE tipo_via WHEN 6 THEN 'CARRETERA' ELSE 'CALLE' END, nom_via, num_via) END,
  'MANZANA ' || manzana, '', '', nom_zona) AS texto FROM (SELECT src_row_id, {_FIELDS} FROM raw_addresses)""")
def _(t):
    return _fields(t).withColumn("modulos", F.array().cast("array<struct<timo_id:int,ditm_nombre:string>>")).withColumn("esquinas", F.array().cast("array<string>")).select("id", va.rebuilt_text().alias("texto"))


_quoted = lambda text: text.replace("'", "''")
_ALIASES = "[" + ", ".join(f"{{'alias': '{_quoted(a)}', 'target': '{_quoted(t)}'}}" for a, t in STREET_ALIASES.items()) + "]"
_ALSO = f"CASE WHEN split_part(clean, ' ', 2) <> '' THEN array_to_string(list_transform(list_filter({_ALIASES}, lambda a: contains(split_part(clean, ' ', 2), a.target) OR contains(a.target, split_part(clean, ' ', 2))), lambda a: a.alias), ' ') ELSE '' END"


@query("v4_coverage", f"""WITH {_CLEAN}, tok AS (SELECT src_row_id AS id, {_CANON_SQL.replace("raw_text", "clean")} AS raw, {_CANON_SQL.replace("coalesce(raw_text, '')", f"'AVENIDA ' || split_part(clean, ' ', 2) || ' ' || strip_accents({_ALSO})")} AS norm FROM clean WHERE clean <> '')
SELECT id, round(len(list_filter(raw, lambda w: list_contains(norm, w) OR w IN ('AVENIDA', 'CALLE', 'JIRON', 'PASAJE', 'PROLONGACION', 'CARRETERA', 'AUTOPISTA'))) / len(raw), 6) AS coverage FROM tok""")
def _(t):
    df = cut(clean(t)).where("clean != ''").select(F.col("src_row_id").alias("id"), "clean", F.coalesce(F.get(F.split("clean", " "), F.lit(1)), F.lit("")).alias("nom_via"), F.lit(None).cast("string").alias("nom_zona"), F.lit(None).cast("long").alias("zona_id"), F.array().cast("array<string>").alias("esquinas"))
    df = df.withColumn("rebuilt", F.concat(F.lit("AVENIDA "), "nom_via"))
    return va.coverage(df).select("id", F.round("coverage", 6).alias("coverage"))


@query("v5_validate")
def _(t):
    from .plans.normalize import addresses, clean_texts, match_fields

    df = cut(extract_fields(addresses(clean_texts(t["raw_addresses"])), risk=False))
    df = va.validate(cut(match_fields(df, t["via_catalog"], t["zona_catalog"], fuzzy=False)))
    return df.select("clean", "score", F.round("coverage", 6).alias("coverage"), F.round("sequence_ratio", 6).alias("ratio"), "valid", F.array_join("unmatched", " ").alias("unmatched"))


@query("v6_veto", "SELECT src_row_id AS id, src_row_id % 2 = 0 AS es_procesado, CASE WHEN src_row_id % 2 = 0 THEN 'M' ELSE 'M SIMILITUD_INSUFICIENTE (50.0%)' END AS metodo FROM raw_addresses")
def _(t):
    df = t["raw_addresses"].selectExpr("src_row_id AS id", "'M' AS metodo", "true AS es_procesado", "CAST(array() AS array<string>) AS reasons", "CASE WHEN src_row_id % 2 = 0 THEN 0.9 ELSE 0.5 END AS score", "src_row_id % 2 = 0 AS valid")
    return va.veto(df).select("id", "es_procesado", "metodo")


@query("v7_align_fields", f"SELECT src_row_id AS id, coalesce('1:' || manzana, '') AS componentes FROM (SELECT src_row_id, {_FIELDS} FROM raw_addresses)")
def _(t):
    return va.align_fields(_fields(t)).select("id", F.array_join(F.transform("componentes", lambda c: F.concat_ws(":", c["codi_id"].cast("string"), c["diti_valor"])), ",").alias("componentes"))


# ---- external extraction -------------------------------------------------------------------------------

_ANSWER = """CASE src_row_id % 5
  WHEN 0 THEN '{"vias":[{"nombre":" ' || lower(name) || '","tipo":"calle","num":"' || row || '"},"Grau"],"zona":"sol","Tipo_Zona":"H.U."}'
  WHEN 1 THEN '{"nombre_via":"' || name || '","NÚMERO":"' || row || '","Mz":"a","LT.":"' || row || '","Nivel":"piso 3","Torre":"torre c"}'
  WHEN 2 THEN '{"via":"Chiclayo","nom_zona":"Pimentel","componentes":[{"nombre":"sublote","valor":"SLT B' || row || '"},{"nombre":"nivel","valor":"2do"}],"modulos":[{"tipo_modulo":"TIENDA","valor":["3","' || row || '"]},{"tipo_modulo":"blq","valor":"D"}]}'
  WHEN 3 THEN '{"Sub LT.":"INT 5, 6","referencia":"2DO PISO FRENTE A ' || name || ' TORRE A - ","Dep.":"201"}' ELSE 'not json ' || name END"""
_NAMED_SQL = f"named AS (SELECT src_row_id, CAST(src_row_id AS VARCHAR) AS row, {_NAME_SQL} AS name FROM clean WHERE {_NAME_SQL} IS NOT NULL)"


def _parts_text(column: str, a: str, b: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x[a].cast("string"), x[b])), ",")


@query("l1_parse_extraction", f"""WITH {_CLEAN}, {_NAMED_SQL}, f AS (SELECT *, src_row_id % 5 AS form FROM named)
SELECT src_row_id, CASE WHEN form < 2 THEN name END AS nom_via, CASE WHEN form = 0 THEN 'CALLE' END AS tipo_via, CASE WHEN form < 2 THEN row END AS num_via,
  CASE form WHEN 0 THEN name || ',GRAU' WHEN 1 THEN name ELSE '' END AS vias, CASE WHEN form = 0 THEN 'SOL' END AS nom_zona, CASE WHEN form = 0 THEN 'URBANIZACION' END AS tipo_zona,
  CASE form WHEN 1 THEN 'MANZANA:A,LOTE:' || row || ',PISO:3,BLOCK:C' WHEN 2 THEN 'SUBLOTE:B' || row || ',PISO:2,BLOCK:D' WHEN 3 THEN 'PISO:2,BLOCK:A' ELSE '' END AS componentes,
  CASE form WHEN 2 THEN '5:3' || CASE WHEN row = '3' THEN '' ELSE ',5:' || row END WHEN 3 THEN '2:201,1:5,1:6' ELSE '' END AS modulos, CASE WHEN form = 1 THEN row END AS lote, CASE WHEN form = 2 THEN 'B' || row END AS slote,
  CASE form WHEN 1 THEN '3' WHEN 2 THEN '2' WHEN 3 THEN '2' END AS piso, CASE form WHEN 1 THEN 'C' WHEN 2 THEN 'D' WHEN 3 THEN 'A' END AS block, CASE WHEN form = 3 THEN 'FRENTE A ' || name END AS referencia FROM f""")
def _(t):
    df = an.parse_answers(cut(named(t).withColumn("row", F.col("src_row_id").cast("string")).select("src_row_id", F.expr(_ANSWER).alias("answer"))), "answer")
    return df.select("src_row_id", "nom_via", "tipo_via", "num_via", F.array_join("vias.nombre", ",").alias("vias"), "nom_zona", "tipo_zona", _parts_text("componentes", "nombre", "valor").alias("componentes"), _parts_text("modulos", "timo_id", "ditm_nombre").alias("modulos"), "lote", "slote", "piso", "block", "referencia")


@query("v7_align_lists", """WITH p AS (SELECT dire_id, max(CASE WHEN codi_id = 1 THEN diti_valor END) AS manzana, max(CASE WHEN codi_id = 2 THEN diti_valor END) AS lote, max(CASE WHEN codi_id = 3 THEN diti_valor END) AS sub,
  max(CASE WHEN codi_id = 4 THEN diti_valor END) AS piso, max(CASE WHEN codi_id = 11 THEN diti_valor END) AS block, count(*) AS n FROM address_comp GROUP BY dire_id), f AS (SELECT *, dire_id % 4 AS form, CAST(dire_id AS VARCHAR) AS row FROM p)
SELECT dire_id, manzana, lote, CASE form WHEN 2 THEN 'INT ' || row WHEN 3 THEN 'B' ELSE sub END AS slote, coalesce(CASE WHEN form = 0 THEN row END, piso) AS piso, coalesce(CASE WHEN form = 1 THEN 'C' END, block) AS block,
  CASE WHEN form = 0 THEN 'ESQUINA SOL' END AS referencia, CASE WHEN form = 2 THEN '1:' || row ELSE '' END AS modulos, row AS num_via,
  n + CASE WHEN form >= 2 AND sub IS NULL THEN 1 ELSE 0 END + CASE WHEN form = 0 AND piso IS NULL THEN 1 ELSE 0 END + CASE WHEN form = 1 AND block IS NULL THEN 1 ELSE 0 END AS partes FROM f""")
def _(t):
    parts = t["address_comp"].groupBy("dire_id").agg(F.array_sort(F.collect_list(F.struct("codi_id", "diti_valor"))).alias("componentes"))
    none, row = F.lit(None).cast("string"), F.col("dire_id").cast("string")
    sub = F.expr("CASE dire_id % 4 WHEN 0 THEN 'piso ' || CAST(dire_id AS STRING) || ' - esquina sol' WHEN 1 THEN 'SLT - TORRE C' WHEN 2 THEN 'INT ' || CAST(dire_id AS STRING) ELSE 'Sub Lote: B' END")
    df = parts.withColumns({**{c: none for c in ("manzana", "lote", "piso", "block", "referencia", "num_via")}, "slote": sub, "modulos": F.array().cast(an.UNITS), "vias": F.array(F.struct(row.alias("divi_numero")))})
    return an.align_lists(df).select("dire_id", "manzana", "lote", "slote", "piso", "block", "referencia", _parts_text("modulos", "timo_id", "ditm_nombre").alias("modulos"), "num_via", F.size("componentes").cast("long").alias("partes"))


@query("l2_evidence", f"WITH {_CLEAN}, {_NAMED_SQL} SELECT src_row_id, CASE WHEN src_row_id % 2 = 0 THEN name END AS nom_via FROM named")
def _(t):
    return named(t).select("src_row_id", va.with_evidence(F.when(F.col("src_row_id") % 2 == 0, F.col("name")).otherwise("CALLE QUETZALCOATL"), F.col("raw_text")).alias("nom_via"))


@query("l2_evidence_aliases", f"""WITH {_CLEAN}, {_NAMED_SQL} SELECT src_row_id, CASE WHEN src_row_id % 4 = 0 THEN 'PORCULLA' END AS nom_via,
  CASE src_row_id % 4 WHEN 0 THEN 'CERCADO DE CHICLAYO' WHEN 1 THEN 'URB. ' || name WHEN 3 THEN 'PROGRESIVA SAN JOSÉ OBRERO' END AS nom_zona, CASE WHEN src_row_id % 4 <> 2 THEN 'FRENTE A ' || name END AS referencia FROM named""")
def _(t):
    text = F.expr("concat(name, CASE src_row_id % 4 WHEN 0 THEN ' PORCUYA CERCADO' WHEN 1 THEN ' URB. ' || name WHEN 2 THEN ' 5' ELSE ' JOSE OBRERO' END)")
    zone = F.expr("CASE src_row_id % 4 WHEN 0 THEN 'CERCADO DE CHICLAYO' WHEN 1 THEN 'URB. ' || name WHEN 2 THEN name ELSE 'PROGRESIVA SAN JOSÉ OBRERO' END")
    ref = F.expr("CASE WHEN src_row_id % 4 = 2 THEN 'FRENTE AL QUETZALCOATL' ELSE 'FRENTE A ' || name END")
    return named(t).select("src_row_id", va.with_evidence(F.lit("PORCULLA"), text).alias("nom_via"), va.zone_with_evidence(zone, F.col("name"), text).alias("nom_zona"), va.reference_with_evidence(ref, text).alias("referencia"))


@query("l3_combine", "SELECT src_row_id, CASE WHEN src_row_id % 2 = 0 THEN 'IA' ELSE 'PROPIA' END AS nom_via, CASE WHEN src_row_id % 3 = 0 THEN '5' END AS num_via, CASE WHEN src_row_id % 2 <> 0 THEN 'HEURISTICA' WHEN src_row_id % 3 = 0 THEN 'HIBRIDO' ELSE 'IA' END AS metodo FROM raw_addresses")
def _(t):
    own = {"nom_via": F.lit("PROPIA"), "num_via": F.expr("CASE WHEN src_row_id % 3 = 0 THEN '5' END")}
    out, how = va.combine({"nom_via": F.expr("CASE WHEN src_row_id % 2 = 0 THEN 'IA' END")}, own)
    return t["raw_addresses"].select("src_row_id", *[c.alias(k) for k, c in out.items()], how.alias("metodo"))


@query("l4_verdict", "SELECT src_row_id AS id, CASE WHEN src_row_id % 4 = 0 THEN 'INCOMPLETA' WHEN src_row_id % 2 = 0 THEN 'Vía oficial: REAL' ELSE 'Sin coincidencia' END AS dictamen FROM raw_addresses")
def _(t):
    why = F.expr("CASE WHEN src_row_id % 4 = 0 THEN array('INCOMPLETA') ELSE CAST(array() AS array<string>) END")
    none = F.lit(None).cast("string")
    return t["raw_addresses"].select(F.col("src_row_id").alias("id"), va.verdict(why, F.expr("CASE WHEN src_row_id % 2 = 0 THEN 'REAL' END"), none, none).alias("dictamen"))


# ---- load and consolidation ----------------------------------------------------------------------------


@query("u1_flatten_children", "SELECT dire_id, via_id, CAST(row_number() OVER (PARTITION BY dire_id ORDER BY divi_orden, via_id) AS INT) AS divi_orden, divi_numero FROM address_via")
def _(t):
    nested = t["address_via"].groupBy("dire_id").agg(F.array_sort(F.collect_list(F.struct("divi_orden", "via_id", F.concat(F.lit(" "), "divi_numero").alias("divi_numero")))).alias("vias"))
    return ld.flatten_children(nested, "vias", "dire_id", {"via_id": "via_id", "divi_numero": "divi_numero"}, "divi_orden")


@query("u2_upsert", "SELECT dire_id, via_id, CASE WHEN dire_id % 2 = 0 THEN divi_numero || 'N' ELSE divi_numero END AS divi_numero FROM address_via")
def _(t):
    old = t["address_via"].select("dire_id", "via_id", "divi_numero")
    return ld.upsert(old, old.where("dire_id % 2 = 0").withColumn("divi_numero", F.concat("divi_numero", F.lit("N"))), ["dire_id", "via_id"])


@query("u3_update_central", "SELECT dire_id, CASE WHEN dire_id % 3 = 0 THEN TRUE WHEN dire_id % 3 = 1 THEN FALSE ELSE dire_es_procesado END AS dire_es_procesado, CASE WHEN dire_id % 3 = 0 THEN 7 WHEN dire_id % 3 = 2 THEN zona_id END AS zona_id, CASE WHEN dire_id % 3 = 0 THEN 'REF' WHEN dire_id % 3 = 2 THEN dire_referencia END AS dire_referencia FROM central")
def _(t):
    done = t["central"].where("dire_id % 3 < 2").selectExpr("dire_id", "dire_id % 3 = 0 AS es_procesado", "CAST(7 AS BIGINT) AS zona_id", "'REF' AS referencia", "create_at AS at")
    return ld.update_central(t["central"], done).select("dire_id", "dire_es_procesado", "zona_id", "dire_referencia")


@query("u4_write_back", "SELECT src_row_id, CASE WHEN src_row_id % 2 = 0 THEN src_row_id + 1000 END AS dire_id, CASE WHEN src_row_id % 2 = 0 THEN 'A' END AS manzana FROM raw_addresses")
def _(t):
    src = t["raw_addresses"].select("src_row_id")
    return ld.write_back(src, src.selectExpr("src_row_id", "src_row_id + 1000 AS dire_id", "src_row_id % 2 = 0 AS es_procesado", "'A' AS manzana"), "src_row_id", ["manzana"])


@query("u5_address_key", "SELECT count(*) AS n, count(*) AS keys FROM raw_addresses")
def _(t):
    key = ld.address_key(F.col("src_schema"), F.col("src_table"), F.col("src_row_id"), F.col("raw_text"))
    return t["raw_addresses"].agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


_DUPES = "SELECT v.via_id AS old_id, m.new_id FROM via_catalog v JOIN (SELECT id_tipo_via, nom_via, min(via_id) AS new_id FROM via_catalog GROUP BY id_tipo_via, nom_via) m ON m.id_tipo_via = v.id_tipo_via AND m.nom_via = v.nom_via WHERE v.via_id <> m.new_id"


@query("u6_duplicate_map", _DUPES)
def _(t):
    return ld.duplicate_map(t["via_catalog"], "via_id", "id_tipo_via", "nom_via")


# Chains of five steps over six neighbours; in every fifth six the last points back at the first.
@query("u6_transitive_map", """SELECT via_id AS old_id, CASE WHEN via_id // 6 % 5 = 4 THEN NULL ELSE via_id // 6 * 6 + 5 END AS new_id, via_id // 6 % 5 = 4 AS cycle
FROM via_catalog WHERE via_id % 6 < 5 OR via_id // 6 % 5 = 4""")
def _(t):
    return chained(t["via_catalog"])


def chained(catalog: DataFrame) -> DataFrame:
    """Where the catalogue's ids end; the last six is whole in the map, however few of it the catalogue has."""
    v, six = F.col("v"), F.expr("v div 6")
    whole = catalog.select(F.explode(F.expr("sequence(via_id div 6 * 6, via_id div 6 * 6 + 5)")).alias("v")).distinct()
    chains = whole.where((v % 6 < 5) | (six % 5 == 4)).select(v.alias("old_id"), F.when(v % 6 == 5, v - 5).otherwise(v + 1).alias("new_id"))
    known = catalog.select(F.col("via_id").alias("old_id"))
    ends, cycles = (found.join(known, "old_id", "left_semi") for found in ld.resolve_map(chains))
    return ends.withColumn("cycle", F.lit(False)).unionByName(cycles.select("old_id", F.lit(None).cast("long").alias("new_id"), F.lit(True).alias("cycle")))


@query("u7_repoint", f"""WITH m AS ({_DUPES}), moved AS (SELECT a.dire_id, coalesce(m.new_id, a.via_id) AS via_id, a.divi_numero, CASE WHEN m.old_id IS NULL THEN 0 ELSE 1 END AS moved, a.via_id AS was FROM address_via a LEFT JOIN m ON m.old_id = a.via_id)
SELECT dire_id, via_id, divi_numero FROM (SELECT *, row_number() OVER (PARTITION BY dire_id, via_id ORDER BY moved, was) AS k FROM moved) WHERE k = 1""")
def _(t):
    id_map = ld.duplicate_map(t["via_catalog"], "via_id", "id_tipo_via", "nom_via")
    return ld.repoint(t["address_via"].select("dire_id", "via_id", "divi_numero"), id_map, "via_id", "dire_id")


@query("u8_drop_orphans", "SELECT via_id, nom_via FROM via_catalog WHERE via_id <= 500 OR via_id IN (SELECT via_id FROM address_via WHERE dire_id % 3 = 0)")
def _(t):
    return ld.drop_orphans(t["via_catalog"].select("via_id", "nom_via"), t["address_via"].where("dire_id % 3 = 0"), "via_id", "via_id", 500)


@query("u9_align_types", """WITH e AS (SELECT CAST(n_nationkey AS INT) AS id, n_name AS nombre FROM nation), o AS (SELECT CAST(n_nationkey + 1 AS INT) AS id, n_name AS nombre FROM nation WHERE n_nationkey % 2 = 0),
j AS (SELECT e.id, o.id AS oid, e.nombre, t.id AS taken FROM e LEFT JOIN o ON o.nombre = e.nombre LEFT JOIN o t ON t.id = e.id), top AS (SELECT greatest((SELECT max(id) FROM e), (SELECT max(id) FROM o)) AS m)
SELECT id AS old_id, CAST(CASE WHEN oid IS NOT NULL THEN oid WHEN taken IS NOT NULL THEN m + row_number() OVER (PARTITION BY oid IS NULL, taken IS NOT NULL ORDER BY id) ELSE id END AS INT) AS new_id FROM j, top""")
def _(t):
    existing = t["nation"].selectExpr("n_nationkey AS id", "n_name AS nombre")
    official = t["nation"].where("n_nationkey % 2 = 0").selectExpr("n_nationkey + 1 AS id", "n_name AS nombre")
    return ld.align_types(existing, official)[1].select(F.col("old_id").cast("int").alias("old_id"), F.col("new_id").cast("int").alias("new_id"))


@query("u10_seed", "SELECT via_id, CASE WHEN via_id % 5 = 0 THEN nom_via || ' X' ELSE nom_via END AS nom_via FROM via_catalog")
def _(t):
    base = t["via_catalog"].select("via_id", "nom_via")
    return ld.seed(base, base.where("via_id % 5 = 0").withColumn("nom_via", F.concat("nom_via", F.lit(" X"))), "via_id")


@query("u11_dedupe_units", "SELECT l_orderkey AS dire_id, CAST(1 + l_suppkey % 6 AS INT) AS timo_id, 'A' AS ditm_nombre, max(l_linenumber) AS pos FROM lineitem GROUP BY l_orderkey, CAST(1 + l_suppkey % 6 AS INT)")
def _(t):
    units = t["lineitem"].selectExpr("l_orderkey AS dire_id", "CAST(1 + l_suppkey % 6 AS INT) AS timo_id", "'A' AS ditm_nombre", "l_linenumber AS pos")
    return ld.dedupe_units(units, "pos")


@query("u12_adopt_columns", "SELECT via_id, nom_via AS via_nombre, 'A' AS via_estado FROM via_catalog")
def _(t):
    return ld.adopt_columns(t["via_catalog"].select("via_id", "nom_via"), {"nom_via": "via_nombre"}, {"via_estado": F.lit("A")})


@query("u13_add_entries", "SELECT CAST(n_nationkey AS INT) AS id, n_name AS nombre, 'N.' AS abreviatura FROM nation UNION ALL SELECT CAST(24 + row_number() OVER (ORDER BY r_name) AS INT), r_name, 'R.' FROM region")
def _(t):
    base = t["nation"].selectExpr("CAST(n_nationkey AS INT) AS id", "n_name AS nombre", "'N.' AS abreviatura", "array(n_name) AS sinonimos")
    new = t["region"].selectExpr("r_name AS nombre", "'r' AS abreviatura", "array('X') AS sinonimos").unionByName(base.select("nombre", "abreviatura", "sinonimos").limit(3))
    return ld.add_entries(base, new).select("id", "nombre", "abreviatura")


# ---- views and reports ---------------------------------------------------------------------------------

_WIDE = """SELECT c.dire_id, c.dire_es_procesado, z.nom_zona, v1.via_id AS a, s1.nom_via AS via_1, v1.divi_numero AS numero_1, s2.nom_via AS via_2, s3.nom_via AS via_3 FROM central c
LEFT JOIN (SELECT dire_id, min(via_id) AS via_id, min_by(divi_numero, via_id) AS divi_numero FROM address_via WHERE divi_orden = 1 GROUP BY dire_id) v1 ON v1.dire_id = c.dire_id LEFT JOIN via_catalog s1 ON s1.via_id = v1.via_id
LEFT JOIN (SELECT dire_id, min(via_id) AS via_id FROM address_via WHERE divi_orden = 2 GROUP BY dire_id) v2 ON v2.dire_id = c.dire_id LEFT JOIN via_catalog s2 ON s2.via_id = v2.via_id
LEFT JOIN (SELECT dire_id, min(via_id) AS via_id FROM address_via WHERE divi_orden = 3 GROUP BY dire_id) v3 ON v3.dire_id = c.dire_id LEFT JOIN via_catalog s3 ON s3.via_id = v3.via_id
LEFT JOIN zona_catalog z ON z.zona_id = c.zona_id"""


def _wide(t: dict[str, DataFrame]) -> DataFrame:
    return vw.wide_view(t["central"], t["address_via"], t["via_catalog"], t["zona_catalog"])


@query("q1_wide_view", f"SELECT dire_id, nom_zona, via_1, numero_1, via_2, via_3 FROM ({_WIDE})")
def _(t):
    return _wide(t).select("dire_id", "nom_zona", "via_1", "numero_1", "via_2", "via_3")


_AGG = lambda table, fields, where="": f"(SELECT dire_id, string_agg(DISTINCT {fields}, ',' ORDER BY {fields}) AS x FROM {table} {where} GROUP BY dire_id)"
_VIA_TXT, _COMP_TXT, _MOD_TXT = "CAST(via_id AS VARCHAR) || ':' || divi_numero", "CAST(codi_id AS VARCHAR) || ':' || diti_valor", "CAST(timo_id AS VARCHAR) || ':' || ditm_nombre"


def _children(t: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[str]]]:
    vias = t["address_via"].join(t["via_catalog"].select("via_id", F.col("nom_via").alias("via_nombre")), "via_id", "left")
    return {"vias": (vias, ["divi_orden", "via_id", "divi_numero", "via_nombre"]), "componentes": (t["address_comp"], ["codi_id", "diti_valor"]), "modulos": (t["address_mod"], ["timo_id", "ditm_nombre"])}


def _text(array: str, a: str, b: str) -> F.Column:
    return F.array_join(F.array_sort(F.transform(array, lambda x: F.concat_ws(":", x[a].cast("string"), x[b]))), ",")


@query("q2_nested_view", f"""SELECT c.dire_id, coalesce(v.x, '') AS vias, coalesce(k.x, '') AS componentes, coalesce(m.x, '') AS modulos FROM central c LEFT JOIN {_AGG('address_via', _VIA_TXT)} v ON v.dire_id = c.dire_id
LEFT JOIN {_AGG('address_comp', _COMP_TXT, "WHERE estado = 'A'")} k ON k.dire_id = c.dire_id LEFT JOIN {_AGG('address_mod', _MOD_TXT)} m ON m.dire_id = c.dire_id""")
def _(t):
    nested = vw.nested_view(t["central"], _children(t))
    return nested.select("dire_id", _text("vias", "via_id", "divi_numero").alias("vias"), _text("componentes", "codi_id", "diti_valor").alias("componentes"), _text("modulos", "timo_id", "ditm_nombre").alias("modulos"))


@query("q3_source_view", f"SELECT r.src_row_id, r.raw_text, w.via_1 FROM raw_addresses r LEFT JOIN ({_WIDE}) w ON w.dire_id = r.src_row_id")
def _(t):
    src = t["raw_addresses"].select("src_row_id", "raw_text", F.col("src_row_id").alias("dire_id"))
    return vw.source_view(src, _wide(t)).select("src_row_id", "raw_text", "via_1")


_N = "count(*) AS total, count(*) FILTER (WHERE dire_es_procesado IS NULL) AS pendientes, count(*) FILTER (WHERE dire_es_procesado) AS validos, count(*) FILTER (WHERE NOT dire_es_procesado) AS observados"
query("q4_status_counts", f"SELECT {_N} FROM central")(lambda t: vw.status_counts(t["central"]))
query("q5_overview", f"SELECT dire_esquema, dire_tabla, {_N}, max(coalesce(update_at, create_at)) AS ultima FROM central GROUP BY dire_esquema, dire_tabla")(lambda t: vw.overview(t["central"]))
query("q6_global_counts", f"SELECT {_N}, count(DISTINCT dire_esquema || '.' || dire_tabla) AS fuentes FROM central")(lambda t: vw.global_counts(t["central"]))
query("q7_effectiveness", "SELECT dire_esquema, dire_tabla, round(100.0 * count(*) FILTER (WHERE dire_es_procesado) / count(dire_es_procesado), 2) AS efectividad FROM central GROUP BY dire_esquema, dire_tabla")(lambda t: vw.effectiveness(t["central"]))
query("q8_observed", "SELECT dire_id, dire_valor_origen, coalesce(dire_referencia, 'SIN OBSERVACION') AS nota FROM central WHERE NOT dire_es_procesado")(lambda t: vw.observed(t["central"]))
query("q9_transition", "SELECT CASE WHEN dire_es_procesado THEN 'CANONICA' WHEN NOT dire_es_procesado THEN 'SUGERENCIA' ELSE 'PENDIENTE' END AS etapa, count(*) AS total, count(dire_valor_origen) AS con_texto FROM central GROUP BY 1")(lambda t: vw.transition(t["central"]))
query("q10_run_summary", "SELECT dire_esquema AS metodo, count(*) AS procesados, count(*) FILTER (WHERE dire_es_procesado) AS validos, count(*) FILTER (WHERE NOT dire_es_procesado) AS observados FROM central GROUP BY dire_esquema")(
    lambda t: vw.run_summary(t["central"].select(F.col("dire_esquema").alias("metodo"), F.col("dire_es_procesado").alias("es_procesado")))
)


@query("q11_progress", """WITH per AS (SELECT event_type AS run, date_trunc('second', ts) AS "at", count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY 1, 2),
w AS (SELECT run, "at", sum(n) OVER (PARTITION BY run ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS done, sum(k) OVER (PARTITION BY run ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS valid,
  sum(n) OVER (PARTITION BY run) AS total, CAST(epoch("at") - epoch(min("at") OVER (PARTITION BY run)) AS BIGINT) AS seconds FROM per)
SELECT run, "at", CAST(done AS BIGINT) AS done, CAST(valid AS BIGINT) AS valid, CAST(total AS BIGINT) AS total, seconds, round(100.0 * done / total, 2) AS pct FROM w""")
def _(t):
    return vw.progress(t["events"], "event_type", "ts", F.col("value") > 50).select("run", "at", "done", "valid", "total", "seconds", "pct")


@query("q12_export_enrichment", f"SELECT c.dire_id, z.nom_zona, coalesce(v.x, '') AS vias FROM central c LEFT JOIN zona_catalog z ON z.zona_id = c.zona_id LEFT JOIN {_AGG('address_via', _VIA_TXT)} v ON v.dire_id = c.dire_id")
def _(t):
    nested = vw.nested_view(t["central"], {"vias": _children(t)["vias"]}).join(t["zona_catalog"].select("zona_id", "nom_zona"), "zona_id", "left")
    return nested.select("dire_id", "nom_zona", _text("vias", "via_id", "divi_numero").alias("vias"))


@query("q13_export_scope", "SELECT dire_id, CASE WHEN dire_es_procesado THEN 'NORMALIZADO' ELSE 'OBSERVADO' END AS estado FROM central WHERE dire_es_procesado IS NOT NULL")
def _(t):
    return sl.filter_status(t["central"], "procesados").select("dire_id", vw.export_status(F.col("dire_es_procesado")).alias("estado"))


@query("q14_enrich", "SELECT a.dire_id, a.via_id, v.nom_via, CASE v.id_tipo_via WHEN 1 THEN 'AVENIDA' WHEN 2 THEN 'CALLE' WHEN 3 THEN 'JIRON' WHEN 4 THEN 'PASAJE' END AS tipo_via_nombre, z.nom_zona FROM address_via a LEFT JOIN via_catalog v ON v.via_id = a.via_id LEFT JOIN zona_catalog z ON z.zona_id = 1 + a.dire_id % 25")
def _(t):
    src = t["address_via"].withColumn("zona_id", 1 + F.col("dire_id") % 25)
    types = mt.type_synonyms(src, lx.STREET_TYPES).select("id", "name").distinct()
    zone_types = t["region"].selectExpr("r_regionkey + 1 AS id", "r_name AS name")
    return vw.enrich(src, t["via_catalog"], t["zona_catalog"], types, zone_types).select("dire_id", "via_id", "nom_via", "tipo_via_nombre", "nom_zona")


@query("q15_header_sizes", "SELECT CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM address_via WHERE dire_id IN (SELECT dire_id FROM central) GROUP BY dire_id)) AS INT) AS max_vias, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM address_mod WHERE dire_id IN (SELECT dire_id FROM central) GROUP BY dire_id)) AS INT) AS max_modulos, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM address_comp WHERE estado = 'A' AND dire_id IN (SELECT dire_id FROM central) GROUP BY dire_id)) AS INT) AS max_componentes")
def _(t):
    return vw.header_sizes(vw.nested_view(t["central"], _children(t)))


@query("q16_flat_export", """SELECT c.dire_id, CASE WHEN c.dire_es_procesado THEN 'NORMALIZADO' WHEN NOT c.dire_es_procesado THEN 'OBSERVADO' ELSE 'PENDIENTE' END AS estado, k.diti_valor AS manzana
FROM central c LEFT JOIN address_comp k ON k.dire_id = c.dire_id AND k.codi_id = 1 AND k.estado = 'A'""")
def _(t):
    return vw.flat_export(vw.nested_view(t["central"], _children(t))).select("dire_id", "estado", "manzana")


@query("q17_nested_export", f"SELECT c.dire_id AS id, CASE WHEN c.dire_es_procesado THEN coalesce(m.x, '') END AS modulos FROM central c LEFT JOIN {_AGG('address_mod', _MOD_TXT)} m ON m.dire_id = c.dire_id")
def _(t):
    out = vw.nested_export(vw.nested_view(t["central"], _children(t)))
    return out.select("id", F.when(F.col("catastro").isNotNull(), _text("catastro.modulos", "timo_id", "ditm_nombre")).alias("modulos"))


@query("q18_day_cycle", "SELECT event_id, 'cycle_' || strftime(CASE WHEN strftime(ts, '%H:%M') < '06:00' THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y-%m-%d') || '_22:00' AS cycle, strftime(ts, '%H:%M') >= '22:00' OR strftime(ts, '%H:%M') < '06:00' AS inside FROM events")
def _(t):
    return t["events"].select("event_id", vw.day_cycle(F.col("ts"), "22:00", "06:00").alias("c")).select("event_id", "c.*")


@query("x3_counts_by_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS ok FROM events GROUP BY 1, 2")
def _(t):
    return counts_by_window(t["events"], "ts", "event_type", ok=F.col("value") > 50)


@query("x3_progress_by_cycle", """SELECT CAST(CASE WHEN strftime(ts, '%H:%M') < '06:00' THEN ts - INTERVAL 1 DAY ELSE ts END AS DATE) AS day, event_type, count(*) AS n,
  count(*) FILTER (WHERE strftime(ts, '%H:%M') >= '22:00' OR strftime(ts, '%H:%M') < '06:00') AS inside FROM events GROUP BY 1, 2""")
def _(t):
    return progress_by_cycle(t["events"], "ts", "event_type")
