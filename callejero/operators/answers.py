"""Answers of an external extraction: JSON text to canonical fields, and fields aligned with lists (L1, V7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import remove_accents
from ..session import cut
from .match import match_type

# What is no value of a unit.
UNIT_LABELS = ["LOCAL", "LOC", "TIENDA", "TDA", "STAND", "STD", "OFICINA", "OF", "INTERIOR", "INT", "DPTO", "DEP", "DEPARTAMENTO", "PUESTO", "PTO", "PUERTA", "PTA", "BLOCK", "BLQ", "TORRE", "PISO", "NIVEL"]
UNIT_BRANDS = ["METRO", "TOTTUS", "SODIMAC", "SAGA", "FALABELLA", "RIPLEY", "PLAZA VEA", "PLAZAVEA", "VEA", "MAESTRO", "PROMART", "OECHSLE", "WONG", "MAXI", "SUPERMERCADO", "HIPERMERCADO", "ESTILOS", "CURACAO", "EFE", "ELEKTRA", "TAMBO", "MASS", "OXXO", "INRETAIL"]
UNIT_NOISE = ["N", "NRO", "NUM", "PISO", "PISOS", "NIVEL", "CHICLAYO", "LAMBAYEQUE", "FERRENAFE", "PIMENTEL", "LA VICTORIA", "VICTORIA", "JLO", "REQUE", "MONSEFU", "LIMA", "PERU", "PERÚ"]
#: Keys of units written beside the list, and their type.
UNIT_KEYS = {"dep": 2, "dpto": 2, "int": 1, "stand": 4, "tda": 5, "tienda": 5, "puerta": 3, "oficina": 6, "of": 6, "puesto": 8}

_UNIT = r"\b(?:INT(?:ERIOR(?:ES)?)?|DPTO|DEP(?:ARTAMENTO)?|PUERTA|PTA|STAND|STD|TIENDA|TDA|OFICINA|OF|PUESTO|PTO|LOCAL|LOC)\b"
_UNIT_VALUES = rf"(?U)({_UNIT})\.?\s*[:-]?\s*([A-Z0-9]+(?:\s*(?:,|\bY\b|-)\s*(?!{_UNIT})[A-Z0-9]+)*)"
_SUBLOT = r"^(?:SUB[\s_-]*(?:LOTE|LT)|SLT|SLOTE|S/LT|S/L)\b\.?[\s:,-]*"
_NO_SUBLOT = r"^(?:|SIN\s+SUB\s*LOTE|NO|N/A|NA|NONE|NULL|-|\.)$"
_FLOOR = r"(?U)\bPISO\s*([A-Z0-9]+)\b|\b(\d+)(?:DO|ER|TO|VO|MO)?\.?\s*PISO\b"
_TOWER = r"(?U)\b(?:BLOCK|BLOQUE|BLQ|TORRE)\s*([A-Z0-9-]+)\b"
_PLACE = r"(?U)\b(?:ESQ|ESQUINA|FRENTE|ENTRE|CRUCE|ALTURA|CUADRA)\b"

PARTS = "array<struct<nombre:string,valor:string>>"
UNITS = "array<struct<timo_id:int,ditm_nombre:string>>"


def _filled(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _strip(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, r"^[\s/,.-]+|[\s/,.-]+$", ""), F.lit(""))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _first(pairs: Column, name: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["nombre"] == name), F.lit(0))["valor"]


def _floor(text: Column) -> Column:
    return F.coalesce(_group(text, _FLOOR), _group(text, _FLOOR, 2))


def _digits(text: Column) -> Column:
    return F.coalesce(_group(text, r"(\d+)"), text)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit_values(value: Column) -> Column:
    """The values of a unit: lists and ranges split if all parts are numbers or short codes; labels and brands give none."""
    brand = lambda x: x.rlike("|".join(UNIT_BRANDS))
    noise, none = [*UNIT_NOISE, *UNIT_LABELS], F.array().cast("array<string>")

    def split(v: Column) -> Column:
        parts = F.filter(F.split(v, r",\s*|\s+Y\s+|\s*-\s*"), lambda p: (p != "") & ~p.isin(noise) & ~brand(p) & ((F.char_length(p) <= 5) | p.rlike(r"^\d+$")))
        return F.when(v.isin(["", *noise]) | brand(v), none).otherwise(_let(parts, lambda p: several(v, p)))

    def several(v: Column, parts: Column) -> Column:
        short = F.forall(parts, lambda p: p.rlike(r"^(?:\d+|[A-Z0-9]{1,3})$"))
        return F.when(F.size(parts) <= 1, F.array(v)).when(short, parts).otherwise(none)

    bare = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), r"[\[\]()'\"]", ""), r"^(?:N°\.?|NUM°?\.?|NRO\.?|N\s+)", ""))
    return _let(bare, split)


def _units(kind: Column, value: Column) -> Column:
    """(timo_id, value) of every value of one unit; nothing without a value."""
    return F.coalesce(F.transform(unit_values(value), lambda v: F.struct(kind.alias("timo_id"), v.alias("ditm_nombre"))), F.array().cast(UNITS))


def sublot_units(text: Column) -> Column:
    """Units that are written in a sublot."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(_UNIT_VALUES), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(_UNIT_VALUES), F.lit(2)).alias("v"))
    return F.flatten(F.transform(found, lambda p: _units(match_type(F.regexp_replace(p["k"], "ES$", ""), lx.UNIT_TYPES), p["v"])))


def sublot(text: Column) -> Column:
    """A sublot without its prefix; placeholders give null."""
    v = F.regexp_replace(text, _SUBLOT, "")
    return F.when(~v.rlike(_NO_SUBLOT), _strip(v))


def parse_answers(df: DataFrame, answer: str) -> DataFrame:
    """L1: df with the fields of an answer in JSON: vias, nom_via, tipo_via, num_via, nom_zona, tipo_zona, componentes,
    modulos, manzana, lote, slote, piso, block, referencia, confianza and observaciones.

    Keys count without case, accents, underscores and last dot. Lists come first, flat keys fill what they lack. Cities
    are no streets without a type and no zones. Units, floors and towers leave the sublot and the reference. Text that
    is no JSON object gives nulls and empty lists.
    """
    key = lambda k: F.rtrim(remove_accents(F.lower(F.replace(k, F.lit("_"), F.lit(" ")))), F.lit("."))
    entries = F.transform(F.map_entries(F.from_json(F.col(answer), "map<string,string>")), lambda e: F.struct(key(e["key"]).alias("k"), F.trim(e["value"]).alias("v")))
    df = df.withColumn("_said", F.filter(entries, lambda e: e["v"] != ""))
    value_of = lambda name: F.get(F.filter("_said", lambda e: e["k"] == name), F.lit(0))["v"]
    raw = lambda *names: F.coalesce(*map(value_of, names))
    said = lambda *names: F.upper(raw(*names))
    listed = lambda name, kind: F.coalesce(F.from_json(raw(name), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))

    via = "nombre string, nom_via string, via string, tipo_via string, tipo string, numero string, num_via string, num string"
    street = lambda name, kind, number: F.struct(_filled(F.upper(name)).alias("nombre"), _filled(F.upper(kind)).alias("tipo_via"), _filled(number).alias("numero"))

    def one(text: Column) -> Column:
        v = F.from_json(text, via)
        return F.when(text.startswith("{"), street(F.coalesce(v["nombre"], v["nom_via"], v["via"]), F.coalesce(v["tipo_via"], v["tipo"]), F.coalesce(v["numero"], v["num_via"], v["num"]))).otherwise(street(text, F.lit(None).cast("string"), F.lit(None).cast("string")))

    city = lambda name: name.isin(lx.CITIES) | remove_accents(name).isin(lx.CITIES)
    flat = street(raw("nom via", "nombre via", "nombre de via", "via", "calle"), raw("tipo via detectado", "tipo via", "tipovia", "tipo de via"), raw("num via", "numero via", "numero", "num", "nro"))
    named = F.filter(F.transform(listed("vias", "string"), one), lambda v: v["nombre"].isNotNull())
    vias = F.when(F.size(named) > 0, named).otherwise(F.array(flat))
    df = df.withColumn("vias", F.filter(vias, lambda v: v["nombre"].isNotNull() & ~(city(v["nombre"]) & v["tipo_via"].isNull())))

    kinds = F.create_map(*[F.lit(x) for pair in UNIT_KEYS.items() for x in pair])
    zone, kind = said("nom zona", "nombre zona", "nombre de zona", "zona nombre", "zona", "urbanizacion"), said("tipo zona detectada", "tipo zona", "tipozona", "tipo de zona")
    df = df.withColumns({
        "_parts": listed("componentes", "struct<nombre:string,valor:string>"), "_mods": listed("modulos", "struct<tipo_modulo:string,valor:string>"),
        "nom_zona": F.when(~city(zone), zone), "tipo_zona": F.when(kind.isin("H.U.", "HU", "HABILITACION URBANA", "HABILITACIÓN URBANA"), "URBANIZACION").otherwise(kind),
        "_sub": said("slote", "sub lt", "sub lote", "sublote"), "_ref": said("referencia", "ref"), "_mz": said("manzana", "mz", "mza"), "_lt": said("lote", "lt"),
        "_piso": _digits(said("piso", "nivel")), "_block": _filled(F.regexp_replace(said("block", "bloque", "torre"), r"^(?:BLOCK|BLOQUE|BLQ|TORRE)\s+", "")),
        "_keyed": F.coalesce(F.flatten(F.transform(F.filter("_said", lambda e: e["k"].isin(list(UNIT_KEYS))), lambda e: _units(F.try_element_at(kinds, e["k"]), e["v"]))), F.array().cast(UNITS)), "confianza": F.coalesce(F.try_to_number(raw("confianza"), F.lit("9.99")).cast("double"), F.lit(1.0)),
        "observaciones": raw("observaciones", "observacion", "comentario", "motivo"),
    })

    df = cut(df.drop("_said"))  # or every key would be looked up anew wherever its column is read
    pair = lambda name, value: F.struct(name.alias("nombre"), value.alias("valor"))

    def component(p: Column) -> Column:
        name, value = F.upper(F.trim(p["nombre"])), F.upper(F.trim(p["valor"]))
        own = F.when(value.rlike(f"(?U){_UNIT}"), None).when(F.contains(value, F.lit("PISO")), pair(F.lit("PISO"), _digits(value))).when(value.rlike(_TOWER), pair(F.lit("BLOCK"), _group(value, _TOWER))).when(sublot(value).isNotNull(), pair(F.lit("SUBLOTE"), sublot(value)))
        known = F.when(name.isin("BLOCK", "BLOQUE", "BLQ", "TORRE", "PABELLON", "PABELLÓN"), pair(F.lit("BLOCK"), value)).when(name.isin("PISO", "PISOS", "NIVEL"), pair(F.lit("PISO"), _digits(value)))
        return F.when(name.isin("SUBLOTE", "SUB LOTE", "SLOTE"), own).otherwise(F.coalesce(known, F.when(_filled(name).isNotNull() & _filled(value).isNotNull(), pair(name, value))))

    tower = lambda m: F.upper(F.trim(m["tipo_modulo"])).isin("BLOCK", "BLQ", "TORRE", "PABELLON", "PABELLÓN")
    towers = F.flatten(F.transform(F.filter("_mods", tower), lambda m: unit_values(m["valor"])))
    mods = F.flatten(F.transform(F.filter("_mods", lambda m: ~tower(m) & m["valor"].isNotNull()), lambda m: _units(match_type(m["tipo_modulo"], lx.UNIT_TYPES), m["valor"])))
    other = F.col("_sub").rlike(f"(?U){_UNIT}") | F.col("_sub").rlike(r"(?U)\b(?:PISO|BLOCK|BLOQUE|BLQ|TORRE|ESQ|ESQUINA|FRENTE|ALTURA|CUADRA|EDIFICIO)\b")
    ref = F.regexp_replace("_ref", r"(?U)\b(?:\d+(?:DO|ER|TO|VO|MO)?\.?\s*)?PISO\b(?:\s*\d+\b)?", " ")
    df = df.withColumns({
        "_listed": F.array_compact(F.transform("_parts", component)), "_towers": towers, "_rfloor": _digits(_floor(F.col("_ref"))), "_rtower": _group(F.col("_ref"), _TOWER),
        "modulos": F.array_distinct(F.concat(mods, "_keyed", F.coalesce(sublot_units(F.col("_sub")), F.array().cast(UNITS)))),
        "referencia": _strip(F.regexp_replace(ref, _TOWER, " ")), "_slote": F.when(~other, sublot(F.col("_sub"))),
    })
    more = {"MANZANA": "_mz", "LOTE": "_lt", "PISO": F.coalesce("_piso", "_rfloor"), "BLOCK": F.coalesce("_block", F.get("_towers", F.lit(0)), "_rtower"), "SUBLOTE": "_slote"}
    value = lambda v: F.col(v) if isinstance(v, str) else v
    extra = F.array_compact(F.array(*[F.when(value(v).isNotNull() & _first(F.col("_listed"), n).isNull(), pair(F.lit(n), value(v))) for n, v in more.items()]))
    df = df.withColumn("componentes", F.concat("_listed", extra))
    top = F.get("vias", F.lit(0))
    part = lambda name: _first(F.col("componentes"), name)
    df = df.withColumns({
        "nom_via": top["nombre"], "tipo_via": top["tipo_via"], "num_via": top["numero"], "manzana": F.coalesce("_mz", part("MANZANA")), "lote": F.coalesce("_lt", part("LOTE")), "slote": F.coalesce("_slote", part("SUBLOTE")),
        "piso": F.coalesce("_rfloor", "_piso", part("PISO")), "block": F.coalesce("_rtower", F.try_element_at("_towers", F.lit(-1)), "_block", part("BLOCK")),
    })
    return df.drop("_parts", "_mods", "_sub", "_ref", "_mz", "_lt", "_piso", "_block", "_keyed", "_listed", "_towers", "_rfloor", "_rtower", "_slote")


#: Components that have a column of their own.
COLUMNS = {1: "manzana", 2: "lote", 3: "slote", 4: "piso", 11: "block"}
COMPONENTS = "array<struct<codi_id:int,diti_valor:string>>"


def align_lists(df: DataFrame) -> DataFrame:
    """V7, both ways: fields, `componentes`, `modulos` and `vias` (where df has them) fill each other.

    Floors and towers leave the sublot, a landmark in it goes to the reference, a unit in it becomes a unit if there is
    none; then an empty field takes its first component, and a filled one becomes a component if there is none of its id.
    """
    s = F.upper(F.trim("slote"))
    rest = F.regexp_replace(s, _FLOOR, "")
    df = df.withColumns({"_floor": _floor(s), "_tower": _group(rest, _TOWER), "_rest": _strip(F.regexp_replace(rest, _TOWER, ""))})
    place = F.coalesce(F.col("_rest").rlike(_PLACE), F.lit(False))
    df = df.withColumns({"referencia": F.when(place, F.concat_ws(" ", _filled(F.col("referencia")), "_rest")).otherwise(_filled(F.col("referencia"))), "slote": F.when(~place, sublot(F.col("_rest")))})
    df = df.withColumns({"piso": F.coalesce(_filled(F.col("piso")), "_floor"), "block": F.coalesce(_filled(F.col("block")), "_tower")})
    if "modulos" in df.columns:
        units = F.coalesce(F.col("modulos").cast(UNITS), F.array().cast(UNITS))
        df = df.withColumn("modulos", F.when(F.size(units) > 0, units).otherwise(F.coalesce(F.slice(sublot_units(F.col("slote")), 1, 1), F.array().cast(UNITS))))
    if "vias" in df.columns:
        top = F.get("vias", F.lit(0))
        names = {f.name for f in df.schema["vias"].dataType.elementType.fields}
        for column, field in (("via_id", "via_id"), ("num_via", "divi_numero"), ("nom_via", "via_nombre"), ("tipo_via", "tipo_via")):
            if column in df.columns and field in names:
                df = df.withColumn(column, F.coalesce(column, top[field]))
    parts = F.coalesce(F.col("componentes").cast(COMPONENTS), F.array().cast(COMPONENTS)) if "componentes" in df.columns else F.array().cast(COMPONENTS)
    clean = F.transform(parts, lambda p: F.struct(p["codi_id"].alias("codi_id"), F.when(p["codi_id"] == 3, sublot(F.upper(F.trim(p["diti_valor"])))).otherwise(_filled(p["diti_valor"])).alias("diti_valor")))
    df = df.withColumn("componentes", F.filter(clean, lambda p: p["diti_valor"].isNotNull()))
    first = lambda i: F.get(F.filter("componentes", lambda p: p["codi_id"] == i), F.lit(0))["diti_valor"]
    df = df.withColumns({c: F.coalesce(_filled(F.col(c)), first(i)) for i, c in COLUMNS.items()})
    added = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & first(i).isNull(), F.struct(F.lit(i).alias("codi_id"), F.col(c).alias("diti_valor"))) for i, c in COLUMNS.items()]))
    return df.withColumn("componentes", F.concat("componentes", added)).drop("_floor", "_tower", "_rest")
