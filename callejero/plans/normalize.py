"""Raw addresses to normalised rows, set at a time.

All rules run once per distinct text, cleaning too; the catalogues are joined by name, the
exact cascade first and the fuzzy one on what it missed; results join back to the rows by text. The plan is
cut by a written table after cleaning, extraction and matching, or Catalyst would spend minutes on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import lexicon as lx
from ..functions.risk import with_complexity
from ..functions.text import capped, clean_number, clean_reference, clean_sublot, kilometre, remove_accents, sanitize
from ..operators import match as mt
from ..operators import roles as ro
from ..operators import validate as va
from ..operators.fuzzy import ACCEPT
from ..session import cut


def clean_texts(raw: DataFrame) -> DataFrame:
    """raw_text and clean of the distinct raw texts that are not blank; stored. Each is cleaned once, however many rows have it."""
    texts = _dealt(raw.select("raw_text").where("trim(raw_text) != ''").distinct())
    return cut(texts.withColumn("clean", sanitize(F.col("raw_text"))))


def addresses(cleaned: DataFrame) -> DataFrame:
    """The distinct clean texts of clean_texts, but for ''."""
    return _dealt(cleaned.select("clean").where("clean != ''").distinct())


def _dealt(texts: DataFrame) -> DataFrame:
    """The texts dealt over all cores: a short text is much work, and by their bytes a few tasks would get them."""
    return texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism)


def extract_fields(texts: DataFrame, risk: bool = True) -> DataFrame:
    """R1, R2 (with risk), E1 to E19 for distinct (clean) texts, with an id per text."""
    t = F.col("clean")
    df = texts.withColumn("id", F.xxhash64("clean"))
    if risk:
        df = with_complexity(df, "clean", cleaned=True)
    df = df.withColumn("nom_zona", ex.zone_name(t)).withColumn("nom_via", ex.street_name(t))
    df = df.withColumn("_date", F.when(F.col("nom_via").isNull(), ex.date_street_parts(t, F.col("nom_zona")))).withColumn("nom_via", F.coalesce("nom_via", "_date.street"))
    df = df.withColumn("_ref", ex.reference(t))
    shop = ex.is_shop(F.col("nom_via"))
    df = df.withColumn("referencia", capped(F.coalesce("_ref", F.when(shop, F.col("nom_via"))), "referencia")).withColumn("nom_via", F.when(~shop, capped(F.col("nom_via"), "nom_via"))).drop("_ref")
    return df.withColumns({
        "tipo_via": ex.street_type(t), "tipo_zona": ex.zone_type(t), "num_via": F.coalesce(ex.house_number(t, F.col("nom_via")), "_date.number"), "manzana": ex.block(t), "lote": ex.lot(t),
        "slote": F.col("_date.letter"), "piso": ex.floor_number(t), "block": ex.tower(t), "modulos": ex.units(t), "esquinas": ex.corner_names(t), "metodo": F.lit("HEURISTICA"),
    }).drop("_date")


def settle_roles(df: DataFrame, vias: DataFrame, zonas: DataFrame) -> DataFrame:
    """E4, E15, E17, then T8 to T11 on what they settle; `cruce` holds the streets that cross."""
    df = ro.settle_pair(df, vias, zonas)
    df = ro.settle_pieces(df, vias, zonas)
    df = cut(ro.swap_roles(cut(df), vias, zonas))
    km = kilometre(F.col("clean"))
    on_road = F.coalesce(F.regexp_replace(km, r"^KM\.?\s*0*", "") == F.ltrim(F.col("num_via"), F.lit("0")), F.lit(False))
    ref = clean_reference(F.col("referencia"), F.col("clean"))
    return df.withColumns({
        "slote": clean_sublot(F.coalesce("slote", ex.door_letter(F.col("clean"), F.col("num_via")))),
        "num_via": capped(F.when(~on_road & F.col("nom_via").isNotNull(), clean_number(F.col("num_via"))), "num_via"),
        "referencia": capped(F.when(km.isNotNull() & ~F.coalesce(F.contains(ref, km), F.lit(False)), F.concat_ws(" - ", ref, km)).otherwise(ref), "referencia"),
        "nom_via": capped(F.col("nom_via"), "nom_via"), "nom_zona": capped(F.col("nom_zona"), "nom_zona"),
    })


def _with_match(df: DataFrame, names: DataFrame, index: DataFrame, catalog: DataFrame, kind: str, fields: dict[str, str], id_col: str, name_col: str, fuzzy: bool) -> DataFrame:
    """df with id_col: the exact match of its (name, hints), or the fuzzy one that C9 accepts; fields: column of names -> of df."""
    hints = [c for c in fields if c != "name"]
    exact = [c for c in hints if kind == "street"]
    found = mt.match_exact(names, index, id_col, hint="type_hint" if "type_hint" in exact else None, sector="sector_hint" if "sector_hint" in exact else None)
    if fuzzy:
        lost = found.where(F.col(id_col).isNull()).select("name", *hints)
        if kind == "zone":  # a city alone is no zone, whatever the hint
            lost = lost.where(~remove_accents(F.upper(F.trim("name"))).isin(lx.CITIES))
        near = mt.accept_match(mt.fuzzy_candidates(lost, catalog, kind, id_col, name_col, k=1, min_score=ACCEPT), id_col)
        near = near.select(*[F.col(c).alias(f"_near_{c}") for c in ("name", *hints)], F.col(id_col).alias("_near"))
        on = F.col("name") == F.col("_near_name")
        for c in hints:
            on &= F.col(c).eqNullSafe(F.col(f"_near_{c}"))
        found = found.join(near, on, "left").select("name", *hints, F.coalesce(id_col, "_near").alias(id_col))
    # Stored, its size is known: few names are sent to the texts.
    found = cut(found.where(F.col(id_col).isNotNull()).select(*[F.col(c).alias(f"_m_{c}") for c in fields], id_col))
    on = F.lit(True)
    for c, field in fields.items():
        on &= F.col(field).eqNullSafe(F.col(f"_m_{c}")) if c != "name" else F.col(field) == F.col("_m_name")
    return df.join(found, on, "left").drop(*[f"_m_{c}" for c in fields])


def match_fields(df: DataFrame, vias: DataFrame, zonas: DataFrame, fuzzy: bool = True, via_aliases: DataFrame | None = None, zona_aliases: DataFrame | None = None) -> DataFrame:
    """Zone first, for its sector settles streets of equal name; distinct names only. Aliases: (alias, target)."""
    zones = df.select(F.col("nom_zona").alias("name"), F.col("tipo_zona").alias("type_hint")).where("name is not null").distinct()
    zone_index = mt.name_index(zonas, "zona_id", "nom_zona", unique=True, aliases=zona_aliases)
    df = _with_match(df, zones, zone_index, zonas, "zone", {"name": "nom_zona", "type_hint": "tipo_zona"}, "zona_id", "nom_zona", fuzzy)
    sectors = zonas.groupBy(F.col("zona_id").alias("_z")).agg(F.max("sector").alias("sector_hint"))
    df = df.join(sectors, F.col("zona_id") == F.col("_z"), "left").drop("_z")
    if fuzzy:
        df = cut(df)
    names = df.select(F.col("nom_via").alias("name"), F.col("tipo_via").alias("type_hint"), "sector_hint").where("name is not null").distinct()
    street_index = mt.name_index(vias, "via_id", "nom_via", aliases=via_aliases)
    fields = {"name": "nom_via", "type_hint": "tipo_via", "sector_hint": "sector_hint"}
    return _with_match(df, names, street_index, vias, "street", fields, "via_id", "nom_via", fuzzy).drop("sector_hint")


def normalize(raw: DataFrame, vias: DataFrame, zonas: DataFrame, fuzzy: bool = True, check: bool = True, route: bool = True, via_aliases: DataFrame | None = None, zona_aliases: DataFrame | None = None) -> DataFrame:
    """Rows of raw (src_schema, src_table, src_row_id, raw_text) with fields, es_procesado, reasons and metodo."""
    cleaned = clean_texts(raw)
    df = cut(settle_roles(cut(extract_fields(addresses(cleaned), risk=route)), vias, zonas))
    df = cut(ro.with_streets(cut(match_fields(df, vias, zonas, fuzzy, via_aliases, zona_aliases)), vias, zonas))
    df = va.settle_zone(df)
    df = df.withColumn("reasons", va.reasons(df))
    if route:
        df = df.withColumn("reasons", F.when(F.col("risk.complex"), F.array_prepend("reasons", F.concat(F.lit("COMPLEJA: "), F.array_join("risk.triggers", ",")))).otherwise(F.col("reasons")))
    df = cut(va.settle(df))
    if check:
        df = va.veto(va.validate(df))
    fields = [c for c in (*va.FIELDS, "modulos", "esquinas", "vias", "es_procesado", "reasons", "metodo") if c in df.columns]
    done = cleaned.join(df.select("clean", *fields), "clean", "left").withColumnRenamed("raw_text", "_raw")
    # Null and blank texts have no partner; they are not sent to one task.
    key = F.when(F.trim("raw_text") != "", F.col("raw_text"))
    done = raw.join(done, key == F.col("_raw"), "left").drop("_raw").withColumn("clean", F.coalesce("clean", F.lit("")))
    empty = F.col("clean") == ""
    return done.withColumn("es_procesado", F.when(empty, F.lit(False)).otherwise(F.col("es_procesado"))).withColumn("reasons", F.when(empty, F.array(F.lit("DIRECCION VACIA"))).otherwise(F.col("reasons"))).withColumn("metodo", F.when(empty, "VACIA").otherwise(F.col("metodo")))
