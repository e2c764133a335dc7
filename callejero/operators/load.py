"""Relational load, upsert and catalogue consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import remove_accents
from ..session import cut
from .numbering import numbered


def flatten_children(df: DataFrame, array: str, key: str, fields: dict[str, str], order: str) -> DataFrame:
    """One row an element of an array column; null ids and blank values are left out, texts upper-cased and trimmed."""
    rows = df.select(key, F.posexplode(array).alias("_pos", "_x"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema[array].dataType.elementType}
    out = {to: F.upper(F.trim(F.col(f"_x.{frm}"))) if kinds[frm] == "string" else F.col(f"_x.{frm}") for to, frm in fields.items()}
    rows = rows.select(key, *[c.alias(n) for n, c in out.items()], (F.col("_pos") + 1).cast("int").alias(order))
    for to, frm in fields.items():
        rows = rows.where(F.col(to) != "" if kinds[frm] == "string" else F.col(to).isNotNull())
    return rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both by key; the new one wins, among equals the last by order (else by all its values)."""
    cols = old.columns
    both = old.withColumn("_age", F.lit(0)).unionByName(new.select(*cols).withColumn("_age", F.lit(1)))
    rank = F.struct("_age", *([order] if order else []), *[c for c in cols if c not in keys and c != order])
    best = both.groupBy(*keys).agg(F.max(rank).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in cols])


def update_central(central: DataFrame, results: DataFrame) -> DataFrame:
    """Results (dire_id, es_procesado, zona_id, referencia, at) put into the central rows; others stay."""
    r = results.select(F.col("dire_id").alias("_id"), F.col("es_procesado").alias("_ok"), F.col("zona_id").alias("_zona"), F.col("referencia").alias("_ref"), F.col("at").alias("_at"))
    joined = central.join(r, F.col("dire_id") == F.col("_id"), "left")
    known = F.col("_id").isNotNull()
    new = {
        "dire_es_procesado": F.when(known, F.col("_ok")).otherwise(F.col("dire_es_procesado")),
        "zona_id": F.when(known & F.col("_ok"), F.col("_zona")).when(~known, F.col("zona_id")),
        "dire_referencia": F.when(known & F.col("_ok"), F.col("_ref")).when(~known, F.col("dire_referencia")),
        "update_at": F.when(known, F.col("_at")).otherwise(F.col("update_at")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in central.columns])


def write_back(src: DataFrame, results: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """U4: flat fields and the link put into the source; observed rows get nulls."""
    r = results.select(F.col("src_row_id").alias("_id"), F.when(F.col("es_procesado"), F.col("dire_id")).alias("dire_id"), *[F.when(F.col("es_procesado"), F.col(c)).alias(c) for c in fields])
    return src.drop("dire_id", *fields).join(r, F.col(id_col) == F.col("_id"), "left").drop("_id")


def address_key(schema: Column, table: Column, row_id: Column, text: Column) -> Column:
    """A key that depends on provenance alone: no global counter, reruns agree."""
    return F.xxhash64(schema, table, row_id, F.when(row_id.isNull(), text))


def catalog_key(name: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(remove_accents(name), r"\s+", " ")))


def resolve_map(id_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """old_id, new_id with every chain followed to its end, and the rows that lead into a cycle, as they were.

    Pointers jump: each round every id takes over where its target points, so a chain of n steps takes log2(n)
    rounds, each written. An id that ends nowhere goes round in a cycle, or leads to one; it is not mapped. Once a
    round leaves as many open ids as the one before, only those are left. Of several targets of one id the least
    counts; an id that points at itself, or has a null, is not mapped.
    """
    first = id_map.where("old_id != new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    now, before = cut(first), None
    while True:
        on = now.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n"))
        seen = Observation()
        jumped = now.join(on, F.col("new_id") == F.col("_o"), "left")
        jumped = jumped.observe(seen, F.count("_o").alias("open")).select("old_id", F.coalesce("_n", "new_id").alias("new_id"), F.col("_o").isNotNull().alias("_open"))
        jumped = cut(jumped)
        if seen.get["open"] in (0, before):
            lost = jumped.where("_open").select("old_id")
            return jumped.where("NOT _open").select("old_id", "new_id"), first.join(lost, "old_id", "left_semi").select("old_id", "new_id")
        now, before = jumped.select("old_id", "new_id"), seen.get["open"]


def duplicate_map(catalog: DataFrame, id_col: str, type_col: str, name_col: str, explicit: DataFrame | None = None) -> DataFrame:
    """old_id, new_id of rows with equal type and name: the first that an explicit map aims at, else the least.

    An explicit map (old_id, new_id) goes before; its chains, and those of both maps together, are followed to their
    end. Explicit rows that run in a cycle count as not written; `resolve_map` tells them.
    """
    rows = catalog.select(F.col(id_col).alias("old_id"), F.col(type_col).alias("_t"), catalog_key(F.col(name_col)).alias("_n"))
    if explicit is not None:
        explicit, _ = resolve_map(explicit)
    aimed = explicit.select(F.col("new_id").alias("_aim")).distinct() if explicit is not None else rows.select(F.lit(None).cast("long").alias("_aim")).limit(0)
    rows = rows.join(aimed, F.col("old_id") == F.col("_aim"), "left")
    best = rows.groupBy("_t", "_n").agg(F.coalesce(F.min("_aim"), F.min("old_id")).alias("new_id"))
    found = rows.join(best, rows["_t"].eqNullSafe(best["_t"]) & rows["_n"].eqNullSafe(best["_n"])).select("old_id", "new_id").where("old_id != new_id")
    if explicit is None:
        return found
    # A canonical row may itself be mapped away: then its duplicates follow it. Explicit targets stay canonical, so no cycle arises.
    return resolve_map(explicit.unionByName(found.join(explicit, "old_id", "left_anti")))[0]


def repoint(children: DataFrame, id_map: DataFrame, column: str, parent: str) -> DataFrame:
    """Children moved to the canonical id; of two that meet on (parent, id) the one that was there stays."""
    m = id_map.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    moved = children.join(m, F.col(column) == F.col("_old"), "left").withColumn("_moved", F.col("_old").isNotNull().cast("int")).withColumn("_was", F.col(column))
    moved = moved.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
    first = F.row_number().over(Window.partitionBy(parent, column).orderBy("_moved", "_was"))
    return moved.withColumn("_n", first).where("_n = 1").select(*children.columns)


def drop_orphans(catalog: DataFrame, children: DataFrame, id_col: str, child_col: str, official_max: int) -> DataFrame:
    """U8: the catalogue without rows above the official maximum that no child refers to."""
    used = children.select(F.col(child_col).alias(id_col)).distinct()
    return catalog.where(F.col(id_col) <= official_max).unionByName(catalog.where(F.col(id_col) > official_max).join(used, id_col, "left_semi").select(*catalog.columns))


def align_types(existing: DataFrame, official: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An existing type catalogue (id, nombre) aligned with the official one; the catalogue and the map old_id, new_id.

    Equal names take the official id; own rows whose id is taken move behind the greatest id, in order of id.
    """
    e = existing.select(F.col("id").alias("old_id"), F.col("nombre").alias("_n"), catalog_key(F.col("nombre")).alias("_k"))
    o = official.select(F.col("id").alias("_oid"), catalog_key(F.col("nombre")).alias("_ok"))
    joined = e.join(o, F.col("_k") == F.col("_ok"), "left")
    taken = official.select(F.col("id").alias("_taken"))
    own = joined.where("_oid is null").join(taken, F.col("old_id") == F.col("_taken"), "left")
    top = existing.select("id").unionByName(official.select("id")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    own = numbered(own.withColumn("_clash", F.col("_taken").isNotNull()), ["old_id"], by=["_clash"], name="_rank")
    own = own.withColumn("new_id", F.when(F.col("_clash"), F.lit(top.first()["_top"]) + F.col("_rank")).otherwise(F.col("old_id")).cast(existing.schema["id"].dataType))
    id_map = joined.where("_oid is not null").select("old_id", F.col("_oid").alias("new_id")).unionByName(own.select("old_id", "new_id"))
    catalog = official.select("id", "nombre").unionByName(own.select(F.col("new_id").alias("id"), F.col("_n").alias("nombre")))
    return catalog, id_map


def seed(catalog: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Rows inserted or replaced by id."""
    return catalog.join(rows.select(id_col), id_col, "left_anti").select(*catalog.columns).unionByName(rows.select(*catalog.columns))


def dedupe_units(units: DataFrame, position: str) -> DataFrame:
    """Per (address, type, name) the row with the greatest position."""
    keys = ["dire_id", "timo_id", "ditm_nombre"]
    return units.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in units.columns if c not in keys]), position).alias("_r")).select(*[c if c in keys else F.col(f"_r.{c}") for c in units.columns])


def adopt_columns(df: DataFrame, renames: dict[str, str], defaults: dict[str, Column]) -> DataFrame:
    """Legacy names adopted where the new one is missing; missing columns added with defaults."""
    df = df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns and new not in df.columns})
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def add_entries(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """New (nombre, abreviatura, sinonimos) with ids after the greatest; names that exist are left out, abbreviations end with a dot."""
    known = catalog.select(catalog_key(F.col("nombre")).alias("_k"))
    fresh = entries.withColumn("_k", catalog_key(F.col("nombre"))).join(known, "_k", "left_anti").dropDuplicates(["_k"])
    top = F.lit(catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).first()["_top"])
    fresh = numbered(fresh, ["_k"], name="_rank")
    short = F.upper(F.trim("abreviatura"))
    short = F.when(F.endswith(short, F.lit(".")), short).otherwise(F.concat(short, F.lit(".")))
    name = F.upper(F.trim("nombre"))
    rows = fresh.select((top + F.col("_rank")).cast("int").alias("id"), name.alias("nombre"), short.alias("abreviatura"), F.array_sort(F.array_distinct(F.concat(F.array(name, short), F.coalesce("sinonimos", F.array().cast("array<string>"))))).alias("sinonimos"))
    return catalog.select("id", "nombre", "abreviatura", "sinonimos").unionByName(rows)
