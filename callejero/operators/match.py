"""Catalogue joins: name index, exact cascade, homonyms, blocked fuzzy candidates.

Catalogues are inputs. Small ones are broadcast by Spark itself under its own size limit; nothing here
assumes that they are small. Fuzzy matching (fuzzy.py) runs on the distinct names that the exact cascade missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import normalize_variants, remove_accents, sanitize
from .fuzzy import accept_match, fuzzy_candidates  # noqa: F401
from .load import resolve_map

_PREFIX = r"^(?:AV\.|AVENIDA|CA\.|CALLE|JR\.|JIRON|PJE\.|PASAJE|PRLG\.|PROLONGACION|CTRA\.|CARRETERA|AL\.|ALAMEDA|PSO\.|PASEO)\s+"


def type_synonyms(df: DataFrame, types: dict[int, tuple]) -> DataFrame:
    """synonym, id, name: one row a written form (a literal table of fixed values)."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("synonym"), F.lit(i).alias("id"), F.lit(t[0]).alias("name")) for i, t in types.items() for s in t[-1]]))
    return df.sparkSession.range(1).select(rows.alias("x")).select("x.*")


def match_type(text: Column, types: dict[int, tuple]) -> Column:
    """Id of the type a word stands for: as written, without accents, without the last dot."""
    known = F.create_map(*[F.lit(x) for i, t in types.items() for s in t[-1] for x in (s, i)])
    t = F.upper(F.trim(text))
    plain = remove_accents(t)
    return F.coalesce(*[F.try_element_at(known, k) for k in (t, plain, F.rtrim(t, F.lit(".")), F.rtrim(plain, F.lit(".")))])


def lookup_name(df: DataFrame, id_col: str, catalog: DataFrame, key: str, name: str, default: str = "DESCONOCIDO") -> DataFrame:
    """Add the name of an id, or a default."""
    side = catalog.select(F.col(key).alias("_id"), F.col(name).alias("_name"))
    return df.join(side, F.col(id_col) == F.col("_id"), "left").withColumn(name, F.coalesce("_name", F.lit(default))).drop("_id", "_name")


def remap_ids(df: DataFrame, column: str, id_map: DataFrame) -> DataFrame:
    """C11: old ids replaced by new ones; others stay."""
    side = id_map.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    return df.join(side, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def extend_catalog(catalog: DataFrame, added: DataFrame, key: str, unique: bool) -> DataFrame:
    """User rows put into a catalogue: unless the id is there (streets), or in place of the same name (unique)."""
    on = "_name" if unique else key
    if not unique:
        return catalog.unionByName(added.join(catalog.select(key), key, "left_anti"))
    name = [c for c in catalog.columns if c.startswith("nom_")][0]
    a, b = (d.withColumn(on, remove_accents(F.upper(F.col(name)))) for d in (catalog, added))
    return a.join(b.select(on), on, "left_anti").unionByName(b).drop(on)


def name_index(catalog: DataFrame, id_col: str, name_col: str, unique: bool = False, aliases: DataFrame | None = None) -> DataFrame:
    """C4: key -> row of the catalogue, by name, name without accents, synonyms and aliases; cities are left out.

    Streets keep all rows of a key; with unique (zones) the last by id wins. aliases (alias, target) are other names of
    keys, or of other aliases: chains are followed to the first key of the catalogue. A key of the catalogue is
    never an alias; aliases that end in no key, or run in a cycle, count for nothing.
    """
    name = F.upper(F.trim(F.col(name_col)))
    names = F.array(name, remove_accents(name))
    if "sinonimos" in catalog.columns:
        also = F.transform(F.coalesce("sinonimos", F.array().cast("array<string>")), lambda s: F.upper(F.trim(s)))
        names = F.concat(names, also, F.transform(also, remove_accents))
    index = catalog.withColumn("key", F.explode(F.array_distinct(names))).where(~F.col("key").isin(lx.CITIES))
    if unique:
        cols = [c for c in index.columns if c != "key"]
        index = index.groupBy("key").agg(F.max_by(F.struct(*cols), id_col).alias("_r")).select("key", "_r.*")
    return index if aliases is None else index.unionByName(_alias_rows(index, aliases))


def _alias_rows(index: DataFrame, aliases: DataFrame) -> DataFrame:
    """The index rows of what aliases stand for, under the aliases (with and without accents)."""
    form = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    alias, target = form(F.col("alias")), form(F.col("target"))
    pairs = aliases.select(F.explode(F.array_distinct(F.array(alias, remove_accents(alias)))).alias("old_id"), target.alias("new_id")).where("old_id != ''")
    keys = index.select(F.col("key").alias("old_id")).distinct()
    # A target that is written with accents is also known without.
    known = keys.select(F.col("old_id").alias("_k"))
    plain = remove_accents(F.col("new_id"))
    pairs = pairs.join(known, F.col("new_id") == F.col("_k"), "left").select("old_id", F.coalesce("_k", plain).alias("new_id"))
    ends, _ = resolve_map(pairs.join(keys, "old_id", "left_anti").where(~F.col("old_id").isin(lx.CITIES)))
    rows = index.withColumnRenamed("key", "_key")
    return ends.join(rows, F.col("new_id") == F.col("_key")).drop("new_id", "_key").withColumnRenamed("old_id", "key")


def cascade_keys(clean: Column, bare: Column) -> Column:
    """The keys under which a cleaned name, and the same without prefix, is looked up, in order."""
    return F.array(clean, remove_accents(clean), bare, remove_accents(bare), normalize_variants(bare))


def inferred_type(text: Column) -> Column:
    """The street type that a leading abbreviation names."""
    return F.when(text.rlike(r"^(?:AV\.|AVENIDA|AV)\s"), 1).when(text.rlike(r"^(?:CA\.|CALLE|CL\.|CL|CA)\s"), 2).when(text.rlike(r"^(?:JR\.|JIRON|JIRÓN|JR)\s"), 3).when(text.rlike(r"^(?:PJE\.|PASAJE|PSJ\.|PSJ|PJE)\s"), 4)


def match_exact(queries: DataFrame, index: DataFrame, id_col: str, text: str = "name", hint: str | None = "type_hint", sector: str | None = "sector_hint") -> DataFrame:
    """Queries (distinct name, hints) with the id they match exactly, or null.

    The first key that is in the index decides; among its rows the sector counts first, then the type, then
    condition F, then the order of ids.
    """
    each = queries.withColumn("_clean", sanitize(F.col(text))).withColumn("_bare", F.trim(F.regexp_replace("_clean", _PREFIX, "")))
    keys = F.transform(cascade_keys(F.col("_clean"), F.col("_bare")), lambda k, i: F.struct(i.alias("step"), k.alias("key")))
    kind = F.coalesce(F.col(hint) if hint else F.lit(None).cast("int"), inferred_type(F.col("_clean")))
    each = each.withColumn("_type", kind).where(~(F.col("_bare").isin(lx.CITIES) & F.col("_type").isNull()))
    each = each.withColumn("_k", F.explode(keys)).withColumn("_step", F.col("_k.step")).withColumn("key", F.col("_k.key")).where("key != ''")
    found = each.join(index.select("key", F.col(id_col).alias("_match"), *[F.col(c).alias(f"_{c}") for c in ("sector", "condicion", "id_tipo_via") if c in index.columns]), "key")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    same_sector = flag(F.arrays_overlap(F.split(F.regexp_replace(F.col(sector), ",", " "), " +"), F.split(F.regexp_replace(F.col("_sector"), ",", " "), " +"))) if sector and "_sector" in found.columns else F.lit(0)
    same_type = flag(F.col("_id_tipo_via") == F.col("_type")) if "_id_tipo_via" in found.columns else F.lit(0)
    finished = flag(F.col("_condicion") == "F") if "_condicion" in found.columns else F.lit(0)
    rank = F.struct("_step", (-same_sector).alias("a"), (-same_type).alias("b"), (-finished).alias("c"), "_match")
    names = list(queries.columns)
    best = found.groupBy(*names).agg(F.min(rank)["_match"].alias(id_col)).select(*[F.col(c).alias(f"_q_{c}") for c in names], id_col)
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return queries.join(best, on, "left").select(*names, id_col)


def apply_choice(candidates: DataFrame, choices: DataFrame, id_col: str) -> DataFrame:
    """C14: a choice made elsewhere, if it is among the candidates."""
    return candidates.join(choices.select("name", id_col), ["name", id_col]).select("name", id_col, "score")


def expand_synonyms(catalog: DataFrame, name_col: str, type_col: str) -> DataFrame:
    """Sorted synonyms of a catalogue row: with type prefixes, without parentheses, hyphen parts, digits, stages."""
    name = F.upper(F.trim(F.col(name_col)))
    plain = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    prefixes = F.create_map(*[x for i, t in lx.STREET_TYPES.items() for x in (F.lit(i), F.array(F.lit(t[0]), F.lit(t[1])))])
    typed = F.transform(F.coalesce(F.try_element_at(prefixes, F.col(type_col)), F.array().cast("array<string>")), lambda p: F.concat_ws(" ", p, plain))
    parts = F.filter(F.split(plain, r"\s+-\s+"), lambda p: F.char_length(p) > 3)
    every = F.array_distinct(F.concat(F.array(plain, remove_accents(plain), normalize_variants(plain)), typed, parts))
    return catalog.withColumn("sinonimos", F.array_sort(F.filter(every, lambda s: (s != "") & (s != name))))
