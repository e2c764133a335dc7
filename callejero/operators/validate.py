"""Integrity rules and validation of a normalised address, evidence of external values (V1 to V7, L2 to L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import lexicon as lx
from ..functions.aliases import STREET_ALIASES, ZONE_ALIASES
from ..functions.similarity import numbered_grams, ratio_bound, seq_ratio
from ..functions.text import canonical_tokens, let, sanitize, sig_tokens, words_to_array, written
from ..session import cut

#: Columns of a normalised row that rules look at.
FIELDS = ["nom_via", "tipo_via", "via_id", "num_via", "nom_zona", "tipo_zona", "zona_id", "manzana", "lote", "slote", "piso", "block", "referencia"]


def _has(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")) != "", F.lit(False))


def settle_zone(df: DataFrame, text: str = "clean") -> DataFrame:
    """V1: an uncatalogued zone that is noise, or an informal sector, is no reason but a number or a reference.

    Digits become the second number of the door, a shop and an informal sector (a catalogued street with a number
    or a corner, no plot, no road, no formal settlement in the text) go to the reference, words of units go.
    """
    zone, t = F.col("nom_zona"), F.col(text)
    noise = F.when(_has("nom_zona") & F.col("zona_id").isNull(), ex.noisy_zone(zone))
    corner = F.size(F.coalesce("esquinas", F.array().cast("array<string>"))) > 0
    road = (F.coalesce(F.col("tipo_via"), F.lit(0)) == 6) | F.coalesce(F.col("nom_via").rlike(r"(?U)\b(?:PANAMERICANA|CARRETERA|AUTOPISTA)\b"), F.lit(False))
    informal = _has("nom_zona") & F.col("zona_id").isNull() & F.col("via_id").isNotNull() & (_has("num_via") | corner)
    informal &= ~(_has("manzana") | _has("lote")) & ~road & ~ex.formal_zone(t) & ~ex.formal_zone(zone)
    kind = F.coalesce(noise, F.when(F.coalesce(informal, F.lit(False)), "sector"))
    df = df.withColumn("_kind", kind)
    digits = F.coalesce(F.nullif(F.ltrim(F.trim(zone), F.lit("0")), F.lit("")), F.lit("0"))
    second = (F.col("_kind") == "number") & F.col("num_via").rlike(r"^\d+$") & (F.col("num_via") != digits)
    moved = F.when(F.col("_kind") == "shop", F.concat(F.lit("C.C. "), zone)).when(F.col("_kind") == "sector", F.concat(F.lit("SECTOR: "), zone))
    return df.withColumns({
        "num_via": F.when(F.coalesce(second, F.lit(False)), F.concat_ws("-", "num_via", digits)).otherwise(F.col("num_via")),
        "referencia": F.when(moved.isNotNull(), F.concat_ws(" - ", F.nullif("referencia", F.lit("")), moved)).otherwise(F.col("referencia")),
        "nom_zona": F.when(F.col("_kind").isNull(), zone),
    }).drop("_kind")


def reasons(df: DataFrame, text: str = "clean") -> Column:
    """V1: why an address cannot be taken as normalised.

    Two catalogued streets that a mere hyphen joins (`cruce`, where df has it) are a conflict; a written corner is none.
    """
    t = F.col(text)
    plot = _has("manzana") | _has("lote") | _has("slote") | _has("block")
    street, zone = _has("nom_via"), _has("nom_zona")
    units = F.size(F.coalesce("modulos", F.array().cast("array<struct<timo_id:int,ditm_nombre:string>>"))) > 0
    corner = F.size(F.coalesce("esquinas", F.array().cast("array<string>"))) > 0
    written = t.rlike(r"(?U)\bS/N\b") | F.contains(t, F.lit("/"))
    outside = ex.outside_district(t, F.col("nom_via"), F.col("nom_zona"), F.col("via_id"), F.col("zona_id"))
    crossing = F.col("cruce") if "cruce" in df.columns else F.lit(None).cast("array<string>")
    cornered = t.rlike(r"(?U)\b(?:CON|ESQ(?:UINA)?|CRUCE|Y)\b") | F.contains(t, F.lit("/")) | corner
    rules = [
        ((F.size(crossing) > 1) & ~cornered, F.concat(F.lit("CONFLICTO DE VIAS: "), F.array_join(crossing, " / "))),
        (street & F.col("via_id").isNull(), F.concat(F.lit("VIA NO CATALOGADA: "), F.col("nom_via"))),
        (zone & F.col("zona_id").isNull() & ~(F.col("via_id").isNotNull() | _has("num_via")), F.concat(F.lit("ZONA NO CATALOGADA: "), F.col("nom_zona"))),
        (plot & ~zone & ~street, F.lit("MANZANA O LOTE SIN ZONA")),
        ((F.col("tipo_via") == 6) & ~_has("num_via") & ~plot, F.lit("CARRETERA SIN NUMERO")),
        (~street & ~zone & ~plot & ~units, F.lit("NADA RECONOCIDO")),
        (F.lit(True), F.concat(F.lit("FUERA DEL DISTRITO: "), outside)),  # null without one
        (~street & (zone | plot | units) & ~(F.col("zona_id").isNotNull() & (plot | _has("piso") | units) & ~_has("num_via")), F.lit("SIN VIA")),
        (street & ~(_has("num_via") | plot | units | corner | written), F.lit("INCOMPLETA")),
        (ex.unclear_unit(t), F.lit("UNIDAD COMERCIAL NO CLARA")),
        (F.contains(t, F.lit("NO USAR LA VIA PUBLICA")), F.lit("ADVERTENCIA: NO USAR LA VIA PUBLICA")),
    ]
    return F.array_compact(F.array(*[F.when(rule, why) for rule, why in rules]))


def settle(df: DataFrame) -> DataFrame:
    """V2: any reason makes the address observed and empties its relations and fields."""
    bad = F.size("reasons") > 0
    keep = [c for c in FIELDS if c in df.columns]
    df = df.withColumn("es_procesado", ~bad)
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in [*keep, *[x for x in ("modulos", "esquinas") if x in df.columns]]})


def rebuilt_text() -> Column:
    """V3: the canonical text of the fields: street and number, plot, units, zone, reference."""
    types = F.create_map(*[x for i, t in lx.STREET_TYPES.items() for x in (F.lit(i), F.lit(t[0]))])
    units = F.create_map(*[x for i, t in lx.UNIT_TYPES.items() for x in (F.lit(i), F.lit(t[0]))])
    said = lambda label, c: F.when(_has(c), F.concat(F.lit(label), F.col(c)))
    number = F.when(F.col("num_via") != "S/N", F.col("num_via"))
    modules = F.transform(F.coalesce("modulos", F.array().cast("array<struct<timo_id:int,ditm_nombre:string>>")), lambda m: F.concat_ws(" ", F.try_element_at(units, m["timo_id"]), m["ditm_nombre"]))
    street = F.when(_has("nom_via"), F.concat_ws(" ", F.try_element_at(types, F.col("tipo_via")), "nom_via", number))
    return F.concat_ws(" ", street, said("MANZANA ", "manzana"), said("LOTE ", "lote"), said("SUBLOTE ", "slote"), said("PISO ", "piso"), said("BLOCK ", "block"), F.array_join(modules, " "), F.concat_ws(" ", F.array_join("esquinas", " ")), F.col("nom_zona"), F.col("referencia"))


def _alias_words(names: Column, aliases: dict[str, str]) -> Column:
    """The words of all aliases whose target is one of the names, holds it or is held by it."""
    known = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(t).alias("target")) for a, t in aliases.items()])
    names = F.filter(F.transform(names, lambda n: F.upper(F.trim(n))), lambda n: n != "")
    said = lambda all_: F.filter(known, lambda a: F.exists(all_, lambda n: F.contains(n, a["target"]) | F.contains(a["target"], n)))
    # Most names have nothing to do with any alias, which one look at all targets tells.
    targets = list(dict.fromkeys(aliases.values()))
    related = lambda all_: F.exists(all_, lambda n: F.contains(F.lit("\n".join(targets)), n) | written(n, targets))
    words = lambda all_: canonical_tokens(F.array_join(F.transform(said(all_), lambda a: a["alias"]), " "))
    return let(names, lambda all_: F.when(related(all_), words(all_)).otherwise(F.array().cast("array<string>")))


def may_be_alike(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (_t, _u) of words whose letters in common allow that ratio; the others never reach Python."""
    bound = ratio_bound(numbered_grams(F.col("_t"), 1), numbered_grams(F.col("_u"), 1), F.char_length("_t"), F.char_length("_u"))
    return pairs.where(bound + F.lit(1e-9) >= least)


def coverage(df: DataFrame, text: str = "clean", key: str = "id") -> DataFrame:
    """V4: `raw_tokens`, `unmatched` and `coverage` of each row; aliases excuse words, the similarity helper sees leftovers only."""
    no_words = F.array().cast("array<string>")
    streets = F.concat(F.array("nom_via"), F.coalesce("esquinas", no_words))
    explained = F.concat(canonical_tokens(F.col("rebuilt")), _alias_words(streets, STREET_ALIASES), _alias_words(F.array("nom_zona"), ZONE_ALIASES))
    extra = F.concat(
        F.when(_has("nom_via"), words_to_array(lx.TOKEN_STREET_TYPES)).otherwise(no_words),
        F.when(_has("nom_zona") | F.col("zona_id").isNotNull(), words_to_array(lx.TOKEN_ZONE_TYPES)).otherwise(no_words),
        F.when(F.size("esquinas") > 0, words_to_array(lx.CORNER_WORDS)).otherwise(no_words),
    )
    df = df.withColumn("raw_tokens", canonical_tokens(F.col(text))).withColumn("_norm", explained).withColumn("_left", F.array_except("raw_tokens", F.concat("_norm", extra)))
    df = cut(df)  # or the words' rules would run anew wherever these columns are read
    rest = df.where((F.size("_left") > 0) & (F.size("_norm") > 0)).select(key, F.explode("_left").alias("_t"), "_norm").withColumn("_u", F.explode(F.array_distinct("_norm")))
    rest = rest.where(F.abs(F.char_length("_t") - F.char_length("_u")) <= 2).select(key, "_t", "_u")
    close = may_be_alike(rest.select("_t", "_u").distinct(), 0.88).withColumn("_r", seq_ratio("_t", "_u")).where("_r >= 0.88").select("_t", "_u")
    alike = rest.join(close, ["_t", "_u"]).groupBy(key).agg(F.collect_set("_t").alias("_alike"))
    # The lost words are found once a text, not for each of its words; mostly there are none.
    lost = F.when(F.size("_left") == 0, no_words).otherwise(F.array_except("_left", F.coalesce("_alike", no_words)))
    unmatched = let(lost, lambda lost: F.when(F.size(lost) == 0, no_words).otherwise(F.filter("raw_tokens", lambda t: F.array_contains(lost, t))))
    df = df.join(alike, key, "left").withColumn("unmatched", unmatched)
    n = F.size("raw_tokens")
    return df.withColumn("coverage", F.when(n > 0, (n - F.size("unmatched")) / n).otherwise(0.0)).drop("_norm", "_left", "_alike")


def validate(df: DataFrame, text: str = "clean", key: str = "id", threshold: float = 0.85) -> DataFrame:
    """V5: score = 0.6 coverage + 0.4 ratio of the sorted words; valid from the threshold on if coverage is 0.75 or more."""
    df = coverage(df.withColumn("rebuilt", rebuilt_text()), text, key)
    # Where all words are explained both texts are the same; only the others are put together and reach Python.
    df = cut(df)
    same = df.where(F.size("unmatched") == 0).withColumn("sequence_ratio", F.when(F.size("raw_tokens") > 0, F.lit(1.0)).otherwise(0.0))
    kept = F.filter("raw_tokens", lambda t: ~F.array_contains("unmatched", t))
    sorted_text = lambda words: F.array_join(F.sort_array(words), " ")
    rest = df.where(F.size("unmatched") > 0)
    df = same.union(rest.withColumn("sequence_ratio", seq_ratio(sorted_text(F.col("raw_tokens")), sorted_text(kept))))
    score = F.bround(0.6 * F.col("coverage") + 0.4 * F.col("sequence_ratio"), 3)
    df = df.withColumn("score", F.when(F.size("raw_tokens") > 0, score).otherwise(0.0))
    return df.withColumn("valid", (F.col("score") >= threshold) & (F.col("coverage") >= 0.75))


def veto(df: DataFrame) -> DataFrame:
    """V6: what is not valid becomes observed, with its score in the method."""
    why = F.concat(F.lit("SIMILITUD_INSUFICIENTE ("), F.format_string("%.1f", F.col("score").cast("double") * 100), F.lit("%)"))
    lost = F.col("es_procesado") & ~F.col("valid")
    df = df.withColumn("reasons", F.when(lost, F.array_append("reasons", why)).otherwise(F.col("reasons")))
    return settle(df.withColumn("metodo", F.when(lost, F.concat_ws(" ", "metodo", why)).otherwise(F.col("metodo"))))


def align_fields(df: DataFrame) -> DataFrame:
    """V7: plot fields as components and back: (codi_id, value) for what is filled, in a fixed order."""
    part = lambda i, c: F.when(_has(c), F.struct(F.lit(i).alias("codi_id"), F.upper(F.trim(F.col(c))).alias("diti_valor")))
    parts = F.array_compact(F.array(part(1, "manzana"), part(2, "lote"), part(3, "slote"), part(4, "piso"), part(11, "block")))
    return df.withColumn("componentes", parts)


def with_evidence(value: Column, text: Column, kind: str = "street") -> Column:
    """L2: an external value counts only if it shares a telling word with the text, or if an alias of it is written."""
    aliases = STREET_ALIASES if kind == "street" else ZONE_ALIASES
    known = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(t).alias("target")) for a, t in aliases.items()])
    said = F.struct(F.upper(value).alias("value"), F.upper(text).alias("text"))  # once, not for each alias
    alias = let(said, lambda u: F.exists(known, lambda a: F.contains(u["value"], a["target"]) & F.contains(u["text"], a["alias"])))
    return F.when(F.arrays_overlap(sig_tokens(value, kind), sig_tokens(sanitize(text), kind)) | alias, value)


_STREET_WORD = r"(?iU)\b(?:AV\.?|AVENIDA|CA\.?|CALLE|JR\.?|JIRON|PJE\.?|PASAJE)\b"
_ZONE_WORD = r"(?iU)\b(?:URB\.?|URBANIZACION|PJ\.?|PP\.?JJ\.?|PUEBLO\s+JOVEN|A\.?H\.?)\b"
# Words that are no evidence of a reference.
REFERENCE_STOPWORDS = ["DEL", "LOS", "LAS", "POR", "CON", "PARA", "SIN", "FRENTE", "CERCA", "COSTADO", "ENTRE", "CRUCE", "ESQ", "ESQUINA", "PISO", "BLOCK", "LOTE", "MANZANA"]


def zone_with_evidence(zone: Column, street: Column, text: Column) -> Column:
    """L2 for zones: no city, CERCADO only if written, a shared word or alias, and not the street's name over again."""
    said = F.upper(text)
    cercado = F.contains(F.upper(zone), F.lit("CERCADO")) & ~F.contains(said, F.lit("CERCADO"))
    city = F.upper(F.trim(zone)).isin(lx.CITIES)
    v, z = sig_tokens(F.regexp_replace(street, _STREET_WORD, ""), "street"), sig_tokens(F.regexp_replace(zone, _ZONE_WORD, ""), "zone")
    within = (F.size(F.array_except(v, z)) == 0) | (F.size(F.array_except(z, v)) == 0)
    again = F.coalesce((F.size(v) > 0) & (F.size(z) > 0) & within, F.lit(False)) & ~text.rlike(_ZONE_WORD)
    return F.when(~cercado & ~city & ~again, with_evidence(zone, text, "zone"))


def reference_with_evidence(value: Column, text: Column) -> Column:
    """L2 for references: dropped if it has telling words and none of them is in the text."""
    words = F.filter(F.regexp_extract_all(F.upper(value), F.lit(r"([A-ZÁÉÍÓÚÑ0-9]+)"), F.lit(1)), lambda w: (F.char_length(w) > 2) & ~w.isin(REFERENCE_STOPWORDS))
    return F.when((F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.upper(text), w)), value)


def combine(external: dict[str, Column], own: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """L3: the external value first, ours fills gaps; and how the row came about."""
    out = {k: F.coalesce(external.get(k, F.lit(None)), v) for k, v in own.items()}
    some = lambda cols: F.coalesce(*cols).isNotNull() if cols else F.lit(False)
    filled = F.lit(False)
    for k, v in own.items():
        filled = filled | (external.get(k, F.lit(None).cast("string")).isNull() & v.isNotNull())
    any_external = some(list(external.values()))
    return out, F.when(any_external & filled, "HIBRIDO").when(any_external, "IA").when(some(list(own.values())), "HEURISTICA").otherwise("DIRECTO")


def verdict(why: Column, street: Column, zone: Column, number: Column) -> Column:
    """L4: one sentence by priority: first reason, street with number, street, zone, nothing."""
    return F.coalesce(
        F.get(why, F.lit(0)),
        F.when(street.isNotNull() & number.isNotNull(), F.concat_ws(" ", F.lit("Vía oficial con numeración:"), street, number)),
        F.when(street.isNotNull(), F.concat_ws(" ", F.lit("Vía oficial:"), street)),
        F.when(zone.isNotNull(), F.concat_ws(" ", F.lit("Zona oficial:"), zone)),
        F.lit("Sin coincidencia"),
    )
