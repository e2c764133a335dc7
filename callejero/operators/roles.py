"""Which written name is the street and which the zone, and the streets of a corner.

The candidate names of all texts meet the two catalogues in one exact join, once per distinct name, and what is
found is stored by name. Each text then looks up the names of its roles; every decision is an expression over these
hits. Texts that ask for no name pass by: they are neither looked up nor moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import lexicon as lx
from ..functions.text import let, squeeze, written
from ..session import cut
from . import match as mt

_TRAILING = r"(?U)\s*(?:\b(?:NUM|NRO|N)\b[°.]*|N°)?\s*(\d+)$"
_STREET_MARKS = ["AV.", "AV", "AVENIDA", "CA.", "CA", "CALLE", "JR.", "JR", "JIRON", "PSJ.", "PSJ", "PJE.", "PASAJE", "PROL.", "PROL", "PROLONGACION", "MALECON", "ALAMEDA"]
_ZONE_MARKS = ["URB.", "URB", "URBANIZACION", "PJ.", "PJ", "P.J.", "PP.JJ.", "PUEBLO JOVEN", "A.H.", "AH", "AA.HH.", "ASENTAMIENTO HUMANO", "CASERIO", "FUNDO", "COOP.", "COOPERATIVA"]
_CORNER = r"(?U)\b(?:ESQ(?:UINA)?|CON|CRUCE|Y)\b|/"


def _bare(name: Column) -> Column:
    """The name without a number at its end, null if nothing else is left."""
    return F.nullif(F.trim(F.regexp_replace(name, _TRAILING, "")), F.lit(""))


def _number(name: Column) -> Column:
    """The number at the end of a name, without leading zeros (S/N for zero)."""
    digits = F.nullif(F.regexp_extract(name, _TRAILING, 1), F.lit(""))
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.when(digits.isNotNull(), "S/N"))


def _marked(text: Column, name: Column, marks: list[str]) -> Column:
    """Is the name written behind one of the marks?"""
    start = F.left(name, F.lit(10))
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, "[-,(]", " "))
    behind = lambda x: reduce(lambda a, b: a | b, [F.contains(x["spaced"], F.concat(F.lit(f" {m} "), x["start"])) for m in marks])
    return F.coalesce(let(F.struct(spaced.alias("spaced"), start.alias("start")), behind), F.lit(False))  # once, not for each mark


def with_hits(df: DataFrame, candidates: dict[str, Column], vias: DataFrame, zonas: DataFrame) -> DataFrame:
    """df (cheap to read twice) with `hit`: role -> the name and the ids of the street and zone so called."""
    each = df.select(F.explode(F.array(*candidates.values())).alias("name"))
    names = each.where("name is not null").distinct()
    streets = mt.match_exact(names, mt.name_index(vias, "via_id", "nom_via"), "via_id", hint=None, sector=None)
    zones = mt.match_exact(names, mt.name_index(zonas, "zona_id", "nom_zona", unique=True), "zona_id", hint=None, sector=None)
    named = streets.join(vias.select("via_id", "nom_via"), "via_id", "left").join(zones, "name")
    # Stored, its size is known: few names are sent to the texts, in place of the texts to the names.
    named = cut(named.where("via_id is not null or zona_id is not null").select("name", "via_id", "nom_via", "zona_id"))
    roles = {role: f"_hit{i}" for i, role in enumerate(candidates)}
    df = df.withColumns({f"{c}_name": candidates[role] for role, c in roles.items()})
    for c in roles.values():
        side = named.select(F.col("name").alias("_key"), F.struct("name", "via_id", "nom_via", "zona_id").alias(c))
        df = df.join(side, F.col(f"{c}_name") == F.col("_key"), "left").drop("_key", f"{c}_name")
    return df.withColumn("hit", F.struct(*[F.col(c).alias(role) for role, c in roles.items()])).drop(*roles.values())


def _via(role: str) -> Column:
    return F.col("hit").getField(role)["via_id"]


def _is_via(role: str) -> Column:
    return _via(role).isNotNull()


def _is_zona(role: str) -> Column:
    return F.col("hit").getField(role)["zona_id"].isNotNull()


def settle_pair(df: DataFrame, vias: DataFrame, zonas: DataFrame) -> DataFrame:
    """Street, zone and number of 'A - B n' where no street was found, and `cruce`: both names if both are streets only.

    The name that carries the number is the street if the catalogue has it; then zone - street, street - zone,
    two streets; without any hit the first name is the zone. Cities and blocks are no part of a pair.
    """
    named, df = df.where("nom_via is not null"), df.where("nom_via is null")
    pair = ex.zone_and_street(F.col("clean"))
    df = df.withColumn("_a", pair["first"]).withColumn("_b", pair["second"]).withColumn("_n", pair["number"])
    block = r"^(?:MZ|MZA|MANZANA|LT|LOTE)\b"
    usable = F.col("_b").isNotNull() & ~F.col("_a").isin(lx.CITIES) & ~F.col("_b").isin(lx.CITIES) & ~F.col("_a").rlike(block)
    df = df.withColumn("_pair", F.coalesce(usable, F.lit(False)))
    of = lambda c: F.when(F.col("_pair"), c)
    df = cut(df)  # or the pattern would run anew wherever its parts are read
    df = with_hits(df, {"a": of(F.col("_a")), "b": of(F.col("_b")), "a-": of(_bare(F.col("_a"))), "b-": of(_bare(F.col("_b")))}, vias, zonas)
    # A number at the end is part of the name where the catalogue has it so.
    n1, n2 = (F.when(~whole & _bare(F.col(c)).isNotNull(), _number(F.col(c))) for c, whole in (("_a", _is_zona("a") | _is_via("a")), ("_b", _is_zona("b") | _is_via("b"))))
    df = df.withColumn("_n1", n1).withColumn("_n2", F.coalesce(n2, F.ltrim(F.col("_n"), F.lit("0"))))
    bare_a, bare_b = F.col("_n1").isNotNull(), n2.isNotNull()
    name = {"a": F.when(bare_a, _bare(F.col("_a"))).otherwise(F.col("_a")), "b": F.when(bare_b, _bare(F.col("_b"))).otherwise(F.col("_b"))}
    v = {"a": F.when(bare_a, _is_via("a-")).otherwise(_is_via("a")), "b": F.when(bare_b, _is_via("b-")).otherwise(_is_via("b"))}
    z = {"a": F.when(bare_a, _is_zona("a-")).otherwise(_is_zona("a")), "b": F.when(bare_b, _is_zona("b-")).otherwise(_is_zona("b"))}
    choice = (
        F.when(bare_a & v["a"], "street first").when(F.col("_n2").isNotNull() & v["b"], "zone first").when(z["a"] & v["b"], "zone first")
        .when(v["a"] & z["b"], "street first").when(v["a"] & v["b"], "two streets").otherwise("no hit")
    )
    df = df.withColumn("_choice", F.when(F.col("_pair"), choice))
    street = F.when(F.col("_choice").isin("street first", "two streets"), name["a"]).when(F.col("_choice").isNotNull() & ~name["b"].rlike(block), name["b"])
    zone = F.when(F.col("_choice") == "street first", name["b"]).when(F.col("_choice") == "zone first", name["a"]).when(F.col("_choice") == "no hit", F.coalesce("nom_zona", name["a"]))
    df = df.withColumns({
        "nom_zona": F.coalesce(zone, "nom_zona"), "nom_via": F.coalesce("nom_via", street), "num_via": F.coalesce("num_via", F.when(F.col("_choice").isNotNull() & street.isNotNull(), F.coalesce("_n1", "_n2"))),
        "cruce": F.when(F.col("_choice") == "two streets", F.array(name["a"], name["b"])),
    })
    df = df.drop("_a", "_b", "_n", "_n1", "_n2", "_pair", "_choice", "hit")
    return df.unionByName(named.withColumn("cruce", F.lit(None).cast("array<string>")))


def settle_pieces(df: DataFrame, vias: DataFrame, zonas: DataFrame) -> DataFrame:
    """A street text that is no street of the catalogue but two or three names: zone and street, or streets that cross."""
    joined = F.coalesce(written(F.col("nom_via"), ["-", "Y", "CON", "ESQ", "CRUCE"]), F.lit(False))
    parts = ex.street_pieces(F.col("nom_via"))
    df = df.withColumn("_p", F.when(joined, let(parts, lambda p: F.when(F.size(p) > 1, F.transform(p, F.trim)))))
    whole, df = df.where("_p is null").drop("_p"), cut(df.where("_p is not null"))
    df = with_hits(df, {"whole": F.col("nom_via"), **{f"p{i}": F.get("_p", F.lit(i)) for i in range(3)}}, vias, zonas)
    p = [F.get("_p", F.lit(i)) for i in range(3)]
    two, three = (F.coalesce((F.size("_p") == n) & ~_is_via("whole"), F.lit(False)) for n in (2, 3))
    rule = (
        F.when(two & _is_zona("p0") & _is_via("p1") & ~_is_via("p0"), "zone first").when(two & _is_zona("p1") & _is_via("p0") & ~_is_via("p1"), "street first")
        .when(two & _is_via("p0") & _is_via("p1"), F.when(_via("p0") == _via("p1"), "one street").otherwise("crossing"))
        .when(three & _is_via("p0") & _is_via("p1") & _is_via("p2"), "crossing")
    )
    df = df.withColumn("_rule", rule)
    street = F.when(F.col("_rule") == "zone first", p[1]).when(F.col("_rule") == "one street", F.col("hit.p0.nom_via")).when(F.col("_rule").isNotNull(), p[0])
    zone = F.when(F.col("_rule") == "zone first", p[0]).when(F.col("_rule") == "street first", p[1])
    cross = F.when(F.col("_rule") == "crossing", F.col("_p"))
    df = df.withColumns({"nom_via": F.coalesce(street, "nom_via"), "nom_zona": F.coalesce(zone, "nom_zona"), "cruce": F.coalesce("cruce", cross)})
    return df.drop("_p", "_rule", "hit").unionByName(whole)


def swap_roles(df: DataFrame, vias: DataFrame, zonas: DataFrame) -> DataFrame:
    """Street and zone swapped, or a name moved to the empty role, where the catalogues say so.

    Both names behind marks of their own kind are never swapped. Two streets and no zone: the second goes, as
    'ESQ. name' into the reference if the text shows a corner. A zone that stands alone as street takes that
    role, and the reference or the first other part of the text becomes the street.
    """
    text, via, zona, ref = (F.col(c) for c in ("clean", "nom_via", "nom_zona", "referencia"))
    df = with_hits(df, {"via": via, "zona": zona}, vias, zonas)
    vv, vz, zv, zz = (F.coalesce(c, F.lit(False)) for c in (_is_via("via"), _is_zona("via"), _is_via("zona"), _is_zona("zona")))
    zone_mark = _marked(text, zona, _ZONE_MARKS) | F.coalesce(zona.rlike(r"^(?:SECTOR|ETAPA)\b"), F.lit(False))
    df = df.withColumns({"_street_mark": _marked(text, via, _STREET_MARKS), "_zone_mark": zone_mark})
    street_mark, zone_mark = F.col("_street_mark"), F.col("_zone_mark")
    both = via.isNotNull() & zona.isNotNull()
    free = both & ~(street_mark & zone_mark)
    sure = free & vz & zv & ((~zz & ~street_mark) | ~vv)
    swap = sure | (free & ~vv & vz & ~zz & ~street_mark)
    crossing = both & vv & zv & ~vz & ~zz & ~zone_mark
    other = F.col("hit.zona.nom_via")
    own = F.col("hit.via.nom_via")
    words = F.filter(F.split(other, " "), lambda w: F.char_length(w) > 2)
    corner = crossing & ~F.contains(own, other) & ~F.contains(other, own) & F.forall(words, lambda w: F.contains(text, w)) & (text.rlike(_CORNER) | F.contains(text, F.lit(" - ")))
    # The first part of the text that is another name than the one that turns out to be a zone.
    parts = F.transform(F.split(text, r"\s*[-–—,]\s*"), lambda s: F.struct(_bare(squeeze(F.regexp_replace(s, r"(?U)\bS/N\b", ""))).alias("name"), _number(s).alias("number")))
    parts = F.filter(parts, lambda s: s["name"].isNotNull() & (s["name"] != via) & ~s["name"].isin(lx.CITIES) & ~F.contains(s["name"], via))
    lone = via.isNotNull() & zona.isNull() & ~vv & vz
    found = F.when(ref.isNotNull(), F.struct(_bare(ref).alias("name"), _number(ref).alias("number"))).otherwise(F.get(parts, F.lit(0)))
    found = F.when(lone & found["name"].isNotNull(), found)
    moved = via.isNull() & zona.isNotNull() & zv & ~zz
    last = F.when(sure, _number(text))
    df = df.withColumns({"_swap": swap, "_sure": sure, "_crossing": crossing, "_corner": F.when(corner, F.concat(F.lit("ESQ. "), other)), "_found": found, "_moved": moved, "_last": last})
    name, number = F.col("_found")["name"], F.col("_found")["number"]
    df = df.withColumns({
        "nom_via": F.when(F.col("_swap") | F.col("_moved"), zona).otherwise(F.coalesce(name, via)),
        "nom_zona": F.when(F.col("_swap") | name.isNotNull(), via).when(~F.col("_moved") & ~F.col("_crossing"), zona),
        "num_via": F.coalesce("num_via", F.when(F.col("_sure"), F.col("_last")), number),
        "referencia": F.when(F.col("_corner").isNotNull(), F.when(ref.isNotNull() & F.contains(ref, F.col("_corner")), ref).otherwise(F.concat_ws(" - ", "_corner", ref))).when(name.isNull() | ~F.contains(ref, name), ref),
    })
    return df.drop("hit", "_swap", "_sure", "_crossing", "_corner", "_found", "_moved", "_last", "_street_mark", "_zone_mark")


def with_streets(df: DataFrame, vias: DataFrame, zonas: DataFrame, most: int = 3) -> DataFrame:
    """`vias`, the matched street and those that cross it, in order, none twice: via_id, divi_numero, divi_orden."""
    names = F.slice(F.concat(F.coalesce(F.slice("cruce", 2, 2), F.array().cast("array<string>")), F.coalesce("esquinas", F.array().cast("array<string>"))), 1, 4)
    df = df.withColumn("_x", names)
    alone, df = df.where(F.size("_x") == 0).drop("_x"), cut(df.where(F.size("_x") > 0))
    df = with_hits(df, {f"x{i}": F.get("_x", F.lit(i)) for i in range(4)}, vias, zonas)
    number = F.coalesce("num_via", F.lit("S/N"))
    ids = F.array_compact(F.array("via_id", *[_via(f"x{i}") for i in range(4)]))
    ids = F.when(F.col("via_id").isNotNull(), F.slice(F.array_distinct(ids), 1, most)).otherwise(F.array().cast("array<bigint>"))
    row = lambda v, n, i: F.struct(v.alias("via_id"), n.alias("divi_numero"), i.alias("divi_orden"))
    rows = F.transform(ids, lambda v, i: row(v, F.when(i == 0, number).otherwise("S/N"), i + 1))
    own = F.array(row(F.col("via_id"), number, F.lit(1)))
    none = F.array().cast("array<struct<via_id:bigint,divi_numero:string,divi_orden:int>>")
    alone = alone.withColumn("vias", F.when(F.col("via_id").isNotNull(), own).otherwise(none))
    return df.withColumn("vias", rows).drop("hit", "_x").unionByName(alone)
