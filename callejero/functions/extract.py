"""Fields cut from a cleaned address, as columns.

A pattern over a whole text is run only where one of the words is written that it can't match without (`needs`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import UPPER, let, squeeze, written

_WORD = rf"[{UPPER}0-9 .]"
#: Street type words, longest first so that a prefix does not win.
STREET_PREFIX = "|".join(sorted({s.replace(".", r"\.") for _, _, names in lx.STREET_TYPES.values() for s in names}, key=lambda s: (-len(s), s)))
ZONE_PREFIX = r"URBANIZACION|URB\.?|PUEBLO JOVEN|P\.J\.|PJ|A\.H\.|AH|ASENTAMIENTO HUMANO|UPIS|COOPERATIVA|COOP\.?|SECTOR|CONDOMINIO|RESIDENCIAL"
_ZONE_NEEDS = ["URB", "PUEBLO JOVEN", "P.J.", "PJ", "A.H.", "AH", "ASENTAMIENTO HUMANO", "UPIS", "COOP", "SECTOR", "CONDOMINIO", "RESIDENCIAL"]


def _get(text: Column, pattern: str, group: int = 1, needs: list[str] | None = None) -> Column:
    """The group of the first match, null without one or if it is blank; the text is evaluated once, without needs."""
    found = F.trim(F.regexp_extract(text, f"(?U){pattern}", group))
    found = let(found, lambda v: F.when(v != "", v))
    return found if needs is None else F.when(written(text, needs), found)


def _shortest(words: list[str]) -> list[str]:
    """The words that hold no other one: any of the words is written only where one of these is."""
    return [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]


def street_type(text: Column) -> Column:
    """Id of the first type, in catalogue order, that is written."""
    found = F.lit(None).cast("int")
    for id_, (_, _, names) in reversed(lx.STREET_TYPES.items()):
        words = sorted({n.rstrip(".") for n in names if len(n) > 2}, key=lambda s: (-len(s), s))
        stems = "|".join(w.replace(".", r"\.") for w in words)
        found = F.when(written(text, _shortest(words)) & text.rlike(rf"(?U)\b(?:{stems})\b"), F.lit(id_)).otherwise(found)
    return found


_STOP = r"(?=\s+(?:N°|NUM|NRO|S/N|\d|\(|MZ|LT|,|-)|\s*$|\s*,|\s*-)"


def street_name(text: Column) -> Column:
    """The name behind a street type, else behind a leading city and before a number."""
    typed = _get(text, rf"(?:^|\s)(?:{STREET_PREFIX})\s+([{UPPER} .]+?){_STOP}")
    city = _get(text, rf"^(?:CHICLAYO|LAMBAYEQUE|FERRENAFE|PIMENTEL|LA VICTORIA|JLO)\s*(?:-\s*)?([{UPPER} .-]+?)\s+(?:N°\s*)?(?:\d+|S/N)")
    return let(F.coalesce(typed, city), lambda name: F.when(~is_no_street(name), name))


def is_no_street(name: Column) -> Column:
    """City names and blocks or lots never stand as a street."""
    return name.isin(lx.CITIES) | name.rlike(r"^(?:MZ|MZA|MANZANA|LT|LOTE)\b")


def zone_and_street(text: Column) -> Column:
    """Struct of both parts and the number of 'A - B n'."""
    pattern = rf"^({_WORD}+?)\s*(?<!INT)(?<!DPTO)(?<!DEP)-\s*({_WORD}+?)(?:,?\s+(\d+|S/N)\b|\s+(?:BLOCK|MZ|LT)\b|\s*-\s*|$)"
    return F.struct(_get(text, pattern, 1).alias("first"), _get(text, pattern, 2).alias("second"), _get(text, pattern, 3).alias("number"))


# Streets named by a date or number, in order of precedence.
DATE_STREETS = ["7 DE ENERO SUR", "SIETE DE ENERO SUR", "7 DE ENERO", "SIETE DE ENERO", "8 DE OCTUBRE", "9 DE OCTUBRE", "NUEVE DE OCTUBRE", "28 DE JULIO", "27 DE JULIO", "1 DE MAYO", "1 DE NOVIEMBRE", "15 DE ABRIL", "14 DE ABRIL", "12 DE FEBRERO", "6 DE JUNIO", "7 ENSAYOS"]


def date_street(text: Column, zone: Column) -> Column:
    """E5: the first of the known date streets that is written and not part of the zone."""
    return F.coalesce(*[F.when(written(text, [s]) & text.rlike(rf"(?U)\b{s}\b") & ~F.coalesce(F.contains(zone, F.lit(s)), F.lit(False)), F.lit(s)) for s in DATE_STREETS])


def date_street_parts(text: Column, zone: Column) -> Column:
    """E5: struct of the date street, the number behind it (a marked one first) and the letter behind that.

    Null street: null number and letter. Digits of the street's own name are no number of a house.
    """
    return let(date_street(text, zone), lambda street: _behind_date(text, street))


def _behind_date(text: Column, street: Column) -> Column:
    # Its first mention counts; what stands before it may hold other numbers.
    rest = F.substr(text, F.instr(text, street) + F.char_length(street))
    marked, plain = r"\b(?:N°|NUM°?|NRO\.?|N)\s*(\d+)\b", r"\b(\d+)\b"
    number = F.coalesce(_get(rest, marked), _get(rest, plain))
    letter = r"\s*[-/]?\s*([A-Z])\b"
    behind = F.when(rest.rlike(rf"(?U){marked}"), _get(rest, marked + letter, 2)).otherwise(_get(rest, plain + letter, 2))
    return F.struct(street.alias("street"), number.alias("number"), behind.alias("letter"))


def house_number(text: Column, name: Column) -> Column:
    """S/N, the number behind N°, or the one behind the street's name."""
    marked = _get(text, r"\bN°\.?\s*(\d+)\b", needs=["N°"])
    rest = F.call_function("substring_index", text, name, F.lit(-1))
    after = F.when(F.contains(text, name), _get(rest, r"^\s+(?:N°?\s*)?(\d+)\b"))
    return F.when(name.isNotNull(), F.when(written(text, ["S/N"]) & text.rlike(r"(?U)\bS/N\b"), F.lit("S/N")).otherwise(F.coalesce(marked, after)))


def door_letter(text: Column, number: Column) -> Column:
    """The single letter behind the house number."""
    return F.when(number.rlike(r"^\d+$"), _get(F.call_function("substring_index", text, number, F.lit(-1)), r"^\s*[-/]?\s*([A-Z])\b"))


def block(text: Column) -> Column:
    """E7: 'manzana'."""
    return _get(text, r"\b(?:MANZANA|MZA|MZ)\b\.?\s*[:-]?\s*([A-Z0-9]+)\b", needs=["MANZANA", "MZ"])


def lot(text: Column) -> Column:
    """E7: 'lote'."""
    return _get(text, r"\b(?:LOTE|LT)\b\.?\s*[:-]?\s*([A-Z0-9]+)\b", needs=["LOTE", "LT"])


def zone_name(text: Column) -> Column:
    """The name before '- MZ', or behind a zone prefix, without street prefix and city."""
    before = _get(text, rf"^([{UPPER} .]+?)\s+-\s*(?:MZA?|MANZANA)\b", needs=["MZ", "MANZANA"])
    behind = _get(text, rf"\b(?:{ZONE_PREFIX})\s+([^,;()-]+?)(?=\s+(?:{STREET_PREFIX}|MZ|LT|LOTE|MANZANA|BLOCK|BLOQUE|BLQ|TORRE|DPTO|DEP|PISO|REF)\b|,|;|\(|\s*-|$)", needs=_ZONE_NEEDS)
    name = F.coalesce(let(before, lambda b: F.when(~b.isin(lx.CITIES), b)), behind)
    name = squeeze(F.regexp_replace(name, r"(?U)\s+(?:CHICLAYO|LAMBAYEQUE|FERRENAFE)$", ""))
    return F.coalesce(name, F.when(written(text, ["CERCADO"]) & text.rlike(r"(?U)\bCERCADO\b"), F.lit("CERCADO DE CHICLAYO")))


def zone_type(text: Column) -> Column:
    """Id of the written zone type; CERCADO last."""
    rules = [
        (1, r"AA\.?HH\.?|A\.H\.?|ASENTAMIENTO\s+HUMANO", ["HH", "A.H", "HUMANO"]), (5, r"PP\.?JJ\.?|P\.J\.?|PUEBLO\s+JOVEN", ["JJ", "P.J", "JOVEN"]), (7, r"UPIS|URB(?:ANIZACION|\.)?\s*POP(?:ULAR)?", ["UPIS", "POP"]),
        (6, r"URB(?:ANIZACION)?|H\.U\.?", ["URB", "H.U"]), (10, "ASOC(?:IACION)?", ["ASOC"]), (11, "COOP(?:ERATIVA)?", ["COOP"]), (26, r"C\.P\.?M?|CENTRO\s+POBLADO", ["C.P", "POBLADO"]), (8, "CERCADO", ["CERCADO"]),
    ]
    return F.coalesce(*[F.when(written(text, needs) & text.rlike(rf"(?U)\b(?:{p})\b"), F.lit(i)) for i, p, needs in rules])


def reference(text: Column) -> Column:
    """Parentheses, REF:, a phrase of place, between two streets, a crossing, or a shopping centre."""
    return F.coalesce(
        _get(text, r"\(([^)]+)\)", needs=["("]),
        _get(text, r"\bREF(?:ERENCIA)?\.?\s*[:-]?\s*([^,;()]+)", needs=["REF"]),
        _get(text, r"\b((?:CERCA\s+(?:AL?|DE)|FRENTE\s+AL?|(?:AL\s+)?COSTADO\s+DEL?|A\s+ESPALDAS?\s+DEL?|A\s+(?:LA\s+)?ALTURA\s+DEL?|A\s+MEDIA\s+CUADRA\s+DEL?)\s+[^,;()]+)", needs=["CERCA", "FRENTE", "COSTADO", "ESPALDA", "ALTURA", "CUADRA"]),
        _get(text, rf"\b(ENTRE\s+{_WORD}+?\s+Y\s+[^,;()]+)", needs=["ENTRE"]),
        _get(text, r"\b(CRUCE\s+(?:CON\s+)?[^,;()]+)", needs=["CRUCE"]),
        _get(text, r"\b((?:(?:C\.?C\.?|CENTRO\s+COMERCIAL|MALL)\s+)?(?:REAL\s+PLAZA|OPEN\s+PLAZA|PLAZA\s+BOLOGNESI)|MALL\s+AVENTURA|BOULEVARD)\b", needs=["PLAZA", "MALL", "BOULEVARD"]),
    )


def floor_number(text: Column) -> Column:
    """The first number of the floor phrase."""
    phrase = _get(text, r"\b((?:\d+(?:DO|ER|TO|VO|MO)?\.?\s*(?:Y\s*\d+(?:DO|ER|TO|VO|MO)?\.?\s*)?PISO)|(?:PISO\s*\d+))\b", needs=["PISO"])
    return _get(phrase, r"(\d+)")


def tower(text: Column) -> Column:
    """Block or tower, not behind 'DE LA', not a number mark."""
    return _get(text, r"(?<!DE LA )\b(?:BLOCK|BLOQUE|BLQ|TORRE)\s+(?!N°|NRO|NUM|N\b)([A-Z0-9-]+)\b", needs=["BLOCK", "BLOQUE", "BLQ", "TORRE"])


_UNIT_WORDS = {n.rstrip("."): id_ for id_, (_, names) in lx.UNIT_TYPES.items() for n in names} | {"TIENDAS": 5, "STANDS": 4, "LOCALES": 9}
_UNIT = rf"\b({'|'.join(sorted(_UNIT_WORDS, key=lambda s: (-len(s), s)))})\b[.\s-]*([A-Z]?\d+[A-Z]?(?:(?:\s*,\s*|\s*-\s*|\s+Y\s+)[A-Z]?\d+[A-Z]?)*|[A-Z](?:-[A-Z])?\b)"


def units(text: Column) -> Column:
    """Distinct (type, value) of every unit phrase, lists and ranges split, in order."""
    kinds = F.regexp_extract_all(text, F.lit(f"(?U){_UNIT}"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"(?U){_UNIT}"), F.lit(2))
    ids = F.create_map(*[F.lit(x) for pair in _UNIT_WORDS.items() for x in pair])

    def each(pair: Column) -> Column:
        parts = F.split(pair["1"], r"\s*(?:,|-|\bY\b)\s*")
        return F.transform(parts, lambda p: F.struct(F.element_at(ids, pair["0"]).alias("timo_id"), p.alias("ditm_nombre")))

    found = F.array_distinct(F.flatten(F.transform(F.arrays_zip(kinds.alias("0"), values.alias("1")), each)))
    none = F.array().cast("array<struct<timo_id:int,ditm_nombre:string>>")
    return F.when(written(text, _shortest(list(_UNIT_WORDS))), found).when(text.isNotNull(), none)


def corner_names(text: Column) -> Column:
    """The streets named behind CON, ESQ or CRUCE, at most two more than the first."""
    found = F.regexp_extract_all(text, F.lit(rf"(?U)\b(?:CON|ESQ(?:UINA)?\.?|CRUCE)\s+(?:CON\s+)?(?:(?:{STREET_PREFIX})\s+)?([{UPPER} .]+?)(?=\s+(?:N°|\d|INT|DPTO|PISO|CON|ESQ|CRUCE)|\s*[-,(]|\s*$)"), F.lit(1))
    names = F.slice(F.array_distinct(F.transform(found, F.trim)), 1, 2)
    return F.when(written(text, ["CON", "ESQ", "CRUCE"]), names).when(text.isNotNull(), F.array().cast("array<string>"))


def street_pieces(name: Column) -> Column:
    """A street text that holds two or three streets, split."""
    parts = F.filter(F.split(name, r"(?U)\s+-\s+|\s+Y\s+|\s+CON\s+|\s+ESQ\.?\s+|\s+CRUCE\s+"), lambda p: F.char_length(p) > 2)
    return F.when(F.size(parts).between(2, 3), parts).otherwise(F.array(name))


def is_shop(name: Column) -> Column:
    """Shops, markets and malls are not streets or zones but references."""
    brands = "|".join(b.replace("-", r"\-") for b in lx.BRANDS if b not in ("METRO", "NOW"))
    return name.rlike(rf"(?U)\b(?:MERCADO|MALL|REAL PLAZA|OPEN PLAZA|CENTRO COMERCIAL|GALERIA|{brands})\b")


def noisy_zone(name: Column) -> Column:
    """V1: why an uncatalogued zone is none: 'number', 'shop' or 'unit'; null for a name."""
    shop = r"(?U)\b(?:GRAN\s+PLAZA|REAL\s+PLAZA|OPEN\s+PLAZA|AEROPUERTO|MERCADO|MDO|MALL|GALERIA)\b"
    unit = r"(?U)\b(?:TIENDA|TDA|STAND|STD|INT(?:ERIOR)?|DPTO|DEP|EDIF(?:ICIO)?|PLANTA|PISO|PLAZA)\b"
    return F.when(F.trim(name).rlike(r"^\d+$"), "number").when(name.rlike(shop), "shop").when(name.rlike(unit), "unit")


def formal_zone(text: Column) -> Column:
    """V1: an urbanisation or settlement is written, so its zone must be in the catalogue."""
    needs = ["URB", "PJ", "P.J", "JJ", "JOVEN", "AH", "A.H", "HH", "HUMANO", "UPIS", "CONJ"]
    return written(text, needs) & text.rlike(rf"(?U)\b(?:URB\.?|URBANIZACION|P\.?J\.?|PP\.?\s?JJ\.?|PUEBLO\s+JOVEN|A\.?H\.?|AA\.?\s?HH\.?|ASENTAMIENTO\s+HUMANO|UPIS|CONJ\.?\s*HAB\.?)(?!\w)")


def unclear_unit(text: Column) -> Column:
    """A shop unit with a name in place of a number."""
    return written(text, ["TIENDA", "STAND", "PUESTO", "LOCAL"]) & text.rlike(r"(?U)\b(?:TIENDA|STAND|PUESTO|LOCAL)\s+(?!N°|NRO|NUM|\d|[A-Z]\b|[A-Z]?-?\d)[A-Z]{3,}")


# Written form -> district, in order of precedence. Santa Rosa is a zone's name too and counts only with its word.
OUTSIDE = {
    "PIMENTEL": "PIMENTEL", "JOSE LEONARDO ORTIZ": "JOSE LEONARDO ORTIZ", "JOSÉ LEONARDO ORTIZ": "JOSE LEONARDO ORTIZ", "JLO": "JOSE LEONARDO ORTIZ", "J.L.O.": "JOSE LEONARDO ORTIZ",
    "LA VICTORIA": "LA VICTORIA", "LAMBAYEQUE": "LAMBAYEQUE", "FERRENAFE": "FERRENAFE", "FERREÑAFE": "FERRENAFE", "MONSEFU": "MONSEFU", "MONSEFÚ": "MONSEFU", "REQUE": "REQUE",
    "ETEN": "ETEN", "PUERTO ETEN": "PUERTO ETEN", "CIUDAD ETEN": "CIUDAD ETEN", "DISTRITO SANTA ROSA": "SANTA ROSA", "DISTRITO DE SANTA ROSA": "SANTA ROSA", "CALETA SANTA ROSA": "SANTA ROSA",
    "PICSI": "PICSI", "POMALCA": "POMALCA",
}
_ZONE_WORDS = ZONE_PREFIX + r"|PP\.JJ\.?|P\.J\.?|AA\.HH\.?|A\.H\.?|H\.U\.?|C\.P\.?M?\.?|CENTRO POBLADO|ASOCIACION|ASOC\.?|COOPERATIVA|URB\.? POP\.?|HABILITACION URBANA|LOTIZACION"
_NAMED = rf"(?<!\b(?:{STREET_PREFIX}|{_ZONE_WORDS})\s{{1,2}})"


def outside_district(text: Column, street: Column, zone: Column, via_id: Column | None = None, zona_id: Column | None = None) -> Column:
    """A district that is written as place, not as part of the street's or zone's name.

    None for a zone of the catalogue, or for a street of the catalogue where CHICLAYO is written as the district.
    """
    hits = []
    for d, name in OUTSIDE.items():
        part = F.coalesce(F.contains(street, F.lit(d)), F.lit(False)) | F.coalesce(F.contains(zone, F.lit(d)), F.lit(False))
        said = d.replace(".", r"\.")
        hits.append(F.when(written(text, [d]) & ~part & text.rlike(rf"(?U){_NAMED}(?<=^|[-–—,/\s])\b{said}(?!\w)"), F.lit(name)))
    found = F.coalesce(*hits)
    if zona_id is not None:
        found = F.when(zona_id.isNull(), found)
    if via_id is not None:
        chiclayo = text.rlike(r"(?U)(?:^|[-–—,/]|\bDISTRITO\s+(?:DE\s+)?)\s*CHICLAYO\b")
        found = let(found, lambda name: F.when(name.isNotNull() & ~(via_id.isNotNull() & chiclayo), name))
    return found
