"""Text functions: Column in, Column out, all inside the JVM.

Rules are lists of (pattern, replacement) applied in order, so the order is data; steps of rules say what a text must have. Every pattern is Unicode
aware. Null stays null unless stated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

UPPER = "A-ZÁÉÍÓÚÑ"
_KEEPERS = "MZ|MZA|LT|LOTE|INT|DPTO|KM|CDRA|CUADRA"
_UNITS = "DPTO|DEP|DEPARTAMENTO|INT|INTERIOR|TDA|TIENDA|STAND|STD|PTO|PUESTO|LOCAL|LOC|OF|OFICINA|BLOCK|BLQ|PISO|PLANTA|MZ|MZA|LT|LOTE"

#: Rules of cleaning in order, in steps: what a text must have for any rule of the step to match (a pattern, or a list of
#: which one must be written, or both), and the rules. A text without it passes the step as it is, after one look at it.
#: Letters in either case: the lists name no I, K or S, which other letters equal without regard to case.
SANITIZE_STEPS = [
    (["-"], [(rf"([{UPPER}0-9])-([{UPPER}0-9])", "$1 - $2")]),
    (([*lx.EXPANSIONS], rf"(?U)\b(?:{'|'.join(lx.EXPANSIONS)})\b"), [
        *[(rf"(?U)\b{k}\.(?=[{UPPER}])", f"{v} ") for k, v in list(lx.EXPANSIONS.items())[:3]],
        *[(rf"(?U)\b{k}(?:\.|\b)", v) for k, v in lx.EXPANSIONS.items()],
    ]),
    # Glued units, blocks, lots and house numbers.
    (r"(?iU)\d[BDILMOPST]", [(rf"(?iU)(\d+)({_UNITS})\b", "$1 $2")]),
    ((["MZ", "LOTE", "LT"], rf"(?iU)(?:MZA?|LOTE)\b|LT[0-9.\s]"), [
        (rf"(?iU)([{UPPER}]{{2,}})(MZ|MZA|LOTE)\b", "$1 $2"),
        (rf"(?iU)([{UPPER}]{{2,}})(LT)(?=[0-9.\s])", "$1 $2"),
    ]),
    (["MZ"], [(r"(?iU)\b(MZ|MZA)\.?\s*([A-Z0-9])\s*(LT|LOTE)\b", "$1 $2 $3")]),
    (rf"(?U)0(?<=[{UPPER}]0)\d\d", [(rf"(?U)([{UPPER}]{{3,}})(0\d{{2,5}})", "$1 $2")]),
    (["PORVEN", "CTOR", "LORENZO", "MART", "CAMPODON"], [
        (r"(?iU)\b(PORVENIR|VICTORIA|LORENZO|MARTIN|CAMPODONICO)(SIMON|MANUEL|JOSE|FRANCISCO|PEDRO|AV|CA|CALLE|AVENIDA)\b", "$1 $2"),
    ]),
    (None, [(r"^(CHICLAYO|LAMBAYEQUE|FERRENAFE|PIMENTEL|LA VICTORIA|JLO|REQUE|MONSEFU)([A-ZÁÉÍÓÚ])", "$1 $2")]),
    # Numbers glued to words lose leading zeros, but for blocks, lots, units and the like.
    (rf"(?U)\d(?<=[{UPPER}]\d)", [
        (rf"(?U)\b((?!(?:{_KEEPERS})\d)[{UPPER}]{{2,}})(?=\d{{1,6}}\b)0*([1-9]\d*)\b", "$1 $2"),
        (rf"(?U)\b([{UPPER}]{{2,}})(\d{{1,6}})\b", "$1 $2"),
    ]),
    # Normal forms of units and numbers.
    (["INT"], [(r"(?U)\bINT\s*[-–.]\s*([A-Z0-9]+)", "INT-$1")]),
    (["DPTO"], [(r"(?U)\bDPTO\s*[-–.]\s*([A-Z0-9]+)", "DPTO-$1")]),
    (r"(?iU)\b(?:N|NUM|NRO)[°ºª.]*\s*(?:\d|S/?N\b)", [
        (r"(?iU)\b(?:N|NUM|NRO)[°ºª.]*\s*(\d+)", "N° $1"),
        (r"(?iU)\b(?:N|NUM|NRO)[°ºª.]*\s*S/?N\b", "S/N"),
    ]),
    (None, [(r"(?U)^(AV|CA|JR|PJE)\s+([A-Z])", "$1. $2")]),
    (["-"], [(r"(?U)^\s*-\s*", ""), (r"(?U)\s*-\s*$", "")]),
]


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is evaluated once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def written(text: Column, words: list[str]) -> Column:
    """Is one of the words part of the text? Needs no pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def apply_steps(text: Column, steps: list[tuple[str | list[str] | tuple[list[str], str] | None, list[tuple[str, str]]]]) -> Column:
    """The rules of all steps, each step only for texts that have what it needs."""
    for needs, rules in steps:
        if needs is None:
            text = apply_rules(text, rules)
        else:
            text = let(text, partial(_step, needs, rules))
    return text


def _step(needs: str | list[str] | tuple[list[str], str], rules: list[tuple[str, str]], text: Column) -> Column:
    if isinstance(needs, tuple):
        may = written(text, needs[0]) & text.rlike(needs[1])
    else:
        may = text.rlike(needs) if isinstance(needs, str) else written(text, needs)
    return F.when(may, apply_rules(text, rules)).otherwise(text)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank each; a text that has only single blanks is not built anew."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def _single_blanks(text: Column) -> Column:
    """squeeze() of a text whose only white space is the blank."""
    return F.trim(let(text, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)))


def _upper_printable(text: Column) -> Column:
    # Printable ASCII fails at once: most letters need no look at their category.
    printable = F.regexp_replace(F.coalesce(text, F.lit("")), r"[[^ -~]&&[\p{C}\p{Z}]]", "")
    return F.upper(_single_blanks(printable))


def _by_steps(text: Column) -> Column:
    return _single_blanks(apply_steps(text, SANITIZE_STEPS))


def sanitize(text: Column) -> Column:
    """The cleaned, upper-case form of an address; null and blank give ''."""
    return _by_steps(_upper_printable(text))


def sanitize_twice(text: Column) -> Column:
    """The cleaned form, cleaned again; where no rule changed the text, none would the second time."""
    again = lambda start, clean: F.when(start == clean, clean).otherwise(_by_steps(clean))
    return let(_upper_printable(text), lambda start: let(_by_steps(start), lambda clean: again(start, clean)))


_MARKED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy"


def remove_accents(text: Column) -> Column:
    """Latin letters without diacritics; combining marks are dropped."""
    # Letters without any are told by one look: each letter of the others is looked up.
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F°]"), F.regexp_replace(F.translate(t, _MARKED, _PLAIN), r"\p{M}", "")).otherwise(t))


VARIANT_STEPS = [
    (["ETAPA"], [
        (rf"(?iU)\b(?:{n}\s*(?:{suffix})|{roman}|{n})\s+ETAPA\b|\bETAPA\s+(?:{n}(?:{suffix})|{roman}|{n})\b", f"{word} ETAPA")
        for n, (word, roman, suffix) in lx.STAGES.items()
    ]),
    (["0"], [(r"(?U)\b0+(\d+)\b", "$1")]),
    (rf"(?iU)\b(?:{'|'.join(lx.NUMBER_WORDS)})\b", [(rf"(?iU)\b{word}\b", digit) for word, digit in lx.NUMBER_WORDS.items()]),
]


def normalize_variants(text: Column) -> Column:
    """Stages and written numbers in one form, without accents."""
    return squeeze(apply_steps(remove_accents(sanitize(text)), VARIANT_STEPS))


def words_to_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def sig_tokens(text: Column, kind: str) -> Column:
    """T4: the distinct telling words of a street or zone name."""
    stop = lx.STREET_STOPWORDS if kind == "street" else lx.ZONE_STOPWORDS
    found = F.regexp_extract_all(F.upper(text), F.lit(r"([A-Z0-9]+)"), F.lit(1))
    telling = F.filter(found, lambda w: (F.char_length(w) > 1) | w.rlike(r"^\d+$"))
    return F.array_distinct(F.array_except(telling, words_to_array(stop)))


#: Steps of the canonical words: what a text must have, as in SANITIZE_STEPS, and the rules.
CANONICAL_STEPS = [
    (r"(?U)\d[DEMRTV]", [(r"(?U)\b(\d+)(?:ER|ERO|RO|RA|DO|DA|TO|TA|VO|VA|MO|MA)\b", "$1")]),
    (r"(?U)P\.?\s*J", [(r"(?U)\b(?:P\.?P\.?\s*J\.?J\.?|P\.?J\.?)\b", " PUEBLO JOVEN ")]),
    (r"(?U)A\.?\s*H", [(r"(?U)\b(?:A\.?A\.?\s*H\.?H\.?|A\.?H\.?)\b", " ASENTAMIENTO HUMANO ")]),
    (r"(?U)C\.?P", [(r"(?U)\bC\.?P\.?\b", " CENTRO POBLADO ")]),
    (r"(?U)U\.?R\.?B", [(r"(?U)\bU\.?R\.?B\.?\b", " URBANIZACION ")]),
    (None, [(r"[.,;:_/\-()\[\]#°ºª\\–]+", " ")]),
    (rf"(?U)\d(?<=[{UPPER}]\d)", [(rf"(?U)([{UPPER}]{{2,}})(\d+)", "$1 $2")]),
    (rf"(?U)\d[{UPPER}]", [(rf"(?U)(\d+)([{UPPER}]{{2,}})", "$1 $2")]),
]


def _mapped(token: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    # A map is searched entry by entry, a list of constants by hash: most words are in neither.
    return F.when(token.isin(list(pairs)), F.try_element_at(table, token)).otherwise(token)


def canonical_tokens(text: Column) -> Column:
    """T5: the words of an address in canonical form, in order, repeats kept; [] for null or blank."""
    clean = squeeze(apply_steps(F.upper(remove_accents(F.coalesce(text, F.lit("")))), CANONICAL_STEPS))
    tokens = F.filter(F.split(clean, " "), lambda t: (t != "") & ~t.isin(lx.TOKEN_NOISE) & ~t.isin(lx.TOKEN_STOPWORDS))

    def canonical(t: Column) -> Column:
        number = F.regexp_replace(t, r"^0+(?=\d)", "")
        return let(F.when(t.rlike(r"^\d+$"), number).otherwise(_mapped(t, lx.TOKEN_ORDINALS)), lambda w: _mapped(w, lx.TOKEN_FORMS))

    return F.transform(tokens, canonical)


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many leading characters two words share."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.array_max(same)


def split_units(value: Column) -> Column:
    """A list or range of units as separate values; only if all parts are numbers or short codes."""
    clean = F.upper(F.trim(value))
    clean = F.regexp_replace(clean, r"(?U)^(?:INT(?:ERIOR)?|DPTO|DEP(?:ARTAMENTO)?|TIENDAS?|TDA|STANDS?|STD|OF(?:ICINA)?|LOCAL(?:ES)?|PUESTO|PTO|PUERTA|PTA)[.\s-]*", "")
    parts = F.filter(F.split(clean, r"(?U)\s*(?:,|-|\bY\b)\s*"), lambda p: p != "")
    fine = F.forall(parts, lambda p: p.rlike(r"^(?:\d+|[A-Z0-9]{1,3})$"))
    return F.when(clean == "", F.array().cast("array<string>")).when((F.size(parts) > 1) & fine, parts).otherwise(F.array(clean))


def clean_number(value: Column) -> Column:
    """The house number: a range without leading zeros, S/N, or the first digits."""
    v = F.upper(F.trim(value))
    v = F.trim(F.regexp_replace(v, r"(?U)\b(?:INT|DPTO|DEP|TDA|TIENDA|STAND|STD|OF|LOCAL|PISO|MZ|LT|LOTE)\b.*$", ""))
    pair = F.regexp_extract(v, r"^0*(\d+)\s*-\s*0*(\d+)$", 1), F.regexp_extract(v, r"^0*(\d+)\s*-\s*0*(\d+)$", 2)
    first = F.regexp_replace(F.regexp_extract(v, r"(\d+)", 1), r"^0+(?=\d)", "")
    return F.when(v.rlike(r"^S\s*/?\s*N$"), "S/N").when(pair[0] != "", F.concat_ws("-", *pair)).when(first != "", first)


def number_letter(value: Column) -> Column:
    """The letter behind a house number, which is a sublot."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(value)), r"(?U)^\d+\s*[-/]?\s*([A-Z])\b", 1), F.lit(""))


def kilometre(text: Column) -> Column:
    """T10: 'KM n' as written, which goes to the reference and is never a house number."""
    return F.nullif(F.regexp_extract(F.upper(text), r"(?U)\b(KM\.?\s*\d+(?:[.,+]\d+)?)", 1), F.lit(""))


_PLACEHOLDERS = ["", "-", "S/N", "SN", "NINGUNO", "NINGUNA", "NULL", "NONE", "N/A", "NO"]


def clean_sublot(value: Column) -> Column:
    """Sublot without prefix; placeholders, units, floors and landmarks give null; 100 characters."""
    v = F.trim(F.regexp_replace(F.upper(F.trim(value)), r"(?U)^(?:SUB[\s-]?LOTE|SLOTE|SLT)[.:\s-]*", ""))
    other = v.rlike(r"(?U)\b(?:INT(?:ERIOR)?|DPTO|DEP(?:ARTAMENTO)?|TIENDA|TDA|STAND|STD|OFICINA|OF|LOCAL|PISO|NIVEL|FRENTE|COSTADO|CERCA|ALTURA|ESPALDA)\b")
    return F.when(~v.isin(_PLACEHOLDERS) & ~other, F.left(v, F.lit(100)))


def clean_reference(value: Column, text: Column) -> Column:
    """Reference without floors, units, blocks and lots and orphan connectors; kept if over two letters and a word of it is in the text."""
    v = F.regexp_replace(F.upper(F.trim(value)), r"(?U)\b(?:\d+(?:DO|ER|TO|VO|MO)?\.?\s*)?PISO(?:\s*\d+)?\b|\b(?:INT|DPTO|DEP|TDA|TIENDA|STAND|STD|OF)[.\s-]*[A-Z]?\d*\b|\b(?:MZ|MZA|LT|LOTE)\.?\s*[A-Z0-9]+\b", " ")
    v = squeeze(F.regexp_replace(squeeze(v), r"(?U)^(?:Y|CON|DE|DEL|-|,)\s+|\s+(?:Y|CON|DE|DEL|-|,)$", ""))
    known = F.exists(F.split(v, " "), lambda w: (F.char_length(w) > 2) & (F.instr(F.upper(text), w) > 0))
    return F.when((F.char_length(v) > 2) & known, v)


CAPS = {"num_via": 50, "manzana": 20, "lote": 20, "slote": 100, "piso": 20, "block": 20, "nom_via": 255, "referencia": 500, "nom_zona": 150, "unidad": 150}


def capped(column: Column, field: str) -> Column:
    """A field cut to its length."""
    return F.trim(F.left(column, F.lit(CAPS[field])))


def record_state(column: Column) -> Column:
    """Stored state as 'A' or 'I'."""
    v = F.upper(F.trim(column))
    return F.when(v.isin("I", "INA", "INACTIVO"), "I").otherwise("A")
