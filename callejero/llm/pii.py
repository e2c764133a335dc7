"""Operator 5: surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, keys and tokens, IP addresses of both versions, card and account numbers, phone numbers
and names behind a title. Each mention is cut into parts in a canonical form: the digits of a number, the
lower-cased local part and domain of an address, the given and the family name without title. Each distinct
part gets one surrogate in the whole corpus, so `4111 1111` and `4111-1111`, or `Mrs Jones` and `Mr John
Jones`, stay linked; the surrogate then takes on each mention's separators, case and title.

Surrogates are keyed hashes of kind, part and attempt, in the part's own format: digits for digits, letters
for other letters of the same case and script. Card numbers that pass the Luhn check get surrogates that
pass it and keep their first digit; octets stay below 256; country codes, prefixes of tokens and endings of
domains stay. Names are made of syllables by script and gender: that of the titles a given name bears
anywhere in the corpus (neutral if none or both), and of a Cyrillic family name's ending.

Collision checks keep parts apart: a surrogate that equals another's, or any part of its kind in the corpus,
is drawn again with the next attempt. Names grow by a syllable an attempt, and what cannot change (no
letter or digit) or still collides after `PLAIN_ATTEMPTS` gets digits of its hash, so every part ends with
a surrogate of its own. Only distinct parts are shuffled for that; mentions join back by part, a join that
Spark splits where a part is hot. Texts without entities are not shuffled.

Null texts stay null, empty ones empty; mentions of any length are replaced whole. Repeated rows and equal
texts get equal results; ids play no part. Extra columns pass through; `text` and a column `_entities` are
replaced. An empty table gives an empty result. Names without one of the titles are not found, nor local numbers of seven
digits without an area code; a full and a shortened IPv6 address count as two. Digits behind a complete
telephone or card number are no part of it, so a number has one surrogate whatever follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, stored, table

#: Setting that holds the secret key; the query falls back on DEMO_KEY, which is no secret and for trials only.
KEY_SETTING, DEMO_KEY = "spark.callejero.surrogateKey", "callejero-demo"
#: Attempts in the part's own format; later ones add digits of the hash.
PLAIN_ATTEMPTS = 6
#: Parts whose surrogates one task draws.
PARTS_PER_TASK = 2_000

_WORD = r"\p{L}\p{N}"
_TOKEN = r"(?:AKIA|ASIA)|(?:sk|pk|rk)[-_]|gh[pousr]_|xox[abprs]-|eyJ"
_TITLE = "Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr"
#: Titles that count in capitals too; the shorter ones are also abbreviations.
_CAPITAL_TITLE = "MRS|MR|MISS|DR|PROF|HERR|FRAU|MONSIEUR|MADAME|SEÑORA|SEÑOR"

_SEP = r"[ .\-]"
#: Shapes of telephone numbers: each is as long as its plan, so digits that follow are left to what comes next.
_PHONES = [
    rf"(?:\+\d{{1,3}}{_SEP}?)?\(\d{{2,4}}\){_SEP}?\d{{3,4}}{_SEP}?\d{{3,4}}",
    rf"\+1{_SEP}?\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{4}}",
    rf"\+\d{{1,3}}{_SEP}\d{{1,3}}(?:{_SEP}\d\d){{3,4}}",
    rf"\+\d{{1,3}}{_SEP}\d\d{_SEP}\d{{3}}{_SEP}\d{{3}}{_SEP}\d\d",
    rf"\+\d{{1,3}}{_SEP}\d{{2,4}}{_SEP}\d{{5,8}}",
    rf"\+\d{{1,3}}{_SEP}\d{{2,5}}{_SEP}\d{{3,5}}(?:{_SEP}\d{{3,4}})?",
    rf"\+\d{{1,3}}{_SEP}\d{{6,12}}|\+\d{{8,15}}",
    rf"\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}",
    r"0\d{2,4}[ /\-]\d{5,8}",
]
#: Cards and accounts: digits in one run, or in the groups of a card with one separator throughout.
_NUMBERS = [r"\d{13,19}", *[rf"\d{{4}}{x}\d{{4}}{x}\d{{4}}{x}\d{{4}}|\d{{4}}{x}\d{{6}}{x}\d{{4,5}}" for x in (" ", "-")], r"\d{3}-\d{2}-\d{4}"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"

#: Kind -> pattern, in order of precedence. No group repeats without a bound, so long runs need no stack.
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+\-])[{_WORD}._%+\-]++@[{_WORD}\-]++\.[{_WORD}.\-]*[{_WORD}\-]",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)[-_][0-9A-Za-z_\-]{16,}|gh[pousr]_[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z\-]{10,}|eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]+)(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.\p{{L}}])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": rf"(?<![0-9A-Za-z:])(?=[A-Fa-f:]{{0,30}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX}|(?:{_HEX}:){{1,7}}:)(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": rf"(?<![\d\p{{L}}])(?<!\d[.\-/])(?:{'|'.join(_PHONES)})(?!\d|-\d)",
    "number": rf"(?<![\d\p{{L}}])(?:{'|'.join(_NUMBERS)})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_CAPITAL_TITLE})\.? \p{{Lu}}[\p{{Lu}}'\-]+(?![\p{{L}}'\-])(?: \p{{Lu}}[\p{{Lu}}'\-]+(?![\p{{L}}'\-]))?|(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'\-]+(?: \p{{Lu}}[\p{{L}}'\-]+)?",
}
#: What every entity has: a digit, an at sign, the beginning of a token, or a title. Most texts have none and skip the patterns.
HINT = rf"[\d@]|{_TOKEN}|[A-Fa-f]{{32}}|(?<!\p{{L}})(?:{_TITLE}|{_CAPITAL_TITLE})\.? \p{{Lu}}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

_FEMALE, _MALE = r"(?iu)^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)\b", r"(?iu)^(?:Mr|Herr|Monsieur|Señor|Sr)\b"

#: Alphabets in which a letter is replaced by another of the same one.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "áéíóúñüäößèêç", "ÁÉÍÓÚÑÜÄÖÈÊÇ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: Runs of letters of one script and case, as code points: Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Han, Hangul.
RUNS = [(0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3093), (0x30A1, 0x30F6), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]

#: Script -> beginnings, middles, and endings by kind and gender of made names.
SYLLABLES = {
    "latin": (["Ba", "Be", "Da", "Do", "Fa", "Fi", "Ga", "Ha", "Ju", "Ka", "Le", "Lo", "Ma", "Mi", "Na", "Pa", "Ra", "Ro", "Sa", "To", "Va", "Wi"], ["bri", "da", "lo", "ma", "mi", "na", "ne", "ra", "ri", "sa", "se", "ta", "ti", "vi"],
              {"given_f": ["na", "lia", "ra", "ssa", "tte"], "given_m": ["n", "rd", "s", "ro", "k"], "given_n": ["l", "ne", "y", "is"], "family": ["berg", "ford", "ler", "ndez", "nier", "son", "ski", "ton"]}),
    "cyrillic": (["Ан", "Бо", "Ва", "Да", "Ки", "Ла", "Ма", "Ни", "Па", "Ро", "Са", "Та"], ["ва", "ди", "ла", "ми", "на", "ри", "си", "то"],
                 {"given_f": ["на", "рия", "ла"], "given_m": ["н", "р", "слав"], "given_n": ["ша", "ня"], "family": ["нов", "рин", "лев"]}),
}


def kind_of(entity: Column) -> Column:
    found = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        # Look-arounds hold at the ends of the entity as they did in the text.
        found = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def _part(kind: str | Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("part"))


def parts_of(kind: Column, entity: Column) -> Column:
    """The parts (kind, part) of a mention in canonical form; `given` carries its gender as kind."""
    mail = F.split(F.lower(entity), "@")
    prefix = F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .\-(])", 0)
    rest = F.regexp_replace(F.substr(entity, F.char_length(prefix) + 1), r"\D", "")
    bare = F.split(F.regexp_replace(entity, r"^\p{L}+\.? ", ""), " ")
    given = F.when(entity.rlike(_FEMALE), "given_f").when(entity.rlike(_MALE), "given_m").otherwise("given_n")
    family = _part("family", F.initcap(F.element_at(bare, -1)))
    return (
        F.when(kind == "email", F.array(_part("local", mail[0]), _part("domain", mail[1])))
        .when(kind == "phone", F.array(_part("phone", F.concat(prefix, F.lit("|"), rest))))
        .when(kind == "number", F.array(_part("number", F.regexp_replace(entity, r"\D", ""))))
        .when(kind == "iban", F.array(_part("iban", F.regexp_replace(entity, " ", ""))))
        .when(kind == "ip6", F.array(_part("ip6", F.lower(entity))))
        .when((kind == "name") & (F.size(bare) > 1), F.array(_part(given, F.initcap(bare[0])), family))
        .when(kind == "name", F.array(family))
        .otherwise(F.array(_part(kind, entity)))
    )


def _byte(i: Column) -> Column:
    """The i-th of the hash's 32 bytes `_bytes`; further ones repeat, shifted by their round."""
    return F.get("_bytes", i % 32) + (F.floor(i / 32) % 1000).cast("int") * 7


def _characters(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _letters(entity: Column, hexadecimal: Column) -> Column:
    """Each letter and digit replaced by another of its alphabet or run; a key of hexadecimal digits stays one."""

    def step(n: Column, size: int) -> Column:
        return n % (size - 1) + 1

    def swap(c: Column, i: Column) -> Column:
        n, point = _byte(i), F.ascii(c)
        new = F.when(hexadecimal & c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1)))
        new = new.when(hexadecimal & c.rlike("[A-F]"), F.substr(F.lit("ABCDEF0123456789"), n % 16 + 1, F.lit(1)))
        for alphabet in ALPHABETS:
            at = F.instr(F.lit(alphabet), c)
            new = new.when(at > 0, F.substr(F.lit(alphabet), (at - 1 + step(n, len(alphabet))) % len(alphabet) + 1, F.lit(1)))
        for first, last in RUNS:
            moved = (point - first + step(n * 251, last - first + 1)) % (last - first + 1) + first
            new = new.when(point.between(first, last), F.decode(F.unhex(F.lpad(F.hex(moved.cast("long")), 8, "0")), "UTF-32"))
        return new.otherwise(c)

    return F.array_join(F.transform(_characters(entity), swap), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def add(total: Column, x: Column) -> Column:
        d = x["d"].cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(x["i"] % 2 == 1, twice).otherwise(d)

    numbered = F.transform(_characters(F.reverse(digits)), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add)


def _name(kind: Column, part: Column, plain: Column, attempt: int) -> Column:
    """A made name with attempt further syllables; plain if no syllables suit the script."""

    def pick(options: list[str], at: int) -> Column:
        return F.get(F.array(*map(F.lit, options)), (_byte(F.lit(2 * at)) * 256 + _byte(F.lit(2 * at + 1))) % len(options))

    def made(script: str) -> Column:
        begin, middle, endings = SYLLABLES[script]
        stem = F.concat(pick(begin, 0), *[pick(middle, 1 + k) for k in range(1 + min(attempt, 6))])
        ending = None
        for k, options in endings.items():
            ending = F.when(kind == k, pick(options, 9)) if ending is None else ending.when(kind == k, pick(options, 9))
        female = (kind == "family") & part.rlike("а$")
        return F.concat(stem, ending, F.when(female, "а").otherwise("")) if script == "cyrillic" else F.concat(stem, ending)

    of = r"^[\p{%s}'\-]+$"
    return F.when(part.rlike(of % "IsLatin"), made("latin")).when(part.rlike(of % "IsCyrillic"), made("cyrillic")).otherwise(plain)


def with_surrogates(parts: DataFrame, attempt: int, key: str) -> DataFrame:
    """parts (kind, part, form) with the surrogate of each at some attempt."""
    kind, part, plain, hashed = F.col("form"), F.col("part"), F.col("_plain"), F.col("_hash")
    columns = parts.columns
    # Each step is a column that the next one reads often; the kind of a given name holds no gender here.
    parts = parts.withColumn("_hash", F.sha2(F.concat_ws("|", F.lit(key), "kind", "part", F.lit(str(attempt))), 256))
    parts = parts.withColumn("_bytes", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr("_hash", i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    parts = parts.withColumn("_plain", _letters(part, (kind == "ip6") | part.rlike("^[0-9A-Fa-f]{32,}$")))

    def with_head(head: Column) -> Column:
        return F.concat(head, F.substr(plain, F.char_length(head) + 1))

    ending = F.regexp_extract(part, r"\.[^.]+$", 0)
    domain = F.concat(F.left(plain, F.char_length(plain) - F.char_length(ending)), ending)
    octets = F.transform(F.split(part, r"\."), lambda o, i: (_byte(i) % 254 + 1).cast("string"))
    # Numbers that pass the Luhn check keep the first digit and get a last one with which they pass again.
    stem = F.concat(F.left(part, F.lit(1)), F.substr(plain, F.lit(2), F.char_length(plain) - 2))
    check = (F.lit(10) - _luhn_sum(F.concat(stem, F.lit("0"))) % 10) % 10
    number = F.when(_luhn_sum(part) % 10 == 0, F.concat(stem, check.cast("string"))).otherwise(plain)
    made = (
        F.when(kind == "domain", domain).when(kind == "ip", F.array_join(octets, ".")).when(kind == "number", number)
        .when(kind == "phone", with_head(F.regexp_extract(part, r"^\+?\d*\|", 0))).when(kind == "iban", with_head(F.left(part, F.lit(2))))
        .when(kind == "secret", with_head(F.regexp_extract(part, f"^(?:{_TOKEN})", 0))).when((kind == "family") | kind.startswith("given"), _name(kind, part, plain, attempt))
        .otherwise(plain)
    )
    parts, made = parts.withColumn("_made", made), F.col("_made")
    digits = F.left(F.regexp_replace(hashed, "[^0-9]", ""), F.lit(12))
    mark = F.when(kind.isin("local", "domain", "secret", "family", "given_f", "given_m", "given_n"), F.left(F.translate(hashed, "0123456789", "ghijklmnop"), F.lit(12))).otherwise(digits)
    marked = F.when(kind == "domain", F.concat(mark, made)).when(kind == "ip", F.concat(made, F.lit("."), F.lit("1"), mark)).otherwise(F.concat(made, mark))
    made = marked if attempt >= PLAIN_ATTEMPTS else F.when(made == part, marked).otherwise(made)
    return parts.select(*columns, made.alias("surrogate"))


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """kind, part, surrogate for distinct parts (kind, part, form); within a kind no two surrogates are equal, none equals a part."""
    with Scratch(parts.sparkSession) as scratch:
        parts = scratch.stored(parts)
        tasks = 1 + parts.count() // PARTS_PER_TASK
        taken, rest, attempt = None, parts, 0
        while True:
            drawn = scratch.stored(with_surrogates(rest.repartition(tasks), attempt, key))
            real = parts.select("kind", F.col("part").alias("surrogate"))
            if taken is not None:
                real = real.union(taken.select("kind", "surrogate"))
            first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("part")) == 1
            good = drawn.join(real, ["kind", "surrogate"], "left_anti").withColumn("_first", first).where("_first").select("kind", "part", "surrogate")
            good = scratch.stored(good)
            taken = good if taken is None else taken.union(good)
            rest = scratch.stored(drawn.join(good, ["kind", "part"], "left_anti").drop("surrogate"))
            attempt += 1
            if rest.isEmpty():
                return stored(taken)


def dressed(kind: Column, mention: Column, new: Callable[[int], Column]) -> Column:
    """The surrogates of a mention's parts with its separators, case and title."""

    def like(old: Column, made: Column) -> Column:
        """made, with capitals where old has them."""
        capital = lambda c, m: F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(m)).otherwise(m)
        return F.array_join(F.zip_with(_characters(old), _characters(made), lambda c, m: F.coalesce(capital(c, m), m, F.lit(""))), "")

    def between(separators: str, made: Column) -> Column:
        """The characters of made in the places that mention has between separators."""
        return F.array_join(F.zip_with(F.split(mention, separators), _characters(made), lambda s, c: F.concat(F.coalesce(s, F.lit("")), F.coalesce(c, F.lit("")))), "")

    mail = F.split(mention, "@")
    title = F.regexp_extract(mention, r"^\p{L}+\.? ", 0)
    name = F.concat_ws(" ", new(0), new(1))
    bare = F.substr(mention, F.char_length(title) + 1)
    return (
        F.when(kind == "email", F.concat(like(mail[0], new(0)), F.lit("@"), like(mail[1], new(1))))
        .when(kind.isin("phone", "number"), between("[0-9]", F.regexp_replace(new(0), r"\D", "")))
        .when(kind == "iban", between("[0-9A-Z]", new(0)))
        .when(kind == "ip6", like(mention, new(0)))
        .when(kind == "name", F.concat(title, F.when(F.upper(bare) == bare, F.upper(name)).otherwise(name)))
        .otherwise(new(0))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with every entity in `text` replaced, and `_entities`, the number of mentions replaced; key is the caller's secret."""
    if not key:
        raise ValueError("surrogates need a key")
    columns = [c for c in docs.columns if c != "_entities"]
    docs = docs.select(*columns)
    some = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    found = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))
    # One scan cuts the texts that have entities into what is between them and the mentions.
    others = [c for c in columns if c != "text"]
    cut = stored(docs.where(some).select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_rest") if others else F.lit(0).alias("_rest"), F.split("text", ANY).alias("_between"), found.alias("_found")))
    each = cut.select("_row", F.posexplode("_found").alias("_at", "_mention")).withColumn("_kind", kind_of(F.col("_mention")))
    each = stored(each.withColumn("_parts", parts_of(F.col("_kind"), F.col("_mention"))))
    single = each.select("_row", "_at", F.posexplode("_parts").alias("_k", "_part")).select("_row", "_at", "_k", F.regexp_replace("_part.kind", "_.$", "").alias("kind"), F.col("_part.part").alias("part"), F.col("_part.kind").alias("form"))
    # A given name's form follows its titles: neutral if they tell nothing or differ.
    told = F.collect_set(F.when(~F.col("form").endswith("_n"), F.col("form")))
    form = F.when(F.col("kind") != "given", F.col("kind")).when(F.size("_told") == 1, F.col("_told")[0]).otherwise("given_n")
    names = surrogates(single.groupBy("kind", "part").agg(told.alias("_told")).select("kind", "part", form.alias("form")), key)
    new = single.join(names, ["kind", "part"]).groupBy("_row", "_at").agg(F.max(F.when(F.col("_k") == 0, F.col("surrogate"))).alias("_0"), F.max(F.when(F.col("_k") == 1, F.col("surrogate"))).alias("_1"))
    worn = dressed(F.col("_kind"), F.col("_mention"), lambda i: F.col(f"_{i}"))
    lists = each.join(new, ["_row", "_at"]).select("_row", F.struct("_at", worn.alias("_new")).alias("_x"))
    lists = lists.groupBy("_row").agg(F.sort_array(F.collect_list("_x")).alias("_new")).withColumn("_new", F.transform("_new", lambda x: x["_new"]))
    text = F.array_join(F.zip_with("_between", "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = cut.join(lists, "_row").withColumn("_text", text)
    changed = changed.select(*[F.col("_text").alias("text") if c == "text" else F.col("_rest")[c].alias(c) for c in columns], F.size("_new").cast("long").alias("_entities"))
    return docs.where(~some).select(*columns, F.lit(0).cast("long").alias("_entities")).unionByName(changed)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get(KEY_SETTING, DEMO_KEY)).select("doc_id", "text", F.col("_entities").alias("n_entities"))
