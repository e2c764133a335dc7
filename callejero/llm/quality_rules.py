"""Operator 7: quality rules with adaptive thresholds.

Each document gets its counts in one pass. Four ratios (symbols, repeated lines, repeated words, word
length) are sketched per language and source: values fall into bins whose width grows by the factor
GROWTH, and a sketch is the count per bin. Sketches merge by adding counts, so a language's or the
corpus's sketch is the sum of its groups' sketches, and the result does not depend on the order of rows.
A document fails a ratio if it lies above the upper quartile of its group by more than `fence` times the
distance of the quartiles plus a tolerance; word length has a lower limit of the same kind. Most documents
have no repeated line or word at all, so for these two ratios (SPARSE) the quartiles are those of the values
above 0, and the limit is never below LEAST, what is nowhere unusual. Symbols keep the quartiles of all
values: where three quarters of a group have none, those that have some are the unusual ones. A group's upper limit is at most `wider` times its language's, and a language's
at most `wider` times the corpus's, so a source of junk does not set its own limit. Groups of fewer than
`min_rows` values (`min_some` for SPARSE) use their language's limits, and languages of fewer the corpus's.

Null texts count as empty; null languages and sources are groups of their own; an empty table gives an
empty result. Extra columns pass through; the counts are in the struct `_rules`, which replaces a column
of that name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import apart, stored, table, with_broadcast_if_small
from ._tokens import NOT_SPACE, covered, per_text, slices, windows, words

#: Bins of the sketches: value v > FLOOR falls into bin ceil(log(v / FLOOR) / log(GROWTH)), all less into bin 0.
GROWTH, FLOOR = 1.05, 1e-4
REPEAT_WINDOW = 5

#: Ratio -> tolerance beyond its fence.
SLACK = {"symbols": 0.02, "dup_lines": 0.0, "repeats": 0.0, "long_words": 0.5}
#: Ratios whose quartiles leave out the zeros -> the least limit.
SPARSE = {"dup_lines": 0.1, "repeats": 0.1}
#: Ratios that can be too low as well.
TWO_SIDED = ["long_words"]

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_RULES = "struct<" + ", ".join(f"{c}: bigint" for c in _COUNTS) + ">"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _count_by_text(mask: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[begin])


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines), len(lines) - len(set(lines))


def _counter(keep: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            w = words(texts, NOT_SPACE)
            buf = np.frombuffer(w.data, np.uint8)
            begin = np.cumsum([0] + [len(t) + 1 for t in texts])
            symbols = _count_by_text(_SYMBOL[buf], begin)
            chars = _count_by_text(NOT_SPACE[buf] & ((buf & 0xC0) != 0x80), begin)
            n = np.diff(w.first)
            at, found = windows(w, REPEAT_WINDOW)
            repeated = np.zeros(len(w.hash), bool)
            if len(at):
                own = w.text[at]
                order = np.lexsort((found, own))
                same = (found[order][1:] == found[order][:-1]) & (own[order][1:] == own[order][:-1])
                twice = np.zeros(len(at), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                repeated = covered(len(w.hash), at[twice], REPEAT_WINDOW)
            lines = np.array([_dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
            arrays = [n, chars, symbols, lines[:, 1], per_text(w, repeated), lines[:, 0]]
            rules = pa.StructArray.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=_COUNTS)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], rules], names=[*keep, "_rules"])

    return count


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with `_rules`: the counts of every whole text."""
    keep = [c for c in docs.columns if c != "_rules"]
    docs = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `_rules` {_RULES}"
    return docs.mapInArrow(_counter(keep), schema)


def base_failed(r: Column) -> Column:
    return (r["n_words"] < 10) | (100 * r["n_repeat_words"] > 20 * r["n_words"])


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ratios(r: Column) -> dict[str, Column]:
    return {
        "symbols": _share(r["n_symbols"], r["word_chars"]),
        "dup_lines": _share(r["n_dup_lines"], r["n_lines"]),
        "repeats": _share(r["n_repeat_words"], r["n_words"]),
        "long_words": _share(r["word_chars"], r["n_words"]),
    }


def bin_of(value: Column) -> Column:
    return F.when(value > FLOOR, F.ceil(F.round(F.ln(value / FLOOR) / math.log(GROWTH), 9))).otherwise(F.lit(0)).cast("int")


def bin_value(bin_: Column) -> Column:
    return F.when(bin_ > 0, F.lit(FLOOR) * F.pow(F.lit(GROWTH), bin_ - 0.5)).otherwise(F.lit(0.0))


def sketches(counted: DataFrame, by: list[str]) -> DataFrame:
    """The mergeable sketches: by, ratio, bin, n. Base failures are left out: they are rejected anyway.

    Zeros of SPARSE ratios are left out too: a group without a value above 0 has nothing to be judged by them.
    """
    r = F.col("_rules")
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), bin_of(v).alias("bin")) for k, v in ratios(r).items()])
    rows = counted.where(~base_failed(r)).select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.ratio", "_p.bin")
    rows = rows.where((F.col("bin") > 0) | ~F.col("ratio").isin(list(SPARSE)))
    return rows.groupBy(*by, "ratio", "bin").agg(F.count("*").alias("n"))


def _limits(sketch: DataFrame, by: list[str], fence: float) -> DataFrame:
    """Limits per group and ratio from a sketch, with the group's rows."""
    group = Window.partitionBy(*by, "ratio")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col("bin")))
    found = ranked.groupBy(*by, "ratio").agg(at(0.25).alias("_q1"), at(0.75).alias("_q3"), F.first("_all").alias("rows"))
    low, high = bin_value(F.col("_q1")), bin_value(F.col("_q3"))
    slack = F.create_map(*[x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v))])
    reach = fence * (high - low) + slack[F.col("ratio")]
    least = F.coalesce(F.create_map(*[x for k, v in SPARSE.items() for x in (F.lit(k), F.lit(v))])[F.col("ratio")], F.lit(0.0))
    lower = F.when(F.col("ratio").isin(TWO_SIDED), low - reach)
    return found.select(*by, "ratio", "rows", F.greatest(high + reach, least).alias("upper"), lower.alias("lower"))


def thresholds(counted: DataFrame, fence: float = 3.0, min_rows: int = 50, wider: float = 2.0, min_some: int = 20) -> DataFrame:
    """lang, source, and a map of each ratio to its upper and lower limit."""
    fine = stored(sketches(counted, ["lang", "source"]))
    by_lang = fine.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("ratio", "bin").agg(F.sum("n").alias("n"))
    a = _limits(fine, ["lang", "source"], fence).alias("a")
    b = _limits(by_lang, ["lang"], fence).alias("b")
    c = _limits(whole, [], fence).alias("c")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.ratio") == F.col("b.ratio"))).join(c, F.col("a.ratio") == F.col("c.ratio"))
    enough = F.when(F.col("a.ratio").isin(list(SPARSE)), min_some).otherwise(min_rows)
    own, lang = F.col("a.rows") >= enough, F.col("b.rows") >= enough
    of_lang = F.when(lang, F.least(F.col("b.upper"), wider * F.col("c.upper"))).otherwise(F.col("c.upper"))
    upper = F.when(own, F.least(F.col("a.upper"), wider * of_lang)).otherwise(of_lang)
    lower = F.when(own, F.col("a.lower")).when(lang, F.col("b.lower")).otherwise(F.col("c.lower"))
    limit = F.struct(upper.alias("upper"), lower.alias("lower"))
    picked = joined.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("a.ratio").alias("ratio"), limit.alias("limit"))
    maps = picked.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("ratio", "limit"))).alias("_limits"))
    return stored(maps)


def judge(docs: DataFrame, fence: float = 3.0, min_rows: int = 50, wider: float = 2.0, min_some: int = 20) -> DataFrame:
    """docs with `_rules` and `_kept`; thresholds come from all of docs. One side of the join is small."""
    limits = thresholds(with_counts(docs.select("text", "lang", "source")), fence, min_rows, wider, min_some)
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_limits")
    counted = with_counts(docs.drop("_kept", "_limits", "_lang", "_source"))
    joined = counted.join(with_broadcast_if_small(limits), counted["lang"].eqNullSafe(limits["_lang"]) & counted["source"].eqNullSafe(limits["_source"]), "left")
    r = F.col("_rules")
    fine = F.lit(True)
    for k, v in ratios(r).items():
        limit = F.col("_limits")[k]
        fine = fine & F.coalesce(v <= limit["upper"], F.lit(True)) & F.coalesce(v >= limit["lower"], F.lit(True))
    return joined.withColumn("_kept", ~base_failed(r) & fine).drop("_lang", "_source", "_limits")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns, whatever these are called."""
    docs, back = apart(docs, "_kept", "_limits", "_lang", "_source", "_rules")
    return judge(docs).where("_kept").select(*back)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    r = F.col("_rules")
    return judge(docs).select(
        "doc_id", *[r[c].alias(c) for c in _COUNTS[:5]], base_failed(r).alias("base_failed"), F.col("_kept").alias("kept")
    )


OP7_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM wins) WHERE n > 1),
rep AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, unnest(generate_series(i, i + 4)) AS at FROM twice) GROUP BY row),
counts AS (
  SELECT s.row, s.doc_id, s.lang, s.source, CAST(len(s.w) AS BIGINT) AS n_words, CAST(length(array_to_string(s.w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(s.lines) - len(list_distinct(s.lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(s.lines) AS n_lines
  FROM split s LEFT JOIN rep r ON s.row = r.row),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
ratios AS (
  SELECT row, doc_id, lang, source, base_failed, unnest([
    {'ratio': 'symbols', 'v': CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END, 'slack': 0.02, 'least': 0.0, 'enough': 50},
    {'ratio': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END, 'slack': 0.0, 'least': 0.1, 'enough': 20},
    {'ratio': 'repeats', 'v': CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END, 'slack': 0.0, 'least': 0.1, 'enough': 20},
    {'ratio': 'long_words', 'v': CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END, 'slack': 0.5, 'least': 0.0, 'enough': 50}], recursive := true) FROM judged),
binned AS (SELECT *, CAST(CASE WHEN v > 1e-4 THEN ceil(round(ln(v / 1e-4) / ln(1.05), 9)) ELSE 0 END AS INTEGER) AS bin FROM ratios),
good AS (SELECT * FROM binned WHERE NOT base_failed AND (bin > 0 OR ratio NOT IN ('dup_lines', 'repeats'))),
ranked AS (
  SELECT 1 AS level, lang, source, ratio, slack, least, bin, row_number() OVER (PARTITION BY lang, source, ratio ORDER BY bin) AS k, count(*) OVER (PARTITION BY lang, source, ratio) AS n FROM good
  UNION ALL
  SELECT 2, lang, NULL, ratio, slack, least, bin, row_number() OVER (PARTITION BY lang, ratio ORDER BY bin), count(*) OVER (PARTITION BY lang, ratio) FROM good
  UNION ALL
  SELECT 3, NULL, NULL, ratio, slack, least, bin, row_number() OVER (PARTITION BY ratio ORDER BY bin), count(*) OVER (PARTITION BY ratio) FROM good),
quartiles AS (
  SELECT level, lang, source, ratio, slack, least, n, min(CASE WHEN k >= ceil(n * 0.25) THEN bin END) AS q1, min(CASE WHEN k >= ceil(n * 0.75) THEN bin END) AS q3
  FROM ranked GROUP BY level, lang, source, ratio, slack, least, n),
limits AS (
  SELECT level, lang, source, ratio, n, greatest(high + (3.0 * (high - low) + slack), least) AS upper, CASE WHEN ratio = 'long_words' THEN low - (3.0 * (high - low) + slack) END AS lower FROM (
    SELECT *, CASE WHEN q1 > 0 THEN 1e-4 * pow(1.05, q1 - 0.5) ELSE 0.0 END AS low, CASE WHEN q3 > 0 THEN 1e-4 * pow(1.05, q3 - 0.5) ELSE 0.0 END AS high FROM quartiles)),
verdict AS (
  SELECT b.row, bool_and(a.n IS NULL OR b.v <= CASE WHEN a.n >= b.enough THEN least(a.upper, 2.0 * CASE WHEN l.n >= b.enough THEN least(l.upper, 2.0 * c.upper) ELSE c.upper END)
                                                     WHEN l.n >= b.enough THEN least(l.upper, 2.0 * c.upper) ELSE c.upper END)
         AND bool_and(coalesce(b.v >= CASE WHEN a.n >= b.enough THEN a.lower WHEN l.n >= b.enough THEN l.lower ELSE c.lower END, true)) AS fine
  FROM binned b
  LEFT JOIN limits a ON a.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source AND a.ratio = b.ratio
  LEFT JOIN limits l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM b.lang AND l.ratio = b.ratio
  LEFT JOIN limits c ON c.level = 3 AND c.ratio = b.ratio GROUP BY b.row)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, (NOT j.base_failed) AND v.fine AS kept
FROM judged j JOIN verdict v ON j.row = v.row
"""
