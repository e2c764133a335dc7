"""DuckDB SQL of the fuzzy scores: the matching-blocks ratio by recursion, and the candidates by brute force."""

from __future__ import annotations

from ..functions import lexicon as lx


def _best(a: str, b: str) -> str:
    """Size n and place i in a of the longest block that b has too, the first of its size, as 10000 n - i; 0 if none."""
    return f"""coalesce(list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({a}) - i + 2),
      lambda n: CASE WHEN contains({b}, substr({a}, i, n)) THEN n * 10000 - i ELSE 0 END)))), 0)"""


def ratio_ctes(pairs: str) -> str:
    """CTE ratio (a, b, r) over the texts a, b of a CTE; the main WITH must be RECURSIVE."""
    n, i = "((code + 9999) // 10000)", "(n * 10000 - code)"
    return f"""blocks AS (
  SELECT a AS x, b AS y, a, b, {_best("a", "b")} AS code FROM (SELECT DISTINCT a, b FROM {pairs})
  UNION ALL
  SELECT x, y, p.a, p.b, {_best("p.a", "p.b")} FROM (
    SELECT x, y, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, i + n), 'b': substr(b, j + n)}}]) AS p FROM (
      SELECT *, strpos(b, substr(a, i, n)) AS j FROM (SELECT *, {i} AS i FROM (SELECT *, {n} AS n FROM blocks WHERE code > 0))))),
ratio AS (SELECT x AS a, y AS b, 2.0 * sum((code + 9999) // 10000) / (length(x) + length(y)) AS r FROM blocks GROUP BY x, y)"""


def tokens_sql(text: str, kind: str) -> str:
    """The telling words of a text in capitals without accents."""
    stop = lx.STREET_STOPWORDS if kind == "street" else lx.ZONE_STOPWORDS
    listed = "[" + ", ".join(f"'{w}'" for w in stop) + "]"
    return f"list_distinct(list_filter(regexp_extract_all({text}, '[A-Z0-9]+'), lambda w: (length(w) > 1 OR regexp_full_match(w, '[0-9]')) AND NOT list_contains({listed}, w)))"


def letters_in_common(a: str, b: str) -> str:
    """The multiset overlap of two lists of letters' counts."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: least(x[1], x[2])))"


LETTER_COUNTS = "list_transform(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ', ''), lambda c: length({text}) - length(replace({text}, c, '')))"


def candidates_sql(asked: str, catalog: str, id_col: str, kind: str, k: int, least: float, typed: str | None = None) -> str:
    """WITH RECURSIVE ... SELECT name, id, rank, ratio, score of the k best: every pair of asked (name) and catalog (id, nom) is looked at.

    Names must stand in capitals A to Z, digits and single blanks, so that cleaning leaves them as they are.
    """
    score = """CASE WHEN share = 0 AND len(qt) = 1 AND len(nt) = 1 AND r >= 0.75 THEN CASE WHEN left(qt[1], 4) = left(nt[1], 4) AND length(qt[1]) >= 4 AND r >= 0.8 THEN 0.5 + 0.5 * r ELSE 0.4 * r END
    WHEN share >= 1 THEN 0.82 + 0.18 * r{penalty} WHEN share >= 0.5 THEN 0.5 * share + 0.5 * r ELSE 0.55 * r END"""
    penalty = " - CASE WHEN len(nt) > len(qt) AND NOT contains(q, 'ETAPA') THEN 0.05 * (len(nt) - len(qt)) ELSE 0 END" if kind == "zone" else ""
    score = score.replace("{penalty}", penalty)
    digits = lambda t: f"list_filter({t}, lambda w: regexp_full_match(w, '[0-9]+'))"
    return f"""WITH RECURSIVE asked AS ({asked}), named AS ({catalog}),
qs AS (SELECT name AS q, {tokens_sql("name", kind)} AS qt, {LETTER_COUNTS.format(text="name")} AS qc FROM (SELECT DISTINCT name FROM asked WHERE name IS NOT NULL)),
ns AS (SELECT nom AS n, {tokens_sql("nom", kind)} AS nt, {LETTER_COUNTS.format(text="nom")} AS nc FROM (SELECT DISTINCT nom FROM named WHERE nom IS NOT NULL)),
every AS (SELECT *, len(list_intersect(qt, nt)) / len(qt) AS share, 2.0 * {letters_in_common("qc", "nc")} / (length(q) + length(n)) AS most FROM qs, ns
  WHERE len(qt) > 0 AND len(nt) > 0 AND (len({digits("qt")}) = 0 OR len({digits("nt")}) = 0 OR list_has_any({digits("qt")}, {digits("nt")}))),
pairs AS (SELECT q AS a, n AS b, * FROM every WHERE share >= 0.5 OR 0.55 * most >= {least} - 0.08 OR (len(qt) = 1 AND len(nt) = 1)),
{ratio_ctes("pairs")},
scored AS (SELECT q, n, share, r, {score} AS score FROM pairs JOIN ratio USING (a, b)),
ranked AS (SELECT q AS name, c.{id_col}, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c.{id_col}) AS rank FROM scored JOIN named c ON c.nom = n WHERE score >= {least})
SELECT name, {id_col}, rank, round(r, 6) AS ratio, round(score, 6) AS score FROM ranked WHERE rank <= {k}"""
