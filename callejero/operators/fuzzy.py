"""Fuzzy candidates of a name in a catalogue (C7, C8), exact for any least score, without meeting all pairs.

The score of a pair follows from the share of the query's telling words that the catalogue's name has, and from
the matching-blocks ratio r of both texts. A pair can reach the least score in three ways only, and each has
an index of its own:

* Words: half of the query's words or more are shared. Of n words at least ceil(share * n) must be found, so
  the n - ceil(share * n) + 1 rarest ones (by how many names of the catalogue hold them) are looked up.
* Letters: both are one word and begin with the same four letters.
* Grams: too few words are shared, so 0.55 r must reach the score. The matching blocks are no longer than a
  common subsequence L >= r T / 2 of two texts with T letters in all; every letter outside it spoils at most q
  grams, which leaves (2 q - 1) L - (q - 1) (T + 1) grams in common. So lengths are bounded, and of a
  text's numbered grams only the rarest few are looked up.
* Segments, in place of grams where r is 0.9 or more and the query has at most 40 letters: D = T - 2 L letters stand
  outside, so of D + 1 segments of the catalogue's text one is whole in the query's, and some whole one has as many
  of these letters before it as there are segments before it. That leaves few places where to look it up. What meets is
  compared in the join (Levenshtein's distance is D at most), so no pair is written that shares a segment only.

Pairs of texts, not of rows, are met: each once, however many rows have the text. The letters that both have
in common bound r from above (the multiset overlap); pairs whose score cannot reach the least one end there,
inside the JVM, and only the rest is compared letter by letter in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.similarity import numbered_grams, ratio_bound, seq_ratio
from ..functions.text import normalize_variants, sig_tokens
from ..session import cut

#: What a matching type and a shared sector add to a score, and from which score on.
TYPE_BONUS, TYPE_FROM, SECTOR_BONUS, SECTOR_FROM = 0.03, 0.6, 0.08, 0.5
#: The weight of r where less than half of the words is shared.
FEW_SHARED = 0.55
#: The least score at which C9 accepts a candidate; no lesser candidate changes what is accepted.
ACCEPT = 0.88
#: From this ratio on, and up to so many letters of a query, segments are looked up; longer texts have too many places.
SEGMENT_FROM, SEGMENT_LETTERS = 0.9, 40
_EPS = 1e-9


def _forms(names: DataFrame, kind: str, q: int) -> DataFrame:
    """Distinct names with their text in one form, its telling words, letters and grams; stored."""
    norm = F.col("_norm")
    tasks = names.sparkSession.sparkContext.defaultParallelism  # few bytes, but much work each: one task would get them all
    named = cut(names.select("name").repartition(tasks, "name").distinct().withColumn("_norm", normalize_variants(F.col("name"))))  # or each letter would clean it anew
    told = {"_tok": sig_tokens(norm, kind), "_len": F.char_length(norm), "_letters": numbered_grams(norm, 1), "_grams": numbered_grams(norm, q)}
    return cut(named.withColumns(told).where(F.size("_tok") > 0))


def _rarest(forms: DataFrame, items: str, counts: DataFrame, keep: Column) -> DataFrame:
    """_norm and _b: the `keep` first items of each form, by how few catalogue forms hold them (none: first)."""
    each = forms.where(keep > 0).select("_norm", keep.alias("_keep"), F.explode(items).alias("_b")).join(counts, "_b", "left")
    rank = F.row_number().over(Window.partitionBy("_norm").orderBy(F.coalesce("_df", F.lit(0)), "_b"))
    return each.withColumn("_at", rank).where("_at <= _keep").where("_df IS NOT NULL").select("_norm", "_b")


def _counts(forms: DataFrame, items: str) -> DataFrame:
    return forms.select(F.explode(items).alias("_b")).groupBy("_b").agg(F.count("*").alias("_df"))


def _by_words(q: DataFrame, n: DataFrame, share: float) -> DataFrame:
    least = F.ceil(F.lit(share) * F.size("_tok") - _EPS).cast("int")
    probe = _rarest(q, "_tok", _counts(n, "_tok"), F.size("_tok") - least + 1)
    return probe.join(n.select(F.col("_norm").alias("n_norm"), F.explode("_tok").alias("_b")), "_b").select(F.col("_norm").alias("q_norm"), "n_norm")


def _by_letters(q: DataFrame, n: DataFrame) -> DataFrame:
    def ones(forms: DataFrame, name: str) -> DataFrame:
        word = F.get("_tok", F.lit(0))
        return forms.where((F.size("_tok") == 1) & (F.char_length(word) >= 4)).select(F.col("_norm").alias(name), F.left(word, F.lit(4)).alias("_b"))

    return ones(q, "q_norm").join(ones(n, "n_norm"), "_b").select("q_norm", "n_norm")


def _by_grams(q: DataFrame, n: DataFrame, r: float, size: int) -> DataFrame:
    """Pairs that can have the ratio r or more."""

    def common(total: Column) -> Column:
        least = F.ceil(r * total / 2 - _EPS)
        return (2 * size - 1) * least - (size - 1) * (total + 1)

    # The shortest partner asks for the fewest common grams.
    shortest = F.ceil(F.col("_len") * r / (2 - r) - _EPS)
    keep = (F.size("_grams") - F.greatest(F.lit(1), common(F.col("_len") + shortest)) + 1).cast("int")
    counts = _counts(n, "_grams")
    a = _rarest(q, "_grams", counts, keep).withColumnRenamed("_norm", "q_norm")
    b = _rarest(n, "_grams", counts, keep).withColumnRenamed("_norm", "n_norm")
    return a.join(b, "_b").select("q_norm", "n_norm")


def _outside(total: Column, r: float) -> Column:
    """How many of the letters of two texts may stand outside a common subsequence, for the ratio r."""
    return (total - 2 * F.ceil(r * total / 2 - _EPS)).cast("int")


def _segments(forms: DataFrame, partner: str, r: float) -> DataFrame:
    """forms with the lengths `partner` that a text of that ratio can have, and `_d`, the letters outside."""
    low, high = F.ceil(F.col("_len") * r / (2 - r) - _EPS), F.floor(F.col("_len") * (2 - r) / r + _EPS)
    each = forms.select("_norm", "_len", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias(partner))
    each = each.withColumn("_d", _outside(F.col("_len") + F.col(partner), r))
    return each.where(F.abs(F.col("_len") - F.col(partner)) <= F.col("_d"))


def _by_segments(q: DataFrame, n: DataFrame, r: float) -> DataFrame:
    """Pairs that can have the ratio r or more: a whole segment in common, and a small distance."""
    i, k = F.col("_i"), F.col("_d") + 1
    start, end = F.floor(i * F.col("_n") / k), F.floor((i + 1) * F.col("_n") / k)

    def key(begin: Column) -> Column:
        return F.xxhash64("_n", "_d", "_i", F.substring("_norm", (begin + 1).cast("int"), (end - start).cast("int"))).alias("_b")

    held = _segments(n, "_m", r).select("_norm", F.col("_len").alias("_n"), "_d").distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), "_d")))
    held = held.select(key(start), F.col("_norm").alias("n_norm"))
    # With i letters outside before segment i, its shift is one of -i, -i + 2, ... i; the rest must make up the lengths.
    asked = _segments(q, "_n", r).withColumn("_i", F.explode(F.sequence(F.lit(0), "_d"))).withColumn("_by", F.explode(F.sequence(-i, i, F.lit(2))))
    asked = asked.where(F.abs(F.col("_len") - F.col("_n") - F.col("_by")) <= F.col("_d") - i)
    asked = asked.where((start + F.col("_by") >= 0) & (end + F.col("_by") <= F.col("_len"))).select(key(start + F.col("_by")), F.col("_norm").alias("q_norm"), F.col("_d"))
    met = asked.join(held, "_b").where(F.expr("levenshtein(q_norm, n_norm, _d) >= 0"))
    return met.select("q_norm", "n_norm")


def gram_size(r: float) -> int:
    """The longest of 3, 2 and 1 letters that leaves a gram in common at every length, for unequal texts of that ratio."""
    return 3 if r >= 0.9 else 2 if r >= 5 / 6 else 1


def _score(share: Column, ratio: Column, kind: str, bound: bool = False) -> Column:
    """The score without bonus; with bound: the most that any ratio up to this one gives."""
    single = (F.size("q_tok") == 1) & (F.size("n_tok") == 1)
    first = F.get("q_tok", F.lit(0))
    begin = single & (F.left(first, F.lit(4)) == F.left(F.get("n_tok", F.lit(0)), F.lit(4))) & (F.char_length(first) >= 4)
    more = F.size("n_tok") - F.size("q_tok")
    penalty = F.when((more > 0) & ~F.contains("q_norm", F.lit("ETAPA")), 0.05 * more).otherwise(0.0) if kind == "zone" else F.lit(0.0)
    lone = F.when(begin & (ratio >= 0.8), 0.5 + 0.5 * ratio).otherwise(0.4 * ratio)
    if bound:  # below 0.75 the last case holds
        lone = F.greatest(lone, F.lit(FEW_SHARED * 0.75))
    score = F.when((share == 0) & single & (ratio >= 0.75), lone).when(share >= 1, 0.82 + 0.18 * ratio - penalty)
    return score.when(share >= 0.5, 0.5 * share + 0.5 * ratio).otherwise(FEW_SHARED * ratio)


def _words_of(sector: str) -> Column:
    return F.split(F.regexp_replace(F.col(sector), ",", " "), " +")


def form_pairs(q: DataFrame, n: DataFrame, kind: str, least: float, bonus: float) -> DataFrame:
    """q_norm, n_norm, q_tok, n_tok, share and bound of the pairs of texts that may reach the score; q, n: stored forms."""
    share = max(0.5, 2 * (least - bonus) - 1)
    found = _by_letters(q, n)
    if share <= 1:
        found = found.union(_by_words(q, n, share))
    elif 1 + bonus >= least:
        found = found.union(_by_words(q, n, 1.0))
    r = max(_EPS, min(least, max(SECTOR_FROM, least - SECTOR_BONUS) if bonus > TYPE_BONUS else least)) / FEW_SHARED
    if r < 1:  # at 1 the texts are equal, and so are their words
        if r >= SEGMENT_FROM:
            found = found.union(_by_segments(q.where(F.col("_len") <= SEGMENT_LETTERS), n, r))
            # A query of more letters, and what is not too short for one.
            found = found.union(_by_grams(q.where(F.col("_len") > SEGMENT_LETTERS), n.where(F.col("_len") > SEGMENT_LETTERS * r / (2 - r)), r, gram_size(r)))
        else:
            found = found.union(_by_grams(q, n, r, gram_size(r)))
    sides = [f.select(*[F.col(c).alias(f"{s}{c}") for c in ("_norm", "_tok", "_len", "_letters")]) for f, s in ((q, "q"), (n, "n"))]
    pairs = found.distinct().join(sides[0], "q_norm").join(sides[1], "n_norm")

    def digits(tok: str) -> Column:
        return F.filter(tok, lambda t: t.rlike(r"^\d+$"))

    clash = (F.size(digits("q_tok")) > 0) & (F.size(digits("n_tok")) > 0) & ~F.arrays_overlap(digits("q_tok"), digits("n_tok"))
    sounds = (F.contains("q_norm", F.lit("BRISAS")) & F.contains("n_norm", F.lit("FRESAS"))) | (F.contains("q_norm", F.lit("FRESAS")) & F.contains("n_norm", F.lit("BRISAS")))
    shared = F.size(F.array_intersect("q_tok", "n_tok")) / F.size("q_tok")
    pairs = pairs.where(~clash & ~sounds).withColumns({"share": shared, "bound": ratio_bound("q_letters", "n_letters", "q_len", "n_len")})
    return pairs.select("q_norm", "n_norm", "q_tok", "n_tok", "share", "bound")


def prunable(pairs: DataFrame, kind: str, least: float, bonus: float) -> DataFrame:
    """Those pairs whose bound on r still allows the score."""
    return pairs.where(_score(F.col("share"), F.col("bound") + _EPS, kind, bound=True) + F.lit(bonus + _EPS) >= least)


def fuzzy_candidates(queries: DataFrame, catalog: DataFrame, kind: str, id_col: str, name_col: str, k: int = 5, min_score: float = 0.55) -> DataFrame:
    """Name (and hints) -> the k best catalogue rows of min_score or more, best first, ties by id.

    queries: name, and type_hint and sector_hint if they are there. Null names, and names without a telling word, have
    no candidates; repeated queries count once. Returns the hints, the catalogue's id, name, type and sector, q_tok,
    n_tok, ratio, score and rank.
    """
    hints = [c for c in ("type_hint", "sector_hint") if c in queries.columns]
    type_col = "id_tipo_zona" if kind == "zone" else "id_tipo_via"
    typed = "type_hint" in hints and type_col in catalog.columns
    near = kind == "street" and "sector_hint" in hints and "sector" in catalog.columns
    bonus = TYPE_BONUS * typed + SECTOR_BONUS * near
    r = max(_EPS, min(min_score, max(SECTOR_FROM, min_score - SECTOR_BONUS) if near else min_score)) / FEW_SHARED
    size = gram_size(min(1.0, r))

    asked = queries.select("name", *hints).where("name IS NOT NULL").distinct()
    q = _forms(asked, kind, size)
    hinted = F.col("type_hint").isNotNull() if "type_hint" in hints else F.lit(False)
    asked = asked.join(q.select("name", F.col("_norm").alias("q_norm")), "name").where(hinted | ~F.col("q_norm").isin(lx.CITIES))
    extra = [c for c in (type_col, "sector") if c in catalog.columns]
    rows = catalog.select(id_col, F.col(name_col).alias("name"), *extra)
    n = _forms(rows, kind, size)
    rows = rows.join(n.select("name", F.col("_norm").alias("n_norm")), "name").withColumnRenamed("name", name_col)

    once = lambda f: f.dropDuplicates(["_norm"])
    pairs = cut(prunable(form_pairs(once(q), once(n), kind, min_score, bonus), kind, min_score, bonus))
    scored = pairs.withColumn("ratio", seq_ratio("q_norm", "n_norm"))
    scored = cut(scored.withColumn("score", _score(F.col("share"), F.col("ratio"), kind)).where(F.col("score") + bonus + _EPS >= min_score).drop("share", "bound"))

    met = asked.join(scored, "q_norm").join(rows, "n_norm")
    score = F.col("score")
    if typed:
        score = score + F.when((F.col(type_col) == F.col("type_hint")) & (score >= TYPE_FROM), TYPE_BONUS).otherwise(0.0)
    if near:
        score = score + F.when(F.arrays_overlap(_words_of("sector_hint"), _words_of("sector")) & (score >= SECTOR_FROM), SECTOR_BONUS).otherwise(0.0)
    best = Window.partitionBy("name", *hints).orderBy(F.desc(F.round("score", 9)), id_col)
    met = met.withColumn("score", score).where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return met.drop("q_norm", "n_norm")


def accept_match(candidates: DataFrame, id_col: str) -> DataFrame:
    """Name -> the accepted candidate: score 0.93, or 0.88 with a shared word or, both one word, four leading letters."""
    letters = (F.size("q_tok") == 1) & (F.size("n_tok") == 1) & (F.left(F.get("q_tok", F.lit(0)), F.lit(4)) == F.left(F.get("n_tok", F.lit(0)), F.lit(4)))
    sure = (F.col("score") >= 0.93) | ((F.col("score") >= ACCEPT) & (F.arrays_overlap("q_tok", "n_tok") | letters))
    return candidates.where((F.col("rank") == 1) & sure).select("name", *[c for c in ("type_hint", "sector_hint") if c in candidates.columns], id_col, "score")
