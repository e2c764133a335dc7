"""Fuzzy candidates against all pairs in plain Python, and what the indexes look up."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from callejero.functions import text as tx
from callejero.functions.similarity import numbered_grams, ratio_bound, seq_ratio
from callejero.operators import fuzzy
from callejero.operators.validate import may_be_alike
from callejero.plans.normalize import match_fields

SYLLABLES = ["PRO", "CE", "RES", "IN", "DE", "PEN", "CIA", "LAM", "BA", "YE", "QUE", "SAN", "TOS", "MAR", "TI", "NEZ", "GON", "ZA", "LES"]


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice([1, 2, 3, 4])))


def misspelt(r, name, every):
    out = []
    for w in name.split():
        if len(w) > 3 and (every or r.random() < 0.5):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("AEIOU") + w[i:], w[:i] + r.choice("AEIOU") + w[i + 1 :]])
        out.append(w)
    return " ".join(out)


def names(n):
    r = random.Random(4)
    found = []
    for i in range(n):
        words = [word(r) for _ in range(r.choice([1, 2, 2, 3, 4]))]
        if i % 7 == 0:
            words.insert(0, "SAN")
        if i % 11 == 0:
            words.append(str(r.randint(1, 9)))
        if i % 13 == 0:
            words += ["II", "ETAPA"]
        found.append(" ".join(words))
    return [(i, 1 + i % 4, n, f"S{i % 3}, S{i % 5}") for i, n in enumerate(found)], [(misspelt(r, n, i % 2), r.choice([None, 1, 2]), r.choice([None, "S1", "S2 S4"])) for i, n in enumerate(found)]


def score(kind, qn, qt, cn, ct, ratio):
    one = len(qt) == len(ct) == 1
    share = len(qt & ct) / len(qt)
    if share == 0 and one and ratio >= 0.75:
        a, b = next(iter(qt)), next(iter(ct))
        return 0.5 + 0.5 * ratio if a[:4] == b[:4] and len(a) >= 4 and ratio >= 0.8 else 0.4 * ratio
    if share >= 1:
        return 0.82 + 0.18 * ratio - (0.05 * max(0, len(ct) - len(qt)) if kind == "zone" and "ETAPA" not in qn else 0)
    return 0.5 * share + 0.5 * ratio if share >= 0.5 else 0.55 * ratio


@pytest.mark.parametrize("case", [("street", 0.5, 1000), ("street", 0.88, 400), ("zone", 0.3, 150)])
def test_all_pairs(spark, case):
    kind, least, n = case
    rows, asked = names(n)
    type_col = "id_tipo_via" if kind == "street" else "id_tipo_zona"
    catalog = spark.createDataFrame(rows, f"id long, {type_col} int, nombre string, sector string")
    queries = spark.createDataFrame([*asked, asked[0], (None, 1, "S1"), ("", 1, None), ("DE LA", 1, None)], "name string, type_hint int, sector_hint string")
    norm = tx.normalize_variants(F.col("t"))
    texts = spark.createDataFrame([(t,) for t in {x[2] for x in rows} | {x[0] for x in asked}], "t string")
    told = {r["t"]: (r["n"], frozenset(r["w"])) for r in texts.select("t", norm.alias("n")).select("t", "n", tx.sig_tokens(F.col("n"), kind).alias("w")).collect()}
    letters = sorted({c for v, _ in told.values() for c in v})
    count = {v: np.array([v.count(c) for c in letters]) for v, _ in told.values()}
    catalogue = np.array([count[told[x[2]][0]] for x in rows])
    sizes = catalogue.sum(axis=1)
    best, ratios = {}, {}
    for name, kind_hint, sector_hint in set(asked):
        qn, qt = told[name]
        if not qt:
            continue
        bound = 2 * np.minimum(catalogue, count[qn]).sum(axis=1) / (sizes + len(qn))
        for (i, t, nombre, sector), most in zip(rows, bound, strict=True):
            cn, ct = told[nombre]
            numbers = [{w for w in s if w.isdigit()} for s in (qt, ct)]
            if not ct or (all(numbers) and not numbers[0] & numbers[1]) or (2 * len(qt & ct) < len(qt) and len(qt) + len(ct) > 2 and most < (least - 0.08) / 0.55 - 1e-9):
                continue
            if (qn, cn) not in ratios:
                ratios[qn, cn] = SequenceMatcher(None, qn, cn).ratio()
            s = score(kind, qn, qt, cn, ct, ratios[qn, cn])
            s += 0.03 if t == kind_hint and s >= 0.6 else 0
            if kind == "street" and sector_hint and set(sector_hint.split()) & set(sector.replace(",", " ").split()) and s >= 0.5:
                s += 0.08
            if s >= least:
                best.setdefault((name, kind_hint, sector_hint), []).append((-round(s, 9), i))
    want = {q: [(i, -s) for s, i in sorted(v)[:5]] for q, v in best.items()}
    got = {}
    for r in fuzzy.fuzzy_candidates(queries, catalog, kind, "id", "nombre", min_score=least).orderBy("rank").collect():
        got.setdefault((r["name"], r["type_hint"], r["sector_hint"]), []).append((r["id"], round(r["score"], 9)))
    assert got == want and len(got) > n / 4
    unshared = [q for q, v in want.items() if any(not told[q[0]][1] & told[rows[i][2]][1] for i, _ in v)]
    assert len(unshared) > (20 if least == 0.5 else 0)  # found by letters or grams alone


def test_a_common_word_is_not_looked_up(spark):
    """Every name begins with SAN; to be accepted, both words must be found, so the rare one leads to its names."""
    catalog = spark.createDataFrame([(i, 1, f"SAN {chr(65 + i // 26 % 26)}{chr(65 + i % 26)}{chr(65 + i // 676)}TINO", "S1") for i in range(2000)], "id long, id_tipo_via int, nombre string, sector string")
    queries = catalog.select(F.concat("nombre", F.lit("S")).alias("name")).union(catalog.select("nombre"))
    q, n = (fuzzy._forms(df, "street", 3) for df in (queries.select("name"), catalog.select(F.col("nombre").alias("name"))))
    looked = fuzzy._rarest(q, "_tok", fuzzy._counts(n, "_tok"), F.size("_tok") - F.ceil(0.76 * F.size("_tok")).cast("int") + 1)
    assert Counter(r["_b"] for r in looked.collect()).most_common(1)[0][1] == 1
    pairs = fuzzy.form_pairs(q, n, "street", fuzzy.ACCEPT, 0.0)
    assert pairs.count() <= 3 * 4000
    found = fuzzy.accept_match(fuzzy.fuzzy_candidates(queries, catalog, "street", "id", "nombre", k=1, min_score=fuzzy.ACCEPT), "id")
    assert {(r["name"], r["id"]) for r in found.collect()} >= {(r["nombre"], r["id"]) for r in catalog.collect()}


def test_the_bound_prunes(spark):
    rows, asked = names(500)
    catalog = spark.createDataFrame(rows, "id long, id_tipo_via int, name string, sector string")
    queries = spark.createDataFrame([(a[0],) for a in asked], "name string")
    q, n = fuzzy._forms(queries, "street", 3), fuzzy._forms(catalog, "street", 3)
    every = q.crossJoin(n.select(F.col("_norm").alias("n"), F.col("_letters").alias("l"), F.col("_len").alias("k")))
    ratios = every.withColumn("b", ratio_bound("_letters", "l", "_len", "k")).withColumn("r", seq_ratio("_norm", "n")).agg(F.max(F.col("r") - F.col("b")).alias("over"), F.count("*").alias("n")).first()
    assert ratios["over"] <= 1e-9
    met = fuzzy.form_pairs(q, n, "street", fuzzy.ACCEPT, 0.0)
    assert 5 * fuzzy.prunable(met, "street", fuzzy.ACCEPT, 0.0).count() < ratios["n"]
    words = spark.createDataFrame([(a, b) for a in {w for x in rows for w in x[2].split()} for b in ["SANTOSMAR", "PROCERES", "LES"]], "_t string, _u string")
    left = may_be_alike(words, 0.88)
    assert 5 * left.count() < words.count()
    assert words.where(seq_ratio("_t", "_u") >= 0.88).count() == left.where(seq_ratio("_t", "_u") >= 0.88).count()


def test_numbered_grams(spark):
    row = spark.createDataFrame([("ABAB", "")], "a string, b string").select(numbered_grams(F.col("a"), 1).alias("x"), numbered_grams(F.col("a"), 2).alias("y"), numbered_grams(F.col("b"), 2).alias("z")).first()
    assert row["x"] == ["A1", "B1", "A2", "B2"] and row["y"] == ["AB1", "BA1", "AB2"] and row["z"] == []


def test_misspelt_zones_settle(spark):
    zonas = spark.createDataFrame([(1, 1, "LOS PRECURSORES", "S1"), (2, 1, "CHICLAYO", "S1"), (3, 2, "SANTA ANGELA", "S2")], "zona_id long, id_tipo_zona int, nom_zona string, sector string")
    vias = spark.createDataFrame([(10, 2, "LOS TUMBOS", "S1", "F"), (11, 2, "LOS TUMBOS", "S2", "F")], "via_id long, id_tipo_via int, nom_via string, sector string, condicion string")
    fields = spark.createDataFrame([(1, "PRECURSORE", 1, "LOS TUMBO", 2), (2, "ANGELA", 2, "LOS TUMBOS", 2), (3, "CHICLAYO", 1, None, None), (4, None, None, "NADA", 2), (5, "LOS PRECURSORES", None, None, None)], "id int, nom_zona string, tipo_zona int, nom_via string, tipo_via int")
    got = {r["id"]: (r["zona_id"], r["via_id"]) for r in match_fields(fields, vias, zonas).collect()}
    assert got == {1: (1, 10), 2: (3, 11), 3: (None, None), 4: (None, None), 5: (1, None)}


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_segments_find_all_pairs_of_the_ratio_and_write_few_others(spark):
    """Words of few syllables, each with a letter lost or changed, short to long: every pair of the ratio is met, hardly any other."""
    r = random.Random(5)
    texts = sorted({" ".join("".join(r.choice(SYLLABLES) for _ in range(3)) for _ in range(1 + i % 7)) for i in range(300)})
    asked = sorted({misspelt(r, t, i % 3) for i, t in enumerate(texts)} | {"".join(c for c in t if r.random() > 0.12) for t in texts[::3]} | {t[:20] for t in texts})
    q, n = (fuzzy._forms(spark.createDataFrame([(t,) for t in x], "name string"), "street", 3).where("name = _norm") for x in (asked, texts))
    left, right = ([x["_norm"] for x in f.collect()] for f in (q, n))
    ratio = 0.5 / fuzzy.FEW_SHARED
    want = {(a, b) for a in left for b in right if abs(len(a) - len(b)) <= (1 - ratio) * (len(a) + len(b)) and common(a, b) >= ratio * (len(a) + len(b)) / 2 - 1e-9}
    short = {p for p in want if len(p[0]) <= fuzzy.SEGMENT_LETTERS}
    met = {tuple(x) for x in fuzzy._by_segments(q.where(F.col("_len") <= fuzzy.SEGMENT_LETTERS), n, ratio).collect()}
    assert short <= met and len(short) > 200 and len(want - short) > 50 and len(met) < 1.2 * len(short)
    every = {(x["q_norm"], x["n_norm"]) for x in fuzzy.form_pairs(q, n, "street", 0.5, 0.0).collect()}
    assert want <= every  # longer texts by grams
