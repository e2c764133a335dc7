"""Brute-force comparisons and edge cases (nulls, empty and long texts, repeated rows, empty tables, clashing columns)."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from callejero.llm import decontamination, html_extraction, language_id, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def corpus():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(50))
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(8, 90))]
        text = " ".join(words)
        if i % 9 == 0:
            text = f"{text} {passage} tail{i}"
        rows.append((i, text, "en" if i % 3 else "fr", f"s{i % 4}", len(text)))
        if i % 7 == 0:  # near copies
            rows.append((100 + i, text.replace(words[0], f"new{i}", 1), "en", "s0", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "one", None, "s1", 3), (203, "x " * 3000, "en", None, 6000), (0, rows[0][1], "fr", "s0", 1), (204, "été ÉTÉ ß", "fr", "s2", 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_substring_dedup(docs, spark):
    rows = corpus()
    words = [re.findall(SPACE, t or "") for _, t, *_ in rows]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = {(d, i + k) for hits in seen.values() if len(hits) > 1 for d, i in hits for k in range(35)}
    want = sorted((r[0], len(w), sum((d, k) in gone for k in range(len(w))), " ".join(x for k, x in enumerate(w) if (d, k) not in gone)) for d, (r, w) in enumerate(zip(rows, words, strict=True)))
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(docs, chunk_bytes=2000).collect())
    assert got == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_near_dedup(docs):
    rows = corpus()

    def shingles(t):
        w = re.findall(SPACE, lower(t))
        return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()

    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets))
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs, width=2).collect()) == want


def test_near_dedup_null_and_repeated_ids(spark):
    base = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    third = " ".join(f"c{i}" for i in range(60))
    near = lambda t: t + " end"
    rows = [(None, base), (None, near(base)), (None, other), (None, other), (7, third), (7, near(third)), (7, "quite another text"), (None, ""), (None, None), (8, near(other))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(((r["doc_id"], r["text"]) for r in near_dedup.deduplicate(table, width=5, percent=80).collect()), key=str)
    # One of each group of near copies, the one with an id first; unlike texts under one id, or none, all stay.
    bases, thirds = [r for r in out if r[1] in (base, near(base))], [r for r in out if r[1] in (third, near(third))]
    assert len(bases) == 1 and len(thirds) == 1
    assert sorted((r for r in out if r not in bases + thirds), key=str) == sorted([(8, near(other)), (7, "quite another text"), (None, ""), (None, None)], key=str)
    judged = near_dedup.near_duplicates(table, width=5, percent=80).collect()
    assert len(judged) == len(rows) and sum(r["kept"] for r in judged) == len(out)


def test_decontamination_blocks_agree(docs, spark):
    rows = corpus()
    items = [(1, " ".join(re.findall(SPACE, rows[3][1])[:14])), (2, "one"), (3, None), (4, ""), (5, "never seen words here at all in any of these documents"), (6, "ÉTÉ")]
    table = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in items if (w := word(t)) for k in range(len(w) - min(10, len(w)) + 1)]
    want = []
    for d, t, *_ in rows:
        w, hit, ids = word(t), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids.add(str(i))
        want.append((d, len(w), len(hit), tuple(sorted(ids))))
    for size in (1 << 20, 20):  # one block, many blocks
        found = decontamination.find_hits(docs.withColumn("_hits", F.lit(1)), table, block_bytes=size)
        got = [(r["doc_id"], r["_hits"]["n_words"], r["_hits"]["n_hit"], tuple(r["_hits"]["items"])) for r in found.collect()]
        assert sorted(got) == sorted(want)
    assert decontamination.decontaminate(docs, table.limit(0)).count() == len(rows)


def test_quality_counts(docs):
    def base(t):
        t = t or ""
        w = re.findall(SPACE, t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 200 else set(range(len(w)))
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)

    got = sorted((r["doc_id"], *[r["_rules"][c] for c in quality_rules._COUNTS[:5]]) for r in quality_rules.judge(docs).collect())
    assert got == sorted((r[0], *base(r[1])) for r in corpus())
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_sharding(docs):
    plan = sharding.shard_plan(docs, shards=4, virtual_nodes=8).collect()
    assert len(plan) == len(corpus())
    sizes = {}
    for s in range(4):
        own = [r for r in plan if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in plan)
    # The walk takes every byte once and fills no shard beyond its room.
    arcs = {0: 50, 1: 0, 2: 170}
    stretches = sharding.walk(arcs, [0, 1, 2], dict.fromkeys(range(3), 75))
    assert sum(hi - lo for _, lo, hi, _ in stretches) == 220
    assert max(sum(hi - lo for _, lo, hi, s in stretches if s == k) for k in range(3)) <= 75
    assert sharding.shard_plan(docs.limit(0)).count() == 0
    out = sharding.with_shards(docs.withColumn("slot", F.lit(9)))
    assert out.count() == len(corpus()) and out.columns == [*docs.columns, "shard", "slot"]


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6
    assert all(t <= 3 * n + 1e-6 for t, n in targets.values())
    for source, (target, _) in targets.items():
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - target) <= max(r["size"] for r in own)
        assert all(0 <= r["copies"] <= 3 for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    for p, q in ((0.3, 0.5), (0.8, 0.9)):  # a meeting keeps the mass and decides one
        for u in (0.0, 0.5, 0.99):
            a, b = mixing.pivot(p, q, u)
            assert abs(a + b - p - q) < 1e-9 and (a in (0.0, 1.0) or b in (0.0, 1.0))


def test_html_extraction(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>Text  <b>bold</b>ly {n}</p></article><form>f</form><section id='comments'>c</section><footer>&copy;</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", page.replace("{n}", str(i))) for i in range(5)] + [(9, None, None), (9, None, None), (10, "http://x/", "")]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head & more Text boldly 3" and got[9] == "" and got[10] == ""
    # Without markup that tells, blocks shared with the neighbours go.
    plain = [(i, f"http://p.example/a{i}", f"<div><div>Menu of all</div><div class='t'>Story {i * 7919} here</div><div>Rights</div></div>") for i in range(6)]
    got = [r["text"] for r in html_extraction.extract(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted(f"Story {i * 7919} here" for i in range(6))
    for broken in ("<a " * 350_000, "<div>" * 20_000 + "</p>" * 20_000, "<![CDATA[" * 100_000, '<a b="' * 150_000):
        begin = time.monotonic()
        assert html_extraction.blocks(broken) == [] and time.monotonic() - begin < 5
    assert html_extraction.lcs([1, 2, 3, 2], [2, 3, 1, 2]) == [(1, 0), (2, 1), (3, 3)]


def test_html_extraction_copies(spark):
    def page(host, i, marked, edit=""):
        body = "".join(f"<p>Story {host} {i} part {k} goes on{edit if k == 3 else ''}</p>" for k in range(12))
        return f"<body><div><div>Menu of {host}</div>{'<article>' if marked else '<div class=t>'}{body}{'</article>' if marked else '</div>'}<div>Rights</div></div></body>"

    rows, want = [], {}
    for marked in (True, False):
        for mirror in ("twice", "mirror", "edited"):
            host = f"{mirror}{int(marked)}.example"
            for i in range(6):
                for copy in range(2):
                    at = 1000 * len(want) + 1 if mirror != "twice" else 500 + 10 * i + int(marked)
                    edit = f" {copy}" if mirror == "edited" else ""
                    rows.append((at, f"http://{host}/a{i}{'' if mirror == 'twice' else f'-{copy}'}", page(host, i, marked, edit)))
                    want[at] = " ".join(f"Story {host} {i} part {k} goes on{edit if k == 3 else ''}" for k in range(12))
    rows += [(7, "http://two.example/a", page("two", 0, False)), (8, "http://two.example/b", page("two", 0, False))]
    got = [(r["page_id"], r["text"]) for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    for at, text in got:
        assert text == want[at] if at in want else "Story two 0 part 11 goes on" in text


def test_language_and_quality_models(docs, spark):
    r = random.Random(3)
    word = {"en": lambda: "".join(r.choice(["th", "er", "on"]) for _ in range(3)), "fr": lambda: "".join(r.choice(["ou", "eau", "é"]) for _ in range(3))}
    rows = [(i, " ".join(word[lang]() for _ in range(30)), lang) for i in range(80) for lang in [("en", "fr")[i % 2]]] + [(900, None, "en"), (901, "123 !", "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(table.where("doc_id < 40"))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(table, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows[:80]) and got[900] == ("und", 0.0) and got[901] == ("und", 0.0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    weights = quality_classifier.learn(table, labels)
    scores = {x["doc_id"]: x["score"] for x in quality_classifier.score(table, weights).collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 2 == 1) for i in range(40, 80)]) >= 0.95 and 0 <= scores[900] <= 1
    assert quality_classifier.score(table.limit(0), weights).count() == 0

