"""Corpus stages leave columns alone that are called like their own; ill-formed UTF-8; clashing labels."""

from pyspark.sql import functions as F

import corpus_pipeline
from callejero.llm import decontamination, html_extraction, mixing, near_dedup, quality_classifier, quality_rules, sharding

OWN = ["_KEPT", "_limits", "_lang", "_source", "_rules", "_key", "_row", "_class", "_size", "_one", "_d", "_s", "_z", "copies", "_n", "_copy", "_i", "_hits", "_crc", "size", "_of_doc_id", "_doc", "_at", "_arc", "_text", "kept", "component_id", "target", "_kept_"]


def test_own_names_as_extra_columns(spark, tmp_path):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    docs = spark.createDataFrame([(i, text(i), "en", f"s{i % 2}", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in OWN})
    items = spark.createDataFrame([(1, text(3))], "item_id long, text string")

    def intact(found):
        rows = found.collect()
        assert found.columns[: len(docs.columns)] == docs.columns and rows
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in OWN)
        return {r["doc_id"] for r in rows}

    assert intact(quality_rules.keep_good(docs)) == set(range(40))
    assert intact(near_dedup.deduplicate(docs)) == set(range(40))
    assert intact(decontamination.decontaminate(docs, items)) == set(range(40)) - {3}
    assert intact(mixing.with_copies(docs)) <= set(range(40))
    assert intact(sharding.with_shards(docs)) == set(range(40))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert intact(corpus_pipeline.run(spark, str(tmp_path))) <= set(range(40)) - {3}


def test_ill_formed_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>")], "page_id long, url string, html string")
    html = F.when(F.col("page_id") == 2, F.decode(F.unhex(F.lit("3C703E74")), "ISO-8859-1")).otherwise(F.col("html"))
    broken = F.concat(html, F.expr("CAST(unhex('FF') AS STRING)"), F.lit("</p>"))
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages.withColumn("html", broken)).collect()}
    assert set(got) == {1, 2} and got[2].startswith("t")


def test_clashing_labels_train_alike(spark):
    rows = [(i // 2, f"word{i} again{i % 5} some{i % 7}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i // 2, i % 2) for i in range(80)], "doc_id long, label int")
    one = quality_classifier.learn(docs.coalesce(1), labels.coalesce(1))
    two = quality_classifier.learn(docs.orderBy(F.desc("text")).repartition(5), labels.orderBy(F.desc("label")).repartition(3))
    assert (one == two).all()
