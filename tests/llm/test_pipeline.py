from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check
from tests.llm.test_substring_dedup import plain_spans


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality(spark, docs, SF).cache()
    assert kept.columns == P.COLUMNS and 0.7 * docs.count() < kept.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}

    near = P.near_duplicates(spark, kept, SF).cache()
    assert near.columns == P.COLUMNS
    want = {d for d, (_, c) in brute(texts, 80, 5).items() if c == d}
    assert {r["doc_id"] for r in near.collect()} == want

    cut = P.substrings(spark, near, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    spans = plain_spans(texts, 25)
    for r in cut.collect():
        gone = sum(b - a for d, a, b in spans if d == r["doc_id"])
        assert len(r["text"]) == len(texts[r["doc_id"]]) - gone and r["n_chars"] == len(r["text"])

    mixed = P.mixture(spark, cut, SF).cache()
    assert mixed.columns == P.COLUMNS
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in cut.collect()}

    rows = P.packed(spark, mixed.where("doc_id in (%s)" % ",".join(str(d) for d, n in times.items() if n == 1)), SF).collect()
    once = {r["doc_id"]: r["text"] for r in mixed.collect() if times[r["doc_id"]] == 1}
    check(rows, once, 1024)


def test_run_applies_the_stages_in_order(spark):
    out = P.run(spark, SF)
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "substrings", "mixture", "packing"]
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sums.agg(F.max("n")).first()[0] <= 1024 and out.count() > 0


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "x", "en", "s", 1), (3, None, None, None, None)], ", ".join(f"{c} {t}" for c, t in zip(P.COLUMNS, ["long", "string", "string", "string", "long"], strict=True)))
    assert sorted(r["doc_id"] or 0 for r in P.near_duplicates(spark, df, SF).collect()) == [0, 1, 3]
