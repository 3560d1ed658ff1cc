"""Stages of the pipeline on odd tables, and the whole of it against the stages one by one."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from tests.conftest import SF, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The committee met on Monday to discuss the plan, and after a long debate the members agreed to send it back for review. "


def odd(spark):
    rows = [(1, PROSE * 3, "en", "a", 1), (1, PROSE * 3, "en", "a", 1), (1, "another text under the same id", "en", "b", 1), (None, PROSE, None, None, None), (2, None, "en", "a", 0), (3, "", "de", None, 0), (4, "word " * 30_000, "en", "a", 5), (5, "a\n\n\nb", "en", "a", 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_rows_and_empty_tables(spark, name):
    stage = dict(P.STAGES)[name]
    given = {tuple(r)[0] for r in odd(spark).collect()}
    more = odd(spark).selectExpr("*", "1 as size", "text as pooled", "2 as row") if name != "packing" else odd(spark)
    for docs in (more, odd(spark).limit(0)):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= given
        if name != "packing":
            assert out.columns == P.COLUMNS
        if docs.isEmpty():
            assert rows == []
        elif name != "near_duplicates":
            assert rows_of(stage(spark, docs.repartition(3), SF).drop("sequence_id", "offset")) == rows_of(out.drop("sequence_id", "offset"))


def test_what_the_stages_do_to_odd_rows(spark):
    docs = odd(spark)
    near = sorted((r["doc_id"] or 0, r["text"] or "") for r in P.near_duplicates(spark, docs, SF).collect())
    assert [d for d, _ in near] == [0, 1, 1, 2, 3, 4, 5]  # texts that differ under one id are kept apart
    cut = P.substrings(spark, docs, SF).collect()
    assert {r["doc_id"] for r in cut} >= {1, 2, 3, 5}
    mixed = P.mixture(spark, docs, SF).collect()
    # a repetition of a whole source takes all of it, documents without words among them
    assert {r["doc_id"] for r in mixed} <= {1, 2, 3, 4, 5, None} and sum(r["doc_id"] is None for r in mixed) <= 3
    packed = P.packed(spark, docs, SF)
    assert packed.where("doc_id = 2").first()["length"] == 1 and packed.where("doc_id = 4").count() > 1


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} <= before, name
    assert rows_of(P.run(spark, SF).drop("sequence_id", "offset")) == rows_of(docs.drop("sequence_id", "offset"))
