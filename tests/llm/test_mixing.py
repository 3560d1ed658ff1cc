from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandflow.llm.mixing import SQL, mix, op4_mixing, source_targets
from tests.conftest import SF, rows_of

SCHEMA = "doc_id long, text string, source string, size string"


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Round by round: clamp what is above its limit and share the rest again."""
    target, clamped, left = [0.0] * len(sizes), set(), float(sum(sizes))
    while True:
        free = [k for k in range(len(sizes)) if k not in clamped]
        total = sum(weights[k] for k in free)
        for k in free:
            target[k] = left * weights[k] / total
        over = [k for k in free if target[k] > cap * sizes[k]]
        if not over:
            return target
        for k in over:
            target[k] = cap * sizes[k]
            clamped.add(k)
            left -= target[k]


@pytest.mark.parametrize("sizes", [[10, 1000, 5, 200], [1, 1, 1, 1000000], [0, 50, 50], [7], [100, 1, 1, 1, 1, 1, 1, 1]])
def test_targets_equal_round_by_round_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 3)
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(want)


def test_query_equals_sql(spark, duck):
    assert rows_of(op4_mixing(spark, SF)) == rows_of(duck.sql(SQL["op4_mixing"]).df())


def test_takes_come_near_the_targets_and_reruns_agree(spark):
    rows = [(k, "w " * (1 + k % 37), "big" if k % 3 else f"s{k % 5}", "clash") for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mix(df).cache()
    for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 37
    assert mixed.agg(F.max("times")).first()[0] <= 3
    assert rows_of(mix(df.repartition(7)).select("doc_id", "times")) == rows_of(mixed.select("doc_id", "times"))


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, "a b", None, "x"), (1, None, None, "x"), (2, "", "", "x"), (3, "a", "b", "x"), (3, "a", "b", "x"), (4, "a b c", "z" * 5000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix(df).collect()
    assert len(out) == len(rows) and all(0 <= r["times"] <= 3 for r in out)
    assert {r["source_size"] for r in out if r["source"] is None} == {2}
    assert mix(df.limit(0)).collect() == []


def test_columns_of_any_name_come_back(spark):
    names = ["bin", "extra", "__place", "place", "whole", "rest", "cut_bin", "cut_before", "none", "name", "upto", "row", "id"]
    df = spark.createDataFrame([(k, f"a b {k}", f"s{k % 3}", *range(len(names))) for k in range(50)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mix(df)
    assert out.columns == [*df.columns, "size", "source_size", "target", "times"]
    assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    assert mix(df.limit(0)).collect() == []
