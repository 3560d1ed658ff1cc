"""A search finds every copy of a repeat, however many there are."""

from __future__ import annotations

import random

from strandflow.operators import align as L


def test_all_copies_of_a_repeat_are_hits(spark):
    rng = random.Random(8)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    repeat = bases(300)
    segments = spark.createDataFrame([(f"s{k}", bases(200) + repeat + bases(200)) for k in range(100)], "name string, sequence string")
    hits = L.search(segments, L.parse_query(spark, repeat)).collect()
    assert {(r["segment"], r["s_st"], r["s_en"]) for r in hits if r["score"] >= 300} == {(f"s{k}", 200, 500) for k in range(100)}
    assert len(L.search(segments, L.parse_query(spark, repeat), max_hits=10).collect()) == 10
