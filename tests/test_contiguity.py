"""Worked examples with answers computed by hand."""

from __future__ import annotations

import pytest

from strandflow.functions import sequence as fn
from strandflow.operators import contiguity as C


def segments(spark, lengths, sequences=None, depths=None):
    rows = [(k, f"s{k}", (sequences or [None] * len(lengths))[k], n, (depths or [None] * len(lengths))[k]) for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "ord long, name string, sequence string, length long, depth double")


def test_four_contigs(spark):
    r = C.contiguity(segments(spark, [100, 200, 300, 400])).first()
    assert (r["n50"], r["l50"], r["n75"], r["l75"]) == (300, 2, 200, 3)
    assert (r["aun"], r["q1"], r["median"], r["q3"]) == (300, 175, 250, 325)


@pytest.mark.parametrize("size, want", [(1000, (300, 2)), (2000, (100, 4)), (800, (400, 1)), (4000, (0, 0))])
def test_against_a_genome_size(spark, size, want):
    r = C.nx(segments(spark, [100, 200, 300, 400]), [0.5], size).first()
    assert (r["nx"], r["lx"]) == want


def test_repeated_lengths_rank_like_single_segments(spark):
    lengths = [50] * 7 + [20] * 5 + [10]
    for r in C.nx(segments(spark, lengths), [0.1, 0.3, 0.5, 0.75, 0.99, 1.0]).collect():
        cum, goal = 0, r["fraction"] * sum(lengths)
        for k, n in enumerate(sorted(lengths, reverse=True), 1):
            cum += n
            if cum >= goal:
                assert (r["nx"], r["lx"]) == (n, k)
                break


def test_empty_assembly(spark):
    r = C.contiguity(segments(spark, [1]).limit(0)).first()
    assert (r["contigs"], r["total"], r["n50"], r["l50"]) == (0, 0, 0, 0)


def test_buckets(spark):
    got = {r["floor"]: r["n"] for r in C.size_buckets(segments(spark, [999, 1000, 9999, 10_000, 49_999, 50_000])).collect()}
    assert got == {0: 6, 1000: 5, 10_000: 3, 50_000: 1}


def test_depths_and_composition(spark):
    r = C.depth_summary(segments(spark, [100] * 9 + [100_000], depths=[100.0] * 9 + [10.0])).first()
    assert (r["median_depth"], r["mean_depth"]) == (10, 91)
    c = C.composition(segments(spark, [8, 8], ["GGGGAAAA", "N" * 8])).first()
    assert (c["gc"], c["n_per_100kb"]) == (25, 50_000)


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTNacgtuRYS",), ("",)], "s string")
    assert [r[0] for r in df.select(fn.revcomp("s")).collect()] == ["SRYaacgtNACGT", ""]
    ov = spark.createDataFrame([("AAACGT", "CGTTT"), ("AAA", "CCC"), ("A", ""), ("ACAC", "ACAC")], "a string, b string")
    assert [r[0] for r in ov.select(fn.exact_overlap("a", "b")).collect()] == [3, 0, 0, 4]
    names = spark.createDataFrame([("NODE_1_length_500_cov_12.5",), ("x",), ("a_cov7",)], "n string")
    assert [tuple(r) for r in names.select(fn.length_from_name("n"), fn.depth_from_name("n")).collect()] == [(500, 12.5), (None, None), (None, 7.0)]
