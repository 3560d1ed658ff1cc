"""Formats for display, side files, paths in a view, and the landing stream."""

from __future__ import annotations

from strandflow.functions import formats as X
from strandflow.operators import compare as D, links as G
from strandflow.sources import sinks as K, textio as T
from strandflow.streaming import landing
from tests.test_graph import clean


def test_formats(spark):
    df = spark.createDataFrame([(1_240_000.0,), (12_345.0,), (1500.0,), (999.5,), (-2e9,), (None,)], "x double")
    assert [r[0] for r in df.select(X.fmt_bp("x")).collect()] == ["1.24 Mb", "12.3 kb", "1.50 kb", "1,000 bp", "-2.00 Gb", "–"]
    assert [r[0] for r in df.select(X.fmt_int("x")).collect()] == ["1,240,000", "12,345", "1,500", "1,000", "-2,000,000,000", "–"]
    assert [r[0] for r in df.select(X.axis_label("x")).collect()][:3] == ["1.24M", "12.345k", "1.5k"]
    assert [r[0] for r in df.select(X.fmt_span("x")).collect()][1] == "12,345 (12.3 kb)" and df.select(X.fmt_pct("x")).first()[0] == "1240000.00%"


def test_paths_in_a_view(spark):
    segments, links = clean(spark)
    steps = spark.createDataFrame([("p", 0, "e1", "+"), ("p", 1, "e2", "+"), ("p", 2, "f", "+"), ("p", 3, "gone", "+"), ("p", 4, "e3", "+")], "path string, pos long, name string, orient string")
    r = G.resolve_paths(steps, links, segments).first()
    assert (r["members"], r["dropped"], r["joins"], r["broken"], r["bases"]) == (4, 1, 1, 2, 233)


def test_comparison_files(spark, tmp_path):
    segments, _ = clean(spark)
    block = spark.createDataFrame([("e1", 1, 0, 46, "x", 46, 46)], "query string, ord long, q_st long, q_en long, ref string, matches long, block_len long")
    contigs = D.contig_diff(segments, block)
    parts = D.component_diff(contigs, segments.selectExpr("name", "ord as component"))
    K.comparison_files(segments, contigs, D.uncovered(segments, block), parts, str(tmp_path), "a", least=30)
    only = T.fasta_records(T.read_lines(spark, str(tmp_path / "a.only-contigs.fasta")))
    assert {r["name"] for r in only.collect()} == {"e2", "e3", "f", "loop"}
    regions = {r["name"]: len(r["sequence"]) for r in T.fasta_records(T.read_lines(spark, str(tmp_path / "a.only-regions.fasta"))).collect()}
    assert regions["e1:47-78"] == 32 and regions["e2:1-75"] == 75
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "a.contigs.tsv")).count() == 5


def test_landing_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "q\t100\t0\t90\t+\tr\t500\t10\t100\t88\t90\t60\tcg:Z:90M\n"
    (tmp_path / "in/a.paf").write_text(line)
    for want in (1, 2):
        landing.land(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == want
        (tmp_path / "in/b.paf").write_text(line.replace("q", "q2", 1))


def test_certainty_around_a_fork(spark):
    from strandflow.operators import paths as P
    from tests.test_graph import LINKS, SEGMENTS

    names = "SABCDX"
    segments = spark.createDataFrame([(k, n, None, 10, None) for k, n in enumerate(names)], SEGMENTS)
    # S forks into A and B, which meet again in C; D hangs behind C; X is apart
    rows = [("S", "+", "A", "+"), ("S", "+", "B", "+"), ("A", "+", "C", "+"), ("B", "+", "C", "+"), ("C", "+", "D", "+")]
    links = spark.createDataFrame([(k, *r, 0) for k, r in enumerate(rows)], LINKS)
    got = {r["name"]: r["status"] for r in P.certainty(segments, links, segments.where("name = 'S'"), 5).collect()}
    # backwards from A, B and C everything leads to S; forwards each first link makes its own walk certain
    assert got == {"S": "starting", "A": "contiguous", "B": "contiguous", "C": "contiguous", "D": "contiguous", "X": "not"}
    far = {r["name"]: r["status"] for r in P.certainty(segments, links, segments.where("name = 'D'"), 5).collect()}
    assert (far["D"], far["C"], far["S"], far["X"]) == ("starting", "contiguous", "contiguous", "not") and far["A"] == far["B"] == "contiguous"
