"""Paths, tags, malformed files, merges and evaluation totals of a session."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions.sequence import cigar
from strandflow.operators import blocks as B, contiguity as C, links as G
from strandflow.session import load, open_session
from strandflow.sources.textio import FormatError
from tests.conftest import rows_of

GFA = "H\tVN:Z:1.0\nS\ta\tACGTAC\tdp:f:3\tXX:Z:kept\nS\tb\tACGGG\tKC:i:20\nS\tc\tTTTTTT\nL\ta\t+\tb\t+\t2M\nL\tb\t+\tc\t-\t0M\nP\tone\ta+,b+;c-\t*\nW\tsm\t1\tq\t0\t9\t>a>b\n"


def _paths(session):
    return [(r["path"], r["pos"], r["name"], r["orient"], r["gap_after"]) for r in session.attached_paths().orderBy("path", "pos").collect()]


def test_paths_and_tags_come_back(spark, tmp_path):
    (tmp_path / "a.gfa").write_text(GFA)
    s = load(spark, str(tmp_path / "a.gfa"))
    steps = [("one", 0, "a", "+", False), ("one", 1, "b", "+", True), ("one", 2, "c", "-", False), ("sm_q", 0, "a", "+", False), ("sm_q", 1, "b", "+", False)]
    assert _paths(s) == steps
    s.export(str(tmp_path / "out"), ("gfa",))
    again = load(spark, str(tmp_path / "out/gfa"), "gfa")
    assert _paths(again) == steps
    assert {r["name"]: (r["tags"].get("XX") or [None, None])[1] for r in again.graph.segments.collect()} == {"a": "kept", "b": None, "c": None}
    assert {r["name"]: r["depth"] for r in again.graph.segments.collect()} == {"a": 3.0, "b": 4.0, "c": None}
    turned = s.edit("reverse", names=spark.createDataFrame([("b",)], "name string"))
    assert [x[3] for x in _paths(turned)] == ["+", "-", "-", "+", "-"]
    fewer = s.edit("delete", names=spark.createDataFrame([("c",)], "name string"))
    assert {x[0] for x in _paths(fewer)} == {"sm_q"}


def test_merges_need_links(spark, tmp_path):
    (tmp_path / "a.gfa").write_text(GFA)
    s = load(spark, str(tmp_path / "a.gfa"))
    merged = s.edit("merge_path", steps=[("a", "+"), ("b", "+")], name="ab")
    assert {r["name"]: r["sequence"] for r in merged.graph.segments.collect()} == {"ab": "ACGTACGGG"[:6] + "GGG", "c": "TTTTTT"}
    assert [(r["from_name"], r["to_name"], r["to_orient"]) for r in merged.graph.links.collect()] == [("ab", "c", "-")]
    with pytest.raises(ValueError, match="no link from a. to c"):
        s.edit("merge_path", steps=[("a", "+"), ("c", "+")], name="x")
    with pytest.raises(ValueError, match="exists"):
        s.edit("merge_path", steps=[("a", "+"), ("b", "+")], name="c")
    gone = spark.createDataFrame([("b", "-", "a", "-")], "from_name string, from_orient string, to_name string, to_orient string")
    assert [r["from_name"] for r in s.edit("remove_links", gone=gone).graph.links.collect()] == ["b"]


@pytest.mark.parametrize("text, line", [("S\ta\tAC\nS\tb\n", 2), ("S\ta\tAC\nL\ta\t+\n", 2), ("S\ta\tAC\n#\nL\ta\t+\ta\t?\t*\n", 3), ("H\tVN:Z:1.0\n", None)])
def test_bad_gfa_raises_with_its_line(spark, tmp_path, text, line):
    (tmp_path / "a.gfa").write_text(text)
    with pytest.raises(FormatError) as e:
        load(spark, str(tmp_path / "a.gfa"), "gfa")
    assert e.value.line == line


@pytest.mark.parametrize("text, line", [("AC\n>a\nAC\n", 1), (">a\nAC\n>\nAC\n", 3), (">a\nA\n>b\nA\n>a x\nC\n", 5), ("\n", None)])
def test_bad_fasta_raises_with_its_line(spark, tmp_path, text, line):
    (tmp_path / "a.fa").write_text(text)
    with pytest.raises(FormatError) as e:
        load(spark, str(tmp_path / "a.fa"), "fasta")
    assert e.value.line == line


def test_topology_of_an_odd_graph(spark):
    segments = spark.createDataFrame([(0, "r", 100, 2.0), (1, "x", 50, 1.0), (2, "y", 60, None), (3, "z", 5, 1.0)], "ord long, name string, length long, depth double")
    links = spark.createDataFrame([(0, "r", "+", "r", "+", 9), (1, "x", "+", "y", "-", 4), (2, "x", "-", "gone", "+", 1)], "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long")
    row = G.topology(segments, links, C.depth_summary(segments)).first()
    assert (row["links"], row["components"], row["dead_ends"], row["circular"], row["overlap_min"], row["overlap_max"]) == (2, 3, 4, 1, 4, 9)
    assert (row["largest_component_length"], row["orphaned"], row["orphaned_length"], row["length_no_overlaps"], row["dead_end_percent"]) == (110, 1, 5, 91 + 46 + 56 + 5, 50.0)
    empty = G.topology(segments.limit(0), links.limit(0), C.depth_summary(segments.limit(0))).first()
    assert (empty["links"], empty["components"], empty["orphaned_percent"]) == (0, 0, 0.0)


def _block(query, q_st, q_en, r_st, r_en, ops, nm):
    return (query, q_st, 10_000, q_st, q_en, 1, "g", 50_000, r_st, r_en, q_en - q_st, q_en - q_st, nm, True, 60, ops)


def test_rates_and_totals_by_hand(spark):
    names = "query string, ord long, q_len long, q_st long, q_en long, strand int, ref string, r_len long, r_st long, r_en long, matches long, block_len long, nm long, is_primary boolean, mapq int, ops string"
    rows = [_block("c", 0, 5000, 0, 5000, "2000M3I2997M", 5), _block("c", 4950, 9500, 20_000, 24_550, "5000M2D500M", 1), _block("d", 0, 400, 0, 400, None, 4)]
    df = spark.createDataFrame(rows, names).withColumn("cigar", F.when(F.col("ops").isNotNull(), cigar("ops"))).drop("ops")
    got = B.rates(df).first()
    assert (got["mismatches"], got["indels"], got["mismatches_per_100kb"]) == (2 + 0 + 4, 2, round(6 * 100_000 / 9950, 6))
    lengths = spark.createDataFrame([("c", 10_000), ("d", 500), ("e", 77)], "query string, length long")
    contigs = B.query_coverage(df, lengths)
    assert {r["query"]: (r["covered"], r["aligned"], r["status"]) for r in contigs.collect()} == {"c": (9500, 9550, "aligned"), "d": (400, 400, "partial"), "e": (0, 0, "unaligned")}
    references = B.reference_coverage(df, spark.createDataFrame([("g", 50_000)], "ref string, length long"))
    t = B.alignment_totals(references, contigs, B.structural_differences(df)).first()
    assert (t["aligned_contigs"], t["unaligned_contigs"], t["partially_unaligned"], t["fully_unaligned_length"]) == (2, 1, 1, 77)
    assert (t["misassembled_contigs"], t["misassembled_contigs_length"], t["covered_bases"]) == (1, 10_000, 9550)
    a = B.aligned_contiguity(df, 30_000).first()
    assert (a["na50"], a["la50"], a["nga50"], a["largest_alignment"], a["merged_bases"]) == (5000, 1, 0, 5000, 9950)
    near = [_block("c", 0, 100, 0, 100, "100M", 0), _block("c", 100, 200, 103, 203, "50M3I50M", 3)]
    one = B.merge_collinear(spark.createDataFrame(near, names).withColumn("cigar", cigar("ops")).drop("ops")).first()
    assert [(x["n"], x["op"]) for x in one["cigar"]] == [(100, "M"), (50, "M"), (3, "I"), (50, "M")]


def test_metrics_hold_topology(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "a.fa").write_text("".join(f">n{k}\n{''.join(rng.choices('ACGT', k=50))}\n" for k in range(3)))
    row = load(spark, str(tmp_path / "a.fa")).metrics().first()
    assert (row["contigs"], row["links"], row["components"], row["dead_ends"], row["orphaned_length"]) == (3, 0, 3, 6, 150)


GENES = "S\ta\tACGTACGTAC\tdp:f:3\nS\tb\tGTACGGGTTT\tdp:f:4\nS\tc\tTTTTTCCCCC\nL\ta\t+\tb\t+\t4M\nL\tb\t+\tc\t-\t2M1D\nP\tp\ta+,b+\t*\n"


def test_a_session_comes_back_with_its_past(spark, tmp_path):
    (tmp_path / "a.gfa").write_text(GENES)
    s = load(spark, str(tmp_path / "a.gfa"))
    assert s.default_overlap == 4
    new = spark.createDataFrame([("d", "AAAA"), ("e", None)], "name string, sequence string")
    s = s.edit("add_segments", rows=new).edit("add_links", rows=spark.createDataFrame([("d", "+", "a", "+", 2), ("a", "-", "d", "-", 9), ("d", "+", "nope", "+", 0)], "from_name string, from_orient string, to_name string, to_orient string, overlap long"))
    assert {(r["name"], r["length"]) for r in s.graph.segments.collect()} == {("a", 10), ("b", 10), ("c", 10), ("d", 4), ("e", 0)}
    assert s.graph.links.count() == 3 and s.graph.segments.select("ord").distinct().count() == 5
    with pytest.raises(ValueError, match="exists"):
        s.edit("add_segments", rows=new)
    with pytest.raises(ValueError, match="nope"):
        s.edit("add_links", rows=spark.createDataFrame([("d", "+", "nope", "+")], "from_name string, from_orient string, to_name string, to_orient string"), strict=True)
    again = s.edit("add_segments", rows=spark.createDataFrame([("d", "CCCCC")], "name string, sequence string"), replace=True)
    assert again.graph.segments.where("name = 'd'").first()["length"] == 5 and rows_of(again.undo().graph.segments) == rows_of(s.graph.segments)
    s.save(str(tmp_path / "kept"))
    back = open_session(spark, str(tmp_path / "kept"))
    for x, y in ((s, back), (s.undo(), back.undo()), (s.undo().undo(), back.undo().undo())):
        assert rows_of(x.graph.segments) == rows_of(y.graph.segments) and rows_of(x.graph.links) == rows_of(y.graph.links)
    assert rows_of(back.paths) == rows_of(s.paths) and back.default_overlap == 4 and len(back.graph.past) == 2
    assert {r["path"]: r["sequence"] for r in back.path_sequences().collect()} == {"p": "ACGTACGTACGGGTTT"}
    with pytest.raises(ValueError, match="nothing to undo"):
        back.undo().undo().undo()


def test_link_cigars_come_back_and_bad_paths_raise(spark, tmp_path):
    (tmp_path / "a.gfa").write_text(GENES)
    s = load(spark, str(tmp_path / "a.gfa"))
    s.export(str(tmp_path / "out"), ("gfa",))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out/gfa")).collect())
    assert "L\tb\t+\tc\t-\t2M1D" in text and "L\ta\t+\tb\t+\t4M" in text and "P\tp\ta+,b+" in text
    (tmp_path / "b.gfa").write_text(GENES + "P\tq\n")
    with pytest.raises(FormatError) as e:
        load(spark, str(tmp_path / "b.gfa"))
    assert e.value.line == 7


def test_a_reference_name_that_comes_twice_raises(spark, tmp_path):
    (tmp_path / "a.gfa").write_text(GENES)
    (tmp_path / "r.fa").write_text(">r\nACGT\n>r\nACGT\n")
    with pytest.raises(FormatError, match="repeated name r"):
        load(spark, str(tmp_path / "a.gfa")).with_reference(str(tmp_path / "r.fa"))
