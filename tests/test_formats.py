"""Text formats: parsing, odd records and round trips."""

from __future__ import annotations

import gzip

import pytest

from strandflow.sources import sinks as K, textio as T

GFA = """H\tVN:Z:1.0
# comment
S\ta\tACGT\tdp:f:3.5
S\tb\t*\tLN:i:100\tKC:i:500
S\tNODE_length_70_cov_2.5\t*
L\ta\t+\tb\t-\t4M
L\tb\t+\ta\t-\t9M
L\ta\t-\tzz\t+\t4M2I3D
P\tp\ta+,b-;a+\t*
P\tq\ta+,nope+\t*
W\tsam\t0\tchr\t0\t9\t>a<b
S\ta\tACGTAC\tdp:f:4
L\ta\t?\tb\t+\t*
"""


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n")[:-1])), "line long, value string")


def test_gfa(spark):
    df = lines(spark, GFA)
    assert sorted((r["ord"], r["name"], r["sequence"], r["length"], r["depth"]) for r in T.gfa_segments(df).collect()) == [(2, "a", "ACGTAC", 6, 4.0), (3, "b", None, 100, 5.0), (4, "NODE_length_70_cov_2.5", None, 70, 2.5)]
    assert [r["overlap"] for r in T.gfa_links(df).orderBy("ord").collect()] == [4, 9, 7]
    steps = [(r["path"], r["pos"], r["name"], r["orient"], r["gap_after"]) for r in T.gfa_path_steps(df, T.gfa_segments(df)).orderBy("path", "pos").collect()]
    assert steps == [("p", 0, "a", "+", False), ("p", 1, "b", "-", True), ("p", 2, "a", "+", False), ("sam_chr", 0, "a", "+", False), ("sam_chr", 1, "b", "-", False)]
    assert T.modal_overlap(T.gfa_links(df)).first()[0] == 4
    with pytest.raises(T.FormatError, match="line 13"):
        T.check_strict(df, "x.gfa")


def test_gfa_is_read_back_as_written(spark, tmp_path):
    df = lines(spark, GFA)
    segments, links = T.gfa_segments(df), T.gfa_links(df)
    K.write_lines(K.gfa_text(segments, links), str(tmp_path / "g"), "rank", "ord")
    back = T.read_lines(spark, str(tmp_path / "g"))
    same = lambda x: sorted((r["name"], r["sequence"], r["length"], r["depth"]) for r in x.collect())
    assert same(T.gfa_segments(back)) == same(segments)
    assert T.gfa_links(back).count() == 3


@pytest.mark.parametrize("head, name, want", [(["H\tVN:Z:2.0"], "x", "gfa2"), (["S\ta\t10\t*"], "x", "gfa2"), (["S\ta\tACGT"], "x", "gfa"), (["E\t*\ta+\tb+"], "x", "gfa2"), ([">e:f;"], "x", "fastg"), ([">e"], "x.fastg", "fastg"), ([">e"], "x.fa", "fasta"), ([], "x.gfa.gz", "gfa"), (["?"], "x", "unknown")])
def test_sniffing(head, name, want):
    assert T.sniff(head, name) == want


def test_gfa2(spark):
    df = lines(spark, "H\tVN:Z:2.0\nS\ta\t8\tACGTACGT\nS\tb\t9\t*\nE\t*\ta+\tb-\t4\t8$\t0\t4\t4M\n")
    assert [(r["name"], r["length"]) for r in T.gfa2_segments(df).orderBy("ord").collect()] == [("a", 8), ("b", 9)]
    assert [tuple(r)[1:] for r in T.gfa2_links(df).collect()] == [("a", "+", "b", "-", 4)]


def test_fasta_over_several_files_and_compressed(spark, tmp_path):
    for k in range(3):
        with gzip.open(tmp_path / f"f{k}.fa.gz", "wt") as f:
            f.write(f">r{k}a first one\nACG\n; note\nTT\n\n>r{k}b\nGG\n>r{k}c\n")
    got = {r["name"]: (r["description"], r["sequence"]) for r in T.fasta_records(T.read_lines(spark, str(tmp_path))).collect()}
    assert len(got) == 9 and got["r1a"] == ("first one", "ACGTT") and got["r2b"] == ("", "GG") and got["r0c"] == ("", "")
    wide = K.fasta_text(spark.createDataFrame([(0, "x", "A" * 125), (1, "y", None)], "ord long, name string, sequence string")).orderBy("ord").collect()
    assert wide[0]["value"] == ">x\n" + "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 5 and wide[1]["value"] == ">y\n"


def test_fastg(spark):
    df = lines(spark, ">E1_length_4_cov_2:E2,E3';\nACGG\n>E1_length_4_cov_2';\nCCGT\n>E2';\nAAC\n")
    segments, links = T.fastg(df)
    assert {r["name"]: r["sequence"] for r in segments.collect()} == {"E1_length_4_cov_2": "ACGG", "E2": "GTT"}
    assert sorted(tuple(r)[1:5] for r in links.collect()) == [("E1_length_4_cov_2", "+", "E2", "+"), ("E1_length_4_cov_2", "+", "E3", "-")]


def test_paf_and_agp(spark):
    paf = lines(spark, "q\t100\t0\t90\t-\tr\t500\t10\t102\t88\t92\t60\tNM:i:4\ttp:A:S\tcg:Z:40M2D50M\nshort\tline\n")
    r = T.paf_blocks(paf).first()
    assert (r["strand"], r["nm"], r["is_primary"], [(x["n"], x["op"]) for x in r["cigar"]]) == (-1, 4, False, [(40, "M"), (2, "D"), (50, "M")])
    agp = lines(spark, "##agp-version\t2.1\ns\t1\t100\t1\tW\tc1\t1\t100\t+\ns\t101\t150\t2\tN\t50\tscaffold\tyes\talign_genus\n")
    rows = T.agp_rows(agp).orderBy("line").collect()
    assert (rows[0]["component"], rows[0]["gap"], rows[1]["component"], rows[1]["gap"]) == ("c1", None, None, 50)
    text = [x["value"] for x in K.agp_text(T.agp_rows(agp), ("by hand",)).orderBy("object", "part").collect()]
    assert text == ["##agp-version\t2.1", "# by hand", "s\t1\t100\t1\tW\tc1\t1\t100\t+", "s\t101\t150\t2\tN\t50\tscaffold\tyes\talign_genus"]


def test_contig_paths_do_not_depend_on_stretches(spark, monkeypatch):
    text = ["NODE_1", "a+,b-;", "c+", "NODE_1'", "c-;", "b+,a-", "NODE_2", "b+"]
    lines = spark.createDataFrame([(k, v) for k, v in enumerate(text)], "line long, value string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    want = [("NODE_1", 0, "a", "+", False), ("NODE_1", 1, "b", "-", True), ("NODE_1", 2, "c", "+", False), ("NODE_2", 0, "b", "+", False)]
    for bits in (0, 1, 24):
        monkeypatch.setattr(T, "_STRETCH", bits)
        assert sorted(tuple(r) for r in T.contig_paths(lines, known).collect()) == want
