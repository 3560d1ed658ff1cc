"""Hit tables, name search, side-by-side tables, comparisons and odd files."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions.sequence import parse_tags, public_tags
from strandflow.operators import compare as D, hits as H, paths as P, tables as R
from strandflow.session import SessionError, load
from strandflow.sources import textio as T
from strandflow.sources.textio import FormatError
from tests.test_graph import LINKS, SEGMENTS, clean
from tests.test_scaffold import BLOCKS, block


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, value string")


def test_tabular_hits_and_the_best_of_each_segment(spark):
    text = "# comment\nq\ts1\t95.5\t100\t11\t110\t300\t201\t180.5\t1e-40\nq\ts1\t99\t100\t1\t100\t1\t100\t180.5\t1e-41\nq\ts2\t80\t20\t1\t20\t5\t24\t30\t0.1\nq\ts2\tx\t20\t1\t20\t5\t24\t30\t0.1\nshort\tline"
    got = H.tabular_hits(lines(spark, text), min_length=30).orderBy("q_st").collect()
    assert [(r["segment"], r["strand"], r["q_st"], r["q_en"], r["s_st"], r["s_en"], r["identity"], r["score"]) for r in got] == [("s1", 1, 0, 100, 0, 100, 0.99, 180.5), ("s1", -1, 10, 110, 200, 300, 0.955, 180.5)]
    every = H.tabular_hits(lines(spark, text))
    assert {(r["segment"], r["s_st"]) for r in H.best_of_segments(every).collect()} == {("s1", 0), ("s2", 4)}
    assert [r["score"] for r in H.top(every, 2).collect()] == [180.5, 180.5]
    sized = spark.createDataFrame([("s1", 400), ("s2", 40)], "name string, length long")
    spans = {(r["name"], r["s"]): (r["e"], r["q_from"], r["q_to"]) for r in H.search_spans(every, sized).collect()}
    assert spans["s1", 0.5] == (0.75, 1.0, 10 / 110)  # back along the query on the minus strand
    made = H.parts(H.search_spans(every, sized), per_query=10).where("name = 's1' and source = 'q'").collect()
    assert len(made) == 10 + 10 and max(r["q"] for r in made) == 1.0
    assert H.parts(H.search_spans(every, sized), per_query=10, room=F.lit(1)).count() == 3


def test_both_searches_have_one_form(spark, tmp_path):
    rng = random.Random(1)
    seq = "".join(rng.choices("ACGT", k=600))
    (tmp_path / "a.gfa").write_text(f"S\ts\t{seq}\n")
    s = load(spark, str(tmp_path / "a.gfa"))
    own = s.search(seq[100:300])
    assert tuple(own.columns) == H.COLUMNS == tuple(H.tabular_hits(lines(spark, "")).columns) and own.dtypes == H.tabular_hits(lines(spark, "")).dtypes
    for bad in ({"min_identity": 2}, {"max_hits": 0}, {"min_length": -1}, {"min_identity": "x"}):
        with pytest.raises(ValueError):
            s.search("ACGT", **bad)
    with pytest.raises(ValueError):
        s.metrics(-1)


def test_names_are_found_by_their_parts(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices("abAB1_", k=rng.randint(1, 9))) for _ in range(200)] + ["é.x[y", "x%y", "aa"]
    names = list(dict.fromkeys(names))
    segments = spark.createDataFrame([(k, n, None, 1, None) for k, n in enumerate(names)], SEGMENTS)
    terms = ["a", "ab", "aba", "b1_a", "A1", "[y", "%", "zzz", "aaaa", "é"]
    queries = spark.createDataFrame([(t,) for t in [*terms, ""]], "q string")
    got = {(r["q"], r["name"]) for r in P.match_names(segments, queries, exact=False).collect()}
    want = {(t, n) for t in terms for n in names if t in n}
    assert got == want | {(t, None) for t in [*terms, ""] if t not in {q for q, _ in want}}
    assert [r["name"] for r in P.find_names(segments, "ABA, é  %").orderBy("ord").collect()] == [n for n in names if "aba" in n.lower() or "é" in n or "%" in n]
    assert [r["name"] for r in P.find_names(segments, "aa aa,AA", exact=True).orderBy("ord").collect()] == [n for n in names if n in ("aa", "AA")]
    assert P.find_names(segments, " , ").collect() == []


def test_the_table_of_segments(spark):
    segments, links = clean(spark)
    blocks = spark.createDataFrame([block("e1", 78, -1, 5, 83), block("e1", 40, 1, 500, 540, "other")], BLOCKS)
    plan = spark.createDataFrame([(1, "sc", 0, "e1"), (2, "sd", 3, "e1")], "ord long, scaffold string, pos long, segment string")
    rows = {r["name"]: r for r in R.segment_table(segments, links, blocks, plan).collect()}
    assert len(rows["e1"]) == 15
    assert tuple(rows["e1"])[8:] == ("chr", 5, 83, "1.00000", -1, "sd", 3) and tuple(rows["f"])[8:] == (None,) * 7
    assert (rows["loop"]["circular"], rows["f"]["circular"], rows["f"]["gc"], rows["e1"]["depth"]) == (1, 0, "1.00000", "12.0000")
    assert R.segment_table(segments, links).columns == list(rows["e1"].asDict())


def test_a_comparison_of_assemblies(spark):
    one = spark.createDataFrame([(3, 12345, 41.256, 0.5)], "contigs long, total long, gc double, aun double")
    two = spark.createDataFrame([(1_000_000, None)], "contigs long, total long")
    got = [tuple(r)[1:] for r in R.comparison_table({"a": one, "b": two}).orderBy("ord").collect()]
    assert got == [("# contigs", "3", "1,000,000"), ("Total length", "12,345", "-"), ("GC (%)", "41.26", "-"), ("auN", "0", "-")]


def test_ranges_of_a_view(spark):
    none = spark.createDataFrame([(0, "a", None, 0, None)], SEGMENTS)
    r = R.view_ranges(none).first()
    assert (r["depth_min"], r["depth_max"], r["has_depth"], r["gc_min"], r["gc_max"], r["length_min"], r["length_max"]) == (0.0, 1.0, False, 0.0, 1.0, 1, 1)
    same = spark.createDataFrame([(0, "a", "GC", 2, 5.0), (1, "b", "CG", 2, 5.0), (2, "c", "GG", 9, float("inf"))], SEGMENTS)
    r = R.view_ranges(same).first()
    assert (r["depth_min"], r["depth_max"], r["gc_min"], r["bases"], r["depth_q1"]) == (5.0, 6.0, 0.99, 13, 5.0) and abs(r["gc_max"] - 1.01) < 1e-9


def test_a_side_of_a_comparison(spark):
    segments, links = clean(spark)
    blocks = spark.createDataFrame([("e1", 1, 0, 70, "x", 70, 70), ("e2", 1, 0, 20, "x", 10, 20), ("loop", 1, 0, 32, "y", 32, 32)], "query string, ord long, q_st long, q_en long, ref string, matches long, block_len long")
    found = D.score_side(segments, links, blocks, min_identity=0.9)
    assert {r["name"]: (r["covered"], r["status"], r["circular"]) for r in found["contigs"].collect()} == {"e1": (70, "partial", False), "e2": (0, "missing", False), "e3": (0, "missing", False), "f": (0, "missing", False), "loop": (32, "shared", True)}
    assert {(r["component"], r["covered"], r["circular"], r["status"]) for r in found["components"].collect()} == {(0, 70, False, "partial"), (1, 0, False, "missing"), (2, 32, True, "shared")}
    assert {(r["query"], r["ref"], r["weight"]) for r in found["matches"].collect()} == {("e1", "x", 70), ("loop", "y", 32)}
    assert {(r["query"], r["st"], r["en"]) for r in found["uncovered"].collect()} == {("e1", 70, 78), ("e2", 0, 75), ("e3", 0, 48), ("f", 0, 32)}
    with pytest.raises(ValueError):
        D.score_side(segments, links, blocks, shared=0.1, present=0.2)


def test_comparing_sessions_writes_both_sides(spark, tmp_path):
    rng = random.Random(2)
    a, b = ("".join(rng.choices("ACGT", k=3000)) for _ in range(2))
    (tmp_path / "a.gfa").write_text(f"S\tone\t{a}\nS\ttwo\t{b}\nL\ttwo\t+\ttwo\t+\t0M\n")
    (tmp_path / "b.fa").write_text(f">x\n{a[:1000]}{a[1700:]}\n")
    x, y = load(spark, str(tmp_path / "a.gfa")), load(spark, str(tmp_path / "b.fa"))
    found = x.compare(y)
    assert {r["name"]: r["status"] for r in found["contigs_a"].collect()} == {"one": "partial", "two": "missing"}
    assert {(r["contigs"], r["circular"], r["status"]) for r in found["components_a"].collect()} == {(1, False, "partial"), (1, True, "missing")}
    x.write_comparison(y, str(tmp_path / "out"), ("my side", "my side"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"my_side{n}.{k}" for n in ("", "_2") for k in ("components.tsv", "contigs.tsv", "only-contigs.fasta", "only-regions.fasta"))
    assert [r["name"] for r in T.fasta_records(T.read_lines(spark, str(tmp_path / "out/my_side.only-contigs.fasta"))).collect()] == ["two"]
    empty = load(spark, str(tmp_path / "b.fa")).edit("add_segments", rows=spark.createDataFrame([("n", None)], "name string, sequence string")).edit("delete", names=spark.createDataFrame([("x",)], "name string"))
    with pytest.raises(SessionError):
        x.compare(empty)


def test_gzip_without_its_suffix_loads_with_line_numbers(spark, tmp_path):
    text = "S\ta\tACGT\n" * 2 + "S\tb\tGG\nL\ta\t+\tb\t+\t1M\n"
    (tmp_path / "plain.gfa").write_bytes(gzip.compress(text.encode()))
    s = load(spark, str(tmp_path / "plain.gfa"))
    assert {r["name"] for r in s.graph.segments.collect()} == {"a", "b"} and s.graph.links.count() == 1
    (tmp_path / "bad.gfa").write_bytes(gzip.compress((text + "L\ta\t?\tb\t+\n").encode()))
    with pytest.raises(FormatError) as e:
        load(spark, str(tmp_path / "bad.gfa"))
    assert e.value.line == 5
    (tmp_path / "r.fa").write_bytes(gzip.compress(b">r one\nAC\nGT\n>s\nA\n"))
    assert {(r["name"], r["sequence"]) for r in T.fasta_records(T.read_lines(spark, str(tmp_path / "r.fa"))).collect()} == {("r", "ACGT"), ("s", "A")}


def test_paths_of_contigs_over_partitions(spark):
    segments, _ = clean(spark)
    text = ["NODE_1", "e1+,nope+;", "", "e2-,e3+", "NODE_1'", "e3-,e2+", "NODE_2", "loop+;", "nope-;", "f+"]
    for cut in range(len(text) + 1):  # where a second partition of the file begins
        df = spark.createDataFrame([((k >= cut) << 33 | k, v) for k, v in enumerate(text)], "line long, value string")
        got = [tuple(r) for r in T.contig_paths(df, segments).orderBy("path", "pos").collect()]
        assert got == [("NODE_1", 0, "e1", "+", True), ("NODE_1", 1, "e2", "-", False), ("NODE_1", 2, "e3", "+", False), ("NODE_2", 0, "loop", "+", True), ("NODE_2", 1, "f", "+", False)]


def test_gfa2_groups_come_with_the_file(spark, tmp_path):
    (tmp_path / "a.gfa2").write_text("H\tVN:Z:2.0\nS\ta\t4\tACGT\nS\tb\t4\tGGGG\nE\te\ta+\tb-\t2\t4$\t0\t2\t2M\nO\tp\ta+ b- x\nU\tset\tb+ a-\n")
    s = load(spark, str(tmp_path / "a.gfa2"))
    assert [(r["path"], r["name"], r["orient"]) for r in s.attached_paths().orderBy("path", "pos").collect()] == [("p", "a", "+"), ("p", "b", "-"), ("set", "b", "+"), ("set", "a", "-")]
    assert s.graph.links.first()["overlap"] == 2


def test_files_that_are_not_what_they_say(spark, tmp_path):
    agp = "##agp-version\t2.1\ns\t1\t4\t1\tW\tc\t1\t4\t+\ns\t5\tx\t2\tN\t10\tscaffold\tyes\tu\n"
    T.check_agp(lines(spark, agp.replace("x", "14").rstrip()))
    with pytest.raises(FormatError) as e:
        T.check_agp(lines(spark, agp.rstrip()))
    assert e.value.line == 3
    (tmp_path / "a.fastg").write_text(">x;\nACGT\n")
    with pytest.raises(FormatError):
        load(spark, str(tmp_path / "a.fastg"))


def test_public_tags_and_many_fields(spark):
    text = "\t".join(["XX:Z:" + "y" * 201, "NN:i:" + "1" * 300, "MM:i:" + "z" * 300, "SS:Z:short"])
    df = spark.createDataFrame([(text,)], "t string").select(public_tags(parse_tags(F.split("t", "\t"))).alias("m"))
    assert set(df.first()["m"]) == {"NN", "SS"}
    many = "S\ta\tA\t" + "\t".join(f"{chr(65 + k % 26)}{chr(97 + k // 26 % 26)}:i:{k}" for k in range(600))
    assert len(T.gfa_segments(lines(spark, many)).first()["tags"]) == 600


def test_depth_range_tells_the_depths(spark):
    from strandflow.plans import catalog
    from tests.conftest import SF

    rows = catalog.QUERIES["depth_range"](spark, SF).select("name", "depth").collect()
    assert rows and all(10 <= r["depth"] <= 20 for r in rows)
