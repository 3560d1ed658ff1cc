"""From files to results, and searching the graph."""

from __future__ import annotations

import random

import pytest

from strandflow.operators import paths as P
from strandflow.session import SessionError, load
from tests.conftest import rows_of
from tests.test_graph import LINKS, SEGMENTS, clean


def test_from_gfa_to_scaffolds(spark, tmp_path):
    rng = random.Random(9)
    genome = "".join(rng.choices("ACGT", k=12_000))
    parts = [genome[0:4000], genome[3945:8000], genome[7945:12_000]]
    (tmp_path / "a.gfa").write_text("".join(f"S\ts{k}\t{s}\tdp:f:{10 + k}\n" for k, s in enumerate(parts)) + "L\ts0\t+\ts1\t+\t*\nL\ts1\t+\ts2\t+\t*\n")
    (tmp_path / "r.fa").write_text(">chr one\n" + "\n".join(genome[k : k + 70] for k in range(0, len(genome), 70)) + "\n")
    s = load(spark, str(tmp_path / "a.gfa"))
    assert [r["overlap"] for r in s.graph.links.orderBy("ord").collect()] == [55, 55]
    assert s.metrics().first()["contigs"] == 3
    with pytest.raises(SessionError):
        s.evaluation()
    s = s.with_reference(str(tmp_path / "r.fa"))
    result = s.evaluation()
    assert result["references"].first()["covered"] == 12_000 and result["breaks"].count() == 0
    plan = s.scaffold().plan.orderBy("pos").collect()
    assert [(r["segment"], r["orientation"]) for r in plan] == [("s0", "+"), ("s1", "+"), ("s2", "+")]
    merged = s.edit("simplify")
    assert [r["sequence"] for r in merged.graph.segments.collect()] == [genome]
    assert merged.undo().graph.segments.count() == 3
    scaffolded = s.scaffold()
    scaffolded.write_plan(str(tmp_path / "plan"))
    assert rows_of(scaffolded.with_plan(str(tmp_path / "plan")).plan) == rows_of(scaffolded.plan)
    made = scaffolded.scaffold_preview().first()
    assert (made["records"], made["bases"], made["gaps"], made["n50"], made["placed"]) == (1, 12_000, 0, 12_000, 3) and scaffolded.scaffold_warnings().count() == 0
    scaffolded.export(str(tmp_path / "out"), ("gfa", "fasta", "csv", "agp", "scaffolds"))
    again = load(spark, str(tmp_path / "out/gfa"), "gfa")
    assert again.status()["bases"] == sum(map(len, parts))
    both = s.compare(again)
    assert {r["status"] for r in both["contigs_a"].collect()} == {"shared"}
    assert s.search(genome[5000:5300]).first()["segment"] == "s1"


def test_paths_and_bridges(spark):
    seqs = {"L": "A" * 50, "x": "C" * 30 + "G" * 30, "y": "T" * 200, "R": "A" * 40, "z": "G" * 10}
    segments = spark.createDataFrame([(k, n, s, len(s), None) for k, (n, s) in enumerate(seqs.items())], SEGMENTS)
    links = spark.createDataFrame([(0, "L", "+", "x", "-", 5), (1, "x", "-", "R", "+", 5), (2, "L", "+", "y", "+", 0), (3, "y", "+", "R", "+", 0), (4, "L", "+", "z", "+", 0)], LINKS)
    pairs = spark.createDataFrame([(1, "L", "+", "R", "+"), (2, "R", "-", "L", "-"), (3, "z", "+", "R", "+")], "pair int, a string, ao string, b string, bo string")
    got = {(r["pair"], "".join(w["name"] + w["orient"] for w in r["walk"])) for r in P.find_paths(links, segments, pairs).collect()}
    assert got == {(1, "x-"), (1, "y+"), (2, "x+"), (2, "y-")}
    gaps = spark.createDataFrame([(1, "L", "+", "R", "+", 55), (2, "L", "+", "z", "+", 10), (3, "L", "+", "R", "+", 5000)], "pair int, a string, ao string, b string, bo string, gap int")
    made = {r["pair"]: r["sequence"] for r in P.bridges(links, segments, gaps).collect()}
    assert made == {1: ("C" * 30 + "G" * 30)[5:], 2: ""}


def test_scopes_and_names(spark):
    segments, links = clean(spark)
    seeds = segments.where("name = 'e1'")
    assert {r["name"] for r in P.scope(segments, links, "around", seeds=seeds, distance=1).collect()} == {"e1", "e2"}
    assert {r["name"] for r in P.scope(segments, links, "depth", min_depth=15, max_depth=35).collect()} == {"e2", "e3"}
    assert {r["name"] for r in P.scope(segments, links, component=0, min_length=70).collect()} == {"e1", "e2"}
    assert {r["name"] for r in P.scope(segments, links, max_nodes=2).collect()} == {"e1", "e2"}
    queries = spark.createDataFrame([("e1+",), ("E2",), ("nope",)], "q string")
    assert {(r["q"], r["name"]) for r in P.match_names(segments, queries).collect()} == {("e1+", "e1"), ("E2", None), ("nope", None)}
