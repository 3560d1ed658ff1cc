"""Walks, bridges, trims and what their AGP rows spell, against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandflow.operators import paths as P, scaffold as S
from strandflow.runtime import Scratch
from tests.test_graph import LINKS, SEGMENTS

PAIRS = "pair long, a string, ao string, b string, bo string"


def all_walks(links, sizes, start, goal, max_length, max_nodes):
    """Every walk by depth."""
    turn = {"+": "-", "-": "+"}
    nexts: dict = {}
    for a, ao, b, bo in links:
        nexts.setdefault((a, ao), set()).add((b, bo))
        nexts.setdefault((b, turn[bo]), set()).add((a, turn[ao]))
    out, stack = [], [(start, [])]
    while stack:
        node, walk = stack.pop()
        for n in nexts.get(node, ()):
            if n == goal:
                out.append(walk)
            elif len(walk) < max_nodes and sum(sizes[x] for x, _ in walk) + sizes[n[0]] <= max_length and Counter(x for x, _ in walk)[n[0]] < 2:
                stack.append((n, [*walk, n]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_the_first_walks_are_found_among_rings(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(9)]
    sizes = {n: rng.choice([10, 20, 30]) for n in names}
    links = list({(rng.choice(names), rng.choice("+-"), rng.choice(names), rng.choice("+-")) for _ in range(16)})
    ends = [(k, rng.choice(names), rng.choice("+-"), rng.choice(names), rng.choice("+-")) for k in range(12)]
    segments = spark.createDataFrame([(k, n, None, sizes[n], None) for k, n in enumerate(names)], SEGMENTS)
    edges = spark.createDataFrame([(k, *x, 0) for k, x in enumerate(links)], LINKS)
    got: dict = {}
    for r in P.find_paths(edges, segments, spark.createDataFrame(ends, PAIRS), max_length=150, max_nodes=7, max_paths=3).collect():
        got.setdefault(r["pair"], []).append((r["hops"], r["length"], "".join(f"{w['name']}{w['orient']}\t" for w in r["walk"])))
    for pair, a, ao, b, bo in ends:
        want = sorted((len(w), sum(sizes[n] for n, _ in w), "".join(f"{n}{o}\t" for n, o in w)) for w in all_walks(links, sizes, (a, ao), (b, bo), 150, 7))
        assert sorted(got.get(pair, [])) == want[:3], (pair, a, ao, b, bo)


def test_a_ladder_of_bubbles_keeps_few_rows(spark, monkeypatch):
    n, names, links = 30, ["s0"], []
    for k in range(n):
        names += [f"a{k}", f"b{k}", f"s{k + 1}"]
        links += [(f"s{k}", f"a{k}"), (f"s{k}", f"b{k}"), (f"a{k}", f"s{k + 1}"), (f"b{k}", f"s{k + 1}")]
    segments = spark.createDataFrame([(k, x, None, 10, None) for k, x in enumerate(names)], SEGMENTS)
    edges = spark.createDataFrame([(k, a, "+", b, "+", 0) for k, (a, b) in enumerate(links)], LINKS)
    seen, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": (out := save(self, df, name), seen.append(out.count()) if name in ("step", "front") else None)[0])
    got = P.find_paths(edges, segments, spark.createDataFrame([(1, "s0", "+", f"s{n}", "+")], PAIRS), max_nodes=2 * n, max_paths=24).collect()
    assert len(got) == 24 and {r["hops"] for r in got} == {2 * n - 1} and max(seen) <= 4 * 24
    assert sorted("".join(w["name"] for w in r["walk"]) for r in got)[0] == "".join(f"a{k}s{k + 1}" for k in range(n))[: -len(f"s{n}")]


def turned(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def block(query, n, strand, st, en, ref="chr"):
    return (query, 1, n, 0, n, strand, ref, 100_000, st, en, n, n, 0, True, 60)


BLOCKS = "query string, ord long, q_len long, q_st long, q_en long, strand int, ref string, r_len long, r_st long, r_en long, matches long, block_len long, nm long, is_primary boolean, mapq int"


def assembly(spark):
    """A, m (only in the graph), B turned round, C overlapping B, a gap, D; and x, that nothing places."""
    rng = random.Random(4)
    genome = "".join(rng.choices("ACGT", k=6000))
    seqs = {"A": genome[:1000], "m": turned(genome[980:1600]), "B": turned(genome[1590:2600]), "C": genome[2550:3500], "D": genome[4000:6000], "x": "".join(rng.choices("ACGT", k=700))}
    segments = spark.createDataFrame([(k, n, s, len(s), 1.0) for k, (n, s) in enumerate(seqs.items())], SEGMENTS)
    links = spark.createDataFrame([(0, "A", "+", "m", "-", 20), (1, "m", "-", "B", "-", 10)], LINKS)
    blocks = spark.createDataFrame([block("A", 1000, 1, 0, 1000), block("B", 1010, -1, 1590, 2600), block("C", 950, 1, 2550, 3500), block("D", 2000, 1, 4000, 6000)], BLOCKS)
    return genome, seqs, segments, links, blocks


def test_a_scaffold_spells_the_genome(spark):
    genome, seqs, segments, links, blocks = assembly(spark)
    plan = S.scaffold_by_reference(blocks, segments, links)
    rows = {(r["scaffold"], r["pos"]): r for r in plan.collect()}
    assert {k[0] for k in rows} == {"scaffold_chr", "unplaced_x"}
    assert [(w["name"], w["orient"]) for w in rows["scaffold_chr", 0]["bridge"]] == [("m", "-")]
    assert (rows["scaffold_chr", 1]["trim"], rows["scaffold_chr", 1]["gap_after"], rows["scaffold_chr", 2]["gap_after"], rows["scaffold_chr", 2]["evidence"]) == (50, 0, 500, "reference")
    agp = S.agp(plan, segments, links)
    assert S.verify_agp(agp).count() == 0 and S.plan_warnings(plan, segments, links).count() == 0
    made = {r["name"]: r["sequence"] for r in S.scaffold_sequences(agp, segments).collect()}
    assert made == {"scaffold_chr": genome[:3500] + "N" * 500 + genome[4000:], "unplaced_x": seqs["x"]}
    p = S.preview(plan, agp).first()
    assert (p["records"], p["bases"], p["gaps"], p["gap_bases"], p["bridged_bases"], p["n50"], p["largest"], p["placed"], p["scaffolds"]) == (2, 6700, 1, 500, 600, 6000, 6000, 4, 1)
    assert {(r["segment"], r["scaffold"], r["pos"]) for r in S.member_index(plan).collect()} == {("A", "scaffold_chr", 0), ("B", "scaffold_chr", 1), ("C", "scaffold_chr", 2), ("D", "scaffold_chr", 3), ("x", "unplaced_x", 0)}


def test_without_a_graph_gaps_stay_and_unplaced_ones_go_on_request(spark):
    genome, seqs, segments, links, blocks = assembly(spark)
    plan = S.scaffold_by_reference(blocks, segments, links.limit(0), include_unplaced=False)
    agp = S.agp(plan, segments, links.limit(0))
    assert S.scaffold_sequences(agp, segments).first()["sequence"] == seqs["A"] + "N" * 590 + genome[1590:3500] + "N" * 500 + genome[4000:]
    assert {r["segment"] for r in plan.collect()} == set("ABCD")


def test_walks_that_no_longer_hold_become_gaps_with_a_warning(spark):
    _, _, segments, links, blocks = assembly(spark)
    plan = S.scaffold_by_reference(blocks, segments, links)
    lost = links.where("ord = 0")
    agp = S.agp(plan, segments, lost).where("object = 'scaffold_chr'").orderBy("part").collect()
    assert [(r["kind"], r["component"], r["gap"]) for r in agp][:3] == [("W", "A", None), ("N", None, 100), ("W", "B", None)]
    assert {(r["scaffold"], r["kind"], r["detail"]) for r in S.plan_warnings(plan, segments, lost).collect()} == {("scaffold_chr", "not linked", "A+ to B-")}
    flipped = plan.withColumn("orientation", F.when(F.col("segment") == "B", "+").otherwise(F.col("orientation")))
    assert S.plan_warnings(flipped, segments, links).where("kind = 'not linked'").count() == 1
    fewer = segments.where("name != 'C'")
    found = {(r["kind"], r["detail"]) for r in S.plan_warnings(plan.unionByName(plan.where("segment = 'D'").withColumn("pos", F.lit(9).cast("long"))), fewer, links).collect()}
    assert found == {("missing", "C"), ("repeated", "D: 2"), ("not linked", "B- to D+"), ("not linked", "D+ to D+")}
    assert S.verify_agp(S.agp(plan, fewer, links)).count() == 0


def test_members_shorter_than_their_overlap_are_swallowed(spark):
    segments = spark.createDataFrame([(0, "a", "A" * 50, 50, 1.0), (1, "b", "C" * 10, 10, 1.0), (2, "c", "G" * 30, 30, 1.0)], SEGMENTS)
    links = spark.createDataFrame([(0, "a", "+", "b", "+", 20), (1, "b", "+", "c", "+", 5)], LINKS)
    plan = spark.createDataFrame([(0, "s", "graph", k, n, "+", 0) for k, n in enumerate("abc")], "ord long, scaffold string, source string, pos long, segment string, orientation string, gap_after long")
    assert [(r["component"], r["beg"], r["end"]) for r in S.agp(plan, segments, links).orderBy("part").collect()] == [("a", 1, 50), ("c", 51, 75)]
    assert [(r["kind"], r["detail"]) for r in S.plan_warnings(plan, segments, links).collect()] == [("swallowed", "b: 10 of 20")]


def test_references_with_one_label_make_scaffolds_of_their_own(spark):
    segments = spark.createDataFrame([(k, n, "ACGT" * 200, 800, 1.0) for k, n in enumerate(["p", "q", "u v", "u_v"])], SEGMENTS)
    blocks = spark.createDataFrame([block("p", 800, 1, 0, 800, "chr 1"), block("q", 800, 1, 0, 800, "chr_1")], BLOCKS)
    plan = S.plan_by_reference(blocks, segments)
    assert {r["scaffold"] for r in plan.collect()} == {"scaffold_chr_1", "scaffold_chr_1_2", "unplaced_u_v", "unplaced_u_v_2"}
    chains = spark.createDataFrame([], "chain long, pos long, name string, orient string")
    assert plan.columns == S.plan_by_chains(chains, segments).columns and S.plan_by_chains(chains, segments).count() == 4


def test_two_walks_that_come_close_must_be_the_same_bases(spark):
    """Of two ways over a gap one fills it only where both spell the same, or where bases of the other are not known."""
    segments = spark.createDataFrame([(k, n, s, len(s or "A" * 40), 1.0) for k, (n, s) in enumerate({"a": "C" * 50, "x": "AC" * 20, "y": "AC" * 20, "z": "AG" * 20, "u": None, "b": "G" * 50}.items())], SEGMENTS)
    gaps = spark.createDataFrame([(1, "a", "+", "b", "+", 40)], "pair long, a string, ao string, b string, bo string, gap long")
    for middle, fills in (("xy", True), ("xz", False), ("xu", True), ("u", False)):
        links = spark.createDataFrame([(k, *e, 0) for k, e in enumerate([e for m in middle for e in (("a", "+", m, "+"), (m, "+", "b", "+"))])], LINKS)
        made = P.bridges(links, segments, gaps).collect()
        assert [r["sequence"] for r in made] == (["AC" * 20] if fills else []), middle
