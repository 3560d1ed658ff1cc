"""Links, components, walks and edits on small graphs drawn by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandflow.operators import edits as E, links as G
from strandflow.operators.names import unique_names
from strandflow.operators.components import connected_components
from strandflow.runtime import Scratch

SEGMENTS = "ord long, name string, sequence string, length long, depth double"
LINKS = "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long"


def tiny(spark):
    """A chain of three, one by itself and a loop."""
    seqs = {"e1": ("CA" * 35 + "TGCATTAC", 12.0), "e2": ("TGCATTAC" + "AG" * 30 + "CCTAGGT", 18.0), "e3": ("CCTAGGT" + "T" * 41, 34.0), "f": ("GC" * 16, 6.0), "loop": ("ACCT" * 8, 42.0)}
    segments = spark.createDataFrame([(k, n, s, len(s), d) for k, (n, (s, d)) in enumerate(seqs.items())], SEGMENTS)
    links = spark.createDataFrame([(0, "e1", "+", "e2", "+", 8), (1, "e2", "+", "e3", "+", 7), (2, "loop", "+", "loop", "+", 0), (3, "e2", "-", "e1", "-", 5), (4, "e3", "+", "nowhere", "+", 1)], LINKS)
    return segments, links


def clean(spark):
    segments, links = tiny(spark)
    return segments, G.drop_dangling(G.dedup_links(links), segments)


def test_reverse_spellings_collapse_and_dangling_links_go(spark):
    _, links = clean(spark)
    assert sorted((r["ord"], r["overlap"]) for r in links.collect()) == [(0, 8), (1, 7), (2, 0)]


def test_adjacency_of_hairpins_and_loops(spark):
    df = spark.createDataFrame([(0, "H", "+", "H", "-", 0), (1, "L", "+", "L", "+", 0)], LINKS)
    assert sorted(tuple(r)[:4] for r in G.adjacency(df).collect()) == [("H", "+", "H", "-"), ("L", "+", "L", "+"), ("L", "-", "L", "-")]


def test_topology(spark):
    segments, links = clean(spark)
    assert {r["name"]: r["component"] for r in G.components(segments, links).collect()} == {"e1": 0, "e2": 0, "e3": 0, "f": 1, "loop": 2}
    dead = {r["name"]: r["dead_ends"] for r in G.degrees(segments, links).collect()}
    assert dead == {"e1": 1, "e2": 0, "e3": 1, "f": 2, "loop": 0}
    assert [r["name"] for r in G.circular_segments(links).collect()] == ["loop"]
    assert G.no_overlap_length(segments, links).first()[0] == 242
    assert tuple(G.orphaned(segments, links).first()) == (1, 32)
    from strandflow.operators.contiguity import depth_summary

    assert G.estimated_length(segments, links, depth_summary(segments)).first()[0] == 298
    assert {r["name"]: r["distance"] for r in G.within_distance(links, segments.where("name = 'e1'"), 2).collect()} == {"e1": 0, "e2": 1, "e3": 2}


def test_walk(spark):
    segments, links = clean(spark)
    steps = spark.createDataFrame([("p", 0, "e1", "+"), ("p", 1, "e2", "+"), ("p", 2, "e3", "+")], "path string, pos long, name string, orient string")
    r = G.walk_sequences(steps, links, segments).first()
    assert r["length"] == 186 and r["sequence"] == "CA" * 35 + "TGCATTAC" + "AG" * 30 + "CCTAGGT" + "T" * 41


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2050)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).collect() == []


def test_split_keeps_bases_and_links(spark):
    segments, links = clean(spark)
    g = E.split_segments(E.Graph(segments, links), spark.createDataFrame([("e2", 30), ("e2", 50), ("e2", 0), ("loop", 10)], "name string, pos long"))
    assert {r["name"]: r["length"] for r in g.segments.collect()} == {"e1": 78, "e2_part1": 30, "e2_part2": 20, "e2_part3": 25, "e3": 48, "f": 32, "loop_part1": 10, "loop_part2": 22}
    ends = {(r["from_name"], r["from_orient"], r["to_name"], r["to_orient"]) for r in g.links.collect()}
    assert ends == {("e1", "+", "e2_part1", "+"), ("e2_part3", "+", "e3", "+"), ("e2_part1", "+", "e2_part2", "+"), ("e2_part2", "+", "e2_part3", "+"), ("loop_part1", "+", "loop_part2", "+")}
    assert g.undo().segments.count() == 5


def test_simplify_merges_chains(spark):
    segments, links = clean(spark)
    g = E.simplify(E.Graph(segments, links))
    rows = {r["name"]: (r["length"], r["depth"]) for r in g.segments.collect()}
    assert rows["merged_0"] == (186, (78 * 12 + 75 * 18 + 48 * 34) / 201) and set(rows) == {"merged_0", "f", "loop"}
    assert [r["from_name"] for r in g.links.collect()] == ["loop"]


def test_chains_read_through_reversed_segments(spark):
    segments = spark.createDataFrame([(k, n, None, 10, None) for k, n in enumerate("PABCQ")], SEGMENTS)
    links = spark.createDataFrame([(0, "P", "+", "A", "-", 0), (1, "B", "+", "A", "+", 0), (2, "B", "-", "C", "+", 0), (3, "C", "+", "Q", "+", 0)], LINKS)
    got = [(r["pos"], r["name"], r["orient"]) for r in G.chains(links, segments).orderBy("pos").collect()]
    assert got == [(0, "P", "+"), (1, "A", "-"), (2, "B", "-"), (3, "C", "+"), (4, "Q", "+")]


def test_filters_treat_unknown_depth_apart(spark):
    segments = spark.createDataFrame([(0, "a", None, 10, None), (1, "b", None, 10, 5.0), (2, "c", None, 10, 50.0)], SEGMENTS)
    g = E.Graph(segments, spark.createDataFrame([], LINKS))
    assert {r["name"] for r in E.filter_graph(g, min_depth=1).segments.collect()} == {"b", "c"}
    assert {r["name"] for r in E.filter_graph(g, max_depth=10).segments.collect()} == {"a", "b"}


def distinct_ids(graph):
    ords, names = ([r[c] for r in graph.segments.collect()] for c in ("ord", "name"))
    assert len(set(ords)) == len(ords) and len(set(names)) == len(names)


def test_pieces_of_a_split_are_nodes_of_their_own(spark):
    segments = spark.createDataFrame([(k, n, n * 300, 300, 1.0) for k, n in enumerate("XAY")], SEGMENTS)
    links = spark.createDataFrame([(0, "X", "+", "A", "+", 10), (1, "A", "+", "Y", "+", 10)], LINKS)
    cut = E.split_segments(E.Graph(segments, links), spark.createDataFrame([("A", 100), ("A", 200)], "name string, pos long"))
    distinct_ids(cut)
    g = E.delete(cut, spark.createDataFrame([("A_part2",)], "name string"))
    assert len({r["component"] for r in G.components(g.segments, g.links).collect()}) == 2
    assert len({r["chain"] for r in G.chains(g.links, g.segments).collect()}) == 2
    merged = E.simplify(g)
    distinct_ids(merged)
    turned = "R" * 300 + "T" * 90  # a chain is read from the end that comes first
    assert sorted((r["length"], r["sequence"]) for r in merged.segments.collect()) == [(390, turned), (390, "X" * 300 + "A" * 90)]
    again = E.split_segments(merged, merged.segments.select("name", F.lit(50).cast("long").alias("pos")))
    distinct_ids(again)
    assert again.segments.agg(F.sum("length")).first()[0] == 780


def test_new_names_keep_out_of_the_way(spark):
    segments = spark.createDataFrame([(k, n, "A" * 30, 30, 1.0) for k, n in enumerate(["x", "x_part1", "x_part1_2", "y", "merged_3", "z"])], SEGMENTS)
    links = spark.createDataFrame([(0, "y", "+", "z", "+", 0)], LINKS)
    g = E.split_segments(E.Graph(segments, links), spark.createDataFrame([("x", 10)], "name string, pos long"))
    distinct_ids(g)
    assert {r["name"] for r in g.segments.collect()} == {"x_part1", "x_part1_2", "x_part1_2_2", "x_part2", "y", "merged_3", "z"}
    merged = E.simplify(E.Graph(segments, links))
    distinct_ids(merged)
    assert {r["name"] for r in merged.segments.collect()} >= {"merged_3", "merged_3_2"}


def test_unique_names_count_on_until_all_differ(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a_2"), (3, "b"), (4, "a")], "ord long, label string")
    taken = spark.createDataFrame([("b",)], "name string")
    got = {r["ord"]: r["name"] for r in unique_names(rows, taken).collect()}
    assert len(set(got.values())) == 5 and "b" not in got.values() and got[0] == "a" and got[2] == "a_2" and got[3] == "b_2"
    assert unique_names(rows.limit(0)).collect() == []
