"""What a task holds and how often a line is taken apart: read off plans, beside small results."""

from pyspark.sql import functions as F

from strandflow.operators import links as G
from strandflow.runtime import spread


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _links(spark):
    rows = [(5, "b", "-", "a", "-", 7), (3, "a", "+", "b", "+", 4), (9, "a", "+", "b", "+", 1), (4, "a", "+", "a", "-", 2)]
    return spark.createDataFrame(rows, "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long")


def test_dedup_links_hashes_and_keeps_the_first_spelling(spark):
    made = G.dedup_links(_links(spark).where("ord != 3"))
    assert "SortAggregate" not in _plan(made)
    assert sorted(tuple(r) for r in made.collect()) == [(4, "a", "+", "a", "-", 2), (5, "b", "-", "a", "-", 7)]


def test_spread_follows_the_rows(spark):
    few, many = (spread(spark.range(n), "id", rows=10).rdd.getNumPartitions() for n in (10, 1000))
    assert few == spark.sparkContext.defaultParallelism and many == 100


def test_first_steps_of_walks_are_dealt_out(spark):
    steps = spark.range(4000).select((F.col("id") / 2).cast("long").alias("path"), (F.col("id") % 2).alias("pos"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("name"), F.lit("+").alias("orient"))
    segments = spark.createDataFrame([("a", 10, None), ("b", 20, None)], "name string, length long, sequence string")
    made = G.walk_pieces(steps, _links(spark), segments)
    assert [tuple(r) for r in made.groupBy("name").agg(F.min("overlap"), F.max("overlap"), F.count("*")).orderBy("name").collect()] == [("a", 0, 0, 2000), ("b", 4, 4, 2000)]
    # the join is by the four parts of a link, of which first steps have their path as the first: not one null for all of them
    assert "cast(path" in _plan(made) and "[k0" in _plan(made)


def test_blocks_are_cut_in_their_own_rows(spark):
    from strandflow.functions.sequence import cigar
    from strandflow.operators import blocks as B

    text = [("a", 1, "5S100M2000D50M1500I3D20M4H"), ("b", -1, "100M2000D50M"), ("c", 1, "2000D"), ("d", 1, "30M5I30M"), ("e", 1, None)]
    rows = spark.createDataFrame(text, "query string, strand int, text string").select(
        "query", F.lit(1).cast("long").alias("ord"), F.lit(10_000).cast("long").alias("q_len"), F.lit(0).cast("long").alias("q_st"), F.lit(1679).cast("long").alias("q_en"), "strand", F.lit("r").alias("ref"), F.lit(9000).cast("long").alias("r_len"),
        F.lit(1000).cast("long").alias("r_st"), F.lit(3173).cast("long").alias("r_en"), F.lit(170).cast("long").alias("matches"), F.lit(3673).cast("long").alias("block_len"), F.lit(3503).cast("long").alias("nm"), cigar("text").alias("cigar"),
    )
    made = B.split_at_long_indels(rows)
    assert "Exchange" not in _plan(made)
    text = F.array_join(F.transform("cigar", lambda c: F.concat(c["n"].cast("string"), c["op"])), "")
    got = made.select("query", "q_st", "q_en", "r_st", "r_en", "block_len", text.alias("cigar"), "matches", "nm").orderBy("query", "r_st", "q_st").collect()
    assert [tuple(r) for r in got] == [
        ("a", 0, 105, 1000, 1100, 100, "100M", 98, 2), ("a", 105, 155, 3100, 3150, 50, "50M", 49, 1), ("a", 1655, 1679, 3150, 3173, 23, "3D20M", 23, 0),
        ("b", 1579, 1679, 1000, 1100, 100, "100M", 113, 1002), ("b", 1529, 1579, 3100, 3150, 50, "50M", 57, 501),
        ("c", 0, 1679, 1000, 3173, 3673, "2000D", 170, 3503), ("d", 0, 1679, 1000, 3173, 3673, "30M5I30M", 170, 3503), ("e", 0, 1679, 1000, 3173, 3673, None, 170, 3503),
    ]


def test_lines_are_split_once(spark):
    from strandflow.operators import hits as H
    from strandflow.sources import textio as T

    lines = spark.createDataFrame([(1, "L\ta\t+\tb\t-\t5M\r")], "line long, value string").repartition(2)
    for made in (T.gfa_links(lines), T.bad_records(lines), H.tabular_hits(lines)):
        assert _plan(made).count("split(") == 1
    assert [tuple(r) for r in T.gfa_links(lines).collect()] == [(1, "a", "+", "b", "-", 5, "5M")]


def test_steps_of_a_line_are_found_once(spark):
    from strandflow.sources import textio as T

    lines = spark.createDataFrame([(1, "P\tp\ta+,b-;c+,x;;d-;\t*"), (2, "W\ts\t1\tc\t0\t9\t>a<b"), (3, "P\tq"), (4, "W\ts\t1\tc")], "line long, value string").repartition(2)
    assert _plan(lines.select(T._steps(F.col("value")).alias("s"))).count(", ;, -1") == 1
    got = [tuple(r) for r in T.gfa_path_steps(lines).orderBy("ord", "pos").collect()]
    assert got == [(1, "p", 0, "a", "+", False), (1, "p", 1, "b", "-", True), (1, "p", 2, "c", "+", True), (1, "p", 3, "d", "-", False), (2, "s_c", 0, "a", "+", False), (2, "s_c", 1, "b", "-", False)]


def test_warnings_lay_a_plan_out_once(spark, monkeypatch):
    from strandflow.operators import scaffold as S

    seen, layout = [], S.layout
    monkeypatch.setattr(S, "layout", lambda *a, **k: seen.append(1) or layout(*a, **k))
    segments = spark.createDataFrame([("a", 50), ("b", 60)], "name string, length long")
    plan = spark.createDataFrame([(0, "s", "graph", p, n, "+", 0) for p, n in enumerate("abx")], "ord long, scaffold string, source string, pos long, segment string, orientation string, gap_after long")
    got = sorted(tuple(r) for r in S.plan_warnings(plan, segments, _links(spark)).collect())
    assert got == [("s", "missing", "x")] and len(seen) == 1


def test_covered_bases_shuffle_spans_once(spark):
    from strandflow.operators import intervals as I

    w = I.WIDTH
    spans = spark.createDataFrame([("a", 10, 20), ("a", 15, 3 * w + 5), ("a", 15, 30), ("a", 3 * w + 7, 3 * w + 9), ("a", 5, 5), ("b", w, w + 1), (None, 0, 4)], "ref string, st long, en long")
    made = I.covered_bases(spans)
    assert {r["ref"]: r["covered"] for r in made.collect()} == {"a": 3 * w - 3, "b": 1, None: 4}
    assert _plan(made.where("ref is not null")).count("hashpartitioning(ref") <= 2 and "Join" not in _plan(made)


def test_graphs_without_loops_shuffle_no_links_for_them(spark):
    rows = spark.createDataFrame([(1, "a", "+", "a", "+", 0), (2, "b", "+", "b", "+", 0), (3, "b", "+", "c", "-", 0)], "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long")
    made = G.circular_segments(rows)
    assert [r[0] for r in made.collect()] == ["a"]
    assert "BroadcastHashJoin" in _plan(made)


def test_simplify_writes_its_links_once(spark):
    from strandflow.operators import edits as E

    segments = spark.createDataFrame([(k, n, None, 10 + k, None) for k, n in enumerate("abc")], "ord long, name string, sequence string, length long, depth double")
    links = spark.createDataFrame([(1, "a", "+", "b", "+", 4)], "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long")
    graph = E.Graph(segments, G.dedup_links(links))
    made = E.simplify(graph)
    assert sorted(tuple(r) for r in made.segments.select("name", "length").collect()) == [("c", 12), ("merged_0", 17)]
    assert made.undo() == graph
    assert "k0" not in _plan(made.links)  # links are read as written, not told apart again


def test_tables_carry_no_sequences_through_joins(spark):
    from strandflow.operators import tables as R

    segments = spark.createDataFrame([(0, "a", "ACGT", 4, 1.0), (1, "b", None, 7, None)], "ord long, name string, sequence string, length long, depth double")
    made = R.segment_table(segments, _links(spark).where("overlap = 7"))
    assert sorted((r["name"], r["gc"], r["depth"], r["component"]) for r in made.collect()) == [("a", "0.50000", "1.0000", 0), ("b", None, None, 0)]
    lines = [x for x in _plan(made).splitlines() if "Sort " in x or "Exchange hash" in x]
    assert lines and not any("sequence" in x for x in lines)


def test_warnings_shuffle_members_few_times(spark, monkeypatch):
    from strandflow.operators import scaffold as S
    from strandflow.runtime import Scratch

    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": (plans.append(_plan(df)), save(self, df, name))[1])
    segments = spark.createDataFrame([("a", 50), ("b", 60), ("c", 5)], "name string, length long")
    links = spark.createDataFrame([(1, "a", "+", "b", "-", 4), (2, "c", "-", "b", "+", 7), (3, "b", "-", "c", "+", 6)], "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long")
    members = [(0, "s", 0, "a", "+"), (0, "s", 1, "b", "-"), (0, "s", 2, "c", "+"), (0, "s", 3, "x", "+"), (0, "s", 4, "a", "-"), (1, "t", 0, "c", "-"), (1, "t", 1, "x", "-")]
    plan = spark.createDataFrame([(o, s, "graph", p, n, c, 0) for o, s, p, n, c in members], "ord long, scaffold string, source string, pos long, segment string, orientation string, gap_after long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = S.plan_warnings(plan, segments, links)
        plans.append(_plan(made))
        got = sorted((r["scaffold"] or "", r["kind"], r["detail"]) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("", "repeated", "a: 2"), ("", "repeated", "c: 2"), ("", "repeated", "x: 2"), ("s", "missing", "x"), ("s", "not linked", "c+ to a-"), ("s", "swallowed", "c: 5 of 6"), ("t", "missing", "x")]
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 8


def test_tables_make_a_sequence_once(spark):
    from strandflow.operators import tables as R

    rows = [(0, "a", "acgtt", 5, 1.0), (1, "b", None, 7, None), (2, "c", "", 0, None), (3, "d", "sSnN-é😀a", 8, 2.0), (4, "e", "nn", 2, None)]
    segments = spark.createDataFrame(rows, "ord long, name string, raw string, length long, depth double").withColumn("sequence", F.upper("raw"))
    made = R.segment_table(segments, _links(spark).where("overlap = 7"))
    assert {r["name"]: r["gc"] for r in made.collect()} == {"a": "0.40000", "b": None, "c": None, "d": "0.66667", "e": "0.00000"}
    assert max(line.count("upper(raw") for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
