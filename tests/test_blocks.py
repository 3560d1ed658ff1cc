"""Spans, block folds against plain loops, and scaffolds that give the genome back."""

from __future__ import annotations

import random

import pytest

from strandflow.operators import blocks as B, intervals as I, scaffold as S

BLOCK = "query string, ord long, q_len long, q_st long, q_en long, strand int, ref string, r_len long, r_st long, r_en long, matches long, block_len long, nm long, is_primary boolean, mapq int"


def block(query, q_st, q_en, r_st, r_en, ref="chr1", strand=1, ord_=0, primary=True, q_len=10_000, r_len=1_000_000):
    return (query, ord_, q_len, q_st, q_en, strand, ref, r_len, r_st, r_en, q_en - q_st, q_en - q_st, 0, primary, 60)


def frame(spark, rows):
    return spark.createDataFrame(rows, BLOCK)


def test_unions_touch_and_complement(spark):
    df = spark.createDataFrame([("a", 90, 100), ("a", 0, 10), ("a", 5, 12), ("b", 0, 60), ("b", 60, 100), ("b", 0, 60)], "ref string, st long, en long")
    assert {r["ref"]: r["covered"] for r in I.covered(df).collect()} == {"a": 22, "b": 100}
    lengths = spark.createDataFrame([("a", 95), ("b", 100), ("c", 7)], "ref string, length long")
    assert sorted(tuple(r) for r in I.complement(I.union_spans(df), lengths).collect()) == [("a", 12, 90), ("c", 0, 7)]


def plain_merge(rows, gap, back):
    out, groups = [], {}
    for r in rows:
        groups.setdefault((r[0], r[6], r[5]), []).append(r)
    for (q, ref, strand), own in groups.items():
        cur = None
        for r in sorted(own, key=lambda r: (r[3], r[1])):
            if cur and -back <= r[3] - cur[1] <= gap and -back <= (r[8] - cur[3] if strand > 0 else cur[2] - r[9]) <= gap:
                cur = [cur[0], max(cur[1], r[4]), min(cur[2], r[8]), max(cur[3], r[9]), cur[4] + r[10]]
            else:
                if cur:
                    out.append((q, ref, strand, *cur))
                cur = [r[3], r[4], r[8], r[9], r[10]]
        out.append((q, ref, strand, *cur))
    return sorted(out)


def test_collinear_merge_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        q_st, r_st, size = rng.randrange(4000), rng.randrange(4000), rng.randrange(1, 900)
        rows.append(block(f"q{k % 9}", q_st, q_st + size, r_st, r_st + size + rng.randrange(-3, 4), ref=f"c{k % 2}", strand=rng.choice([1, -1]), ord_=k))
    got = sorted((r["query"], r["ref"], r["strand"], r["q_st"], r["q_en"], r["r_st"], r["r_en"], r["matches"]) for r in B.merge_collinear(frame(spark, rows), 300, 100).collect())
    assert got == plain_merge(rows, 300, 100)


@pytest.mark.parametrize("pair, kind", [
    ((block("c", 0, 5000, 0, 5000, "a"), block("c", 5000, 10_000, 0, 5000, "b")), "translocation"),
    ((block("c", 0, 5000, 0, 5000), block("c", 5000, 10_000, 5000, 10_000, strand=-1)), "inversion"),
    ((block("c", 0, 5000, 0, 5000), block("c", 5000, 10_000, 20_000, 25_000)), "relocation"),
    ((block("c", 0, 5000, 0, 5000), block("c", 5000, 10_000, 5500, 10_500)), "local"),
    ((block("c", 0, 5000, 0, 5000), block("c", 5000, 10_000, 5100, 10_100)), None),
    ((block("c", 0, 5000, 995_000, 1_000_000), block("c", 5000, 10_000, 0, 5000)), None),
    ((block("c", 0, 4000, 0, 4000), block("c", 8000, 10_000, 4000, 6000)), "relocation"),
])
def test_kinds_of_breaks(spark, pair, kind):
    got = [(r["kind"], r["break_pos"]) for r in B.structural_differences(frame(spark, pair)).collect()]
    assert got == ([] if kind is None else [(kind, (pair[0][4] + pair[1][3]) // 2)])


def test_origin_join_and_coverage(spark):
    rows = [block("c", 0, 5000, 995_000, 1_000_000), block("c", 5000, 10_000, 0, 5000)]
    assert [(r["q_st"], r["q_en"]) for r in B.join_across_origin(frame(spark, rows)).collect()] == [(0, 10_000)]
    lengths = spark.createDataFrame([("c", 10_000), ("d", 400)], "query string, length long")
    got = {r["query"]: r["status"] for r in B.query_coverage(frame(spark, rows[:1]), lengths).collect()}
    assert got == {"c": "partial", "d": "unaligned"}


def test_long_deletions_cut_blocks_on_both_strands(spark):
    from pyspark.sql import functions as F

    from strandflow.functions.sequence import cigar

    base = frame(spark, [block("p", 0, 300, 0, 2300), block("m", 0, 300, 0, 2300, strand=-1), block("n", 0, 5, 0, 5)])
    df = base.withColumn("cigar", F.when(F.col("query") == "n", F.lit(None)).otherwise(cigar(F.lit("100M2000D200M")))).withColumn("nm", F.lit(2004).cast("long"))
    got = sorted((r["query"], r["q_st"], r["q_en"], r["r_st"], r["r_en"], r["nm"]) for r in B.split_at_long_indels(df).collect())
    assert got == [("m", 0, 200, 2100, 2300, 3), ("m", 200, 300, 0, 100, 1), ("n", 0, 5, 0, 5, 2004), ("p", 0, 100, 0, 100, 1), ("p", 100, 300, 2100, 2300, 3)]


@pytest.mark.parametrize("overlap", [0, 21, 55, 127])
def test_scaffold_gives_the_genome_back(spark, overlap):
    rng = random.Random(overlap)
    genome = "".join(rng.choices("ACGT", k=3000))
    cuts = [(0, 800 + overlap), (800, 1500 + overlap), (1500, 2300 + overlap), (2300, 3000)]
    turn = str.maketrans("ACGT", "TGCA")
    rows, blocks = [], []
    for k, (a, b) in enumerate(cuts):
        b = min(b, 3000)
        seq = genome[a:b] if k % 2 == 0 else genome[a:b].translate(turn)[::-1]
        rows.append((k, f"c{k}", seq, b - a, None))
        blocks.append(block(f"c{k}", 0, b - a, a, b, "g", strand=1 if k % 2 == 0 else -1, q_len=b - a, r_len=3000))
    segments = spark.createDataFrame(rows, "ord long, name string, sequence string, length long, depth double")
    none = spark.createDataFrame([], "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long")
    plan = S.scaffold_by_reference(frame(spark, blocks), segments, none)
    agp = S.agp(plan, segments, none)
    assert S.verify_agp(agp).count() == 0
    # ends that only touch may or may not follow each other, so a gap stays
    want = genome if overlap else ("N" * 100).join(genome[a:b] for a, b in cuts)
    assert [r["sequence"] for r in S.scaffold_sequences(agp, segments).collect()] == [want]
