"""What must not depend on how rows are dealt out: bins, ranges, rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import blocks as B, contiguity as C, intervals as I, links as G, scaffold as S
from strandflow.runtime import Scratch
from strandflow.session import load
from tests.test_graph import LINKS, SEGMENTS
from tests.test_scaffold import BLOCKS, block


def merged(spans):
    out = []
    for st, en in sorted(x for x in spans if x[1] > x[0]):
        if out and st <= out[-1][1]:
            out[-1][1] = max(out[-1][1], en)
        else:
            out.append([st, en])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("width", [7, 50, 1 << 20])
def test_islands_over_bins(spark, monkeypatch, width):
    monkeypatch.setattr(I, "WIDTH", width)
    rng = random.Random(width)
    spans = {ref: [(a := rng.randrange(-20, 400), a + rng.choice([0, 1, 3, 5, 120])) for _ in range(n)] for ref, n in (("r", 60), ("s", 5), ("t", 1))}
    df = spark.createDataFrame([(ref, *x) for ref, own in spans.items() for x in own] + [("u", 5, 5)], "ref string, st long, en long")
    got = I.union_spans(df)
    assert sorted(tuple(r) for r in got.select("ref", "st", "en").collect()) == sorted((ref, *x) for ref, own in spans.items() for x in merged(own))
    lengths = spark.createDataFrame([("r", 300), ("s", 300), ("t", 90), ("u", 10), ("v", 0)], "ref string, length long")
    rest = {(r["ref"], x) for r in I.complement(got, lengths).collect() for x in range(r["st"], r["en"])}
    size = {r["ref"]: r["length"] for r in lengths.collect()}
    covered = {(ref, x) for ref, own in spans.items() for st, en in own for x in range(st, en)}
    assert rest == {(ref, x) for ref, n in size.items() for x in range(n)} - covered


def test_bins_order_rows_as_one_window_does(spark, monkeypatch):
    monkeypatch.setattr(I, "WIDTH", 10)
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(60), rng.randrange(5), k) for k in range(80)]
    df = spark.createDataFrame(rows, "ref string, st long, v long, tie long")
    got = I.next_row(I.running_sum(df, "ref", "st", F.col("v"), "upto", F.col("tie")), "ref", "st", F.col("tie"), "after", F.col("tie")).collect()
    for ref in "ab":
        own = sorted((r for r in rows if r[0] == ref), key=lambda r: (r[1], r[3]))
        want = {r[3]: (sum(x[2] for x in own[: k + 1]), own[k + 1][3] if k + 1 < len(own) else None) for k, r in enumerate(own)}
        assert {r["tie"]: (r["upto"], r["after"]) for r in got if r["ref"] == ref} == want


def test_order_along_a_reference_over_bins(spark, monkeypatch):
    rng = random.Random(8)
    rows = [block(f"q{k}", n := rng.choice([500, 800, 1500]), 1, st := rng.randrange(20_000), st + n) for k in range(40)]
    df = spark.createDataFrame(rows, BLOCKS)
    want = sorted(map(str, S.order_by_reference(df).collect()))
    monkeypatch.setattr(I, "WIDTH", 1000)
    assert sorted(map(str, S.order_by_reference(df).collect())) == want


def test_weighted_median(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 400):
        rows = [(round(rng.random() * 9, 2), rng.randrange(1, 50)) for _ in range(n)]
        total, upto, want = sum(w for _, w in rows), 0, None
        for v, w in sorted(rows):
            upto += w
            if want is None and upto >= total / 2:
                want = v
        assert C.weighted_median(spark.createDataFrame(rows, "v double, w long"), "v", "w").first()[0] == want
    assert C.weighted_median(spark.createDataFrame([], "v double, w long"), "v", "w").first()[0] is None


def test_rings_cost_no_rounds(spark, monkeypatch):
    """A ring of three, a ring of one, and a chain of 70."""
    names = ["x", "y", "z", "o", *[f"c{k}" for k in range(70)]]
    rows = [("x", "y"), ("y", "z"), ("z", "x"), ("o", "o"), *[(f"c{k}", f"c{k + 1}") for k in range(69)]]
    segments = spark.createDataFrame([(k, n, None, 10, None) for k, n in enumerate(names)], SEGMENTS)
    links = spark.createDataFrame([(k, a, "+", b, "+", 0) for k, (a, b) in enumerate(rows)], LINKS)
    written, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": (written.append(name), save(self, df, name))[1])
    got = G.chains(links, segments).orderBy("pos").collect()
    assert [(r["pos"], r["name"], r["orient"]) for r in got] == [(k, f"c{k}", "+") for k in range(70)]
    assert written.count("back") <= 9
    written.clear()
    assert G.chains(links.where("ord < 4"), segments).collect() == [] and written.count("back") <= 2


def test_a_long_deletion_cuts_a_block_and_shows_as_a_break(spark, tmp_path):
    (tmp_path / "a.gfa").write_text("S\tc\t" + "ACGT" * 1000 + "\n")
    (tmp_path / "a.paf").write_text("c\t4000\t0\t4000\t+\tchr\t50000\t100\t18100\t3990\t18000\t60\tNM:i:14010\tcg:Z:1500M14000D2000M3I497M\n")
    rows = load(spark, str(tmp_path / "a.gfa")).with_blocks(str(tmp_path / "a.paf")).blocks.orderBy("q_st").collect()
    assert [(r["q_st"], r["q_en"], r["r_st"], r["r_en"], r["block_len"], r["matches"], r["nm"]) for r in rows] == [(0, 1500, 100, 1600, 1500, 1496, 4), (1500, 4000, 15_600, 18_097, 2500, 2494, 6)]
    assert ["".join(f"{c['n']}{c['op']}" for c in r["cigar"]) for r in rows] == ["1500M", "2000M3I497M"]
    events = B.structural_differences(load(spark, str(tmp_path / "a.gfa")).with_blocks(str(tmp_path / "a.paf")).blocks).collect()
    assert [(r["kind"], r["break_pos"], r["ref_gap"]) for r in events] == [("relocation", 1500, 14_000)]
