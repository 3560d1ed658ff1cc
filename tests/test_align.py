"""Alignment against planted errors, and search."""

from __future__ import annotations

import random

import pytest

from strandflow.operators import align as L, blocks as B, compare as D

TURN = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.translate(TURN)[::-1]


def planted():
    rng = random.Random(11)
    rand = lambda n: "".join(rng.choices("ACGT", k=n))
    snp = lambda s: "".join(rng.choice("ACGT".replace(c, "")) if rng.random() < 0.001 else c for c in s)
    chromosome, plasmid = rand(60_000), rand(9000)
    contigs = {
        "clean": snp(chromosome[:19_000]), "reverse": rc(snp(chromosome[20_000:32_000])), "inversion": snp(chromosome[33_000:37_000]) + rc(snp(chromosome[37_000:41_000])),
        "relocation": snp(chromosome[41_000:45_000]) + snp(chromosome[50_000:54_000]), "translocation": snp(chromosome[54_000:59_000]) + snp(plasmid[:4000]),
        "deletion": snp(chromosome[21_000:24_000]) + snp(chromosome[24_050:27_000]), "foreign": rand(3000), "short": "ACGT" * 10,
    }
    return {"chromosome": chromosome, "plasmid": plasmid}, contigs


@pytest.fixture(scope="module")
def aligned(spark):
    reference, contigs = planted()
    frame = lambda d: spark.createDataFrame(list(d.items()), "name string, sequence string")
    return frame(contigs), L.align(frame(contigs), frame(reference), "asm5").cache()


def test_planted_differences_are_found(aligned):
    _, blocks = aligned
    events = {(r["query"], r["kind"]): r["break_pos"] for r in B.structural_differences(B.usable(blocks)).collect()}
    assert set(events) == {("inversion", "inversion"), ("relocation", "relocation"), ("translocation", "translocation")}
    assert all(abs(at - want) < 100 for at, want in [(events["inversion", "inversion"], 4000), (events["relocation", "relocation"], 4000), (events["translocation", "translocation"], 5000)])


def test_blocks_reach_from_end_to_end(aligned):
    _, blocks = aligned
    rows = {r["query"]: r for r in B.merge_collinear(B.usable(blocks)).collect()}
    assert (rows["clean"]["q_st"], rows["clean"]["q_en"], rows["clean"]["r_st"], rows["clean"]["r_en"]) == (0, 19_000, 0, 19_000)
    assert (rows["reverse"]["r_st"], rows["reverse"]["r_en"], rows["reverse"]["strand"]) == (20_000, 32_000, -1)
    assert "foreign" not in rows and "short" not in rows
    rates = B.rates(B.usable(blocks).where("query = 'clean'")).first()
    assert 40 < rates["mismatches_per_100kb"] < 200


def test_cigars_agree_with_the_spans(aligned):
    _, blocks = aligned
    for r in blocks.collect():
        size = lambda ops: sum(x["n"] for x in r["cigar"] if x["op"] in ops)
        assert size("MI") == r["q_en"] - r["q_st"] and size("MD") == r["r_en"] - r["r_st"]
        assert r["matches"] + r["nm"] == r["block_len"] == size("MID")


def test_content_of_two_assemblies(aligned):
    from pyspark.sql import functions as F

    contigs, blocks = aligned
    got = {r["name"]: r["status"] for r in D.contig_diff(contigs.withColumn("length", F.length("sequence").cast("long")), blocks).collect()}
    assert got["clean"] == "shared" and got["foreign"] == "missing"


def test_search_and_its_errors(spark, aligned):
    contigs, _ = aligned
    reference, own = planted()
    query = L.parse_query(spark, ">probe\n" + rc(own["clean"][500:900]) + "\n")
    hits = L.search(contigs, query).collect()
    assert hits[0]["segment"] == "clean" and (hits[0]["s_st"], hits[0]["s_en"], hits[0]["strand"]) == (500, 900, -1)
    with pytest.raises(ValueError):
        L.parse_query(spark, "not a sequence!")
    with pytest.raises(ValueError):
        L.align(contigs, contigs, "asm99")


def test_minimizers_are_told_once_across_chunks(spark, monkeypatch):
    sequence = "".join(random.Random(5).choices("ACGTN", weights=[10, 10, 10, 10, 1], k=5000))
    whole = set(L.minimizers_of(sequence.encode(), 15, 8)[1].tolist())
    monkeypatch.setattr(L, "CHUNK", 64)
    made = [r["pos"] for r in L.minimizers(spark.createDataFrame([("s", sequence)], "name string, sequence string"), 15, 8).collect()]
    assert len(made) == len(set(made)) and whole <= set(made)


def test_pieces_of_chains_are_one_block_again(spark, aligned):
    contigs, blocks = aligned
    reference, _ = planted()
    made = L.align(contigs, spark.createDataFrame(list(reference.items()), "name string, sequence string"), "asm5", piece=3000)
    shape = lambda df: sorted((r["query"], r["ref"], r["strand"], r["q_st"], r["q_en"], r["r_st"], r["r_en"], r["matches"], r["nm"], str(r["cigar"])) for r in df.collect())
    assert shape(made) == shape(blocks)


def _plain_chains(found, band, max_gap, least):
    """Chains as sets of pins: by diagonal, then by place on the query, over all anchors of a pair at once."""
    pairs, out = {}, []
    for query, q, r in found:
        pairs.setdefault(query, set()).add((q, r))
    for query, pins in pairs.items():
        groups, before = [], None
        for q, r in sorted(pins, key=lambda p: p[1] - p[0]):
            if before is None or r - q - before > band:
                groups.append([])
            groups[-1].append((q, r))
            before = r - q
        for group in groups:
            runs, before = [], None
            for q, r in sorted(group):
                if before is None or q - before > max_gap:
                    runs.append([])
                runs[-1].append((q, r))
                before = q
            out += [(query, tuple(x)) for x in runs if len(x) >= least]
    return sorted(out)


def test_chains_by_cells_are_those_over_all_anchors(spark):
    rng = random.Random(8)
    found = [(rng.choice("xyz"), rng.randrange(4000), rng.randrange(4000)) for _ in range(600)]
    frame = spark.createDataFrame([(n, "r", 1, 5000, 5000, q, r) for n, q, r in found], "query string, ref string, strand int, q_len long, r_len long, q long, r long")
    for piece in (1 << 20, 100):
        rows = L.chains(frame, 30, 90, 3, piece=piece).collect()
        made = {}
        for r in sorted(rows, key=lambda r: r["piece"]):
            made.setdefault((r["query"], r["g"], r["c"]), []).append(r)
        assert sorted((n, tuple((p["q"], p["r"]) for x in v for p in x["pins"])) for (n, _, _), v in made.items()) == _plain_chains(found, 30, 90, 3)
        for v in made.values():
            assert v[-1]["until"] is None and [x["until"] for x in v[:-1]] == [x["pins"][0] for x in v[1:]]
            assert all(a["pins"][0]["r"] < b["pins"][0]["r"] for a, b in zip(v, v[1:], strict=False))
