"""Report tables and pages."""

from __future__ import annotations

import random
from dataclasses import replace
from html.parser import HTMLParser

from pyspark.sql import functions as F

from strandflow.operators import report as H
from strandflow.operators.scaffold import _members as complete
from strandflow.session import load


class Tables(HTMLParser):
    """The headings of a page and the cells of the rows below each."""

    def __init__(self):
        super().__init__()
        self.open, self.rows, self.title, self.at = [], {}, None, ""

    def handle_starttag(self, tag, attrs):
        if tag != "meta":
            self.open.append(tag)
        if tag == "tr":
            self.rows.setdefault(self.title, []).append([])
        elif tag in ("td", "th"):
            self.rows[self.title][-1].append("")

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        if self.open and self.open[-1] in ("td", "th"):
            self.rows[self.title][-1][-1] += data
        elif self.open and self.open[-1] == "h2":
            self.title = data


def read(spark, folder) -> dict[str, list[list[str]]]:
    page = Tables()
    page.feed("\n".join(r["value"] for part in sorted(p for p in folder.iterdir() if p.name.startswith("part")) for r in spark.read.text(str(part)).collect()))
    page.close()
    assert page.open == []
    return page.rows


def test_report_of_a_session(spark, tmp_path):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(24_000))
    (tmp_path / "a.gfa").write_text("".join(f"S\t{n}\t{s}\n" for n, s in (("big", genome[:9000]), ("mid", genome[9500:15_000]), ("odd<&>", genome[20_000:23_000] + genome[16_000:19_000]))))
    (tmp_path / "r.fa").write_text(f">ref\n{genome}\n")
    s = load(spark, str(tmp_path / "a.gfa")).with_reference(str(tmp_path / "r.fa"))
    s.report(str(tmp_path / "plain"), contigs=2)
    rows = read(spark, tmp_path / "plain")
    assert list(rows) == ["Overview", "Assembly", "Contigs", "Reference", "Coverage of references", "Misassemblies"]
    assert ["Total length", "20,500 (20.5 kb)", "sum of segment lengths; shared overlaps count twice"] in rows["Assembly"]
    assert [r[:2] for r in rows["Contigs"][1:]] == [["big", "9,000"], ["odd<&>", "6,000"], ["and 1 more", ""]]
    assert ["Misassemblies", "1", "0 local"] in rows["Overview"]
    (broken,) = rows["Misassemblies"][1:]
    assert broken[:3] == ["odd<&>", "relocation", "yes"] and abs(int(broken[3].replace(",", "")) - 3000) < 50 and broken[4].startswith("ref:2")
    assert rows["Coverage of references"][1][:2] == ["ref", "24,000 (24.0 kb)"]


def test_report_of_scaffolds_and_of_a_comparison(spark, tmp_path):
    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(9000))
    for name, parts in (("a", (genome[:4000], genome[4300:7000], genome[7000:8000])), ("r", (genome,))):
        (tmp_path / f"{name}.fa").write_text("".join(f">{name}{k}\n{x}\n" for k, x in enumerate(parts)))
    s = load(spark, str(tmp_path / "a.fa"))
    other = load(spark, str(tmp_path / "r.fa"))
    plan = [(0, "x", "reference", "r0", 0, "a0", "+", 300, "reference", 0, 4000), (0, "x", "reference", "r0", 1, "a1", "-", 0, None, 4300, 7000), (1, "a2", "unplaced", None, 0, "a2", "+", 0, None, None, None)]
    made = spark.createDataFrame(plan, "ord long, scaffold string, source string, reference string, pos long, segment string, orientation string, gap_after long, evidence string, r_st long, r_en long")
    replace(s, plan=complete(made)).report(str(tmp_path / "more"), others={"again": s}, contigs=None)
    rows = read(spark, tmp_path / "more")
    assert [r[0] for r in rows["Contigs"]] == ["name", "a0", "a1", "a2"]
    assert rows["Members of scaffolds"][1] == ["x", "reference", "r0", "a0", "+", "0–4,000", "300", "reference", "–"] and len(rows["Members of scaffolds"]) == 4
    assert ["# contigs unplaced", "1", "records of their own"] in rows["Scaffolds"] and "Warnings" in rows
    assert all(a == b for _, a, b in rows["Comparison"][1:]) and len(rows["Comparison"]) > 10
    s.comparison_report(other, str(tmp_path / "diff"), ("ours", "genome"))
    rows = read(spark, tmp_path / "diff")
    assert [r[1] for r in rows["ours: content"] if r[0] == "# missing contigs"] == ["0"] and [r[1] for r in rows["ours: content"] if r[0] == "# shared contigs"] == ["3"]


def test_without_alignments_links_or_rows(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\n\n>b\nACGT\n")
    load(spark, str(tmp_path / "a.fa")).report(str(tmp_path / "out"))
    rows = read(spark, tmp_path / "out")
    assert list(rows) == ["Overview", "Assembly", "Contigs"] and [r[0] for r in rows["Contigs"]] == ["name", "b", "a"]
    empty = spark.createDataFrame([], "query string, break_pos long, kind string, left_ref string, left_end long, right_ref string, right_start long, ref_gap long")
    H.write_page(H.page('<"title">', {"Breaks": H.break_rows(empty)}), str(tmp_path / "none"))
    assert read(spark, tmp_path / "none") == {"Breaks": [["contig", "kind", "extensive", "position", "location", "ref gap"]]}


def test_tones(spark):
    for share, breaks, want in ((90.0, 0, ["good", "good"]), (89.9, 1, ["fair", "fair"]), (70.0, 5, ["fair", "fair"]), (69.9, 6, ["bad", "bad"]), (None, None, ["bad", "good"])):
        reference = spark.createDataFrame([(share, None, breaks, 0, 1.5, None)], "genome_fraction double, nga50 long, extensive long, local long, mismatches_per_100kb double, indels_per_100kb double")
        metrics = spark.range(1).select(*[F.lit(1).alias(c) for c in ("contigs", "n_1000", "total", "largest", "n50", "l50")])
        got = {r["label"]: r for r in H.cards(metrics, reference).collect()}
        assert [got["Genome fraction"]["tone"], got["Misassemblies"]["tone"]] == want
    assert got["Genome fraction"]["value"] == "–" and got["Mismatches / 100 kb"]["remark"] == "– indels / 100 kb"
