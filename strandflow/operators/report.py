"""Results as tables of texts, and such tables as a page of HTML.

Every table has a ``key`` that its rows are read by and otherwise texts alone. A page is lines of HTML made in the JVM, one
for each row, so a page may be of any length; the parts that ``write_page`` writes are in order, and a page that
fits in one partition is one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandflow.functions import formats as X
from strandflow.runtime import Scratch
from strandflow.sources.sinks import write_lines

#: The rows of a report, with the column that each shows, its format and a remark.
ASSEMBLY = (
    ("# contigs", "contigs", "int", ""), ("# contigs >= 1 kb", "n_1000", "int", ""), ("# contigs >= 10 kb", "n_10000", "int", ""), ("# contigs >= 50 kb", "n_50000", "int", ""),
    ("Total length", "total", "span", "sum of segment lengths; shared overlaps count twice"), ("Total length (no overlaps)", "length_no_overlaps", "span", "without the largest overlap of each segment"),
    ("Total length (>= 1 kb)", "bases_1000", "span", ""), ("Largest contig", "largest", "span", ""), ("Smallest contig", "smallest", "span", ""), ("Mean contig length", "mean", "float1", ""),
    ("Lower quartile contig length", "q1", "int", ""), ("Median contig length", "median", "int", ""), ("Upper quartile contig length", "q3", "int", ""), ("GC content", "gc", "pct", ""), ("# N's per 100 kb", "n_per_100kb", "float", ""),
    ("N50", "n50", "span", "contigs this long or longer hold half of all bases"), ("L50", "l50", "int", "contigs that hold half of all bases"), ("N75", "n75", "span", ""), ("L75", "l75", "int", ""), ("auN", "aun", "float0", "area under the Nx curve"),
    ("NG50", "ng50", "span", ""), ("LG50", "lg50", "int", ""), ("NG75", "ng75", "span", ""), ("# links", "links", "int", ""), ("Smallest overlap", "overlap_min", "int", ""), ("Largest overlap", "overlap_max", "int", ""),
    ("# connected components", "components", "int", ""), ("Largest component", "largest_component_length", "span", ""), ("Share of the largest component", "largest_component_percent", "pct", ""), ("Orphaned length", "orphaned_length", "span", "in segments without links"),
    ("Share of orphaned length", "orphaned_percent", "pct", ""), ("# dead ends", "dead_ends", "int", ""), ("Percentage dead ends", "dead_end_percent", "pct", "of both ends of all segments"), ("# circular contigs", "circular", "int", ""),
    ("Median depth", "median_depth", "float", "by length: half of all bases lie below"), ("Mean depth", "mean_depth", "float", ""), ("Depth CV", "depth_cv", "float", ""), ("Estimated sequence length", "estimated_length", "span", "each segment as often as its depth says"),
)
REFERENCE = (
    ("Reference length", "reference_length", "span", ""), ("# reference sequences", "reference_sequences", "int", ""), ("Genome fraction", "genome_fraction", "pct", "reference bases under any alignment"), ("Covered reference bases", "covered_bases", "span", ""),
    ("Duplication ratio", "duplication_ratio", "float3", "aligned bases to covered reference bases"), ("# aligned contigs", "aligned_contigs", "int", ""), ("# unaligned contigs", "unaligned_contigs", "int", ""), ("# partially unaligned", "partially_unaligned", "int", ""),
    ("Fully unaligned length", "fully_unaligned_length", "span", ""), ("Total aligned length", "total_aligned_length", "span", ""), ("Largest alignment", "largest_alignment", "span", ""), ("NA50", "na50", "span", "N50 of aligned blocks"), ("NGA50", "nga50", "span", ""),
    ("LA50", "la50", "int", ""), ("# mismatches per 100 kb", "mismatches_per_100kb", "float", ""), ("# indels per 100 kb", "indels_per_100kb", "float", ""), ("Total mismatches", "mismatches", "int", ""), ("Total indels", "indels", "int", ""),
    ("# misassemblies (extensive)", "extensive", "int", ""), ("# relocations", "relocation", "int", ""), ("# inversions", "inversion", "int", ""), ("# translocations", "translocation", "int", ""), ("# local misassemblies", "local", "int", ""),
    ("# misassembled contigs", "misassembled_contigs", "int", ""), ("Misassembled contigs length", "misassembled_contigs_length", "span", ""),
)
SCAFFOLDS = (
    ("# scaffolds", "scaffolds", "int", "of placed contigs"), ("# contigs placed", "placed", "int", ""), ("# contigs unplaced", "unplaced", "int", "records of their own"), ("# records written", "records", "int", ""), ("Total scaffold length", "bases", "span", ""),
    ("# gaps", "gaps", "int", ""), ("Gap bases (N)", "gap_bases", "span", ""), ("Bridged bases (from graph)", "bridged_bases", "span", "sequence of the graph in place of a gap"), ("Largest scaffold", "largest", "span", ""), ("Scaffold N50", "n50", "span", ""),
)
SIDE = (
    ("Shared bases", "shared_bases", "span", ""), ("Unique bases", "unique_bases", "span", ""), ("# shared contigs", "shared", "int", ""), ("# partial contigs", "partial", "int", ""), ("# missing contigs", "missing", "int", ""), ("Missing bases", "missing_bases", "span", ""),
)

FORMATS = {"int": X.fmt_int, "span": X.fmt_span, "pct": X.fmt_pct, "float": X.fmt_float, "float0": lambda c: X.fmt_float(c, 0), "float1": lambda c: X.fmt_float(c, 1), "float3": lambda c: X.fmt_float(c, 3)}


def number_key(c: Column) -> Column:
    """Texts that sort as the numbers do, from 0 on."""
    return F.lpad(c.cast("long").cast("string"), 20, "0")


def labelled(one: DataFrame, rows=ASSEMBLY) -> DataFrame:
    """``(key, label, value, remark)`` of a table of one row; rows whose column it lacks are left out, a null is a dash."""
    shown = [F.struct(number_key(F.lit(k)).alias("key"), F.lit(label).alias("label"), FORMATS[how](F.col(c)).alias("value"), F.lit(remark).alias("remark")) for k, (label, c, how, remark) in enumerate(rows) if c in one.columns]
    return one.select(F.explode(F.array(*shown)).alias("x")).select("x.*")


def reference_row(found: dict[str, DataFrame]) -> DataFrame:
    """One row of all that ``Session.evaluation`` counts."""
    counts = found["counts"].drop("contigs").withColumn("extensive", F.col("translocation") + F.col("inversion") + F.col("relocation"))
    out = found["totals"].crossJoin(F.broadcast(found["references"].agg(F.count("*").alias("reference_sequences"))))
    for one in (found["rates"], found["aligned"], counts):
        out = out.crossJoin(F.broadcast(one))
    return out


def cards(metrics: DataFrame, reference: DataFrame | None = None, scaffolds: DataFrame | None = None) -> DataFrame:
    """``(key, label, value, remark, tone)``: what a report begins with. A genome fraction is good from 90 per cent and fair
    from 70 on; no extensive misassembly is good, up to 5 are fair."""
    one, has = metrics, metrics.columns
    if reference is not None:
        one = one.crossJoin(F.broadcast(reference.select([F.col(c).alias(f"ref_{c}") for c in ("genome_fraction", "nga50", "extensive", "local", "mismatches_per_100kb", "indels_per_100kb")])))
    if scaffolds is not None:
        one = one.crossJoin(F.broadcast(scaffolds.select(F.col("scaffolds").alias("scaf_n"), F.col("n50").alias("scaf_n50"))))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit("")
    made = [("Contigs", X.fmt_int("contigs"), text(X.fmt_int("n_1000"), " >= 1 kb"), none), ("Total length", X.fmt_bp("total"), text("largest ", X.fmt_bp("largest")), none), ("N50", X.fmt_bp("n50"), text("L50 ", X.fmt_int("l50")), none)]
    if "gc" in has:
        made.append(("GC", X.fmt_pct("gc"), text(X.fmt_float("n_per_100kb"), " N / 100 kb"), none))
    if "links" in has:
        made.append(("Graph links", X.fmt_int("links"), text(X.fmt_int("components"), " components, ", X.fmt_int("dead_ends"), " dead ends"), none))
    if reference is not None:
        share, breaks = F.coalesce("ref_genome_fraction", F.lit(0.0)), F.coalesce("ref_extensive", F.lit(0))
        tone = lambda good, fair: F.when(good, "good").when(fair, "fair").otherwise("bad")
        made += [
            ("Genome fraction", X.fmt_pct("ref_genome_fraction"), text("NGA50 ", X.fmt_bp("ref_nga50")), tone(share >= 90, share >= 70)),
            ("Misassemblies", X.fmt_int(breaks), text(X.fmt_int("ref_local"), " local"), tone(breaks == 0, breaks <= 5)),
            ("Mismatches / 100 kb", X.fmt_float("ref_mismatches_per_100kb"), text(X.fmt_float("ref_indels_per_100kb"), " indels / 100 kb"), none),
        ]
    if scaffolds is not None:
        made.append(("Scaffolds", X.fmt_int("scaf_n"), text("N50 ", X.fmt_bp("scaf_n50")), none))
    boxes = [F.struct(number_key(F.lit(k)).alias("key"), F.lit(label).alias("label"), value.alias("value"), remark.alias("remark"), tone.alias("tone")) for k, (label, value, remark, tone) in enumerate(made)]
    return one.select(F.explode(F.array(*boxes)).alias("x")).select("x.*")


def break_rows(events: DataFrame) -> DataFrame:
    """Breaks as texts, by contig and position; a second reference is named only where it is another one."""
    to = F.concat(F.lit(f" {X.DASH}> "), F.when(F.col("left_ref") != F.col("right_ref"), F.concat("right_ref", F.lit(":"))).otherwise(""), X.fmt_int("right_start"))
    return events.select(
        F.concat_ws("\t", "query", number_key(F.col("break_pos"))).alias("key"), F.col("query").alias("contig"), "kind", F.when(F.col("kind") == "local", "no").otherwise("yes").alias("extensive"),
        X.fmt_int("break_pos").alias("position"), F.concat("left_ref", F.lit(":"), X.fmt_int("left_end"), to).alias("location"), X.fmt_int("ref_gap").alias("ref_gap"),
    )


def contig_rows(table: DataFrame, limit: int | None = 2000) -> DataFrame:
    """The table of segments as texts, longest first; ``limit`` keeps that many of the longest ones and says how many are left out."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(X.DASH))
    percent = lambda c: X.fmt_pct(100 * F.col(c).cast("double"))
    first = table if limit is None else table.orderBy(F.desc("length"), "name").limit(limit)
    rows = first.select(
        F.concat_ws("\t", number_key((1 << 62) - F.col("length")), "name").alias("key"), "name", X.fmt_int("length").alias("length"), X.fmt_float(F.col("depth").cast("double")).alias("depth"), percent("gc").alias("gc"), dash("component").alias("component"),
        dash("deg_start").alias("links_at_start"), dash("deg_end").alias("links_at_end"), F.when(F.col("circular") == 1, "yes").otherwise("no").alias("circular"), dash("ref").alias("ref"),
        F.when(F.col("ref_start").isNotNull(), F.concat(X.fmt_int("ref_start"), F.lit(X.DASH), X.fmt_int("ref_end"))).otherwise(X.DASH).alias("ref_span"), percent("ref_identity").alias("identity"),
        F.when(F.col("ref_strand") < 0, "-").when(F.col("ref_strand") > 0, "+").otherwise(X.DASH).alias("strand"), dash("scaffold").alias("scaffold"), dash("scaffold_position").alias("position"),
    )
    return rows if limit is None else rows.unionByName(_left_out(table, limit, rows.columns))


def _left_out(table: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    """The last row of a table that was cut: how many there are besides. None if none are."""
    more = table.agg((F.count("*") - limit).alias("more")).where("more > 0")
    return more.select(F.lit("~").alias("key"), F.concat(F.lit("and "), X.fmt_int("more"), F.lit(" more")).alias(columns[1]), *[F.lit("").alias(c) for c in columns[2:]])


def longest(table: DataFrame, columns: dict[str, str], name: str, limit: int) -> DataFrame:
    """The ``limit`` longest rows of any table with a length, ``columns`` as texts by their formats ('' for none)."""
    shown = [(FORMATS[how](F.col(c)) if how else F.coalesce(F.col(c).cast("string"), F.lit(X.DASH))).alias(c) for c, how in columns.items()]
    key = F.concat_ws("\t", number_key((1 << 62) - F.col("length")), F.col(name).cast("string")).alias("key")
    rows = table.orderBy(F.desc("length"), name).limit(limit).select(key, *shown)
    return rows.unionByName(_left_out(table, limit, rows.columns))


def member_rows(plan: DataFrame) -> DataFrame:
    """The members of all scaffolds as texts, in order."""
    last = F.col("evidence").isNull()
    steps = F.array_join(F.transform("bridge", lambda x: F.concat(x["name"], x["orient"])), " ")
    walk = F.when(F.size("bridge") > 0, steps).otherwise(X.DASH)
    return plan.select(
        F.concat_ws("\t", number_key(F.col("ord")), F.col("scaffold"), number_key(F.col("pos"))).alias("key"), "scaffold", "source", F.coalesce("reference", F.lit(X.DASH)).alias("reference"), "segment", "orientation",
        F.when(F.col("r_st").isNotNull(), F.concat(X.fmt_int("r_st"), F.lit(X.DASH), X.fmt_int("r_en"))).otherwise(X.DASH).alias("ref_span"), F.when(last, X.DASH).otherwise(X.fmt_int("gap_after")).alias("gap_after"),
        F.coalesce("evidence", F.lit(X.DASH)).alias("evidence"), walk.alias("bridge"),
    )


def escaped(c: Column) -> Column:
    """Text for HTML."""
    for of, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(of), F.lit(to))
    return c


#: Fixed value: how a page looks.
STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ddd;text-align:left}.good{color:#2e7d32}.fair{color:#b26a00}.bad{color:#b3261e}"


def page(title: str, sections: dict[str, DataFrame]) -> DataFrame:
    """``(section, part, key, value)``: the lines of a page with a table for each section. A column ``tone`` becomes the class of its row."""
    spark = next(iter(sections.values())).sparkSession
    plain = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    fixed = [(0, 0, "", f'<!doctype html><html><head><meta charset="utf-8"><title>{plain(title)}</title><style>{STYLE}</style></head><body><h1>{plain(title)}</h1>')]
    body = []
    for k, (name, table) in enumerate(sections.items(), 1):
        shown = [c for c in table.columns if c not in ("key", "tone")]
        heads = "".join(f"<th>{plain(c.replace('_', ' '))}</th>" for c in shown)
        fixed += [(k, 0, "", f"<h2>{plain(name)}</h2><table><tr>{heads}</tr>"), (k, 2, "", "</table>")]
        cells = [x for c in shown for x in (F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))]
        start = F.when(F.col("tone") != "", F.concat(F.lit('<tr class="'), "tone", F.lit('">'))).otherwise("<tr>") if "tone" in table.columns else F.lit("<tr>")
        body.append(table.select(F.lit(k).alias("section"), F.lit(1).alias("part"), "key", F.concat(start, *cells, F.lit("</tr>")).alias("value")))
    fixed.append((len(sections) + 1, 0, "", "</body></html>"))
    out = spark.createDataFrame(fixed, "section int, part int, key string, value string")
    for lines in body:
        out = out.unionByName(lines)
    return out


def write_page(lines: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write a page below ``folder``: its parts, one after the other, are the document."""
    made = Scratch(lines.sparkSession, "page").save(lines, "lines")  # sorting reads its input twice
    write_lines(made, folder, "section", "part", "key", mode=mode)
