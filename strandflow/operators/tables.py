"""Tables that put what is known of an assembly side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandflow.functions.sequence import gc_content, let
from strandflow.operators import blocks as B, links as G, scaffold as S
from strandflow.runtime import Scratch


def segment_table(segments: DataFrame, links: DataFrame, blocks: DataFrame | None = None, plan: DataFrame | None = None) -> DataFrame:
    """One row of 15 columns for each segment: length, depth, GC, component, links at its ends, whether it is a ring by itself, the
    reference it lies on most, and its place in the scaffolds."""
    links = Scratch(segments.sparkSession, "table").save(links, "links")
    # sequences stay where they are, each made once: what is told of them goes through the joins
    gc = let(F.col("sequence"), lambda s: F.when(s.isNotNull() & (s != ""), F.format_string("%.5f", gc_content(s))))
    told = segments.select("name", "length", F.when(F.col("depth").isNotNull(), F.format_string("%.4f", "depth")).alias("depth"), gc.alias("gc"))
    rows = told.join(G.components(segments, links), "name").join(G.degrees(segments, links), "name")
    ring = G.circular_segments(links).withColumn("circular", F.lit(1))
    rows = rows.join(ring, "name", "left")
    if blocks is None:
        rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in (("ref", "string"), ("ref_start", "long"), ("ref_end", "long"), ("ref_identity", "string"), ("ref_strand", "int"))})
    else:
        identity = F.coalesce(F.col("matches") / F.nullif("block_len", F.lit(0)), F.lit(0.0))
        hit = B.top_hits(blocks, 1).select(F.col("query").alias("name"), "ref", F.col("r_st").alias("ref_start"), F.col("r_en").alias("ref_end"), F.format_string("%.5f", identity).alias("ref_identity"), F.col("strand").alias("ref_strand"))
        rows = rows.join(hit, "name", "left")
    if plan is None:
        rows = rows.withColumns({"scaffold": F.lit(None).cast("string"), "scaffold_position": F.lit(None).cast("long")})
    else:
        rows = rows.join(S.member_index(plan).select(F.col("segment").alias("name"), "scaffold", F.col("pos").alias("scaffold_position")), "name", "left")
    return rows.select(
        "name", "length", "depth", "gc", "component", "deg_start", "deg_end",
        F.coalesce("circular", F.lit(0)).alias("circular"), "ref", "ref_start", "ref_end", "ref_identity", "ref_strand", "scaffold", "scaffold_position",
    )


#: The rows of a comparison of assemblies, the column of ``Session.metrics`` each shows and its decimals.
ROWS = (
    ("# contigs", "contigs", 0), ("# contigs >= 1 kb", "n_1000", 0), ("# contigs >= 10 kb", "n_10000", 0), ("Total length", "total", 0), ("Largest contig", "largest", 0), ("GC (%)", "gc", 2), ("N50", "n50", 0), ("L50", "l50", 0),
    ("N75", "n75", 0), ("auN", "aun", 0), ("NG50", "ng50", 0), ("LG50", "lg50", 0), ("# N's per 100 kb", "n_per_100kb", 2), ("# links", "links", 0), ("# components", "components", 0), ("# dead ends", "dead_ends", 0),
)


def comparison_table(named: dict[str, DataFrame]) -> DataFrame:
    """``(ord, label, <a column of texts for each assembly>)`` of one-row tables of metrics; a row that none has a value for is left out,
    one that some lack has a dash there."""
    long = None
    for name, one in named.items():
        cell = lambda c, d: F.format_number(F.bround(F.col(c).cast("double")), 0) if not d else F.format_string(f"%.{d}f", F.col(c).cast("double"))
        value: list[Column] = [F.when(F.col(c).isNotNull(), cell(c, d)) if c in one.columns else F.lit(None).cast("string") for _, c, d in ROWS]
        cells = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), v.alias("value")) for k, ((label, _, _), v) in enumerate(zip(ROWS, value, strict=True))])
        rows = one.select(F.lit(name).alias("assembly"), F.explode(cells).alias("x")).select("assembly", "x.*")
        long = rows if long is None else long.unionByName(rows)
    wide = long.where("value is not null").groupBy("ord", "label").pivot("assembly", list(named)).agg(F.first("value"))
    return wide.select("ord", "label", *[F.coalesce(F.col(f"`{n}`"), F.lit("-")).alias(n) for n in named])


def view_ranges(segments: DataFrame) -> DataFrame:
    """One row: the ranges of depth, GC and length that colours and widths go over, the quartiles of depth, and all bases. A range
    without values or of one value is widened, so that it never is empty."""
    gc = F.when(F.col("sequence").isNotNull() & (F.col("sequence") != ""), gc_content("sequence"))
    depth = F.when(~F.isnan("depth") & (F.abs("depth") < float("inf")), F.col("depth"))
    one = segments.agg(
        F.min(depth).alias("d0"), F.max(depth).alias("d1"), F.min(gc).alias("g0"), F.max(gc).alias("g1"), F.greatest(F.lit(1), F.min("length")).alias("length_min"), F.greatest(F.lit(1), F.max("length")).alias("length_max"), F.coalesce(F.sum("length"), F.lit(0)).alias("bases"),
        F.percentile(depth, 0.25).alias("depth_q1"), F.percentile(depth, 0.75).alias("depth_q3"),
    )
    d0, g0 = F.coalesce("d0", F.lit(0.0)), F.coalesce("g0", F.lit(0.0))
    d1, g1 = F.coalesce("d1", F.lit(1.0)), F.coalesce("g1", F.lit(1.0))
    low = F.when(g1 <= g0, F.greatest(F.lit(0.0), g0 - 0.01)).otherwise(g0)
    return one.select(
        d0.alias("depth_min"), F.when(d1 <= d0, d0 + 1).otherwise(d1).alias("depth_max"), F.col("d0").isNotNull().alias("has_depth"), low.alias("gc_min"), F.when(g1 <= g0, low + 0.02).otherwise(g1).alias("gc_max"), F.col("g0").isNotNull().alias("has_gc"),
        F.coalesce("length_min", F.lit(1)).alias("length_min"), F.coalesce("length_max", F.lit(1)).alias("length_max"), "bases", "depth_q1", "depth_q3",
    )
