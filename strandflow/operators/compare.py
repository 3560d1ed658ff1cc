"""Content comparison of two assemblies from their mutual alignment blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandflow.operators import links as G
from strandflow.operators.intervals import complement, covered_bases, union_spans
from strandflow.runtime import Scratch

SHARED, PRESENT = 0.95, 0.10


def status(fraction, shared: float = SHARED, present: float = PRESENT):
    return F.when(fraction >= shared, "shared").when(fraction >= present, "partial").otherwise("missing")


def contig_diff(segments: DataFrame, blocks: DataFrame, shared: float = SHARED, present: float = PRESENT) -> DataFrame:
    """``(name, length, covered, best_match, best_identity, status)`` of one side's segments. The best match has
    the most query bases times identity, first on ties; the best identity is that of any block."""
    lengths = segments.select(F.col("name").alias("query"), "length")
    covered = covered_bases(blocks.select("query", F.col("q_st").alias("st"), F.col("q_en").alias("en")), "query")
    identity = F.col("matches") / F.nullif("block_len", F.lit(0))
    score = (F.col("q_en") - F.col("q_st")) * F.greatest(F.coalesce(identity, F.lit(0.0)), F.lit(0.0))
    best = blocks.groupBy("query").agg(F.max_by("ref", F.struct(score.alias("s"), (-F.col("ord")).alias("o"))).alias("best_match"), F.max(F.coalesce(identity, F.lit(0.0))).alias("best_identity"))
    got = F.least("length", F.coalesce("covered", F.lit(0)))
    return lengths.join(covered, "query", "left").join(best, "query", "left").select(F.col("query").alias("name"), "length", got.alias("covered"), "best_match", "best_identity", status(F.coalesce(got / F.nullif("length", F.lit(0)), F.lit(0.0)), shared, present).alias("status"))


def uncovered(segments: DataFrame, blocks: DataFrame, least: int = 1) -> DataFrame:
    """Spans of a side's segments that no block covers, of ``least`` bases or more."""
    lengths = segments.select(F.col("name").alias("query"), "length")
    merged = union_spans(blocks.select("query", F.col("q_st").alias("st"), F.col("q_en").alias("en")), "query")
    return complement(merged, lengths, "query").where(F.col("en") - F.col("st") >= least)


def match_weights(blocks: DataFrame) -> DataFrame:
    """Query bases that each pair of segments shares, over all blocks."""
    return blocks.groupBy("query", "ref").agg(F.sum(F.greatest(F.lit(0), F.col("q_en") - F.col("q_st"))).alias("weight"))


def component_diff(contigs: DataFrame, member: DataFrame, shared: float = SHARED, present: float = PRESENT) -> DataFrame:
    """Per component of ``member`` ``(name, component)``: contigs, bases, covered bases and status; whether any contig is a ring by
    itself, where ``contigs`` tell (``circular``)."""
    ring = [F.coalesce(F.bool_or("circular"), F.lit(False)).alias("circular")] if "circular" in contigs.columns else []
    rows = contigs.join(member, "name").groupBy("component").agg(F.count("*").alias("contigs"), F.sum("length").alias("length"), F.sum("covered").alias("covered"), *ring)
    return rows.withColumn("status", status(F.coalesce(F.col("covered") / F.nullif("length", F.lit(0)), F.lit(0.0)), shared, present))


def score_side(segments: DataFrame, links: DataFrame, blocks: DataFrame, *, min_identity: float = 0.0, shared: float = SHARED, present: float = PRESENT) -> dict[str, DataFrame]:
    """What the blocks of one side's segments on the other side say: ``contigs`` (with ``circular``), ``components``, ``matches`` (bases by
    pair), ``uncovered`` spans and the ``summary``. Blocks below ``min_identity`` do not count."""
    if not 0 <= present < shared <= 1:
        raise ValueError(f"shares must fulfil 0 <= present < shared <= 1, got {present} and {shared}")
    scratch = Scratch(segments.sparkSession, "side")
    used = scratch.save(blocks.where(F.col("matches") >= min_identity * F.col("block_len")).select("query", "ord", "q_st", "q_en", "ref", "matches", "block_len"), "blocks")
    links = scratch.save(links, "links")
    ring = G.circular_segments(links).withColumn("circular", F.lit(True))
    contigs = contig_diff(segments, used, shared, present).join(ring, "name", "left").withColumn("circular", F.coalesce("circular", F.lit(False)))
    member = G.components(segments, links)
    return {"contigs": contigs, "components": component_diff(contigs, member, shared, present), "matches": match_weights(used), "uncovered": uncovered(segments, used), "summary": side_summary(contigs)}


def side_summary(contigs: DataFrame) -> DataFrame:
    """One row: shared and unique bases, contigs and bases by status."""
    kinds = ("shared", "partial", "missing")
    return contigs.agg(F.sum("covered").alias("shared_bases"), F.sum(F.col("length") - F.col("covered")).alias("unique_bases"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.coalesce(F.sum(F.when(F.col("status") == "missing", F.col("length"))), F.lit(0)).alias("missing_bases"))
