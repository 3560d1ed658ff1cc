"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Sources in code point order (null last) take ``weights`` in turn and share the words of all documents by
weight. A source is clamped at ``max_epochs`` times its own size and what it cannot take is shared again
by weight among the others, until none is above its clamp. In closed form: sources sorted by clamp over
weight are clamped in that order while the level (words left / weight left) exceeds their ratio.

Whole repetitions: each document is taken floor(target / size of its source) times. The fractional one
goes to documents in the order of a seeded hash until the source's target is met; the cut lies where the
running size comes closest. Running sizes are formed over ``BINS`` hash ranges of each source, and by rows
only inside the one range that holds the cut, so that no task sees a whole source.

Inputs: a null text has no words; a null source is a source of its own, null ids are hashed as such, equal
rows share one fate apart from the range of the cut, where (hash, id, size) decide and ties go by place; a
source without words takes none; very long texts are counted whole; an empty table gives an empty result. All other
columns are kept, whatever their names. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from strandflow.llm._text import WORD
from strandflow.runtime import Scratch

BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``(source, source_size)`` to the same with ``weight`` and ``target``. One row per source; the
    windows below run over that small table alone."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = ratio.rowsBetween(W.unboundedPreceding, -1), ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    filled = weighed.withColumn("cap", F.col("source_size") * max_epochs).withColumn("level", level).withColumn("k", F.row_number().over(ratio))
    # the first source that its level does not lift over its clamp sets the level of all that follow
    held = F.col("cap") < F.col("weight") * F.col("level")
    open_from = F.min(F.when(~held, F.col("k"))).over(everything)
    shared = F.min(F.when(F.col("k") == open_from, F.col("level"))).over(everything)
    target = F.when(open_from.isNull() | (F.col("k") < open_from), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * shared, F.col("cap").cast("double")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", *, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """All of ``docs`` with ``size``, ``source_size``, ``target`` (words) and ``times``, the whole number
    of repetitions that the mix takes of each row. Columns of these names are replaced."""
    scratch = Scratch(docs.sparkSession, "mixing")
    base = docs.drop("size", "source_size", "target", "times")
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    # docs' own columns travel as one, so that their names meet none of these; (none, name) are null-safe keys
    own = base.select(
        F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        place.alias("place"), F.col(doc_id).alias("id"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
    )
    own = scratch.save(own.withColumn("bin", F.shiftright("place", 36)), "sized")
    key = ["none", "name"]
    bins = scratch.save(own.groupBy(*key, "bin").agg(F.sum("size").alias("n")), "bins")
    sizes = bins.groupBy(*key).agg(F.sum("n").alias("source_size")).select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, max_epochs).select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    epochs = F.col("target") / F.expr("nullif(source_size, 0)")
    targets = targets.withColumn("whole", F.coalesce(F.floor(epochs), F.lit(0)).cast("long"))
    targets = scratch.save(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    up_to = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    cut = bins.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).join(targets, key)
    cut = cut.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n")))
    cut = cut.groupBy(*key).agg(F.min(F.struct("bin", "before")).alias("cut"))
    plan = targets.join(cut, key, "left").select(*key, "source_size", "target", "whole", "rest", F.coalesce("cut.bin", F.lit(-1)).alias("cut_bin"), F.coalesce("cut.before", F.lit(0)).alias("cut_before"))
    rows = own.join(scratch.save(plan, "plan"), key)
    sure = rows.where("bin != cut_bin").withColumn("extra", (F.col("bin") < F.col("cut_bin")).cast("long"))
    inside = W.partitionBy(*key).orderBy("place", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    near = rows.where("bin = cut_bin").withColumn("upto", F.col("cut_before") + F.sum("size").over(inside))
    near = near.withColumn("extra", (F.abs(F.col("upto") - F.col("rest")) <= F.abs(F.col("upto") - F.col("size") - F.col("rest"))).cast("long")).drop("upto")
    both = sure.unionByName(near)
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in base.columns], "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("times"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; ``taken`` is the size of a document times its repetitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs.drop("lang"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


QUERIES = {"op4_mixing": op4_mixing}
SQL = {
    "op4_mixing": """
with own as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
           ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint as place
    from documents),
sizes as (select source, sum(size)::bigint as source_size from own group by source),
weighed as (
    select source, source_size, source_size * 3 as cap,
           [5.0, 2.0, 1.0][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::double as weight
    from sizes),
levels as (
    select *, row_number() over r as k,
           ((sum(source_size) over ()) - coalesce(sum(cap) over (r rows between unbounded preceding and 1 preceding), 0))::double
           / sum(weight) over (r rows between current row and unbounded following) as level
    from weighed window r as (order by cap / weight, source asc nulls last)),
shared as (select min(k) as open_from, min_by(level, k) as level from levels where not cap < weight * level),
targets as (
    select source, source_size,
           case when s.open_from is null or k < s.open_from then cap::double else least(weight * s.level, cap::double) end as target
    from levels, shared s),
parts as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from targets),
plan as (select *, target - whole * source_size as rest from parts),
running as (
    select o.doc_id, o.size, p.source_size, p.target, p.whole, p.rest,
           sum(o.size) over (partition by o.source order by o.place, o.doc_id, o.size rows unbounded preceding) as upto
    from own o join plan p on o.source is not distinct from p.source)
select doc_id, size, source_size, target,
       size * (whole + case when upto - size < rest and abs(upto - rest) <= abs(upto - size - rest) then 1 else 0 end)::bigint as taken
from running
""",
}
