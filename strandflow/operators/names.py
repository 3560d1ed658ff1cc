"""Ids and names that stay unique while a graph is edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from strandflow.runtime import Scratch


def numbered(rows: DataFrame, *order: str, after: int = -1) -> DataFrame:
    """``rows`` with ``ord``: distinct, ascending in ``order``, above ``after``. They are written, as numbers that
    partitions give must not change; no task sees all rows."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return Scratch(rows.sparkSession, "numbered").save(ordered.withColumn("ord", F.monotonically_increasing_id() + F.lit(after + 1)), "rows")


def last_ord(*tables: DataFrame) -> int:
    """The largest ``ord`` of the tables, -1 where there is none."""
    return max(t.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] for t in tables)


def unique_names(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``(ord, name)`` for ``(ord, label)``: labels that are ``taken`` or come before in order of ``ord`` get _2, _3, ...,
    and so does a label made that way if it is taken too, until all names differ."""
    scratch = Scratch(rows.sparkSession, "names")
    left = rows.select("ord", "label")
    used = taken.select(F.col("name").alias("label")).distinct() if taken is not None else left.select("label").limit(0)
    rank = F.row_number().over(W.partitionBy("label").orderBy("ord"))
    done = None
    while True:
        tried = scratch.save(left.withColumn("k", rank).join(used.withColumn("hit", F.lit(1)), "label", "left").withColumn("hit", F.coalesce("hit", F.lit(0))), "tried")
        fine = (F.col("k") == 1) & (F.col("hit") == 0)
        free = tried.where(fine).select("ord", F.col("label").alias("name"))
        done = free if done is None else done.unionByName(free)
        left = tried.where(~fine).select("ord", F.concat("label", F.lit("_"), F.col("k") + F.col("hit")).alias("label"))
        if left.isEmpty():
            return done
        used = used.unionByName(free.select(F.col("name").alias("label")))
