"""Connected components of an undirected edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandflow.runtime import Scratch


def _flat(scratch: Scratch, parent: DataFrame) -> DataFrame:
    """Pointer doubling, two jumps a round: replace each parent by its own parent until every node points at a root."""
    above = lambda df, a, b: df.select(F.col("node").alias(a), F.col("parent").alias(b))
    while True:
        once = parent.join(above(parent, "parent", "second"), "parent")
        twice = once.join(above(parent, "second", "third"), "second")
        step, moving = scratch.save_counting(twice.select("node", F.col("third").alias("parent"), (F.col("third") != F.col("second")).alias("moved")), "jump", F.col("moved"))
        scratch.drop(parent)
        parent = step.select("node", "parent")
        parent._scratch_path = step._scratch_path
        if not moving:
            return parent


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; ``component`` is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, flattens the resulting trees by pointer
    doubling and contracts the edge list to distinct root pairs. A hub costs one row per map task (its
    neighbours are pre-aggregated) and the joins are between written tables, so that adaptive execution
    can split a skewed root. Null ends and self-loops link nothing. Ids are long.
    """
    left, right = F.col(a).cast("long"), F.col(b).cast("long")
    some = F.lit(True)
    edges, n = scratch.save_counting(edges.where(left != right).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct(), "edges", some)
    total = None
    while total is None or n:
        near = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).groupBy("a").agg(F.min("b").alias("m"))
        parent = _flat(scratch, scratch.save(near.select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "hook"))
        if total is None:
            total, keep = parent, True
        else:
            moved = total.join(parent.select(F.col("node").alias("parent"), F.col("parent").alias("above")), "parent", "left")
            new = scratch.save(moved.select("node", F.coalesce("above", "parent").alias("parent")), "total")
            scratch.drop(total)
            total, keep = new, False
        first = edges.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("ra")), "a")
        both = first.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("rb")), "b").where("ra != rb")
        left_over, n = scratch.save_counting(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges", some)
        scratch.drop(edges, None if keep else parent)
        edges = left_over
    scratch.drop(edges)
    return total.select("node", F.col("parent").alias("component"))
