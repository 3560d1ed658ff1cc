"""Half-open spans: union, complement and coverage.

Windows run over the spans of one key that start in one bin of ``WIDTH`` positions. What they need of the bins before comes from
one row for each bin, so that no task holds a whole reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandflow.runtime import Scratch

WIDTH = 1 << 20


def _bins(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.withColumn("bin", F.floor(F.col(at) / WIDTH))


def _with_bins(rows: DataFrame, key: str, value: Column, carried) -> DataFrame:
    """``rows``, which have a ``bin``, with ``carry``: ``carried`` (a function of a column and a window over bins) of ``value``, an
    aggregate of each bin of a key."""
    bins = rows.groupBy(key, "bin").agg(value.alias("own"))
    carry = bins.select(F.col(key).alias("of"), F.col("bin").alias("at"), carried("own", W.partitionBy(key).orderBy("bin")).alias("carry"))
    return rows.join(carry, rows[key].eqNullSafe(carry["of"]) & (rows["bin"] == carry["at"])).drop("of", "at")


_PAST = (W.unboundedPreceding, -1)


def earlier_end(rows: DataFrame, key: str, st: str, en: str, *ties: Column) -> DataFrame:
    """``rows`` with ``before``: the largest end of the key's rows before in order of start and ``ties``; null for the first."""
    binned = _with_bins(_bins(rows, key, st), key, F.max(en), lambda c, w: F.max(c).over(w.rowsBetween(*_PAST)))
    inside = W.partitionBy(key, "bin").orderBy(st, *ties).rowsBetween(*_PAST)
    return binned.withColumn("before", F.greatest("carry", F.max(en).over(inside))).drop("carry", "bin")


def running_sum(rows: DataFrame, key: str, st: str, value: Column, name: str, *ties: Column) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, in order of start and ``ties``."""
    binned = _with_bins(_bins(rows.withColumn(name, value), key, st), key, F.sum(name), lambda c, w: F.sum(c).over(w.rowsBetween(*_PAST)))
    inside = W.partitionBy(key, "bin").orderBy(st, *ties).rowsBetween(W.unboundedPreceding, 0)
    return binned.withColumn(name, F.coalesce("carry", F.lit(0)) + F.sum(name).over(inside)).drop("carry", "bin")


def next_row(rows: DataFrame, key: str, st: str, value: Column, name: str, *ties: Column) -> DataFrame:
    """``rows`` with ``value`` of the next row in order of start and ``ties``; null for the last."""
    order = F.struct(F.col(st), *[t.alias(f"t{k}") for k, t in enumerate(ties)])
    binned = _with_bins(_bins(rows.withColumn(name, value), key, st), key, F.min_by(name, order), lambda c, w: F.lead(c).over(w))
    return binned.withColumn(name, F.coalesce(F.lead(name).over(W.partitionBy(key, "bin").orderBy(st, *ties)), "carry")).drop("carry", "bin")


def beside(scratch: Scratch, rows: DataFrame, key: str, st: str, en: str, *ties: Column) -> DataFrame:
    """``rows`` with their ``place`` in order of start and ``ties``, from 0 on, the start of the next one, ``next_st``, and the end of the
    one before, ``last_en``. Rows go through one shuffle; keys of more than one bin tell by a row for each bin what lies between bins."""
    inside = W.partitionBy(key, "bin").orderBy(st, *ties)
    binned = scratch.save(_bins(rows, key, st).withColumns({"place": F.row_number().over(inside), "next_st": F.lead(st).over(inside), "last_en": F.lag(en).over(inside)}), "binned")
    edges = binned.where((F.col("place") == 1) | F.col("next_st").isNull())
    bins = edges.groupBy(key, "bin").agg(F.max("place").alias("n"), F.min(st).alias("first"), F.max(F.when(F.col("next_st").isNull(), F.col(en))).alias("last"))
    by = W.partitionBy(key).orderBy("bin")
    carry = bins.select(F.col(key).alias("of"), F.col("bin").alias("at"), F.sum("n").over(by.rowsBetween(*_PAST)).alias("past"), F.lead("first").over(by).alias("first"), F.lag("last").over(by).alias("last"))
    carry = scratch.save(carry.where("past is not null or first is not null"), "carry")
    joined = binned.join(carry, binned[key].eqNullSafe(carry["of"]) & (binned["bin"] == carry["at"]), "left")
    told = {"place": F.coalesce("past", F.lit(0)) + F.col("place") - 1, "next_st": F.coalesce("next_st", "first"), "last_en": F.coalesce("last_en", "last")}
    return joined.withColumns(told).drop("bin", "of", "at", "past", "first", "last")


def union_spans(spans: DataFrame, key: str = "ref") -> DataFrame:
    """``(key, st, en)`` merged per key; spans that touch merge, empty ones are dropped.

    After sorting by start, a span opens an island exactly if it starts after every earlier end. Equal starts are collapsed
    first, so copies weigh nothing and a bin has no more rows than positions.
    """
    rows = earlier_end(spans.where("en > st").groupBy(key, "st").agg(F.max("en").alias("en")), key, "st", "en")
    opens = F.when(F.col("before").isNull() | (F.col("st") > F.col("before")), 1).otherwise(0)
    island = running_sum(rows, key, "st", opens, "island")
    return island.groupBy(key, "island").agg(F.min("st").alias("st"), F.max("en").alias("en")).drop("island")


def complement(merged: DataFrame, lengths: DataFrame, key: str = "ref") -> DataFrame:
    """What ``merged`` leaves of [0, length) per key; keys without spans are left whole."""
    inside = merged.join(lengths, key).select(key, F.greatest("st", F.lit(0)).alias("st"), F.least("en", "length").alias("en")).where("en > st")
    gaps = earlier_end(inside, key, "st", "en").select(key, F.coalesce("before", F.lit(0)).alias("a"), F.col("st").alias("b"))
    ends = lengths.join(inside.groupBy(key).agg(F.max("en").alias("a")), key, "left").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.col("length").alias("b"))
    return gaps.unionByName(ends).where("b > a").select(key, F.col("a").cast("long").alias("st"), F.col("b").cast("long").alias("en"))


def covered(spans: DataFrame, key: str = "ref") -> DataFrame:
    """Covered bases per key."""
    return union_spans(spans, key).groupBy(key).agg(F.sum(F.col("en") - F.col("st")).alias("covered"), F.count("*").alias("islands"))


def covered_bases(spans: DataFrame, key: str = "ref") -> DataFrame:
    """``(key, covered)`` alone, of spans cut at the borders of bins: a bin counts what is new in it, and bins add up, so spans go through one
    shuffle."""
    rows = spans.where("en > st").select(key, "st", "en", F.explode(F.sequence(F.floor(F.col("st") / WIDTH), F.floor((F.col("en") - 1) / WIDTH))).alias("bin"))
    rows = rows.select(key, "bin", F.greatest("st", F.col("bin") * WIDTH).alias("st"), F.least("en", (F.col("bin") + 1) * WIDTH).alias("en"))
    before = F.max("en").over(W.partitionBy(key, "bin").orderBy("st", "en").rowsBetween(*_PAST))
    return rows.select(key, F.greatest(F.lit(0), F.col("en") - F.greatest("st", before)).alias("new")).groupBy(key).agg(F.sum("new").alias("covered"))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "ref", bin_size: int = 10_000) -> DataFrame:
    """Pairs of spans that overlap, by shared bins: each side is listed in the bins it touches, and a pair is
    kept in the first bin that both touch, so no pair comes twice and no range join is planned.

    ``left`` has ``(key, st, en, ...)``; ``right`` the same with ``r_`` before its columns but the key.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
    x, y = left.where("en > st").withColumn("bin", bins("st", "en")), right.where("r_en > r_st").withColumn("bin", bins("r_st", "r_en"))
    first = F.col("bin") == F.floor(F.greatest("st", "r_st") / bin_size)
    return x.join(y, [key, "bin"]).where((F.col("st") < F.col("r_en")) & (F.col("r_st") < F.col("en")) & first).drop("bin")
