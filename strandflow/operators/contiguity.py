"""Length and depth statistics of segments ``(ord, name, sequence, length, depth)``.

Everything that ranks by length works on the counts by distinct length: what is sorted in one place is
bounded by the number of distinct lengths, not of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandflow.functions.sequence import gc_content, half_up, n_count
from strandflow.runtime import Scratch


def by_length(segments: DataFrame, length: str = "length") -> DataFrame:
    return segments.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n"))


def ranked(counts: DataFrame) -> DataFrame:
    """Counts with the number and the bases before and up to each length, longest first, and the total."""
    longest = W.orderBy(F.col("length").desc())
    so_far = longest.rowsBetween(W.unboundedPreceding, 0)
    bases = F.col("length") * F.col("n")
    return counts.select("length", "n", F.sum("n").over(so_far).alias("k"), F.sum(bases).over(so_far).alias("cum"), F.sum(bases).over(W.partitionBy()).alias("total"), F.sum("n").over(W.partitionBy()).alias("all_n"))


def _reach(target: Column) -> Column:
    return F.min(F.when(F.col("cum") >= target, F.struct("k", "length", "n", "cum")))


def nx_lx(reached: Column, target: Column) -> tuple[Column, Column]:
    """(Nx, Lx) of what ``_reach`` found: 0 and 0 where the target is out of reach."""
    inside = F.ceil((target - (reached["cum"] - reached["length"] * reached["n"])) / reached["length"])
    rank = reached["k"] - reached["n"] + F.greatest(inside, F.lit(1))
    return F.coalesce(reached["length"], F.lit(0)).cast("long"), F.coalesce(rank, F.lit(0)).cast("long")


def nx(segments: DataFrame, fractions: list[float], total: int | None = None) -> DataFrame:
    """Rows ``(fraction, nx, lx)``: the first length, longest first, at which ``fraction`` of ``total`` is covered."""
    rows = ranked(by_length(segments))
    whole = F.lit(float(total)) if total is not None else F.col("total").cast("double")
    goals = F.transform(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: F.struct(f.alias("fraction"), (f * whole).alias("goal")))
    first = F.col("k") == F.col("n")  # the longest length; it also takes goals of nothing
    here = F.filter(goals, lambda g: (g["goal"] <= F.col("cum")) & (first | (g["goal"] > F.col("cum") - F.col("length") * F.col("n"))))
    found = rows.select("length", "n", "k", "cum", F.explode(here).alias("g"))
    n, rank = nx_lx(F.struct("k", "length", "n", "cum"), F.col("g.goal"))
    reached = found.select(F.col("g.fraction").alias("fraction"), n.alias("nx"), rank.alias("lx"))
    asked = segments.sparkSession.createDataFrame([(float(f),) for f in dict.fromkeys(fractions)], "fraction double")
    return asked.join(F.broadcast(reached), "fraction", "left").select("fraction", F.coalesce("nx", F.lit(0)).alias("nx"), F.coalesce("lx", F.lit(0)).alias("lx"))


def contiguity(segments: DataFrame, genome_size: int | None = None) -> DataFrame:
    """One row: counts, lengths, N50 and N75 with their ranks, auN, quartiles; NG values with a genome size."""
    rows = ranked(by_length(segments))
    total = F.col("total").cast("double")
    goals = {"50": total * 0.5, "75": total * 0.75}
    if genome_size:
        goals |= {"g50": F.lit(genome_size * 0.5), "g75": F.lit(genome_size * 0.75)}
    squares = F.sum(F.col("length").cast("double") * F.col("length") * F.col("n"))
    agg = rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("contigs"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.max("length").alias("largest"), F.min("length").alias("smallest"),
        squares.alias("squares"), *[F.expr(f"percentile(length, {p}, n)").alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], *[_reach(g).alias(f"r{k}") for k, g in goals.items()],
    )
    out = [F.col("contigs"), F.col("total"), F.col("largest"), F.col("smallest"), (F.col("total") / F.nullif(F.col("contigs"), F.lit(0))).alias("mean"), (F.col("squares") / F.nullif(total, F.lit(0.0))).alias("aun")]
    out += [half_up(F.col("p25")).cast("long").alias("q1"), F.floor("p50").cast("long").alias("median"), half_up(F.col("p75")).cast("long").alias("q3")]
    for k, g in goals.items():
        n, rank = nx_lx(F.col(f"r{k}"), g)
        out += [n.alias(f"n{k}"), rank.alias(f"l{k}")]
    return agg.select(*out)


def size_buckets(segments: DataFrame, floors: tuple[int, ...] = (0, 1000, 10_000, 50_000)) -> DataFrame:
    """Number and bases of segments of at least each floor."""
    each = F.array(*[F.struct(F.lit(x).cast("long").alias("floor")) for x in floors])
    wide = by_length(segments).agg(*[F.coalesce(F.sum(F.when(F.col("length") >= x, F.col(c))), F.lit(0)).alias(f"{c}_{x}") for x in floors for c in ("n",)], *[F.coalesce(F.sum(F.when(F.col("length") >= x, F.col("length") * F.col("n"))), F.lit(0)).alias(f"b_{x}") for x in floors])
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("floor"), F.col(f"n_{x}").alias("n"), F.col(f"b_{x}").alias("bases")) for x in floors])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def size_counts(segments: DataFrame, floors: tuple[int, ...] = (1000, 10_000, 50_000)) -> DataFrame:
    """One row: number (``n_1000``, ...) and bases (``bases_1000``, ...) of segments of at least each floor."""
    many = {f"n_{x}": F.sum(F.when(F.col("length") >= x, F.col("n"))) for x in floors} | {f"bases_{x}": F.sum(F.when(F.col("length") >= x, F.col("length") * F.col("n"))) for x in floors}
    return by_length(segments).agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in many.items()])


def nx_curve(segments: DataFrame, steps: int = 100) -> DataFrame:
    """Nx for x = 1 .. ``steps`` per cent."""
    return nx(segments, [x / 100 for x in range(1, steps + 1)]).select(F.round(F.col("fraction") * 100).cast("int").alias("x"), "nx")


def cumulative(segments: DataFrame, points: int = 2000) -> DataFrame:
    """Running bases by rank, longest first; beyond ``points`` ranks every (n // points + 1)-th and the last."""
    rows = ranked(by_length(segments))
    stride = F.when(F.col("all_n") > points, F.floor(F.col("all_n") / points) + 1).otherwise(1)
    first = F.col("k") - F.col("n") + 1
    # within one length only the ranks on the stride, so that no length lists all its segments
    start = first + F.pmod(1 - first, stride)
    ranks = F.when(start <= F.col("k"), F.sequence(start, F.col("k"), stride)).otherwise(F.array().cast("array<bigint>"))
    last = F.when((F.col("k") == F.col("all_n")) & (F.pmod(F.col("k") - 1, stride) != 0), F.array("k")).otherwise(F.array().cast("array<bigint>"))
    out = rows.withColumn("rank", F.explode(F.concat(ranks, last)))
    return out.select("rank", (F.col("cum") - (F.col("k") - F.col("rank")) * F.col("length")).alias("bases"))


def length_bins(segments: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of segments over ``bins`` equal steps of log10 length; empty bins count 0."""
    counts = by_length(segments).where("length > 0")
    ends = counts.agg(F.log10(F.min("length")).alias("lo"), F.log10(F.max("length")).alias("hi"))
    at = F.least(F.floor((F.log10("length") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    binned = counts.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    return segments.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(binned), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_median(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """One row ``(median)``: the smallest value up to which half of all weight is reached. Values are dealt out by range; the ranges' sums, a
    row each, tell which of them holds the cut, and only that one is sorted."""
    scratch = Scratch(rows.sparkSession, "median")
    summed = rows.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    dealt = scratch.save(summed.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "ranges")
    upto = F.sum("own").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    sums = dealt.groupBy("range").agg(F.sum("w").alias("own")).select("range", (upto - F.col("own")).alias("before"), upto.alias("upto"), F.sum("own").over(W.partitionBy()).alias("total"))
    cut = sums.where((F.col("before") < F.col("total") / 2) & (F.col("upto") >= F.col("total") / 2))
    inside = F.sum("w").over(W.partitionBy("range").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(F.broadcast(cut), "range").withColumn("cum", F.col("before") + inside).where(F.col("cum") >= F.col("total") / 2).agg(F.min("v").alias("median"))


def depth_summary(segments: DataFrame) -> DataFrame:
    """Unweighted mean, coefficient of variation and the length-weighted median of known depths."""
    median = weighted_median(segments.where("depth is not null and length > 0"), "depth", "length").withColumnRenamed("median", "median_depth")
    plain = segments.agg(F.avg("depth").alias("mean_depth"), F.when((F.count("depth") > 1) & (F.avg("depth") > 0), F.stddev_samp("depth") / F.avg("depth")).alias("depth_cv"))
    return plain.crossJoin(F.broadcast(median))


def composition(segments: DataFrame) -> DataFrame:
    """Length-weighted GC per cent and Ns per 100 kb over segments with a sequence."""
    own = segments.where("sequence is not null and sequence != ''")
    size = F.nullif(F.sum("length"), F.lit(0))
    return own.agg(F.coalesce(100 * F.sum(gc_content("sequence") * F.col("length")) / size, F.lit(0.0)).alias("gc"), F.coalesce(F.sum(n_count("sequence")) * 100_000.0 / size, F.lit(0.0)).alias("n_per_100kb"))


def compare(assemblies: dict[str, DataFrame]) -> DataFrame:
    """Statistics as rows, assemblies as columns; a row without any value is left out."""
    long = None
    for name, segments in assemblies.items():
        one = contiguity(segments)
        rows = one.select(F.lit(name).alias("assembly"), F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.col(c).cast("double") for c in one.columns]))).alias("metric", "value"))
        long = rows if long is None else long.unionByName(rows)
    return long.where("value is not null").groupBy("metric").pivot("assembly", list(assemblies)).agg(F.first("value"))
