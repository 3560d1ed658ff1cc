"""Writing the text formats: tables become lines, in order. Formatting stays in the JVM but for floats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from strandflow.functions.sequence import _c


@F.pandas_udf(StringType())
def short_float(x: pd.Series) -> pd.Series:
    """Six significant digits without trailing zeros."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.6g}")


def wrapped(seq: Column | str, width: int = 60) -> Column:
    """The sequence in lines of ``width``; 0 leaves one line."""
    return _c(seq) if not width else F.regexp_replace(F.regexp_replace(_c(seq), f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta_text(records: DataFrame, width: int = 60) -> DataFrame:
    """``(ord, value)``: one value per record, header and body."""
    return records.select("ord", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.coalesce("sequence", F.lit("")), width)).alias("value"))


def _other_tags(segments: DataFrame) -> list[Column]:
    """Tags beyond length and depth, by name, where the segments carry them."""
    if "tags" not in segments.columns:
        return []
    rest = F.filter(F.array_sort(F.map_entries("tags")), lambda e: ~e["key"].isin("LN", "ln", "dp", "DP"))
    return [F.array_join(F.transform(rest, lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])), "\t").alias("t")]


def gfa_text(segments: DataFrame, links: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``(rank, ord, value)`` of a GFA1 file: H, S, L and P lines."""
    spark = segments.sparkSession
    head = spark.createDataFrame([(0, 0, "H\tVN:Z:1.0")], "rank int, ord long, value string")
    has = F.col("sequence") != ""
    stated = F.when(~F.coalesce(has, F.lit(False)) & (F.col("length") > 0), F.concat(F.lit("LN:i:"), "length"))
    depth = F.when(F.col("depth").isNotNull(), F.concat(F.lit("dp:f:"), short_float("depth")))
    s = segments.select(F.lit(1).alias("rank"), "ord", F.concat_ws("\t", F.lit("S"), "name", F.when(has, F.col("sequence")).otherwise("*"), stated, depth, *_other_tags(segments)).alias("value"))
    overlap = F.when(F.col("overlap") > 0, F.concat(F.col("overlap").cast("string"), F.lit("M"))).otherwise("*")
    if "cigar" in links.columns:  # as it was read; a link that has none by now has the overlap
        overlap = F.coalesce(F.when(F.col("cigar") != "*", F.col("cigar")), overlap)
    ln = links.select(F.lit(2).alias("rank"), "ord", F.concat_ws("\t", F.lit("L"), "from_name", "from_orient", "to_name", "to_orient", overlap).alias("value"))
    out = head.unionByName(s).unionByName(ln)
    if steps is not None:
        glue = F.when(F.col("gap_after"), ";").otherwise(",")
        ordered = F.array_sort(F.collect_list(F.struct("pos", F.concat("name", "orient").alias("t"), glue.alias("g"))))
        text = F.array_join(F.transform(ordered, lambda x, i: F.when(i == F.size(ordered) - 1, x["t"]).otherwise(F.concat(x["t"], x["g"]))), "")
        p = steps.groupBy("path").agg(text.alias("t"), F.min("pos").alias("m")).select(F.lit(3).alias("rank"), F.xxhash64("path").alias("ord"), F.concat_ws("\t", F.lit("P"), "path", "t", F.lit("*")).alias("value"))
        out = out.unionByName(p)
    return out


def agp_text(rows: DataFrame, comments: tuple[str, ...] = ()) -> DataFrame:
    """``(object, part, value)`` of an AGP 2.1 file, from the rows of ``operators.scaffold.agp``; its version and ``comments`` come first."""
    c = lambda n: F.col(n).cast("string")
    piece = F.concat_ws("\t", "object", c("beg"), c("end"), c("part"), F.lit("W"), "component", c("c_beg"), c("c_end"), "orient")
    gap = F.concat_ws("\t", "object", c("beg"), c("end"), c("part"), "kind", c("gap"), F.lit("scaffold"), F.lit("yes"), "evidence")
    head = ["##agp-version\t2.1", *(f"# {c}" for c in comments)]
    top = rows.sparkSession.createDataFrame([("", k, x) for k, x in enumerate(head)], "object string, part long, value string")
    return top.unionByName(rows.select("object", "part", F.when(F.col("kind") == "W", piece).otherwise(gap).alias("value")))


def write_lines(df: DataFrame, path: str, *order: str, mode: str = "errorifexists") -> None:
    """Write ``value`` in ``order``: range-partitioned and sorted, so the part files concatenate in order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode(mode).text(path)


def comparison_files(segments: DataFrame, contigs: DataFrame, uncovered: DataFrame, components: DataFrame, folder: str, label: str, least: int = 1000, mode: str = "errorifexists") -> None:
    """One side of a comparison below ``folder``: missing contigs and uncovered stretches of ``least`` bases as FASTA,
    contigs and components as tab-separated tables."""
    missing = segments.join(contigs.where("status = 'missing'").select("name"), "name", "left_semi").where("sequence != ''")
    write_lines(fasta_text(missing), f"{folder}/{label}.only-contigs.fasta", "ord", mode=mode)
    spans = uncovered.where(F.col("en") - F.col("st") >= least).withColumnRenamed("query", "name").join(segments.select("name", "sequence", "ord"), "name").where("sequence != ''")
    size = F.col("en") - F.col("st")
    cut = spans.select("ord", "st", F.concat("name", F.lit(":"), F.col("st") + 1, F.lit("-"), F.col("en"), F.lit(" len="), size).alias("name"), F.col("sequence").substr((F.col("st") + 1).cast("int"), size.cast("int")).alias("sequence"))
    text = cut.select("ord", "st", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped("sequence")).alias("value"))
    write_lines(text, f"{folder}/{label}.only-regions.fasta", "ord", "st", mode=mode)
    for name, table in (("contigs", contigs), ("components", components)):
        table.write.mode(mode).option("header", True).option("sep", "\t").csv(f"{folder}/{label}.{name}.tsv")
