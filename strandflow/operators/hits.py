"""Hits of searches and references as tables: one form for all sources, the best of each segment, and what a view draws of them.

Hits are ``(query, segment, strand, q_st, q_en, s_st, s_en, identity, length, score, evalue)`` with half-open spans that count from 0;
``s_st < s_en`` on either strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ("query", "segment", "strand", "q_st", "q_en", "s_st", "s_en", "identity", "length", "score", "evalue")


def tabular_hits(lines: DataFrame, *, min_length: int = 0, min_identity: float = 0.0) -> DataFrame:
    """Hits of tab-separated rows ``query segment percent length q_from q_to s_from s_to score evalue``, which count from 1 and
    tell the strand by the order of the segment's ends. Rows of fewer fields, or with fields that are no numbers, are left out."""
    value = F.col("value")
    f = F.split(F.when(value.contains("\r"), F.regexp_replace(value, r"\r$", "")).otherwise(value), "\t")
    number = lambda k, kind: F.get("f", F.lit(k)).try_cast(kind)
    # an explode of one array each: the conditions below would else be moved before the split, and split the line again for every field
    rows = lines.where(~value.startswith("#")).select(F.explode(F.array(f)).alias("f")).where(F.size("f") >= 10)
    a, b = F.col("a"), F.col("b")
    rows = rows.select(F.get("f", F.lit(0)).alias("query"), F.get("f", F.lit(1)).alias("segment"), number(2, "double").alias("percent"), number(3, "long").alias("length"), number(4, "long").alias("x"), number(5, "long").alias("q_en"), number(6, "long").alias("a"), number(7, "long").alias("b"), number(8, "double").alias("score"), number(9, "double").alias("evalue"))
    made = rows.dropna().select("query", "segment", F.when(b >= a, 1).otherwise(-1).alias("strand"), (F.col("x") - 1).alias("q_st"), "q_en", (F.least(a, b) - 1).alias("s_st"), F.greatest(a, b).alias("s_en"), (F.col("percent") / 100).alias("identity"), "length", "score", "evalue")
    return made.where((F.col("length") >= min_length) & (F.col("identity") >= min_identity))


def top(hits: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` hits of the highest score."""
    return hits.orderBy(F.col("score").desc(), "query", "segment", "s_st", "q_st").limit(n)


def best_of_segments(hits: DataFrame) -> DataFrame:
    """One hit for each segment: the highest score, then the highest identity, then what stands first in it."""
    rank = F.struct("score", "identity", -F.col("s_st"), -F.col("q_st"))
    return hits.groupBy("segment").agg(F.max_by(F.struct(*hits.columns), rank).alias("x")).select("x.*")


def best_references(blocks: DataFrame) -> DataFrame:
    """The most convincing block of each query: its length, half as much again if it is primary, times its identity; the first of equals."""
    identity = F.coalesce(F.nullif(F.col("matches") / F.nullif("block_len", F.lit(0)), F.lit(0.0)), F.lit(1.0))
    score = F.col("block_len") * F.when(F.col("is_primary"), 1.5).otherwise(1.0) * identity
    rows = blocks.withColumn("score", score)
    return rows.groupBy("query").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "query"]), F.struct("score", -F.col("ord"))).alias("x")).select("query", "x.*")


def extents(hits: DataFrame, key: str, end: str) -> DataFrame:
    """``(key, extent)``: how far each query or reference is known to go."""
    return hits.groupBy(key).agg(F.max(end).alias("extent")).where("extent > 0")


def reference_spans(blocks: DataFrame) -> DataFrame:
    """``(name, source, s, e, q_from, q_to)``: what share of a segment each block covers, and where on the reference it goes from and to."""
    back = F.col("strand") < 0
    at = lambda c: F.col(c) / F.nullif("r_len", F.lit(0))
    rows = blocks.where("q_len > 0 and q_en > q_st")
    return rows.select(F.col("query").alias("name"), F.col("ref").alias("source"), (F.col("q_st") / F.col("q_len")).alias("s"), (F.col("q_en") / F.col("q_len")).alias("e"), F.when(back, at("r_en")).otherwise(at("r_st")).alias("q_from"), F.when(back, at("r_st")).otherwise(at("r_en")).alias("q_to"))


def search_spans(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """The same of search hits, along the queries as far as any hit reaches in them."""
    sized = hits.join(segments.select(F.col("name").alias("segment"), F.col("length").alias("size")), "segment").where("size > 0 and s_en > s_st").join(extents(hits, "query", "q_en"), "query", "left")
    back = F.col("strand") < 0
    at = lambda c: F.col(c) / F.col("extent")
    return sized.select(F.col("segment").alias("name"), F.col("query").alias("source"), (F.col("s_st") / F.col("size")).alias("s"), (F.col("s_en") / F.col("size")).alias("e"), F.when(back, at("q_en")).otherwise(at("q_st")).alias("q_from"), F.when(back, at("q_st")).otherwise(at("q_en")).alias("q_to"))


def parts(spans: DataFrame, per_query: int = 100, room: Column | None = None) -> DataFrame:
    """Spans cut into parts ``(name, source, part, s, e, q)`` of one colour each: ``per_query`` to a whole query, at most ``room`` and one
    at least; ``q`` is where on the query a part begins. A span without such a place is one part with a null ``q``."""
    wide = F.ceil(F.lit(per_query) * F.abs(F.col("q_to") - F.col("q_from")))
    n = F.greatest(F.least(wide, room) if room is not None else wide, F.lit(1))
    rows = spans.withColumn("n", F.coalesce(n, F.lit(1)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    width, step = (F.col("e") - F.col("s")) / F.col("n"), (F.col("q_to") - F.col("q_from")) / F.col("n")
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("q_from") + step * F.col("part")))
    known = F.col("q_from").isNotNull() & F.col("q_to").isNotNull()
    return rows.select("name", "source", "part", (F.col("s") + width * F.col("part")).alias("s"), (F.col("s") + width * (F.col("part") + 1)).alias("e"), F.when(known, q).alias("q"))
