"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of ``documents`` and drop others.

Every stage takes a null text as one without words and an empty table as such, takes very long texts whole and gives
the same rows in every run; equal rows share a fate but where a stage keeps one of them or takes a part of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandflow.llm import mixing, ngram_join, packing, quality_classifier, substring_dedup
from strandflow.runtime import Scratch

FEW = 1_000_000  # ids, 24 MB
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _beside(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ids by ``how``: ids of ``FEW`` rows or less go to all tasks, or else texts are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", how).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of good quality is below one half; null and empty texts are scored as such."""
    scratch = Scratch(spark, "stage-quality")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    pooled = quality_classifier.features(docs.select(*COLUMNS, F.col("text").alias("pooled")), quality_classifier.word_vectors(docs), "pooled")
    table = scratch.save(pooled, "features")
    network = quality_classifier.fit(table.select("doc_id", "features"), labels)
    return quality_classifier.scored(table, network).where("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component; rows without an id or without words stay.

    Documents link from a Jaccard similarity of 0.8 of their 5-word shingles on; ``op3`` has limits of its own. Rows
    that share an id are one document: of those with one text the first in the order of the columns stays.
    """
    scratch = Scratch(spark, "stage-near")
    found = ngram_join.jaccard_components(docs.select("doc_id", "text"), n=5, threshold=80)
    gone = scratch.save(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    kept = _beside(docs.select(*COLUMNS), gone, "left_anti")
    several = scratch.save(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    one = _beside(kept, several, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return _beside(kept, several, "left_anti").unionByName(one.select("row.*"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a document of which nothing is left goes. Texts that were empty stay."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    kept = cut.where(F.col("removed").isNull() | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return kept.withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix takes them; those that it does not take go, and so do sources without words."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("times > 0")
    return mixed.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        before = docs
    return docs


#: A fitted network and a tokenizer are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None
