"""Embedding near-duplicates by Euclidean p-stable hashing, then exact cosines.

Unit vectors with cosine c lie sqrt(2 - 2 c) apart. Each of ``TABLES`` tables hashes a vector by ``HASHES``
quantised Gaussian projections, floor((a.v + b) / WIDTH); vectors of one label that agree in all of a
table's hashes share a bucket. At cosine 0.98 (0.2 apart) one hash agrees with probability 0.92, a table with
0.22 and some table with 0.999; at right angles a table agrees with 2e-6. Every pair of a bucket is then
compared by its cosine in double precision, in the first table where it meets and only there, so links are
counted once without listing pairs.

Equal vectors of a label collapse to one with a multiplicity before hashing. A bucket of more than
``BLOCK`` vectors is cut into blocks and each pair of blocks is one small product; what leaves a block is a
number for each vector and a spanning forest of its links.

A pair at cosine 0.98 meets in no table with probability 0.0008. With ``exact`` there is one table without projections, so all vectors of
a label and length share a bucket and every pair of them is compared, block by block; that is the work of a square and loses nothing.

Labels that are no integers are told apart by a 64-bit hash.

Inputs: vectors that are null, empty or zero, or hold null or non-finite components, rows with a null label
and rows with a null id link with nothing (a null id has a null component and is not kept); vectors of other
lengths never link; repeated rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandflow.llm._text import U64, lists, mix
from strandflow.operators.components import connected_components
from strandflow.runtime import Scratch

TABLES, HASHES, WIDTH, SEED, BLOCK = 28, 18, 2.0, 5, 512


def _hashed(tables: int, hashes: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = np.stack([flat[at[k] : at[k + 1]] for k in own])
                x /= np.abs(x).max(axis=1, keepdims=True)  # keeps the norm finite
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if size not in made:
                    rng = np.random.default_rng([seed, int(size)])
                    made[size] = rng.normal(size=(size, tables * hashes)), rng.uniform(0, width, tables * hashes)
                a, b = made[size]
                h = np.floor((x @ a + b) / width).astype(np.int64).astype(U64).reshape(len(x), tables, hashes)
                label = batch.column(1).to_numpy().astype(np.int64).astype(U64)[own]
                key = mix(label[:, None] + mix(np.arange(tables, dtype=U64) + U64(int(size) << 16))[None, :])
                for k in range(hashes):
                    key = mix(key + h[:, :, k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), batch.column(2).take(pa.array(own)), pa.array([r.tobytes() for r in x], pa.binary()), lists(key.view(np.int64).reshape(-1), [tables] * len(own))],
                    names=["node", "copies", "unit", "keys"],
                )

    return run


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between the rows of block i and of block j of a bucket."""
        i, j, t = (table[c][0].as_py() for c in ("i", "j", "t"))
        node, copies, block = (table[c].to_numpy() for c in ("node", "copies", "block"))
        unit = np.stack([np.frombuffer(u) for u in table["unit"].to_pylist()])
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)[:, :t]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
        a, b = left[a], right[b]
        some = a < b if i == j else np.ones(len(a), bool)
        a, b = a[some], b[some]
        fresh = np.ones(len(a), bool)
        for k in range(t):  # not met in an earlier table
            fresh &= keys[a, k] != keys[b, k]
        a, b = a[fresh], b[fresh]
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        root = list(range(len(node)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        forest = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[rx] = ry
                forest.append((x, y))
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate([node[some], node[[x for x, _ in forest]]]) if forest else node[some], pa.int64()), "b": pa.array([None] * len(some) + [int(node[y]) for _, y in forest], pa.int64()), "n": pa.array([int(x) for x in links[some]] + [0] * len(forest), pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id", *, threshold: float = 0.98, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = SEED, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    if exact:
        tables, hashes = 1, 0
    scratch = Scratch(vectors.sparkSession, "embedding")
    v = F.col("v")
    integral = dict(vectors.dtypes)[label] in ("tinyint", "smallint", "int", "bigint")
    own = F.col(label).cast("long") if integral else F.when(F.col(label).isNotNull(), F.xxhash64(label))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    fine = v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine).withColumn("key", F.xxhash64("label", "v")).withColumn("key2", F.hash("v", "label"))
    classes = rows.where("fine").groupBy("key", "key2", "label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = scratch.save(classes, "classes")
    hashed = scratch.save(classes.select("node", "label", "copies", "v").mapInArrow(_hashed(tables, hashes, width, seed), "node long, copies long, unit binary, keys array<long>"), "hashed")
    listed = hashed.select("node", F.posexplode("keys").alias("t", "bucket"))
    sizes = scratch.save(listed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = scratch.save(listed.join(sizes, "bucket").select("node", "t", "bucket", blocks.alias("blocks"), block.alias("block")), "met")
    other = met.join(hashed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("bucket", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "unit", "keys")
    found = scratch.save(pairs.groupBy("bucket", "i", "j").applyInArrow(_compare(threshold), "a long, b long, n long"), "found")
    component = connected_components(scratch, found.where("b is not null"))
    counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    per_class = scratch.save(classes.join(counted, "node", "left").join(component, "node", "left").select("key", "key2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "final")
    slim = rows.select("vec_id", F.when(F.col("fine"), F.col("key")).alias("key"), "key2")
    out = slim.join(per_class, ["key", "key2"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings of equal label, at cosine 0.98."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
SQL: dict[str, str] = {}
