"""Vector code compression: 8 codebooks of 16 integer entries, assigned behind segment-mean lower bounds.

A component x becomes the integer floor(4096 x); a vector is cut into ``parts`` equal parts and each part is replaced by the
index of the nearest entry of its position's codebook. Codebooks start as the parts of the smallest ids and are moved
``rounds`` times to the mean (rounded down) of what is nearest to them.

Nearest entries: a part and an entry are compared coarse to fine over 1, 2, 4 ... blocks of components. For a block of m components with
sums S and residual norms r (what is left after taking the mean away), its squared distance is at least (Sx - Sc)^2 / m +
(rx - rc)^2. Bounds are rounded down, so they never exceed the distance. The entry with the smallest first bound gets its
exact distance, entries whose bound is above the best one known leave before the next, finer level, and what survives gets exact
distances in 64-bit integers. Ties go to the lower index, as only larger bounds leave. The result is that of comparing all.

Each round is one narrow pass over the integer vectors, written once: a task sums the parts of each entry and gives a
row for each component of a codebook, which Spark adds up. Codebooks (parts x 16 x components) are all that reaches the driver or goes to
every task, so no label, vector or group of equal vectors is ever hot; label sums are added up in tasks first, too.

Inputs: rows whose vector is null or holds null or non-finite components are dropped; equal ids are ordered by their
vectors, null ids come last; a table of fewer than 16 vectors has as many entries; vectors of different lengths have
codebooks by length, and the digest covers their own; a vector that is empty, cannot be cut into equal parts or holds a component so large that
distances might leave 64 bits (beyond 2^15 at 64 components) is returned with a null code and error; a label without codes has
a null label error; repeated rows are vectors of their own; an empty table gives an empty result; other columns than those named do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandflow.runtime import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
FEW = 100_000  # labels that are sent to every task, about 3 MB

Books = dict[int, np.ndarray]  # by length: parts x entries x components


class Codebook:
    """The entries of one part position with what their bounds need."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.levels = [b for b in (1, 2, 4, 8, 16, 32) if width % b == 0 and b < width]
        self.segments = [_segments(entries, b) for b in self.levels]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry of each row, and how many exact distances that took."""
        n, k = len(x), len(self.entries)
        row = np.arange(n)
        exact = np.full((n, k), np.iinfo(np.int64).max)
        if self.levels:
            sums, rest = _segments(x, 1)
            bound = _bounds(sums[:, None], rest[:, None], self.segments[0][0][None], self.segments[0][1][None], x.shape[1])
            first = bound.argmin(axis=1)
            exact[row, first] = best = _distances(x, self.entries[first])
            bound[row, first] = np.inf
            r, e = np.nonzero(bound <= best[:, None])
            for blocks, (entry_sums, entry_rest) in zip(self.levels[1:], self.segments[1:], strict=True):
                sums, rest = _segments(x, blocks)
                near = _bounds(sums[r], rest[r], entry_sums[e], entry_rest[e], x.shape[1] // blocks) <= best[r]
                r, e = r[near], e[near]
        else:
            r, e = np.repeat(row, k), np.tile(np.arange(k), n)
        exact[r, e] = _distances(x[r], self.entries[e])
        at = exact.argmin(axis=1)
        return at, exact[row, at], len(r) + (n if self.levels else 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def _segments(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, residual norms) of the blocks of each row."""
    cut = x.reshape(len(x), blocks, -1)
    sums, m = cut.sum(axis=2), cut.shape[2]
    return sums, np.sqrt(((cut * cut).sum(axis=2) * m - sums * sums) / m)


def _bounds(sums: np.ndarray, rest: np.ndarray, entry_sums: np.ndarray, entry_rest: np.ndarray, m: int) -> np.ndarray:
    """What squared distances are at least, from blocks of m components; rounding is made up for by 1e-12 of each size."""
    apart = np.maximum(np.abs(rest - entry_rest) - (rest + entry_rest) * 1e-12, 0)
    return ((sums - entry_sums).astype(float) ** 2 / m + apart**2).sum(axis=-1) * (1 - 1e-12)


def _by_length(values: pa.ListArray, books: Books, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers as rows x parts x components) of the vectors of one length, some at a time."""
    sizes = np.diff(values.offsets.to_numpy())
    sizes[~values.is_valid().to_numpy(zero_copy_only=False)] = -1
    flat, begin = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    for size, book in books.items():
        own = np.flatnonzero(sizes == size)
        step = max(1, (1 << 22) // (size * book.shape[1]))  # bounds what is compared at once
        for k in range(0, len(own), step):
            rows = own[k : k + step]
            yield rows, flat[begin[rows][:, None] + np.arange(size)].astype(np.int64).reshape(len(rows), parts, -1)


def _sums(books: Books, parts: int):
    """A row for each component of each entry that has parts in a task; position -1 has their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = {size: [Codebook(b) for b in book] for size, book in books.items()}
        total = {size: np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64) for size, book in books.items()}
        for batch in batches:
            for _, x in _by_length(batch.column(0), books, parts):
                size = x.shape[1] * x.shape[2]
                for p, book in enumerate(coded[size]):
                    at = book.nearest(x[:, p])[0]
                    order = at.argsort(kind="stable")
                    begin = np.flatnonzero(np.diff(at[order], prepend=-1))
                    used = at[order[begin]]
                    total[size][p, used, 0] += np.diff(np.append(begin, len(at)))
                    total[size][p, used, 1:] += np.add.reduceat(x[order, p], begin)
        for size, t in total.items():
            p, e, k = (g.reshape(-1) for g in np.indices(t.shape))
            some = t[p, e, 0] > 0
            columns = [np.full(int(some.sum()), size), p[some], e[some], k[some] - 1, t.reshape(-1)[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["size", "part", "entry", "position", "total"])

    return run


def _moved(vectors: DataFrame, books: Books, parts: int) -> Books:
    """The codebooks after one round: means rounded down; entries without parts stay."""
    rows = vectors.select("q").mapInArrow(_sums(books, parts), "size long, part long, entry long, position long, total long")
    found = {(r["size"], r["part"], r["entry"], r["position"]): r["total"] for r in rows.groupBy("size", "part", "entry", "position").agg(F.sum("total").alias("total")).collect()}
    moved = {size: book.copy() for size, book in books.items()}
    for (size, part, entry, position), total in found.items():
        if position >= 0:
            moved[size][part, entry, position] = total // found[size, part, entry, -1]
    return moved


def _coded(books: Books, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = {size: [Codebook(b) for b in book] for size, book in books.items()}
        for batch in batches:
            code: list[str | None] = [None] * batch.num_rows
            error: list[int | None] = [None] * batch.num_rows
            for rows, x in _by_length(batch.column(2), books, parts):
                near = [book.nearest(x[:, p]) for p, book in enumerate(coded[x.shape[1] * x.shape[2]])]
                codes, errors = np.stack([a for a, _, _ in near], axis=1).tolist(), sum(d for _, d, _ in near).tolist()
                for k, c, d in zip(rows.tolist(), codes, errors, strict=True):
                    code[k], error[k] = "".join(f"{i:02x}" for i in c), d
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "size", "code", "error"])

    return run


def integers(vectors: DataFrame, embedding: str, label: str, vec_id: str, parts: int) -> DataFrame:
    """``vec_id, label, q, size`` of the rows with finite vectors; ``q`` (integers) is null where they cannot be coded."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    size, q = F.size("v"), F.transform("v", lambda x: F.floor(x * SCALE))
    # all of size * (2 x)^2 and width^2 * x^2 stay below 2^62
    wide = F.greatest(size, F.lit(1)).cast("double")
    limit = F.floor(F.sqrt(F.least(2.0**60 / wide, (2.0**60 * parts * parts) / (wide * wide))))
    fits = (size > 0) & (size % parts == 0) & (F.array_max("q") <= limit) & (F.array_min("q") >= -limit)
    return rows.where(finite).withColumn("q", q).select("vec_id", "label", F.when(fits, F.col("q").cast("array<int>")).alias("q"), size.alias("size"))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks over all of ``vectors`` (see :func:`integers`) by length: parts x entries x components."""
    books: Books = {}
    for r in vectors.where("q is not null").select("size").distinct().orderBy("size").collect():  # one row for each length of vectors
        first = vectors.where((F.col("size") == r["size"]) & F.col("q").isNotNull()).orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
        books[r["size"]] = np.array([x["q"] for x in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(vectors, books, parts)
    return books


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def _beside_sums(coded: DataFrame, sums: DataFrame, salts: int = 64) -> DataFrame:
    """``coded`` with its label's sum: few labels go to every task, more are met by label and salt, so no label is hot."""
    same: Column = coded["label"].eqNullSafe(sums["of"])
    if sums.count() <= FEW:
        return coded.join(F.broadcast(sums), same, "left")
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return coded.join(sums, same & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int") == sums["salt"]), "left")


def compress(vectors: DataFrame, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for every row with a finite vector."""
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = scratch.save(integers(vectors, embedding, label, vec_id, parts), "integers")
    books = fit(rows, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, size int, code string, error long"
    coded = scratch.save(rows.select("vec_id", "label", "q", "size").mapInArrow(_coded(books, parts), schema), "coded")
    sums = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "labels")
    named = F.lit(None).cast("string")
    for size, book in books.items():
        named = F.when((F.col("size") == size) & F.col("code").isNotNull(), F.lit(digest(book))).otherwise(named)
    return _beside_sums(coded, sums).select("vec_id", "label", "code", "error", "label_error", named.alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings with 8 codebooks of 16 entries after 6 rounds."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")).drop("label")


def _sql() -> str:
    """The rounds written out one after the other, each comparing every part with every entry."""
    steps = [
        """
kept as (
    select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, embedding from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
long as (select r, generate_subscripts(embedding, 1) - 1 as place, len(embedding) // 8 as width, floor(4096 * unnest(embedding)::double)::bigint as v from kept),
part as materialized (select r, place // width as p, place % width as i, v from long),
book0 as materialized (select p, r - 1 as e, i, v from part where r <= 16)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} as materialized (
    select r, p, min(struct_pack(d := d, e := e)) as best
    from (select x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v))::bigint as d from part x join book{k} c using (p, i) group by x.r, x.p, c.e) group by r, p)""")
        if k < ROUNDS:
            steps.append(f"""
book{k + 1} as materialized (
    select p, e, i, coalesce(m.v, b.v) as v
    from book{k} b left join (
        select x.p, n.best.e as e, x.i, floor(sum(x.v)::hugeint / count(*))::bigint as v from part x join near{k} n using (r, p) group by x.p, n.best.e, x.i) m using (p, e, i))""")
    return f"""
with {",".join(steps)},
coded as (
    select r, string_agg(lpad(printf('%x', best.e), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error from near{ROUNDS} group by r),
labelled as (select *, sum(error) over (partition by label)::bigint as label_error from kept join coded using (r))
select vec_id, code, error, label_error, (select sha256(string_agg(v::varchar, ',' order by p, e, i)) from book{ROUNDS}) as codebooks_sha256
from labelled
"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
SQL = {"op13_vector_codes": _sql()}
