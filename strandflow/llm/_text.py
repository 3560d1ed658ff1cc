"""Small helpers that the text operators share: words, hashing and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

#: A word: a run of characters that are not ASCII white space. bytes.split() cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_C1, _C2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * _C1
    x = (x ^ (x >> U64(27))) * _C2
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hash of each word; a memo of bounded size (clearing it changes no result)."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def chosen(column: str = "doc_id"):
    """Rows that may teach: crc32 of the id as text, modulo 3, is not 1. Null ids never teach."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list], dict]], added: T.StructType) -> DataFrame:
    """``df`` and the columns in ``added``, computed from whole texts batch by batch.

    ``make()`` runs once in each task and returns a function from a list of UTF-8 texts (bytes or None)
    to Arrow arrays or lists by name. All columns of ``df`` pass through; one of an added name is replaced.
    """
    names = [f.name for f in added]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    spare = "utf8_" + "_" * max(map(len, df.columns), default=0)  # longer than any of df's names
    body = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(spare))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [to_arrow_schema(added).field(n).type for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                made = fn(batch.column(batch.num_columns - 1).to_pylist())
                arrays = [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], k) for n, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*kept, *names])

    return body.mapInArrow(run, schema)


def lists(values: np.ndarray, lengths: list[int], kind=None) -> pa.Array:
    """An Arrow list array of ``values`` cut into runs of ``lengths``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
