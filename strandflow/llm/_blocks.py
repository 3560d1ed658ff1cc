"""Blocks of hashes for a shuffle: many hashes of one task and one bucket as one compressed value."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from strandflow.llm._text import U64

BUCKET = 16 << 20  # bytes of text whose hashes meet in one bucket, about


def bucket_count(texts: DataFrame, text: str = "text") -> int:
    """How many buckets the hashes of all texts take: one for each partition of a shuffle, and as many more as bound what one
    holds, whatever that setting is."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def bucket_number(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A number for each 64-bit hash: its bucket above 32 other bits of it."""
    return (((hashes & U64(0xFFFFFFFF)) * U64(buckets) >> U64(32)) << U64(32)) + (hashes >> U64(32))


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)


def pack(number: np.ndarray, columns: list[np.ndarray], owner: np.ndarray, entries: np.ndarray) -> tuple[list[int], list[bytes]]:
    """(buckets, blocks) of ascending numbers, of unsigned columns below 2^32 and of the entries that own them."""
    home, packer = (number >> U64(32)).astype(np.int32), zstandard.ZstdCompressor(level=1)
    cuts = runs(home).tolist()
    data = []
    for a, b in zip(cuts, [*cuts[1:], len(home)], strict=True):
        used, place = np.unique(owner[a:b], return_inverse=True)
        steps = np.diff(number[a:b] & U64(0xFFFFFFFF), prepend=U64(0))
        # the bytes of a column by their weight: the high ones are alike
        raw = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (steps, place, *(c[a:b] for c in columns))]
        data.append(np.array([b - a, len(used)], "<i4").tobytes() + packer.compress(b"".join([*raw, entries[used].tobytes()])))
    return home[cuts].tolist(), data


def unpack(data: bytes, columns: int, kind: np.dtype) -> tuple[np.ndarray, ...]:
    """(number within the bucket, columns..., entry) of a block."""
    n, m = np.frombuffer(data, "<i4", 2).tolist()
    raw = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=4 * n * (columns + 2) + m * kind.itemsize)
    steps, place, *rest = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4 * n * k).reshape(4, n).T).view("<u4")[:, 0] for k in range(columns + 2))
    entries = np.frombuffer(raw, kind, m, 4 * n * (columns + 2))
    return steps.cumsum(dtype=U64), *rest, entries[place]
