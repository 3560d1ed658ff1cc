"""Substring dedup by hashing lines, and pieces inside them.

Shared passages begin and end inside lines, so lines are cut where the text itself says: of every ``WINDOW``
neighbouring words of a line, after the one with the smallest hash. No stretch of ``WINDOW`` words is without a
cut, and inside a shared passage the cuts fall at the same places in every copy. A unit is what lies between two
cuts, known by a digest of it and of ``CONTEXT`` words on either side of it (as far as the line goes), so that few
words that many texts use prove nothing; its span takes the context in. A line of fewer than ``SHORT`` words is
not parted from the lines beside it. Of a passage inside a line no more than 11 words at either end count in no
unit, and no more than WINDOW - 1 lie outside the spans, so a passage of over 50 words is always found.

Words are in lower case, without ASCII punctuation. Digests are grouped globally: a unit is a repeat if a smaller document id has it, or the same document
earlier. A maximal run of neighbouring repeats goes if it has ``min_words`` words or more in all, so that
chance repeats stay. Spans are code point offsets into the original text; where two passages overlap, so may they.

A task sorts the digests of its texts and sends each bucket of the digest space one compressed row; of a digest that
it has more than ``OFTEN`` times, the earliest document goes there and the others wait for what the bucket says. A
bucket's task names the repeats of its digests. So a digest takes a few bytes and is sent once, and a hot one comes a
bounded number of times from each task. Where the units are stays with the document, which meets its repeats again.

Inputs: null and empty texts have no units; rows without an id are left alone; equal rows count as one document,
so a repeated row gets the same spans; rows that share an id and not a text are documents of their own, ranked by
a hash of their texts; very long texts are taken whole; an empty table gives an empty result. ``remove_repeats``
keeps all columns, whatever their names, but for ``removed``, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandflow.llm._blocks import bucket_count, bucket_number, pack, runs, unpack
from strandflow.llm._text import mix
from strandflow.runtime import Scratch

MIN_WORDS = 25
WINDOW = 6  # neighbouring words of which one ends a unit
CONTEXT = 6  # words on either side of a unit that its digest covers too
FLUSH = 1 << 21  # digests that a task gathers before it sends them
OFTEN = 32
SHORT = 3  # words below which a line is not parted from the lines beside it
U64 = np.uint64
_LINE = re.compile(r"[^\n]+")
_SPACED = re.compile(r"\S+")
_PUNCTUATION = b"\"'`.,;:!?()[]{}<>*#$%&|-_"


class _Hashes(dict):
    """The hash of a word's normal form, 0 for punctuation alone; a bounded memo."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        w = word.lower().encode().translate(None, _PUNCTUATION)
        self[word] = h = xxhash.xxh3_64_intdigest(w) if w else 0
        return h


_hash = _Hashes()
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            power = lambda x: np.concatenate([np.ones(1, U64), np.full(2 * n, x, U64)]).cumprod(dtype=U64)
            self.up, self.down = power(_BASE), power(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, block) of each word; lines make blocks, short ones together with those beside them."""
    hashes, sizes, starts, ends, block, short = [], [], [], [], [], []
    for m in _LINE.finditer(text):
        line = m[0].split()
        own = [*map(_hash.__getitem__, line)]
        n = len(own) - own.count(0)
        if not n:
            continue
        if " ".join(line) == m[0]:
            size = np.fromiter(map(len, line), np.int64, len(line))
            stop = (size + 1).cumsum() - 1 + m.start()
            starts.append(stop - size)
            ends.append(stop)
        else:
            spans = np.array([w.span() for w in _SPACED.finditer(m[0])], np.int64) + m.start()
            starts.append(spans[:, 0])
            ends.append(spans[:, 1])
        hashes += own
        sizes.append(len(own))
        short.append(n < SHORT)
    if not sizes:
        return np.empty(0, U64), *[np.empty(0, np.int64)] * 3
    short = np.array(short)
    block = np.concatenate([np.zeros(1, np.int64), (~(short[1:] | short[:-1])).cumsum()])
    h = np.array(hashes, U64)
    some = h != 0
    return h[some], np.concatenate(starts)[some], np.concatenate(ends)[some], np.repeat(block, sizes)[some]


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests, starts, ends, counted words, and which unit of the text has the digest first."""
    h, starts, ends, block = _words(text)
    n = len(h)
    if not n:
        return np.empty(0, U64), *[np.empty(0, np.int64)] * 4
    is_cut = np.append(block[1:] != block[:-1], True)
    closing = np.flatnonzero(is_cut)
    if n >= WINDOW:
        at = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1) + np.arange(n - WINDOW + 1)
        is_cut[at[block[: n - WINDOW + 1] == block[WINDOW - 1 :]]] = True
    stop = np.flatnonzero(is_cut) + 1
    start = np.append(0, stop[:-1])
    close = closing[block[start]] + 1
    begin = np.append(0, closing[:-1] + 1)[block[start]]
    a, b = np.maximum(start - CONTEXT, begin), np.minimum(stop + CONTEXT, close)
    up, down = _powers.to(n)
    sums = np.append(U64(0), (h * up).cumsum(dtype=U64))
    place = ((start - a) << 42) + ((stop - start) << 21) + (b - stop)  # units of a short line may cover the same words
    digest = mix((sums[b] - sums[a]) * down[a] + mix(place.astype(U64)))
    _, first, which = np.unique(digest, return_index=True, return_inverse=True)
    return digest, starts[a], ends[b - 1], stop - start, first[which]


CUT = "doc_id long, key long, place binary, digest long, unit int, bucket int, data binary"
_ENTRY = np.dtype([("doc_id", "<i8"), ("key", "<i8")])


def _row(**columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    size = len(next(iter(columns.values())))
    fields = [x.split() for x in CUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(size, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def _place(start: np.ndarray, stop: np.ndarray, words: np.ndarray, first: np.ndarray) -> bytes:
    """Where the units are: small numbers, their bytes by weight."""
    own = np.arange(len(first))
    columns = np.stack([np.diff(start, prepend=0), stop - start, words, own - first]).astype("<i4")
    return zstandard.compress(columns.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _placed(place: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(place), np.uint8)
    gap, length, words, back = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(4, -1).astype(np.int64)
    start = gap.cumsum()
    return start, start + length, words, np.arange(len(back)) - back


class _Gathered:
    """The digests of a task's texts until they are sent."""

    def __init__(self, buckets: int, often: int):
        self.buckets, self.often = buckets, often
        self.clear()

    def clear(self) -> None:
        self.entries, self.digests, self.units, self.size = [], [], [], 0

    def add(self, doc_id: int, key: int, digest: np.ndarray, first: np.ndarray) -> None:
        own = np.flatnonzero(first == np.arange(len(first)))
        self.entries.append((doc_id, key))
        self.digests.append(digest[own])
        self.units.append(own)
        self.size += len(own)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """By bucket, and of frequent digests all but the earliest document's."""
        if not self.size:
            return
        entries, sizes = np.array(self.entries, _ENTRY), [len(x) for x in self.digests]
        digests, unit = np.concatenate(self.digests), np.concatenate(self.units)
        self.clear()
        owner = np.repeat(np.arange(len(entries)), sizes)
        rank = np.empty(len(entries), np.int64)
        rank[np.lexsort((entries["key"], entries["doc_id"]))] = np.arange(len(entries))
        number, low = bucket_number(digests, self.buckets), digests & U64(0xFFFFFFFF)
        order = np.lexsort((rank[owner], low, number))
        number, low, owner, unit, digests = number[order], low[order], owner[order], unit[order], digests[order]
        begin = runs(digests)
        times = np.diff(np.append(begin, len(number)))
        often = np.repeat(times > self.often, times)
        waits = often.copy()
        waits[begin] = False
        own = entries[owner[waits]]
        for k in range(0, len(own), 100_000):
            part = slice(k, k + 100_000)
            yield _row(doc_id=own["doc_id"][part], key=own["key"][part], digest=digests[waits][part].view(np.int64), unit=unit[waits][part])
        buckets, data = pack(number[~waits], [low[~waits], unit[~waits], often[~waits]], owner[~waits], entries)
        for k in range(0, len(data), 64):
            yield _row(bucket=buckets[k : k + 64], data=data[k : k + 64])


def _cut(buckets: int, often: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(buckets, often)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                places = []
                for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    digest, start, stop, words, first = units(text.as_py())
                    places.append(_place(start, stop, words, first))
                    gathered.add(doc_id, key, digest, first)
                    if gathered.size >= FLUSH:
                        yield from gathered.rows()
                yield _row(doc_id=batch.column(0), key=batch.column(1), place=places)
        yield from gathered.rows()

    return run


HITS = "doc_id long, key long, unit int, kept_in long, digest long"


def _repeats(table: pa.Table) -> pa.Table:
    """Of a bucket's digests the units of all but the earliest document; of frequent ones that document as well,
    with ``digest`` and no unit, for those that wait."""
    number, low, unit, often, entry = (np.concatenate(x) for x in zip(*(unpack(d, 3, _ENTRY) for d in table["data"].to_pylist()), strict=True))
    digests = number << U64(32) | low  # all 64 bits
    order = np.lexsort((entry["key"], entry["doc_id"], digests))
    digests, unit, often, entry = digests[order], unit[order], often[order], entry[order]
    begin = runs(digests)
    times = np.diff(np.append(begin, len(digests)))
    least = np.repeat(entry[begin], times)
    later = (entry["doc_id"] > least["doc_id"]) | (entry["key"] > least["key"])
    awaited = np.maximum.reduceat(often, begin) > 0
    told = entry[begin][awaited]
    digest = digests[begin][awaited].view(np.int64)
    none, repeats = pa.nulls(len(told), pa.int32()), int(later.sum())
    return pa.table(
        {
            "doc_id": np.concatenate([entry["doc_id"][later], told["doc_id"]]), "key": np.concatenate([entry["key"][later], told["key"]]),
            "unit": pa.chunked_array([pa.array(unit[later].astype(np.int32)), none]),
            "kept_in": np.concatenate([least["doc_id"][later], told["doc_id"]]), "digest": pa.chunked_array([pa.nulls(repeats, pa.int64()), pa.array(digest)]),
        }
    )


SPANS = "doc_id long, key long, start long, stop long, n_units long, n_words long, kept_in long"


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Maximal runs of neighbouring repeats, of ``min_words`` words or more."""
        for batch in batches:
            rows = []
            for doc_id, key, place, hits in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                start, stop, words, first = _placed(place)
                kept = np.full(len(first), doc_id, np.int64)
                repeat = first < np.arange(len(first))
                if hits.is_valid:
                    unit, kept_in = (hits.values.field(k).to_numpy() for k in (0, 1))
                    hit = np.zeros(len(first), bool)
                    hit[unit], kept[unit] = True, kept_in
                    repeat |= hit[first]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], repeat.astype(np.int8), [0]])))
                for a, b in edges.reshape(-1, 2).tolist():
                    n = int(words[a:b].sum())
                    if n >= min_words:
                        rows.append((doc_id, key, int(start[a]), int(stop[b - 1]), b - a, n, int(kept[first[a]])))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SPANS.split(", ")])

    return run


def _spans(docs: DataFrame, text: str, doc_id: str, min_words: int, often: int = OFTEN) -> DataFrame:
    """The removed spans by ``doc_id`` and ``key``, the hash of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    buckets = bucket_count(source)
    made = scratch.save(source.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_cut(buckets, often), CUT), "units")
    found = scratch.save(made.where("bucket is not null").select("bucket", "data").groupBy("bucket").applyInArrow(_repeats, HITS), "repeats")
    # frequent digests: an earlier document has them, or the same one did not wait
    first = scratch.save(found.where("digest is not null").select("digest", F.col("kept_in").alias("first"), F.col("key").alias("first_key")), "frequent")
    waiting = made.where("digest is not null").select("doc_id", "key", "unit", "digest").join(first, "digest")
    waiting = waiting.where("first < doc_id or first_key < key").select("doc_id", "key", "unit", F.col("first").alias("kept_in"))
    hits = found.where("unit is not null").select("doc_id", "key", "unit", "kept_in").unionByName(waiting)
    hits = hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("unit", "kept_in")).alias("hits"))
    placed = made.where("place is not null").select("doc_id", "key", "place").join(hits, ["doc_id", "key"], "left")
    spans = placed.select("doc_id", "key", "place", "hits").mapInArrow(_runs(min_words), SPANS)
    return spans.dropDuplicates(["doc_id", "key", "start"])


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed span: ``doc_id, start, stop, n_units, n_words, kept_in``.

    ``kept_in`` is the smallest id that has the span's first unit (the document's own for an own repeat).
    """
    return _spans(docs, text, doc_id, min_words).drop("key")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``, and ``removed``: the spans' original offsets."""
    spans = _spans(docs, text, doc_id, min_words)
    per_doc = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    kept = [c for c in docs.columns if c.lower() != "removed"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("key"))
    joined = own.join(per_doc, ["doc_id", "key"], "left")
    # what stands between the spans: from the end of one to the start of the next
    whole = F.col(f"row.`{text}`")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda s: s["stop"]))
    stops = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length(whole).cast("long")))
    left = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(whole, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    cut = F.when(F.col("removed").isNull(), whole).otherwise(F.array_join(left, ""))
    return joined.select(*[cut.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept], "removed")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span that line hashing removes from all documents, by document and original offset."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL: dict[str, str] = {}
