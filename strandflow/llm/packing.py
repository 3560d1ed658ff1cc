"""Best-fit packing by the sum-of-squares rule.

A sequence holds ``capacity`` tokens. N(g) counts the open sequences with residual gap g; a piece goes
where the sum of N(g)^2 over all gaps becomes smallest, an existing sequence winning over a new one and
the tightest gap over a wider one.

Every task first packs the pieces of its own partition as they are tokenised and lets go of a sequence
only when it is exactly full and of at most ``FEW`` pieces: those waste nothing, and leave the small pieces,
which fill gaps, to the rest. The other pieces are dealt to tasks of ``tail`` pieces each and packed
there by the same rule, longest first; what then is not full with few pieces is taken apart and mended
by best fit, where that takes no more sequences. Nothing is collected; a task holds its waiting pieces,
or ``tail`` pieces.

Inputs: a null text is empty (it has the end token alone), null ids and repeated rows are packed like any
other row, an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandflow.runtime import Scratch

#: pieces of a sequence that is let go of at once
FEW = 2
PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class SumOfSquares:
    """Open sequences by residual gap, and the placing rule."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        # N(g) as a float; N(0) = -1/2 makes one formula hold for closing a sequence as well (see place)
        self.count = np.zeros(capacity + 1)
        self.count[0] = -0.5
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``size`` tokens, 1 to capacity.

        Moving a sequence from gap g to g - size changes the sum of squares by 2 (N(g-size) - N(g)) + 2,
        or by 1 - 2 N(g) if that closes it; a new sequence changes it by 2 N(capacity-size) + 1.
        """
        n, c = self.count, self.capacity
        change = n[: c - size] - n[size:c]
        change[n[size:c] == 0] = np.inf
        at = int(change.argmin()) if len(change) else 0
        fresh = n[c - size] - 0.5 if size < c else -0.5
        if len(change) and change[at] <= fresh:
            gap = at + size
            self.count[gap] -= 1
            sequence = self.open[gap].pop()
        else:
            gap, sequence = c, self.made
            self.made += 1
        if gap > size:
            self.count[gap - size] += 1
            self.open[gap - size].append(sequence)
        return sequence, c - gap


def mended(sizes: np.ndarray, sequence: np.ndarray, offset: np.ndarray, capacity: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """A packing of ``sizes``, longest first, with its sequences that are not exactly full, or of more than ``few``
    pieces, taken apart and packed by the tightest gap; as it was if that would take more sequences."""
    made = int(sequence.max()) + 1
    fill, pieces = np.bincount(sequence, sizes, made), np.bincount(sequence, minlength=made)
    loose = (fill < capacity) | (pieces > few)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    new_sequence, new_offset, fresh = sequence.copy(), offset.copy(), 0
    for k in np.flatnonzero(loose[sequence]).tolist():
        size = int(sizes[k])
        gap = size + int(some[size:].argmax())
        if some[gap]:
            at = open_[gap].pop()
            some[gap] = bool(open_[gap])
        else:
            gap, at, fresh = capacity, made + fresh, fresh + 1
        new_sequence[k], new_offset[k] = at, capacity - gap
        if gap > size:
            open_[gap - size].append(at)
            some[gap - size] = True
    return (new_sequence, new_offset) if fresh <= int(loose.sum()) else (sequence, offset)


#: The byte-level pre-tokenizer's pattern: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_names() -> dict[str, int]:
    """The byte behind each character that byte-level vocabularies spell bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merges_by_rank(spec: dict) -> bool:
    """Whether joining the neighbours whose union has the smallest id gives the ids that the merge list gives.

    That holds if ids grow along the list and every entry, spelled out and joined in this way, comes together from
    the very pair that the list names: what happens inside a stretch that no join has crossed yet is the same
    in any text, so the two ways then see the same pairs in the same order.
    """
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or not plain or spec.get("normalizer") or any(model.get(k) for k in odd):
        return False
    ids, names, last = model["vocab"], _byte_names(), -1
    if any(c not in ids for c in names):
        return False
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        parts = list(left + right)
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda k: ids.get(parts[k] + parts[k + 1], 1 << 60))
            if parts[at] + parts[at + 1] not in ids:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [left, right] or ids[left + right] <= last:
            return False
        last = ids[left + right]
    return len(ids) == len(names) + len(model["merges"])


@functools.cache
def ranked(path: str) -> bool:
    """:func:`merges_by_rank` of a file, found out once on the driver."""
    with open(path, encoding="utf-8") as f:
        return merges_by_rank(json.load(f))


class Tokens:
    """Token ids of whole texts: those of the ``tokenizers`` library for the file at ``path``.

    Where :func:`ranked` holds, texts are encoded from the same file's vocabulary by ``tiktoken``, which takes a
    sixth of the time and gives the same ids; texts with an added token's name go through the library.
    """

    def __init__(self, path: str, by_rank: bool):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.names = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if by_rank:
            names = _byte_names()
            ranks = {bytes(map(names.__getitem__, entry)): k for entry, k in self.whole.get_vocab(with_added_tokens=False).items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is None or any(name in text for name in self.names):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


_tokens: dict[str, Tokens] = {}


def tokens(path: str, by_rank: bool) -> Tokens:
    """One tokenizer in each Python worker."""
    if path not in _tokens:
        _tokens[path] = Tokens(path, by_rank)
    return _tokens[path]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _first(path: str, by_rank: bool, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path, by_rank).ids
        base, packer, waiting = TaskContext.get().partitionId() << 33, SumOfSquares(capacity), {}
        out, held = [], 0
        stop = int(end).to_bytes(4, "little")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + stop
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1
                    sequence, offset = packer.place(size)
                    waiting.setdefault(sequence, []).append((doc, piece, at, size, ids[4 * at : 4 * (at + size)], base + sequence, offset))
                    held += 4 * size
                    if offset + size == capacity:
                        rows = waiting.pop(sequence)
                        out += rows if len(rows) <= FEW else [(*row[:5], None, None) for row in rows]
                    at, piece = at + size, piece + 1
                if held > 1 << 24 and out:
                    yield _rows(out)
                    out, held = [], 0
        if out:
            yield _rows(out)
        rest = [(*row[:5], None, None) for rows in waiting.values() for row in rows]
        for k in range(0, len(rest), 10_000):
            yield _rows(rest[k : k + 10_000])

    return run


def _tail(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer = (1 << 62) + (TaskContext.get().partitionId() << 33), SumOfSquares(capacity)
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [], None) if (batches := list(batches)) and any(b.num_rows for b in batches) else None
        if table is None:
            return
        order = sorted(range(table.num_rows), key=list(zip((-table["length"].to_numpy()).tolist(), (x if x is not None else -1 << 63 for x in table["doc_id"].to_pylist()), table["piece"].to_pylist(), table["start"].to_pylist(), strict=True)).__getitem__)
        sizes = table["length"].to_numpy()
        sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for k in order:
            sequence[k], offset[k] = packer.place(int(sizes[k]))
        sequence[order], offset[order] = mended(sizes[order], sequence[order], offset[order], capacity)
        table = table.set_column(5, "sequence_id", pa.array(sequence + base)).set_column(6, "offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=4096)

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, tokenizer: str | None = None, capacity: int = 1024, end: int = 2, tail: int = 16_384) -> DataFrame:
    """One row per piece: its document, number, start and length in tokens, its ``ids`` (little-endian
    unsigned 32-bit, in a binary), and the sequence and the offset there.

    A document is its ids and then ``end``. One over ``capacity`` is cut into full pieces after a first,
    shorter one. ``tail`` bounds the pieces of a task of the second round.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    path = tokenizer or byte_bpe_path()
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = scratch.save(source.mapInArrow(_first(path, ranked(path), capacity, end), PIECES), "first")
    left = first.where("sequence_id is null")
    tasks = max(1, -(-left.count() // tail))
    return first.where("sequence_id is not null").unionByName(left.repartition(tasks).mapInArrow(_tail(capacity), PIECES))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens; ids appear as their crc32."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
