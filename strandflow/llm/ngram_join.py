"""N-gram Jaccard self-join of whole texts by prefix trees.

A text is the set of its distinct word n-grams, as 64-bit hashes; the numeric order of the hashes is the
global order. Texts link when ``100 * |A and B| >= threshold * |A or B|``.

Who meets: sets at the threshold differ in at most d n-grams, so of d + s ranges of the global order at least
s hold the same n-grams in both. A set is listed under a signature of each of its non-empty ranges; if e ranges
are empty, it shares s - e signatures or more with all that it links with (if that is less than one, the empty
ranges are listed too). The number of ranges depends on the smaller set's size class; a set near a class border is
listed for both. No link is lost, and a set that shares fewer signatures of a class with others is left alone:
so go texts that merely have a common passage. s grows with d, by ``MARGIN``.

Signatures travel as blocks: a task sorts those of its texts, keeps the first of equal ones and sends each
bucket of the signature space one compressed row, with its sets' fingerprints once; what it had several times is
shared already. A bucket's task finds those that two sets have. So a signature takes a few bytes and is sent
once, and a hot one comes at most once from each task.

How they are compared: each set of a signature meets the one among them that has most of its signatures shared
(an original rather than a copy with edits). For each such probe the others form a prefix tree (blocks of
``BLOCK`` sets): runs of n-grams that several sets share from their start are counted against the probe once and
the partial overlap is handed down; a subtree is left as soon as the n-grams that remain cannot lift any of its
sets to the threshold. Links make components. Signatures whose sets are still in several components, and in
enough of which a set is, join sets to clusters. A cluster's sets are dealt to blocks by component, small
components together, and every pair of blocks but those within one component is compared by the same tree, all
sets of a block probing at once, and gives a spanning forest of its links. Pairs of documents are never listed,
and a group of copies that all link costs one comparison each.

Before n-grams travel, sketches do, a thirtieth of their size: which of some bits the n-grams hit an odd number of
times. Two sets differ in as many n-grams as their sketches in bits, or more, so sets whose sketches are too far
apart do not link; blocks send only the sets that have a sketch near one of the other block's.

Copies collapse to one set in each task and again before anything is compared, and joins are between written
tables, so adaptive execution can split hot keys. Only ids, hashes and signatures move. A bitmap of at most 16 MB
over hashed ids narrows down the second scan of the texts, which makes the n-grams of documents that met another;
what it wrongly admits only costs its row, and a full one admits all.

Inputs: texts with fewer than ``n`` words are one n-gram of all their words; null texts and texts without
words have empty sets and link with nothing; a null id links with nothing and has a null component; rows
that share an id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from strandflow.llm._blocks import bucket_count, bucket_number, pack, runs, unpack
from strandflow.llm._text import U64, WordHashes, mix
from strandflow.operators.components import connected_components
from strandflow.runtime import Scratch

BLOCK = 256  # sets that are compared at once
SKETCHES = 8 * BLOCK  # sets whose sketches are
SPARE, MARGIN = 3, 10  # alike ranges of linked sets: SPARE and one more for each MARGIN n-grams that may differ
FLUSH = 1 << 21  # signatures that a task gathers before it sends them
BITS = 1 << 27

_CLASS = [1]
while _CLASS[-1] < 1 << 40:
    _CLASS.append(_CLASS[-1] * 3 // 2 + 1)

_hashes = WordHashes(200_000)


def ngram_set(text: bytes | None, n: int = 3) -> np.ndarray:
    """The text's distinct n-grams in global order. Only A-Z are lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, U64)
    h = _hashes.of(words)
    if len(h) < n:
        n = len(h)
    gram = mix(h[: len(h) - n + 1] + U64(n))
    for k in range(1, n):
        gram = mix(gram * U64(3) + h[k : len(h) - n + 1 + k])
    return np.unique(gram)


def fingerprint(grams: np.ndarray) -> int:
    return int(mix(np.array([mix(grams ^ U64(0xA5A5A5A5)).sum(dtype=U64) + U64(len(grams))], U64)).view(np.int64)[0])


class Ranges:
    """Signatures of the ranges of the global order, for one threshold in hundredths."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        self._cuts: dict[int, np.ndarray] = {}

    def number(self, size_class: int) -> tuple[int, int]:
        """(ranges, how many of them are alike in any linked pair whose smaller set is of this class)."""
        top = _CLASS[size_class + 1] - 1
        differ = (top + top * 100 // self.threshold) * (100 - self.threshold) // (100 + self.threshold)
        spare = SPARE + differ // MARGIN if differ else 1
        return differ + spare, spare

    def signatures(self, grams: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(class, need, signatures) for each class that the set is listed for. With any set that it links with
        it shares ``need`` signatures or more of one of the classes."""
        n = len(grams)
        if not n:
            return []
        own, low = bisect_right(_CLASS, n) - 1, bisect_right(_CLASS, -(-n * self.threshold // 100)) - 1
        sums = np.concatenate([np.zeros(1, U64), mix(grams ^ U64(0x5BD1E995)).cumsum(dtype=U64)])
        out = []
        for c in range(low, own + 1):
            k, spare = self.number(c)
            if c not in self._cuts:
                self._cuts[c] = np.array([(j << 64) // k for j in range(1, k)], U64)
            at = np.concatenate([[0], np.searchsorted(grams, self._cuts[c]), [n]])
            count = np.diff(at)
            sig = mix(mix(sums[at[1:]] - sums[at[:-1]]) + mix(np.arange(k, dtype=U64) + U64(c << 48)) + count.astype(U64))
            need = spare - int((count == 0).sum())
            out.append((c, need, sig[count > 0]) if need > 0 else (c, 1, sig))
        return out


DESCRIBED = "doc_id long, n long, fp long, sig long, class int, need int, listed int, bucket int, data binary"
LEFT = "sig long, fp long, class int, need int, listed int"
_ENTRY = np.dtype([("fp", "<i8"), ("class", "<i4"), ("need", "<i4"), ("listed", "<i4")])


def _described(**columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    size = len(next(iter(columns.values())))
    fields = [x.split() for x in DESCRIBED.split(", ")]
    arrays = [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(size, kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


class _Gathered:
    """The signatures of a task's sets until they are sent."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.seen, self.entries, self.sigs, self.size = set(), [], [], 0

    def add(self, fp: int, listed: list[tuple[int, int, np.ndarray]]) -> None:
        if fp in self.seen:  # a copy
            return
        self.seen.add(fp)
        for c, need, sig in listed:
            self.entries.append((fp, c, need, len(sig)))
            self.sigs.append(sig)
            self.size += len(sig)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Signatures that several sets have but for one of them, then the others by bucket."""
        if not self.size:
            return
        entries = np.array(self.entries, _ENTRY)
        sigs, owner = np.concatenate(self.sigs), np.repeat(np.arange(len(entries), dtype=np.int32), [len(x) for x in self.sigs])
        self.clear()
        number = bucket_number(sigs, self.buckets)
        order = number.argsort(kind="stable")
        number, owner = number[order], owner[order]
        begin = runs(number)
        first = np.zeros(len(number), bool)
        first[begin] = True
        several = np.diff(np.append(begin, len(number))) > 1
        again, own = number[~first].view(np.int64), entries[owner[~first]]
        for k in range(0, len(again), 100_000):
            part = slice(k, k + 100_000)
            yield _described(sig=again[part], fp=own["fp"][part], need=own["need"][part], listed=own["listed"][part], **{"class": own["class"][part]})
        buckets, data = pack(number[begin], [several], owner[begin], entries)
        for k in range(0, len(data), 64):
            yield _described(bucket=buckets[k : k + 64], data=data[k : k + 64])


def _describe(n: int, threshold: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, gathered = Ranges(threshold), _Gathered(buckets)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, fps = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    grams = ngram_set(text.as_py(), n)
                    sizes.append(len(grams))
                    fps.append(fingerprint(grams))
                    if doc is not None:
                        gathered.add(fps[-1], ranges.signatures(grams))
                    if gathered.size >= FLUSH:
                        yield from gathered.rows()
                yield _described(doc_id=batch.column(0), n=sizes, fp=fps)
        yield from gathered.rows()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's signatures those that two sets have, with all its sets."""
    number, several, entry = (np.concatenate(x) for x in zip(*(unpack(x, 1, _ENTRY) for x in table["data"].to_pylist()), strict=True))
    order = np.lexsort((entry["fp"], number))
    number, several, entry = number[order], several[order], entry[order]
    other = np.append(True, number[1:] != number[:-1])
    one = other | np.append(True, entry["fp"][1:] != entry["fp"][:-1])
    begin = np.flatnonzero(other)
    known = (np.add.reduceat(one.astype(np.int64), begin) > 1) | (np.maximum.reduceat(several, begin) > 0)
    keep = one & np.repeat(known, np.diff(np.append(begin, len(number))))
    sig = number[keep].view(np.int64) + (table["bucket"][0].as_py() << 32)
    return pa.table({"sig": sig, **{name: entry[name][keep] for name in ("fp", "class", "need", "listed")}})


def _bitmap(df: DataFrame, h) -> dict[int, bytes]:
    """Which of the hash values 0 to ``BITS`` - 1 the rows have: pages of 32768 bits, at most 16 MB for any input."""
    pages = df.select(F.shiftright(h, 15).alias("page"), (h % 32768).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return {r["page"]: bytes(r["bits"]) for r in pages.collect()}


def _unfolded(pages: dict[int, bytes]) -> np.ndarray:
    bits = np.zeros(BITS // 8, np.uint8)
    for page, x in pages.items():
        bits[page * 4096 : (page + 1) * 4096] = np.frombuffer(x, np.uint8)
    return bits


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h >> 3] >> (h & 7) & 1).astype(bool)


def sketch(grams: np.ndarray) -> bytes:
    """The parity of the number of n-grams at each of 2 to 4 bits for an n-gram, 64 or more."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((mix(grams ^ U64(0x3C6EF372)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near(sketches: list[bytes], sizes: np.ndarray, others: list[bytes], other_sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may link, judged by sizes and sketches; linked pairs are among them."""
    sides = []
    for given in (sketches, others):
        by_width: dict[int, list[int]] = {}
        for k, x in enumerate(given):
            by_width.setdefault(len(x) // 8, []).append(k)
        sides.append({w: (np.array(at), np.frombuffer(b"".join(given[k] for k in at), U64).reshape(len(at), w)) for w, at in by_width.items()})
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for v, (i, x) in sides[0].items():
        for w, (j, y) in sides[1].items():
            small, large = sizes[i], other_sizes[j]
            if 100 * min(small.max(), large.max()) < threshold * max(small.min(), large.min()):
                continue
            a, b = _folded(x, min(v, w)), _folded(y, min(v, w))
            step = max(1, (1 << 20) // b.size)
            for k in range(0, len(a), step):
                far = np.bitwise_count(a[k : k + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                both, apart = small[k : k + step, None] + large[None, :], np.abs(small[k : k + step, None] - large[None, :])
                p, q = np.nonzero(np.maximum(far, apart) * (100 + threshold) <= both * (100 - threshold))
                left.append(i[k : k + step][p])
                right.append(j[q])
    return np.concatenate(left), np.concatenate(right)


def _sets(n: int, pages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unfolded(pages.value)
        for whole in batches:
            at = np.flatnonzero(_in(bits, whole.column(0).to_numpy()))
            for k in range(0, len(at), 1000):
                sets = [ngram_set(t, n) for t in whole.column(1).take(pa.array(at[k : k + 1000])).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["fp", "size", "sketch", "grams"],
                )

    return run


def tree_join(probes: list[np.ndarray], sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """(probe, set) positions of all that link; n-grams are in global order. With ``probes is sets`` the pairs of
    a set with itself are left out or not, as it happens.

    The prefix tree over ``sets`` is their sorted list with the lengths of common prefixes of neighbours: a node
    is a run of rows that agree up to a depth. Going down, the n-grams of a node are counted once against all
    probes and their partial overlaps are handed to the children; a subtree is left when for no probe the
    n-grams that remain can lift any of its sets to the threshold.
    """
    if not probes or not sets:
        return []
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    rows = [sets[k] for k in order]
    size = np.array([len(r) for r in rows])
    common = np.zeros(max(0, len(rows) - 1), np.int64)
    for k in range(len(common)):
        m = min(size[k], size[k + 1])
        apart = np.flatnonzero(rows[k][:m] != rows[k + 1][:m])
        common[k] = apart[0] if len(apart) else m
    if probes is sets:  # only n-grams of two sets can add to an overlap
        grams, times = np.unique(np.concatenate(rows), return_counts=True)
        grams = grams[times > 1]
    else:
        grams = np.intersect1d(np.concatenate(probes), np.concatenate(rows))
    held = np.zeros((len(grams) + 1, len(probes)), np.uint8)  # by n-gram, the probes that have it
    for k, p in enumerate(probes):
        held[np.searchsorted(grams, p[np.isin(p, grams, assume_unique=True)]), k] = 1
    at = []
    for r in rows:
        place = np.minimum(np.searchsorted(grams, r), max(0, len(grams) - 1))
        at.append(np.where(grams[place] == r, place, len(grams)) if len(grams) else np.zeros(len(r), np.int64))
    lengths = np.array([len(p) for p in probes])
    least = lambda s: -(-threshold * (s + lengths) // (100 + threshold))
    found, stack = [], [(0, len(rows), 0, np.zeros(len(probes), np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        end = int(common[lo : hi - 1].min()) if hi - lo > 1 else int(size[lo])
        if end > depth:
            overlap = overlap + held[at[lo][depth:end]].sum(axis=0, dtype=np.int64)
        left = int(size[lo:hi].max()) - end
        if end:
            left = np.minimum(left, [len(p) - int(np.searchsorted(p, rows[lo][end - 1], "right")) for p in probes]) if len(probes) < 8 else left
        if (overlap + left < least(int(size[lo:hi].min()))).all():
            continue
        if hi - lo == 1:
            found += [(int(k), order[lo]) for k in np.flatnonzero(overlap >= least(int(size[lo])))]
            continue
        begin = lo
        for split in [*(np.flatnonzero(common[lo : hi - 1] == end) + lo + 1).tolist(), hi]:
            stack.append((begin, split, end, overlap))
            begin = split
    return found


def _star(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of one probe with a block of others."""
        probe, others, names = [], [], []
        for a, b, grams in zip(table["a"].to_pylist(), table["b"].to_pylist(), table["grams"].to_pylist(), strict=True):
            if b == a:
                probe = [np.frombuffer(grams, U64)]
            else:
                others.append(np.frombuffer(grams, U64))
                names.append(b)
        hits = tree_join(probe, others, threshold)
        a = table["a"][0].as_py()
        return pa.table({"a": pa.array([a] * len(hits), pa.int64()), "b": pa.array([names[k] for _, k in hits], pa.int64())})

    return run


def _forest(pairs: list[tuple[int, int]], left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, as fingerprints."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    forest = []
    for a, b in pairs:
        x, y = find(left[a]), find(right[b])
        if x != y:
            root[x] = y
            forest.append((left[a], right[b]))
    return forest


def _may_link(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
            keep = [len(near([x[k]], m[k : k + 1], [y[k]], n[k : k + 1], threshold)[0]) > 0 for k in range(len(x))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(scratch: Scratch, pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) that link; a is the probe of its blocks of b."""
    known = sets.select("fp", "size", "sketch")
    met = pairs.join(known.select(F.col("fp").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x")), "a")
    met = met.join(known.select(F.col("fp").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y")), "b")
    pairs = scratch.save(met.select("a", "b", "m", "n", "x", "y").mapInArrow(_may_link(threshold), "a long, b long"), "near")
    per_probe = scratch.save(pairs.groupBy("a").agg(F.count("*").alias("m")), "probes")
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BLOCK)).cast("int").alias("block")
    blocks = scratch.save(pairs.join(per_probe, "a").select("a", "b", block), "blocks")
    probes = blocks.select("a", "block").distinct().select("a", F.col("a").alias("b"), "block")
    grams = sets.select(F.col("fp").alias("b"), "grams")
    sides = [x.join(grams, "b").select("a", "block", "b", "grams") for x in (blocks, scratch.save(probes, "probe_blocks"))]
    links = scratch.save(sides[0].unionByName(sides[1]).groupBy("a", "block").applyInArrow(_star(threshold), "a long, b long"), "links")
    scratch.drop(pairs, per_probe, blocks)
    return links


_PAIR = "cluster long, i long, j long, sub_i int, sub_j int, right boolean, fp long"


def _close(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """Of two blocks of sketches, or of one with itself, the sets near one of the other's, by ``BLOCK`` sets."""
        right, fp = table["right"].to_numpy(), table["fp"].to_numpy()
        sketches, sizes = table["sketch"].to_pylist(), table["size"].to_numpy()
        order = np.argsort(fp, kind="stable")
        p, q = order[~right[order]], order[right[order]]
        itself = table["i"][0].as_py() == table["j"][0].as_py()
        q = p if itself else q
        x, y = near([sketches[k] for k in p], sizes[p], [sketches[k] for k in q], sizes[q], threshold)
        if itself:
            x, y = x[x < y], y[x < y]
        rows = np.concatenate([np.stack([x // BLOCK, y // BLOCK, 0 * x, fp[p][x]], 1), np.stack([x // BLOCK, y // BLOCK, 0 * y + 1, fp[q][y]], 1)])
        rows = np.unique(rows, axis=0)
        first = lambda c: pa.array(np.full(len(rows), table[c][0].as_py()), pa.int64())
        return pa.table({"cluster": first("cluster"), "i": first("i"), "j": first("j"), "sub_i": rows[:, 0].astype(np.int32), "sub_j": rows[:, 1].astype(np.int32), "right": rows[:, 2] > 0, "fp": rows[:, 3]})

    return run


def _across(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """A forest of the links between two groups of sets."""
        right, fp = table["right"].to_pylist(), table["fp"].to_pylist()
        sets = [np.frombuffer(g, U64) for g in table["grams"].to_pylist()]
        p, q = ([k for k, r in enumerate(right) if r is side] for side in (False, True))
        forest = _forest(tree_join([sets[k] for k in p], [sets[k] for k in q], threshold), [fp[k] for k in p], [fp[k] for k in q])
        return pa.table({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([y for _, y in forest], pa.int64())})

    return run


def _linked_within(scratch: Scratch, clusters: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links that connect what links across components inside each cluster of ``(fp, cluster, component)``.

    Components of half a block or more have blocks of their own, the others of a cluster share some."""
    sizes = clusters.groupBy("cluster", "component").agg(F.count("*").alias("m"))
    sizes = scratch.save(sizes.withColumn("part", F.when(F.col("m") >= SKETCHES // 2, F.col("component"))), "part_sizes")
    parts = scratch.save(sizes.groupBy("cluster", "part").agg(F.ceil(F.sum("m") / SKETCHES).cast("int").alias("blocks")), "parts")
    place = sizes.alias("s").join(parts.alias("p"), (F.col("s.cluster") == F.col("p.cluster")) & F.col("s.part").eqNullSafe(F.col("p.part")))
    placed = clusters.join(scratch.save(place.select("s.cluster", "s.component", "s.part", "p.blocks"), "places"), ["cluster", "component"])
    at = F.xxhash64("cluster", "part", F.pmod(F.xxhash64("fp"), F.col("blocks"))).alias("at")
    placed = scratch.save(placed.select("cluster", "fp", "part", at).join(sets.select("fp", "size", "sketch"), "fp"), "clustered")
    # pairs of blocks, with themselves if they are shared, but for those within one component
    blocks = scratch.save(placed.select("cluster", "part", "at").distinct(), "block_list")
    other = blocks.select("cluster", F.col("at").alias("j"), F.col("part").alias("other"))
    pairs = blocks.withColumnRenamed("at", "i").join(other, "cluster").where("i <= j and coalesce(part != other, true)")
    pairs = scratch.save(pairs.select("cluster", "i", "j"), "block_pairs")
    left = placed.withColumnRenamed("at", "i").join(pairs, ["cluster", "i"]).withColumn("right", F.lit(False))
    right = placed.withColumnRenamed("at", "j").join(pairs.where("i != j"), ["cluster", "j"]).withColumn("right", F.lit(True))
    columns = ["cluster", "i", "j", "right", "fp", "size", "sketch"]
    close = scratch.save(left.select(*columns).unionByName(right.select(*columns)).groupBy("cluster", "i", "j").applyInArrow(_close(threshold), _PAIR), "close")
    groups = close.join(sets.select("fp", "grams"), "fp").groupBy("cluster", "i", "j", "sub_i", "sub_j")
    links = scratch.save(groups.applyInArrow(_across(threshold), "a long, b long"), "links")
    scratch.drop(sizes, parts, placed, blocks, pairs, close)
    return links


def _torn(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """Of ``(sig, probe, fp, class, need, component)``, the rows of signatures whose sets are in several components,
    without the sets that share too few of them to link across: such a link has ``need`` of a class. Twice, as a
    set that goes may leave a signature to one component."""
    for _ in range(2):
        several = scratch.save(placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("sig"), "torn")
        inside = scratch.save(placed.join(several, "sig"), "in_torn")
        able = scratch.save(inside.groupBy("fp", "class").agg(F.count("*").alias("m"), F.max("need").alias("least")).where("m >= least").select("fp", "class"), "able")
        scratch.drop(placed, several)
        placed = scratch.save(inside.join(able, ["fp", "class"], "left_semi"), "placed")
        scratch.drop(inside, able)
    return placed


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, n: int = 3, threshold: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; ``component_id`` is the smallest id
    that links reach. ``threshold`` is in hundredths."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = bucket_count(source)
    made = scratch.save(source.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_describe(n, threshold, buckets), DESCRIBED), "described")
    own = made.where("n is not null").select("doc_id", "n", "fp")
    nodes = scratch.save(own.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    left = made.where("bucket is not null").select("bucket", "data").groupBy("bucket").applyInArrow(_shared, LEFT)
    left = left.unionByName(made.where("sig is not null").select(*[x.split()[0] for x in LEFT.split(", ")]))
    # sets with enough shared signatures, and how many in a thousand of theirs are shared
    per_set = left.groupBy("fp", "class").agg(F.collect_set("sig").alias("sigs"), F.max("need").alias("need"), F.max("listed").alias("listed"))
    able = scratch.save(per_set.where(F.size("sigs") >= F.col("need")), "shared")
    met = able.select("fp", "class", "need", (F.size("sigs") * 1000 / F.col("listed")).cast("int").alias("share"), F.explode("sigs").alias("sig"))
    probe = met.groupBy("sig").agg(F.max(F.struct("share", "fp")).alias("top"), F.count("*").alias("m")).where("m > 1").select("sig", F.col("top.fp").alias("probe"))
    met = scratch.save(met.select("sig", "fp", "class", "need").join(scratch.save(probe, "probes"), "sig"), "met")
    scratch.drop(able)
    # the n-grams of the sets that met another, from their texts: no text is shuffled
    h = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    wanted = met.groupBy("fp", "class").agg(F.count("*").alias("m"), F.max("need").alias("least")).where("m >= least").select("fp").distinct()
    pages = spark.sparkContext.broadcast(_bitmap(wanted.join(nodes, "fp").select(F.col("rep").alias("doc_id")), h))
    texts = source.where("doc_id is not null").select(h.alias("h"), F.col("text").cast("binary").alias("text"))
    sets = scratch.save(texts.mapInArrow(_sets(n, pages), "fp long, size long, sketch binary, grams binary").dropDuplicates(["fp"]), "sets")

    star = met.where("fp != probe").groupBy(F.col("probe").alias("a"), F.col("fp").alias("b"), "class").agg(F.count("*").alias("m"), F.max("need").alias("least"))
    links = _linked(scratch, scratch.save(star.where("m >= least").select("a", "b").distinct(), "star"), sets, threshold)
    first = connected_components(scratch, links)
    # signatures whose sets are in several components yet: their pairs across components
    placed = met.join(first.select(F.col("node").alias("fp"), "component"), "fp", "left").select("sig", "probe", "fp", "class", "need", F.coalesce("component", "fp").alias("component"))
    torn = _torn(scratch, scratch.save(placed, "placed"))
    rest = scratch.save(torn.select("probe", "fp", "component").distinct(), "rest")
    clusters = connected_components(scratch, rest, "probe", "fp").withColumnRenamed("node", "fp").withColumnRenamed("component", "cluster")
    clusters = scratch.save(clusters.join(rest.select("fp", "component").distinct(), "fp"), "clusters")
    scratch.drop(met, torn)
    links = links.unionByName(_linked_within(scratch, clusters, sets, threshold))
    by_set = connected_components(scratch, links)
    scratch.drop(sets)
    # from sets back to documents: the smallest id of all sets of a component
    grouped = scratch.save(nodes.join(by_set, nodes.fp == by_set.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "grouped")
    least = scratch.save(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    final = scratch.save(grouped.join(least, "component").select("fp", "component_id"), "final")
    slim = own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("fp"))
    joined = slim.join(final, "fp", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-gram Jaccard similarity of 0.9."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
SQL: dict[str, str] = {}
