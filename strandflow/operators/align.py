"""Aligning sequences by shared minimizers, and searching with them.

Seeds are minimizers: of every ``w`` neighbouring k-mers the one with the smallest hash, on either strand. Query
and reference seeds meet in a hash join, after seeds with many places on the reference are dropped (their
number is pre-aggregated). Anchors of a (query, reference, strand) are chains where neither the diagonal nor
the query position jumps. Both are found over cells of diagonals and positions, so what one task sorts is a row
for each cell and not the anchors of two chromosomes. Long chains are cut into pieces that begin at an anchor; the bases of
a piece are compared between its anchors: equal stretches by position, unequal ones with one gap at its best place, and outwards
from a chain's ends until the score drops. Only the stretches that a piece spans are fetched, tile by tile, and
a chain's pieces are put together again as one block.

Blocks have the columns of ``operators.blocks`` and ``cigar``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from strandflow.functions.sequence import revcomp
from strandflow.operators.blocks import split_at_long_indels
from strandflow.operators.hits import top
from strandflow.runtime import Scratch

#: (k, w, share of identical bases that blocks must reach) by preset, from near to far
PRESETS = {"asm5": (19, 10, 0.90), "asm10": (17, 10, 0.85), "asm20": (15, 8, 0.75)}
TILE = 100_000
CHUNK = 1 << 20
#: bases of a query in one piece of a chain
PIECE = 1 << 20
KEY = ["query", "ref", "strand"]
CHAIN = [*KEY, "g", "c"]

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b | 32] = _i


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def minimizers_of(seq: bytes, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, strand) of a sequence's minimizers; k-mers with other letters are left out."""
    code = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(code) - k + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    fwd, rev, bad = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(k):
        c = code[j : j + n]
        bad |= c > 3
        fwd = (fwd << np.uint64(2)) | (c & 3)
        rev |= (np.uint64(3) - (c & 3)) << np.uint64(2 * j)
    h = _mix(np.minimum(fwd, rev))
    h[bad | (fwd == rev)] = np.iinfo(np.uint64).max
    width = min(w, n)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    at = at[h[at] != np.iinfo(np.uint64).max]
    return h[at], at.astype(np.int64), (fwd < rev)[at]


def minimizers(sequences: DataFrame, k: int, w: int) -> DataFrame:
    """``(name, size, hash, pos, plus)`` of ``(name, sequence)``. Chunks share the windows at their border; as the places of minimizers only
    rise along a sequence, those up to the last one told are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or not seq:
                    continue
                told = -1
                for st in range(0, len(seq), CHUNK):
                    h, at, plus = minimizers_of(seq[st : st + CHUNK + k + w - 2], k, w)
                    new = at + st > told
                    h, at, plus, n = h[new], at[new], plus[new], int(new.sum())
                    told = int(at[-1]) + st if n else told
                    yield pa.RecordBatch.from_pydict({"name": pa.array([name] * n, pa.string()), "size": pa.array([len(seq)] * n, pa.int64()), "hash": pa.array(h.view(np.int64)), "pos": pa.array(at + st), "plus": pa.array(plus)})

    return sequences.select(F.col("name").cast("string"), F.col("sequence").cast("binary")).mapInArrow(run, "name string, size long, hash long, pos long, plus boolean")


def anchors(queries: DataFrame, references: DataFrame, k: int, w: int, max_places: int | None = 64) -> DataFrame:
    """``(query, ref, strand, q_len, r_len, q, r)``; q counts along the query as it lies on the reference.
    Without ``max_places`` no seed is dropped."""
    ref = minimizers(references, k, w)
    if max_places is not None:
        rare = ref.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") <= max_places).select("hash")
        ref = ref.join(rare, "hash", "left_semi")
    ref = ref.select("hash", F.col("name").alias("ref"), F.col("size").alias("r_len"), F.col("pos").alias("r"), F.col("plus").alias("r_plus"))
    own = minimizers(queries, k, w).select("hash", F.col("name").alias("query"), F.col("size").alias("q_len"), "pos", "plus")
    same = F.col("plus") == F.col("r_plus")
    return own.join(ref, "hash").select("query", "ref", F.when(same, 1).otherwise(-1).alias("strand"), "q_len", "r_len", F.when(same, F.col("pos")).otherwise(F.col("q_len") - k - F.col("pos")).alias("q"), "r")


def chains(found: DataFrame, band: int = 300, max_gap: int = 3000, least: int = 3, piece: int = PIECE) -> DataFrame:
    """Anchors to pieces of chains ``(query, ref, strand, g, c, piece, q_len, r_len, pins, until)``; pins are (q, r) in order, and
    ``until`` is the pin that the next piece begins with, null in a chain's last piece. Both coordinates of the pins that pieces begin with rise.

    Cells are ``band`` diagonals by ``max_gap`` positions, so no jump is inside one: jumps lie between the ends of neighbouring cells."""
    scratch = Scratch(found.sparkSession, "chains")
    d = F.col("r") - F.col("q")
    cells = found.groupBy(*KEY, F.floor(d / band).alias("db"), F.floor(F.col("q") / max_gap).alias("qb")).agg(
        F.first("q_len").alias("q_len"), F.first("r_len").alias("r_len"), F.min(d).alias("d0"), F.max(d).alias("d1"), F.min("q").alias("q0"), F.max("q").alias("q1"), F.collect_set(F.struct("q", "r")).alias("pins"))
    cells = scratch.save(cells, "cells")
    jump = lambda low, high, over, most: F.sum(F.when(F.col(low) - F.lag(high).over(over) > most, 1).otherwise(0)).over(over)
    diagonals = cells.groupBy(*KEY, "db").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    diagonals = diagonals.select(*KEY, "db", jump("d0", "d1", W.partitionBy(*KEY).orderBy("db"), band).alias("g"))
    cells = cells.join(diagonals, [*KEY, "db"])
    places = cells.groupBy(*KEY, "g", "qb").agg(F.min("q0").alias("q0"), F.max("q1").alias("q1"))
    places = places.select(*KEY, "g", "qb", jump("q0", "q1", W.partitionBy(*KEY, "g").orderBy("qb"), max_gap).alias("c"))
    tiles = cells.join(places, [*KEY, "g", "qb"]).groupBy(*CHAIN, F.floor(F.col("qb") * max_gap / piece).alias("t"))
    tiles = tiles.agg(F.first("q_len").alias("q_len"), F.first("r_len").alias("r_len"), F.array_sort(F.flatten(F.collect_list("pins"))).alias("pins"))
    tiles = scratch.save(tiles.withColumns({"head": F.col("pins")[0], "n": F.size("pins")}), "tiles")
    along = W.partitionBy(*CHAIN).orderBy("t")
    behind = F.max("head.r").over(along.rowsBetween(W.unboundedPreceding, -1))
    heads = tiles.select(*CHAIN, "t", "head", "n", F.when(behind.isNull() | (F.col("head.r") > behind), 1).otherwise(0).alias("opens"))
    heads = heads.withColumns({"piece": F.sum("opens").over(along), "all": F.sum("n").over(W.partitionBy(*CHAIN))}).where(F.col("all") >= least)
    after = F.min(F.when(F.col("opens") == 1, F.col("head"))).over(along.rowsBetween(1, W.unboundedFollowing))
    heads = heads.select(*CHAIN, "t", "piece", after.alias("until"))
    out = tiles.drop("head", "n").join(heads, [*CHAIN, "t"]).groupBy(*CHAIN, "piece")
    return out.agg(F.first("q_len").alias("q_len"), F.first("r_len").alias("r_len"), F.array_sort(F.flatten(F.collect_list("pins"))).alias("pins"), F.max("until").alias("until"))


def _fetch(rows: DataFrame, sequences: DataFrame, name: str, st: str, en: str, out: str) -> DataFrame:
    """``rows`` with the stretch [st, en) of the named sequence, put together from tiles."""
    key = [*CHAIN, "piece"]
    tiles = sequences.where("length(sequence) > 0").select(F.col("name").alias(name), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / TILE).cast("int")), lambda t: F.substring("sequence", t * TILE + 1, F.lit(TILE)))).alias("tile", "bases"))
    wanted = rows.select(*key, st, en, F.explode(F.sequence(F.floor(F.col(st) / TILE), F.floor((F.greatest(F.col(en), F.col(st) + 1) - 1) / TILE))).alias("tile"))
    a = F.greatest(F.col(st) - F.col("tile") * TILE, F.lit(0))
    b = F.least(F.col(en) - F.col("tile") * TILE, F.lit(TILE))
    got = wanted.join(tiles, [name, "tile"]).select(*key, "tile", F.substring("bases", (a + 1).cast("int"), (b - a).cast("int")).alias("part"))
    whole = got.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "").alias(out))
    return rows.join(whole, key)


def _runs(ops: list[tuple[int, str]]) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    for n, op in ops:
        if n and out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        elif n:
            out.append((n, op))
    return out


def _reach(same: np.ndarray, drop: int = 60, penalty: int = 3) -> int:
    """How far to go along ``same`` (bool) before the score falls by more than ``drop`` below its best."""
    if not len(same):
        return 0
    score = np.where(same, 1, -penalty).cumsum()
    best = np.maximum.accumulate(np.maximum(score, 0))
    fallen = np.flatnonzero(best - score > drop)
    stop = int(fallen[0]) if len(fallen) else len(score)
    if not stop or score[:stop].max() <= 0:
        return 0
    return int(score[:stop].argmax()) + 1


def align_chain(q: np.ndarray, r: np.ndarray, pins: list[tuple[int, int]], begins: bool = True, until: tuple[int, int] | None = None) -> tuple[int, int, int, int, int, int, list[tuple[int, str]]]:
    """(q_st, q_en, r_st, r_en, matches, edits, cigar) of oriented stretches, from pins inside them. A piece that does not begin its
    chain starts at its first pin, and one with ``until`` ends there."""
    kept = [pins[0]]
    for a, b in pins[1:]:
        if a > kept[-1][0] and b > kept[-1][1] and (until is None or (a < until[0] and b < until[1])):
            kept.append((a, b))
    ops: list[tuple[int, str]] = []
    matches = edits = 0
    a, b = kept[0]
    back = _reach((q[:a][::-1][: min(a, b)] == r[:b][::-1][: min(a, b)])) if begins else 0
    q_st, r_st = a - back, b - back
    at_q, at_r = q_st, r_st
    for a, b in [*kept[1:], until or (None, None)]:
        if a is None:
            n = min(len(q) - at_q, len(r) - at_r)
            stop = _reach(q[at_q : at_q + n] == r[at_r : at_r + n])
            a, b = at_q + stop, at_r + stop
        elif a - at_q < 0 or b - at_r < 0:
            continue
        x, y = q[at_q:a], r[at_r:b]
        n = min(len(x), len(y))
        gap = len(x) - len(y)
        if gap == 0:
            same = int((x == y).sum())
            matches, edits = matches + same, edits + n - same
            ops.append((n, "M"))
        else:
            head, tail = np.concatenate([[0], (x[:n] == y[:n]).cumsum()]), np.concatenate([[0], (x[len(x) - n :] == y[len(y) - n :])[::-1].cumsum()])[::-1]
            cut = int((head + tail).argmax())
            same = int(head[cut] + tail[cut])
            matches, edits = matches + same, edits + n - same + abs(gap)
            ops += [(cut, "M"), (abs(gap), "I" if gap > 0 else "D"), (n - cut, "M")]
        at_q, at_r = a, b
    return q_st, at_q, r_st, at_r, matches, edits, _runs(ops)


_PIECES = "query string, ref string, strand int, g long, c long, piece long, q_len long, r_len long, a long, b long, r_st long, r_en long, matches long, nm long, cigar array<struct<n: bigint, op: string>>"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block of each piece, in the columns of ``_PIECES``."""
    same = ("query", "ref", "strand", "g", "c", "piece", "q_len", "r_len")
    kinds = {n: pa.int64() for n in (*same, "a", "b", "r_st", "r_en", "matches", "nm")} | {"query": pa.string(), "ref": pa.string(), "strand": pa.int32(), "cigar": pa.list_(pa.struct([("n", pa.int64()), ("op", pa.string())]))}
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            q, r = (np.frombuffer(row[x].upper().encode(), np.uint8) for x in ("q_seq", "r_seq"))
            inside = lambda p, row=row: (p["q"] - row["q_from"], p["r"] - row["r_from"])
            made = align_chain(q, r, [inside(p) for p in row["pins"]], row["piece"] == 1, row["until"] and inside(row["until"]))
            values = {x: row[x] for x in same} | {"a": made[0] + row["q_from"], "b": made[1] + row["q_from"], "r_st": made[2] + row["r_from"], "r_en": made[3] + row["r_from"], "matches": made[4], "nm": made[5], "cigar": [{"n": n, "op": op} for n, op in made[6]]}
            yield pa.RecordBatch.from_arrays([pa.array([values[n]], t) for n, t in kinds.items()], names=list(kinds))


def _joined(pieces: DataFrame) -> DataFrame:
    """One block for each chain: its pieces in order, with runs that go on from one to the next as one run."""
    def onto(x, y):
        last, first = F.element_at(x, -1), F.get(y, F.lit(0))
        one = F.array(F.struct((last["n"] + first["n"]).alias("n"), last["op"].alias("op")))
        goes_on = (F.size(x) > 0) & (F.size(y) > 0) & (F.try_element_at(x, F.lit(-1))["op"] == first["op"])
        return F.when(goes_on, F.concat(F.slice(x, 1, F.size(x) - 1), one, F.slice(y, 2, F.size(y)))).otherwise(F.concat(x, y))

    in_order = F.array_sort(F.collect_list(F.struct("piece", "cigar")))
    rows = pieces.groupBy(*CHAIN).agg(*(F.first(c).alias(c) for c in ("q_len", "r_len")), *(F.min(c).alias(c) for c in ("a", "r_st")), *(F.max(c).alias(c) for c in ("b", "r_en")), *(F.sum(c).alias(c) for c in ("matches", "nm")), in_order.alias("parts"))
    begin = F.slice(F.col("parts")[0]["cigar"], 1, 0)
    return rows.withColumns({"block_len": F.col("matches") + F.col("nm"), "cigar": F.aggregate("parts", begin, lambda x, p: onto(x, p["cigar"]))}).drop("parts")


def align(queries: DataFrame, references: DataFrame, preset: str = "asm10", *, min_length: int = 200, flank: int = 2000, max_places: int | None = 64, secondaries: int | None = 5, min_indel: int | None = 1000, piece: int = PIECE) -> DataFrame:
    """Alignment blocks of ``(name, sequence)`` tables. Of blocks that share more than half of their query span
    with a better one all but ``secondaries`` are dropped and the rest are secondary; without it all blocks stay,
    and which are secondary is not told (null). A task compares ``piece`` bases of a query or so. Insertions and deletions of ``min_indel``
    or more cut blocks (``blocks.split_at_long_indels``); without it none does."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {', '.join(PRESETS)}")
    k, w, identity = PRESETS[preset]
    both = [x.where("sequence is not null and sequence != ''").select("name", "sequence") for x in (queries, references)]
    rows = chains(anchors(both[0].where(F.length("sequence") >= min_length), both[1], k, w, max_places), piece=piece)
    first, last, before = F.col("pins")[0], F.element_at("pins", -1), F.when(F.col("piece") == 1, flank).otherwise(0)
    begins = {f"{x}_from": F.greatest(first[x] - before, F.lit(0)) for x in "qr"}
    ends = {"q_to": F.least(last["q"] + k + flank, "q_len"), "r_to": F.least(F.array_max(F.transform("pins", lambda p: p["r"])) + k + flank, "r_len")}
    rows = rows.withColumns(begins | {n: F.coalesce(F.col("until")[n[0]], x) for n, x in ends.items()})
    minus = F.col("strand") < 0
    rows = rows.withColumns({"f_from": F.when(minus, F.col("q_len") - F.col("q_to")).otherwise(F.col("q_from")), "f_to": F.when(minus, F.col("q_len") - F.col("q_from")).otherwise(F.col("q_to"))})
    rows = _fetch(_fetch(rows, both[0], "query", "f_from", "f_to", "q_raw"), both[1], "ref", "r_from", "r_to", "r_seq")
    rows = rows.withColumn("q_seq", F.when(minus, revcomp("q_raw")).otherwise(F.col("q_raw")))
    made = _joined(rows.select(*CHAIN, "piece", "q_len", "r_len", "q_from", "r_from", "pins", "until", "q_seq", "r_seq").mapInArrow(_extend, _PIECES))
    made = made.withColumn("q_st", F.when(minus, F.col("q_len") - F.col("b")).otherwise(F.col("a"))).withColumn("q_en", F.when(minus, F.col("q_len") - F.col("a")).otherwise(F.col("b")))
    made = made.where((F.col("q_en") - F.col("q_st") >= min_length) & (F.col("matches") >= identity * F.col("block_len")))
    best = W.partitionBy("query", "ref", "strand", "q_st", "r_st").orderBy(F.col("matches").desc())
    made = made.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    ranked = made.withColumn("ord", F.row_number().over(W.partitionBy("query").orderBy(F.col("matches").desc(), "ref", "r_st", "q_st", "strand")).cast("long"))
    columns = ["query", "ord", "q_len", "q_st", "q_en", "strand", "ref", "r_len", "r_st", "r_en", "matches", "block_len", "nm"]
    if secondaries is None:
        out = ranked.select(*columns, F.lit(None).cast("boolean").alias("is_primary"), F.lit(None).cast("int").alias("mapq"), "cigar")
        return out if min_indel is None else split_at_long_indels(out, min_indel)
    # what covers more than half of a span covers its middle, so only blocks over the middle's bin are looked at
    over = F.sequence(F.floor(F.col("q_st") / TILE), F.floor((F.col("q_en") - 1) / TILE))
    better = ranked.select("query", F.col("ord").alias("o"), F.col("q_st").alias("x"), F.col("q_en").alias("y"), F.explode(over).alias("bin"))
    shared = F.least("q_en", "y") - F.greatest("q_st", "x")
    own = ranked.select("query", "ord", "q_st", "q_en", F.floor((F.col("q_st") + F.col("q_en")) / 2 / TILE).alias("bin"))
    worse = own.join(better, ["query", "bin"]).where((F.col("o") < F.col("ord")) & (shared > 0.5 * (F.col("q_en") - F.col("q_st")))).groupBy("query", "ord").agg(F.count("*").alias("beaten"))
    out = ranked.join(worse, ["query", "ord"], "left").where(F.coalesce("beaten", F.lit(0)) <= secondaries)
    out = out.select(*columns, F.col("beaten").isNull().alias("is_primary"), F.when(F.col("beaten").isNull(), 60).otherwise(0).alias("mapq"), "cigar")
    return out if min_indel is None else split_at_long_indels(out, min_indel)


def parse_query(spark: SparkSession, text: str) -> DataFrame:
    """``(name, sequence)`` of FASTA text or of one bare sequence."""
    lines = [x.strip() for x in text.strip().splitlines()]
    if not lines or not lines[0]:
        raise ValueError("empty query")
    if not lines[0].startswith(">"):
        seq = "".join(lines).upper()
        if not re.fullmatch("[ACGTURYSWKMBDHVN]+", seq):
            raise ValueError("a query is FASTA or a nucleotide sequence")
        return spark.createDataFrame([("query", seq)], "name string, sequence string")
    rows, name, body = [], None, []
    for x in [*lines, ">"]:
        if x.startswith(">"):
            if name is not None:
                rows.append((name, "".join(body).upper()))
            name, body = (x[1:].split() or ["unnamed"])[0], []
        else:
            body.append(x)
    return spark.createDataFrame(rows, "name string, sequence string")


def search(segments: DataFrame, query: DataFrame, *, min_identity: float = 0.8, min_length: int = 30, max_hits: int = 500) -> DataFrame:
    """The best ``max_hits`` hits of a query among segments, by matching bases."""
    hits = align(query, segments.select("name", "sequence"), "asm20", min_length=min_length, flank=500, max_places=None, secondaries=None, min_indel=None)
    identity = F.col("matches") / F.col("block_len")
    rows = hits.where(identity >= min_identity).select(F.col("query"), F.col("ref").alias("segment"), "strand", "q_st", "q_en", F.col("r_st").alias("s_st"), F.col("r_en").alias("s_en"), identity.alias("identity"), F.col("block_len").alias("length"), F.col("matches").cast("double").alias("score"), F.lit(None).cast("double").alias("evalue"))
    return top(rows, max_hits)


def capabilities() -> dict[str, str]:
    """What does the aligning and the searching here."""
    return {"alignment": "minimizer chains", "search": "minimizer chains", "presets": ", ".join(PRESETS)}
