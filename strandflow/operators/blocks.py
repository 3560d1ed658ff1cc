"""Alignment blocks ``(query, ord, q_len, q_st, q_en, strand, ref, r_len, r_st, r_en, matches, block_len, nm,
is_primary, mapq)``: merging, choosing, classifying and summarising.

The folds carry a state that depends on earlier results, which no window frame can express; they run as
``aggregate`` over the sorted blocks of one query, in the JVM. A query's blocks are few by nature: they are
the pieces of one sequence's alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandflow.functions.sequence import cigar_sum, circular_distance
from strandflow.operators.contiguity import by_length, nx_lx, ranked
from strandflow.operators.intervals import covered

FIELDS = ("q_st", "ord", "q_en", "r_st", "r_en", "matches", "block_len", "nm", "mapq", "is_primary", "q_len", "r_len", "strand", "ref")
MIN_BLOCK, LOCAL, EXTENSIVE = 200, 200, 1000


def _fold(sorted_blocks: Column, absorb, keep_last) -> Column:
    """Left fold into an array: a block either goes into the current one or ends it and becomes the current one. The current one is
    carried beside those that have ended, which are copied only when another one ends."""
    first = F.get(sorted_blocks, F.lit(0))

    def step(state: Column, nxt: Column) -> Column:
        current, hit = state["current"], absorb(state["current"], nxt)
        return F.struct(F.when(hit, keep_last(current, nxt)).otherwise(nxt).alias("current"), F.when(hit, state["done"]).otherwise(F.concat(state["done"], F.array(current))).alias("done"))

    begin = F.struct(first.alias("current"), F.slice(sorted_blocks, 1, 0).alias("done"))
    return F.aggregate(F.slice(sorted_blocks, F.lit(2), F.greatest(F.size(sorted_blocks) - 1, F.lit(0))), begin, step, lambda s: F.when(F.size(sorted_blocks) > 0, F.concat(s["done"], F.array(s["current"]))).otherwise(s["done"]))


def _ops() -> Column:
    """The CIGAR of a block, or an empty one."""
    return F.coalesce("cigar", F.array().cast("array<struct<n:bigint,op:string>>"))


def _sorted(fields=FIELDS) -> Column:
    return F.array_sort(F.collect_list(F.struct(*[F.col(f) for f in fields])))


def _with(block: Column, fields=FIELDS, **changed: Column) -> Column:
    return F.struct(*[(changed[f] if f in changed else block[f]).alias(f) for f in fields])


def _ref_gap(a: Column, b: Column) -> Column:
    return F.when(a["strand"] > 0, b["r_st"] - a["r_en"]).otherwise(a["r_st"] - b["r_en"])


def merge_collinear(blocks: DataFrame, max_gap: int = 10_000, max_overlap: int | None = None) -> DataFrame:
    """Blocks of one query, reference and strand joined where both coordinates go on by at most ``max_gap`` and
    step back by at most ``max_overlap`` from the block merged so far. CIGARs, where given, follow one another."""
    given = "cigar" in blocks.columns
    fields = (*FIELDS, "cigar") if given else FIELDS
    back = min(500, max_gap) if max_overlap is None else max_overlap
    near = lambda gap: (gap >= -back) & (gap <= max_gap)

    def absorb(a: Column, b: Column) -> Column:
        return near(b["q_st"] - a["q_en"]) & near(_ref_gap(a, b))

    def joined(a: Column, b: Column) -> Column:
        added = {f: a[f] + b[f] for f in ("matches", "block_len", "nm")}
        if given:
            added["cigar"] = F.concat(a["cigar"], b["cigar"])
        return _with(a, fields, q_en=F.greatest(a["q_en"], b["q_en"]), r_st=F.least(a["r_st"], b["r_st"]), r_en=F.greatest(a["r_en"], b["r_en"]), mapq=F.greatest(a["mapq"], b["mapq"]), is_primary=a["is_primary"] | b["is_primary"], **added)

    rows = blocks.withColumn("cigar", _ops()) if given else blocks
    grouped = rows.groupBy("query", "ref", "strand").agg(_sorted(fields).alias("b"))
    return grouped.select("query", F.explode(_fold(F.col("b"), absorb, joined)).alias("x")).select("query", "x.*")


def join_across_origin(blocks: DataFrame, max_gap: int = 1000) -> DataFrame:
    """Blocks that the origin of a circular reference cut in two, joined again; only the query span of the
    result is meaningful."""

    def absorb(a: Column, b: Column) -> Column:
        gap = _ref_gap(a, b)
        distance = circular_distance(gap, a["r_len"], F.lit(True))
        return (distance < F.abs(gap)) & (F.abs(b["q_st"] - a["q_en"]) <= max_gap) & (distance <= max_gap)

    def joined(a: Column, b: Column) -> Column:
        return _with(a, q_st=F.least(a["q_st"], b["q_st"]), q_en=F.greatest(a["q_en"], b["q_en"]), **{f: a[f] + b[f] for f in ("matches", "block_len", "nm")})

    grouped = blocks.groupBy("query", "ref", "strand").agg(_sorted().alias("b"))
    return grouped.select("query", F.explode(_fold(F.col("b"), absorb, joined)).alias("x")).select("query", "x.*")


def select_blocks(blocks: DataFrame, min_block: int = MIN_BLOCK) -> DataFrame:
    """Per query the blocks that do not substantially overlap, in order: of two that do, the longer stays."""
    span = (F.col("q_en") - F.col("q_st")).alias("neg")
    fields = [F.col("q_st"), (-span).alias("neg"), F.col("ref"), F.col("strand"), *[F.col(f) for f in FIELDS if f not in ("q_st", "ref", "strand")]]
    order = F.array_sort(F.collect_list(F.struct(*fields)))
    plain = F.transform(order, lambda x: F.struct(*[x[f].alias(f) for f in FIELDS]))

    def clash(a: Column, b: Column) -> Column:
        return b["q_st"] < a["q_en"] - min_block // 2

    def longer(a: Column, b: Column) -> Column:
        return F.when(b["q_en"] - b["q_st"] > a["q_en"] - a["q_st"], b).otherwise(a)

    picked = blocks.groupBy("query").agg(plain.alias("b")).select("query", _fold(F.col("b"), clash, longer).alias("b"))
    return picked.select("query", F.posexplode("b").alias("pos", "x")).select("query", "pos", "x.*")


def structural_differences(blocks: DataFrame, min_block: int = MIN_BLOCK, circular: bool = True) -> DataFrame:
    """One row per break between neighbouring blocks of a query: its kind and position, where the blocks end and start on
    their references, and the gap there."""
    long = lambda df: df.where(F.col("q_en") - F.col("q_st") >= min_block)
    chosen = select_blocks(long(merge_collinear(long(blocks), LOCAL, LOCAL)), min_block)
    by = W.partitionBy("query").orderBy("pos")
    pair = chosen.select("query", "pos", F.struct(*FIELDS).alias("l"), F.lead(F.struct(*FIELDS)).over(by).alias("r")).where("r is not null")
    a, b = F.col("l"), F.col("r")
    gap = _ref_gap(a, b)
    size, round_ = F.greatest(a["r_len"], b["r_len"]), F.lit(circular)
    near = circular_distance(gap, size, round_)
    distance = F.greatest(near, circular_distance(gap - (b["q_st"] - a["q_en"]), size, round_))
    kind = (
        F.when(a["ref"] != b["ref"], "translocation").when(a["strand"] != b["strand"], "inversion")
        .when(round_ & (near < F.abs(gap)) & (near <= EXTENSIVE), None).when(distance > EXTENSIVE, "relocation").when(distance > LOCAL, "local")
    )
    out = pair.select("query", F.floor((a["q_en"] + b["q_st"]) / 2).cast("long").alias("break_pos"), kind.alias("kind"), a["ref"].alias("left_ref"), a["r_en"].alias("left_end"), b["ref"].alias("right_ref"), b["r_st"].alias("right_start"), F.when(kind.isin("relocation", "local"), gap).alias("ref_gap"))
    return out.where("kind is not null")


def difference_counts(events: DataFrame) -> DataFrame:
    kinds = ("translocation", "inversion", "relocation", "local")
    return events.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.countDistinct(F.when(F.col("kind") != "local", F.col("query"))).alias("contigs"))


def best_placements(blocks: DataFrame, min_coverage: float = 0.0) -> DataFrame:
    """The best merged block of each query: primary first, then query span, then matches."""
    merged = merge_collinear(blocks)
    best = W.partitionBy("query").orderBy(F.col("is_primary").desc(), (F.col("q_en") - F.col("q_st")).desc(), F.col("matches").desc(), "q_st", "ord")
    return merged.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn").where((F.col("q_en") - F.col("q_st")) >= F.col("q_len") * min_coverage)


def top_hits(blocks: DataFrame, n: int = 8) -> DataFrame:
    by = W.partitionBy("query").orderBy((F.col("q_en") - F.col("q_st")).desc(), "ord")
    return blocks.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def usable(blocks: DataFrame, min_block: int = MIN_BLOCK, primary_only: bool = True) -> DataFrame:
    out = blocks.where(F.col("q_en") - F.col("q_st") >= min_block)
    return out.where("is_primary") if primary_only else out


def reference_coverage(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Covered bases and per cent of every reference; one that no length is known for counts 0 per cent."""
    spans = covered(blocks.select("ref", F.col("r_st").alias("st"), F.col("r_en").alias("en")))
    return lengths.join(spans, "ref", "full").select("ref", "length", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce(100.0 * F.col("covered") / F.nullif("length", F.lit(0)), F.lit(0.0)).alias("percent"))


def query_coverage(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(query, length, covered, aligned, status)`` of every query: ``covered`` counts its bases in blocks once,
    ``aligned`` sums the blocks; unaligned, partial (less than 0.9 of a known length aligned) or aligned."""
    before = W.partitionBy("query").orderBy("q_st", "q_en").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("q_en") - F.greatest(F.col("q_st"), F.max("q_en").over(before)))
    sums = blocks.select("query", "q_st", "q_en", new.alias("new")).groupBy("query").agg(F.sum("new").alias("covered"), F.sum(F.col("q_en") - F.col("q_st")).alias("aligned"))
    short = (F.col("length") > 0) & (F.col("aligned") < 0.9 * F.col("length"))
    status = F.when(F.col("aligned").isNull(), "unaligned").when(short, "partial").otherwise("aligned")
    rows = lengths.join(sums, "query", "left")
    return rows.select("query", "length", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("aligned", F.lit(0)).alias("aligned"), status.alias("status"))


def alignment_totals(references: DataFrame, contigs: DataFrame, events: DataFrame) -> DataFrame:
    """One row from ``reference_coverage``, ``query_coverage`` and ``structural_differences``: covered share of all
    references, duplication, contigs by status with lengths, and contigs with a break other than a local one."""
    n = lambda status: F.count_if(F.col("status") == status)
    of = references.agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("covered_bases"), F.coalesce(F.sum("length"), F.lit(0)).alias("reference_length"))
    bad = events.where("kind != 'local'").select("query").distinct().withColumn("bad", F.lit(True))
    sums = contigs.join(bad, "query", "left").agg(
        (n("aligned") + n("partial")).alias("aligned_contigs"), n("unaligned").alias("unaligned_contigs"), n("partial").alias("partially_unaligned"),
        F.coalesce(F.sum(F.when(F.col("status") == "unaligned", F.col("length"))), F.lit(0)).alias("fully_unaligned_length"), F.coalesce(F.sum("aligned"), F.lit(0)).alias("total_aligned_length"),
        F.count_if("bad").alias("misassembled_contigs"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("length"))), F.lit(0)).alias("misassembled_contigs_length"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    share, copies = ratio(100.0 * F.col("covered_bases"), "reference_length"), ratio(F.col("total_aligned_length"), "covered_bases")
    return sums.join(of).select("*", share.alias("genome_fraction"), copies.alias("duplication_ratio"))


def aligned_contiguity(blocks: DataFrame, genome_size: int | None = None, min_block: int = MIN_BLOCK, circular: bool = True) -> DataFrame:
    """NA50 and LA50 over merged blocks and their bases, the largest of them; NGA50 against ``genome_size``."""
    merged = merge_collinear(blocks, 1000, 1000)
    merged = (join_across_origin(merged) if circular else merged).where(F.col("q_en") - F.col("q_st") >= min_block)
    rows = ranked(by_length(merged.select((F.col("q_en") - F.col("q_st")).alias("length"))))
    half, size = F.col("total") * 0.5, F.lit((genome_size or 0) * 0.5)
    first = lambda goal: F.min(F.when(F.col("cum") >= goal, F.struct("k", "length", "n", "cum")))
    found = rows.agg(first(half).alias("r"), first(size).alias("g"), F.max("length").alias("largest_alignment"), F.max("total").alias("merged_bases"))
    (n, rank), (ng, _) = nx_lx(F.col("r"), F.col("merged_bases") * 0.5), nx_lx(F.col("g"), size)
    return found.select(n.alias("na50"), rank.alias("la50"), (ng if genome_size else F.lit(0).cast("long")).alias("nga50"), "largest_alignment", "merged_bases")


def rates(blocks: DataFrame) -> DataFrame:
    """Mismatches (edits less bases in insertions and deletions, by block) and insertions and deletions (events),
    in all and per 100 kb of aligned blocks. Blocks without a CIGAR count their edits as mismatches."""
    ops = _ops() if "cigar" in blocks.columns else F.array().cast("array<struct<n:bigint,op:string>>")
    rows = blocks.withColumn("cigar", ops)
    events = F.size(F.filter("cigar", lambda p: p["op"].isin("I", "D"))).cast("long")
    sums = rows.agg(
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("nm") - cigar_sum(F.col("cigar"), "ID"))), F.lit(0)).alias("mismatches"), F.coalesce(F.sum(events), F.lit(0)).alias("indels"),
        F.coalesce(F.sum("block_len"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.col("q_en") - F.col("q_st")), F.lit(0)).alias("aligned_bases"),
    )
    per = lambda name: F.coalesce(F.round(F.col(name) * 100_000.0 / F.nullif("size", F.lit(0)), 6), F.lit(0.0)).alias(f"{name}_per_100kb")
    return sums.select("mismatches", "indels", per("mismatches"), per("indels"), "aligned_bases")


def split_at_long_indels(blocks: DataFrame, min_indel: int = 1000) -> DataFrame:
    """Blocks cut at insertions and deletions of ``min_indel`` or more; needs ``cigar``, an array of (n, op), null where it is not known.

    A piece has its coordinates from running sums over the operations, the operations between its cuts, and its share
    of matches and edits by block length, rounded half to even; the long indels leave the edit count and the
    denominator. A block is taken apart in its own row, so nothing is shuffled.
    """
    is_long = lambda c: c["op"].isin("I", "D") & (c["n"] >= min_indel)
    hit = F.coalesce(F.exists("cigar", is_long), F.lit(False))
    # where the long ones stand, from 1 on, with 0 before and one more behind all
    stand = F.filter(F.transform("cigar", lambda c, i: F.when(is_long(c), i + 1)), lambda i: i.isNotNull())
    rows = blocks.withColumn("at", F.when(hit, F.concat(F.array(F.lit(0)), stand, F.array(F.size("cigar") + 1))))
    run = lambda k: F.slice("cigar", F.get("at", k) + 1, F.get("at", k + 1) - F.get("at", k) - 1)
    runs = F.transform(F.sequence(F.lit(0), F.size("at") - 2), lambda k: F.struct(run(k).alias("ops"), F.get("cigar", F.get("at", k + 1) - 1).alias("then")))
    zero = F.lit(0).cast("long")

    def sized(x: Column) -> Column:
        """A run between cuts: what it takes of query, reference and block, and where the long one behind it moves on to."""
        ops, then = x["ops"], lambda op: F.when(x["then"]["op"] == op, x["then"]["n"]).otherwise(zero)
        sums = {"q": "M=XISH", "r": "M=XDN", "size": "M=XIDN", "base": "M=XID"}
        return F.struct(*[cigar_sum(ops, kinds).alias(c) for c, kinds in sums.items()], then("I").alias("then_q"), then("D").alias("then_r"), F.coalesce(x["then"]["n"], zero).alias("lost"), F.filter(ops, lambda c: ~c["op"].isin("S", "H")).alias("ops"))

    def placed(s: Column, x: Column) -> Column:
        q1, r1 = s["q"] + x["q"], s["r"] + x["r"]
        piece = F.struct(s["q"].alias("q0"), q1.alias("q1"), s["r"].alias("r0"), r1.alias("r1"), x["size"].alias("size"), x["ops"].alias("ops"))
        fine = (x["q"] > 0) & (x["r"] > 0) & (x["size"] > 0)
        return F.struct((q1 + x["then_q"]).alias("q"), (r1 + x["then_r"]).alias("r"), F.when(fine, F.concat(s["done"], F.array(piece))).otherwise(s["done"]).alias("done"))

    total = lambda c: F.aggregate("runs", zero, lambda s, x: s + x[c])
    none = F.array().cast("array<struct<q0:bigint,q1:bigint,r0:bigint,r1:bigint,size:bigint,ops:array<struct<n:bigint,op:string>>>>")
    rows = rows.withColumn("runs", F.transform(runs, sized))
    pieces = F.aggregate("runs", F.struct(zero.alias("q"), zero.alias("r"), none.alias("done")), placed, lambda s: s["done"])
    # a block without a long one, and one of which no piece is left, have no pieces and stay as they are
    rows = rows.select(*blocks.columns, total("base").alias("all_size"), total("lost").alias("lost"), F.explode_outer(pieces).alias("x"))
    x, plus = F.col("x"), F.col("strand") > 0
    share = x["size"] / F.greatest("all_size", F.lit(1))
    changed = {
        "q_st": F.greatest(F.lit(0), F.when(plus, F.col("q_st") + x["q0"]).otherwise(F.col("q_en") - x["q1"])), "q_en": F.least("q_len", F.when(plus, F.col("q_st") + x["q1"]).otherwise(F.col("q_en") - x["q0"])),
        "r_st": F.col("r_st") + x["r0"], "r_en": F.col("r_st") + x["r1"], "matches": F.rint(F.col("matches") * share).cast("long"), "block_len": x["size"],
        "nm": F.rint(F.greatest(F.lit(0), F.col("nm") - F.col("lost")) * share).cast("long"), "cigar": x["ops"],
    }
    return rows.select(*[F.when(x.isNotNull(), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in blocks.columns])
