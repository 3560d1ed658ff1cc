"""Links between oriented segment ends, and what follows from them alone.

Links are ``(ord, from_name, from_orient, to_name, to_orient, overlap)``. A link and its reverse (ends
swapped, both orientations flipped) are the same link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from strandflow.functions.sequence import flip
from strandflow.operators.components import connected_components
from strandflow.runtime import Scratch

ENDS = ("from_name", "from_orient", "to_name", "to_orient")


def canonical_key(ends=ENDS):
    """The smaller of the link's spelling and that of its reverse, from the columns ``ends``."""
    a, ao, b, bo = ends
    plain = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(ends)])
    back = F.struct(F.col(b).alias("k0"), flip(bo).alias("k1"), F.col(a).alias("k2"), flip(ao).alias("k3"))
    return F.least(plain, back)


def dedup_links(links: DataFrame) -> DataFrame:
    """One row per link: the first spelling, with its overlap. Pre-aggregated, so repeats cost one row a task.

    The key holds the ends of either spelling, so what is carried is which of the two it was; with numbers alone to carry, the groups are
    hashed and not sorted.
    """
    rest = [c for c in links.columns if c not in ("ord", *ENDS)]
    key, plain = canonical_key(), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(ENDS)])
    rows = links.withColumn("key", key).withColumn("plain", F.col("key") == plain)
    kept = rows.groupBy("key").agg(F.min("ord").alias("ord"), F.min_by("plain", "ord").alias("plain"), *[F.min_by(c, "ord").alias(c) for c in rest])
    k = [F.col(f"key.k{i}") for i in range(4)]
    back = (k[2], flip(k[3]), k[0], flip(k[1]))
    ends = {c: F.when(F.col("plain"), here).otherwise(there).alias(c) for c, here, there in zip(ENDS, k, back, strict=True)}
    return kept.select(*[ends.get(c, F.col(c)) for c in links.columns])


def drop_dangling(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links whose two segments exist."""
    names = segments.select("name")
    out = links.join(names.withColumnRenamed("name", "from_name"), "from_name", "left_semi").join(names.withColumnRenamed("name", "to_name"), "to_name", "left_semi")
    return out.select(*links.columns)


def adjacency(links: DataFrame) -> DataFrame:
    """``(src, src_o, dst, dst_o, overlap)`` in both directions; a link that is its own reverse comes once."""
    plain = [F.col(c).alias(n) for c, n in zip(ENDS, ("src", "src_o", "dst", "dst_o"), strict=True)]
    own_reverse = (F.col("from_name") == F.col("to_name")) & (F.col("from_orient") != F.col("to_orient"))
    back = links.where(~own_reverse).select(F.col("to_name").alias("src"), flip("to_orient").alias("src_o"), F.col("from_name").alias("dst"), flip("from_orient").alias("dst_o"), "overlap")
    return links.select(*plain, "overlap").unionByName(back)


def link_ends(links: DataFrame) -> DataFrame:
    """``(name, side, overlap)``, two rows per link: a link leaves the end of ``from +`` and enters the start of ``to +``."""
    side = lambda o, plus, minus: F.when(F.col(o) == "+", plus).otherwise(minus)
    two = F.array(
        F.struct(F.col("from_name").alias("name"), side("from_orient", "end", "start").alias("side"), F.col("overlap")),
        F.struct(F.col("to_name").alias("name"), side("to_orient", "start", "end").alias("side"), F.col("overlap")),
    )
    return links.select(F.explode(two).alias("e")).select("e.*")


def degrees(segments: DataFrame, links: DataFrame) -> DataFrame:
    """``(name, deg_start, deg_end, dead_ends)`` for every segment."""
    adj = adjacency(links).groupBy(F.col("src").alias("name")).agg(F.count_if(F.col("src_o") == "-").alias("deg_start"), F.count_if(F.col("src_o") == "+").alias("deg_end"))
    out = segments.select("name").join(adj, "name", "left").select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("deg_start", "deg_end")])
    return out.withColumn("dead_ends", (F.col("deg_start") == 0).cast("long") + (F.col("deg_end") == 0).cast("long"))


def circular_segments(links: DataFrame) -> DataFrame:
    """Segments whose only link joins their own end to their own start. Only the links of segments that have such a link are looked at, and
    where these are few, nothing else is shuffled."""
    loops = links.where((F.col("from_name") == F.col("to_name")) & (F.col("from_orient") == F.col("to_orient"))).select(F.col("from_name").alias("src")).distinct()
    loops = Scratch(links.sparkSession, "loops").save(loops, "loops")
    adj = adjacency(links).join(loops, "src", "left_semi")
    own = F.count_if((F.col("dst") == F.col("src")) & (F.col("src_o") == "+") & (F.col("dst_o") == "+"))
    return adj.groupBy(F.col("src").alias("name")).agg(own.alias("own"), F.count_if(F.col("src_o") == "+").alias("plus"), F.count_if(F.col("src_o") == "-").alias("minus")).where("own = 1 and plus = 1 and minus = 1").select("name")


def induced(links: DataFrame, names: DataFrame) -> DataFrame:
    return drop_dangling(links, names)


def _rooted(segments: DataFrame, links: DataFrame) -> DataFrame:
    """``(name, ord, length, root)``, a written table: ``root`` is the smallest ``ord`` of the segment's component."""
    scratch = Scratch(segments.sparkSession, "components")
    ids = segments.select("name", "ord", "length")
    edges = links.select("from_name", "to_name").join(ids.select(F.col("name").alias("from_name"), F.col("ord").alias("a")), "from_name").select("a", "to_name")
    edges = edges.join(ids.select(F.col("name").alias("to_name"), F.col("ord").alias("b")), "to_name").select("a", "b")
    found = connected_components(scratch, edges)
    return scratch.save(ids.join(found, ids.ord == found.node, "left").select("name", "ord", "length", F.coalesce("component", "ord").alias("root")), "member")


def components(segments: DataFrame, links: DataFrame) -> DataFrame:
    """``(name, component)``: 0 is the component of the most bases, ties by first segment."""
    member = _rooted(segments, links)
    totals = member.groupBy("root").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bases"))
    # ranks over components, not segments
    rank = totals.select("root", (F.row_number().over(W.orderBy(F.col("bases").desc(), "root")) - 1).cast("long").alias("component"))
    return member.select("name", "root").join(rank, "root").select("name", "component")


def component_summary(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Per component: segments, bases, links, and whether it is a ring or has a cycle."""
    scratch = Scratch(segments.sparkSession, "summary")
    member = scratch.save(components(segments, links), "member")
    nodes = segments.select("name", "length").join(member, "name").groupBy("component").agg(F.count("*").alias("segments"), F.sum("length").alias("bases"))
    ends = link_ends(links).groupBy("name").agg(F.count("*").alias("ends"))
    per = segments.select("name").join(member, "name").join(ends, "name", "left").groupBy("component").agg((F.sum(F.coalesce("ends", F.lit(0))) / 2).cast("long").alias("links"), F.min(F.coalesce("ends", F.lit(0))).alias("low"), F.max(F.coalesce("ends", F.lit(0))).alias("high"))
    excess = F.col("links") - F.col("segments")
    ring = ((F.col("segments") == 1) & (F.col("links") == 1)) | ((excess == 0) & (F.col("low") == 2) & (F.col("high") == 2))
    return nodes.join(per, "component").select("component", "segments", "bases", "links", ring.alias("ring"), (excess >= 0).alias("cyclic"))


def within_distance(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(name, distance)`` of all segments at most ``hops`` links from a seed."""
    scratch = Scratch(links.sparkSession, "rings")
    near = scratch.save(adjacency(links).select("src", "dst").where("src != dst").distinct(), "near")
    seen = front = scratch.save(seeds.select("name").distinct().withColumn("distance", F.lit(0)), "ring")
    for k in range(1, hops + 1):
        step = front.join(near, front.name == near.src).select(F.col("dst").alias("name")).distinct().join(seen, "name", "left_anti")
        front = scratch.save(step.withColumn("distance", F.lit(k)), "ring")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def no_overlap_length(segments: DataFrame, links: DataFrame) -> DataFrame:
    """One row: bases once each segment gives up the widest overlap at its ends."""
    widest = link_ends(links).groupBy("name").agg(F.max("overlap").alias("widest"))
    own = F.greatest(F.lit(0), F.col("length") - F.coalesce("widest", F.lit(0)))
    return segments.join(widest, "name", "left").agg(F.coalesce(F.sum(own), F.lit(0)).alias("length_no_overlaps"))


def orphaned(segments: DataFrame, links: DataFrame) -> DataFrame:
    """One row: number and bases of segments without a link."""
    alone = segments.join(link_ends(links).select("name").distinct(), "name", "left_anti")
    return alone.agg(F.count("*").alias("orphaned"), F.coalesce(F.sum("length"), F.lit(0)).alias("orphaned_length"))


def estimated_length(segments: DataFrame, links: DataFrame, median_depth: DataFrame) -> DataFrame:
    """One row: each segment without its widest overlap at its end, times its copies (depth over the median, half up)."""
    trailing = link_ends(links).where("side = 'end'").groupBy("name").agg(F.max("overlap").alias("trailing"))
    rows = segments.join(trailing, "name", "left").crossJoin(F.broadcast(median_depth.select("median_depth")))
    copies = F.round(F.col("depth") / F.nullif("median_depth", F.lit(0.0)))
    return rows.agg(F.sum(F.greatest(F.lit(0), F.col("length") - F.coalesce("trailing", F.lit(0))) * copies).cast("long").alias("estimated_length"))


def topology(segments: DataFrame, links: DataFrame, median_depth: DataFrame) -> DataFrame:
    """One row about the graph of ``segments`` and the links among them: links, components, dead ends, rings of one,
    the range of overlaps, what is largest, orphaned or counted twice, and how much sequence the depths tell of.
    Per cents are of two ends a segment and of all bases; 0 where there is nothing to divide by."""
    own = Scratch(links.sparkSession, "topology").save(drop_dangling(links, segments), "links")
    sizes = _rooted(segments, own).groupBy("root").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bases"))
    # all that is told of a segment's ends comes from one pass over them
    ends = link_ends(own).groupBy("name").agg(F.count_if(F.col("side") == "start").alias("starts"), F.count_if(F.col("side") == "end").alias("ends"), F.max("overlap").alias("widest"), F.max(F.when(F.col("side") == "end", F.col("overlap"))).alias("trailing"))
    joined = segments.select("name", "length", "depth").join(ends, "name", "left").crossJoin(F.broadcast(median_depth.select("median_depth")))
    free = lambda c: (F.coalesce(c, F.lit(0)) == 0).cast("long")
    alone, less = F.col("starts").isNull(), lambda c: F.greatest(F.lit(0), F.col("length") - F.coalesce(c, F.lit(0)))
    copies = F.round(F.col("depth") / F.nullif("median_depth", F.lit(0.0)))
    rows = [
        joined.agg(
            F.count("*").alias("segments"), F.coalesce(F.sum("length"), F.lit(0)).alias("bases"), F.coalesce(F.sum(free("starts") + free("ends")), F.lit(0)).alias("dead_ends"), F.count_if(alone).alias("orphaned"),
            F.coalesce(F.sum(F.when(alone, F.col("length"))), F.lit(0)).alias("orphaned_length"), F.coalesce(F.sum(less("widest")), F.lit(0)).alias("length_no_overlaps"), F.sum(less("trailing") * copies).cast("long").alias("estimated_length"),
        ),
        own.agg(F.count("*").alias("links"), F.min("overlap").alias("overlap_min"), F.max("overlap").alias("overlap_max")),
        sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("bases"), F.lit(0)).alias("largest_component_length")),
        circular_segments(own).agg(F.count("*").alias("circular")),
    ]
    one = rows[0]
    for row in rows[1:]:  # one row each
        one = one.crossJoin(F.broadcast(row))
    share = lambda part, whole: F.coalesce(100.0 * F.col(part) / F.nullif(whole, F.lit(0)), F.lit(0.0))
    one = one.withColumns({"dead_end_percent": share("dead_ends", 2 * F.col("segments")), "largest_component_percent": share("largest_component_length", F.col("bases")), "orphaned_percent": share("orphaned_length", F.col("bases"))})
    told = ("links", "overlap_min", "overlap_max", "components", "largest_component_length", "dead_ends", "circular", "orphaned", "orphaned_length", "length_no_overlaps", "estimated_length")
    return one.select(*told, "dead_end_percent", "largest_component_percent", "orphaned_percent")


def unambiguous_edges(links: DataFrame) -> DataFrame:
    """Oriented steps (src, src_o) -> (dst, dst_o) that are the only way out of one and into the other."""
    adj = adjacency(links).select("src", "src_o", "dst", "dst_o")
    out = adj.groupBy("src", "src_o").agg(F.count("*").alias("n_out"), F.min("dst").alias("dst"), F.min("dst_o").alias("dst_o")).where("n_out = 1")
    into = adj.groupBy("dst", "dst_o").agg(F.count("*").alias("n_in")).where("n_in = 1")
    return out.join(into, ["dst", "dst_o"]).where("src != dst").select("src", "src_o", "dst", "dst_o")


def chains(links: DataFrame, segments: DataFrame, min_length: int = 2) -> DataFrame:
    """Unbranching chains as ``(chain, pos, name, orient)``; a chain and its reverse come once, in the reading
    whose first segment has the smaller ``ord``. Rings have no start and give no chain.

    Positions come from pointer doubling back along the unambiguous steps. A node that knows its head is done and only
    looked up; in every round the nodes up to twice as far from their heads get done, so once none does, only rings are left.
    """
    scratch = Scratch(links.sparkSession, "chains")
    steps = scratch.save(unambiguous_edges(links).select(F.concat("src", "src_o").alias("a"), F.concat("dst", "dst_o").alias("b")), "steps")
    heads = scratch.save(steps.select(F.col("a").alias("node")).join(steps.select(F.col("b").alias("node")), "node", "left_anti"), "heads")
    first = steps.select(F.col("b").alias("node"), F.col("a").alias("up")).join(heads.select(F.col("node").alias("up"), F.lit(True).alias("done")), "up", "left")
    one = F.lit(1).cast("long")
    table, left = scratch.save_counting(first.select("node", "up", one.alias("dist"), F.coalesce("done", F.lit(False)).alias("done")), "back", ~F.col("done"))
    done, going = table.where("done"), table.where("not done")
    while left:
        above = done.unionByName(going).select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("dist").alias("more"), "done")
        table, now = scratch.save_counting(going.drop("done").join(above, "up").select("node", F.col("top").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), "done"), "back", ~F.col("done"))
        done, going = done.unionByName(table.where("done")), table.where("not done")
        if now >= left:
            break
        left = now
    split = lambda c: (F.expr(f"substring({c}, 1, length({c}) - 1)"), F.right(F.col(c), F.lit(1)))
    rows = done.select("node", "up", "dist").unionByName(heads.select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("dist")))
    size = rows.groupBy("up").agg((F.max("dist") + 1).alias("size"), F.max_by("node", "dist").alias("tail"))
    order = segments.select("name", "ord")
    begin, end = split("up")[0], split("tail")[0]
    sided = size.where(F.col("size") >= min_length).select("up", begin.alias("name"), end.alias("last_name")).join(order, "name").join(order.select(F.col("name").alias("last_name"), F.col("ord").alias("last_ord")), "last_name")
    chosen = sided.where((F.col("ord") < F.col("last_ord")) | ((F.col("ord") == F.col("last_ord")) & (F.right("up", F.lit(1)) == "+")))
    return rows.join(chosen.select("up", F.col("ord").alias("chain")), "up").select("chain", F.col("dist").alias("pos"), split("node")[0].alias("name"), split("node")[1].alias("orient"))


def walk_pieces(steps: DataFrame, links: DataFrame, segments: DataFrame, default_overlap: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """Per step of ``(path, pos, name, orient)``: its length and the overlap with the step before, and ``more`` columns of its segment."""
    before = W.partitionBy("path").orderBy("pos")
    pairs = steps.withColumn("p", F.lag("name").over(before)).withColumn("po", F.lag("orient").over(before))
    known = links.groupBy(canonical_key().alias("key")).agg(F.min_by("overlap", "ord").alias("found")).select("key.*", "found")
    key = F.least(F.struct(F.col("p").alias("k0"), F.col("po").alias("k1"), F.col("name").alias("k2"), F.col("orient").alias("k3")), F.struct(F.col("name").alias("k0"), flip("orient").alias("k1"), F.col("p").alias("k2"), flip("po").alias("k3")))
    # first steps have no step before and would all meet in one task under a null; dealt out by their paths, and with a null they find nothing
    none = F.lit(None).cast("string")
    alone = F.struct(F.col("path").cast("string").alias("k0"), none.alias("k1"), none.alias("k2"), none.alias("k3"))
    keyed = pairs.select("path", "pos", "name", "orient", F.col("p").isNull().alias("first"), F.when(F.col("p").isNotNull(), key).otherwise(alone).alias("key")).select("path", "pos", "name", "orient", "first", "key.*")
    joined = keyed.join(known, ["k0", "k1", "k2", "k3"], "left").select("path", "pos", "name", "orient", "first", "found").join(segments.select("name", "length", "sequence", *more), "name")
    trim = F.when(F.col("first"), 0).otherwise(F.coalesce("found", F.lit(default_overlap)))
    return joined.select("path", "pos", "name", "orient", "length", "sequence", trim.cast("long").alias("overlap"), *more)


def walk_sequences(steps: DataFrame, links: DataFrame, segments: DataFrame, default_overlap: int = 0) -> DataFrame:
    """``(path, sequence, length)``: oriented sequences joined, each without its overlap with the one before."""
    from strandflow.functions.sequence import oriented

    pieces = walk_pieces(steps, links, segments, default_overlap)
    body = oriented("sequence", "orient").substr(F.col("overlap").cast("int") + 1, F.length("sequence"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    text = F.array_join(F.transform(ordered, lambda x: x["piece"]), "")
    return pieces.withColumn("piece", body).groupBy("path").agg(text.alias("sequence")).withColumn("length", F.length("sequence"))


def resolve_paths(steps: DataFrame, links: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per path of ``(path, pos, name, orient)`` what a view of the segments ``drawn`` shows of it: members drawn,
    members dropped, joins between neighbours that a link bears out, joins broken, and bases."""
    adj = adjacency(links).select(F.col("src").alias("name"), F.col("src_o").alias("orient"), F.col("dst").alias("n2"), F.col("dst_o").alias("o2"), F.lit(True).alias("linked")).distinct()
    rows = steps.join(drawn.select("name", "length", F.lit(True).alias("drawn")), "name", "left")
    totals = rows.groupBy("path").agg(F.count("drawn").alias("members"), F.count_if(F.col("drawn").isNull()).alias("dropped"), F.coalesce(F.sum("length"), F.lit(0)).alias("bases"))
    shown = rows.where("drawn")
    after = W.partitionBy("path").orderBy("pos")
    pairs = shown.select("path", "pos", "name", "orient", F.lead("name").over(after).alias("n2"), F.lead("orient").over(after).alias("o2"), F.lead("pos").over(after).alias("p2")).where("n2 is not null")
    good = F.coalesce("linked", F.lit(False)) & (F.col("p2") == F.col("pos") + 1)
    joins = pairs.join(adj, ["name", "orient", "n2", "o2"], "left").groupBy("path").agg(F.count_if(good).alias("joins"), F.count_if(~good).alias("broken"))
    return totals.join(joins, "path", "left").select("path", "members", "dropped", F.coalesce("joins", F.lit(0)).alias("joins"), F.coalesce("broken", F.lit(0)).alias("broken"), "bases")
