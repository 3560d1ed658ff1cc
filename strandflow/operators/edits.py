"""Edits of an assembly graph as functions from tables to tables; nothing is changed in place.

A graph is its segments ``(ord, name, sequence, length, depth)`` and its links. All edits are set-based: one
pass rewrites every link that an edit touches.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window as W, functions as F

from strandflow.functions.sequence import flip, oriented, revcomp
from strandflow.operators import links as G
from strandflow.operators.names import last_ord, numbered, unique_names
from strandflow.runtime import Scratch


@dataclass(frozen=True)
class Graph:
    """Segments and links, and the graphs they were before: ``undo`` steps back through at most 40."""

    segments: DataFrame
    links: DataFrame
    past: tuple[Graph, ...] = field(default=(), repr=False)

    def then(self, segments: DataFrame, links: DataFrame) -> Graph:
        return Graph(segments, links, (*self.past, replace(self, past=()))[-40:])

    def undo(self) -> Graph:
        if not self.past:
            raise ValueError("nothing to undo")
        return replace(self.past[-1], past=self.past[:-1])


def add_segments(graph: Graph, rows: DataFrame, replace: bool = False) -> Graph:
    """With the segments ``(name, sequence, length, depth, ...)``, of which all but the name may be missing or null, behind all others.
    One whose name exists raises, or with ``replace`` takes the place of the one there is; of a name that comes twice
    in ``rows`` any one counts."""
    kinds = dict(graph.segments.dtypes)
    own = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in graph.segments.columns if c != "ord"]).dropDuplicates(["name"])
    own = own.where("name is not null").withColumn("length", F.when(F.length("sequence") > 0, F.length("sequence")).otherwise(F.coalesce("length", F.lit(0))).cast("long"))
    there = graph.segments.select("name", F.col("ord").alias("place"))
    if not replace and (first := own.join(there, "name").first()):
        raise ValueError(f"a segment {first['name']!r} exists")
    kept = graph.segments.join(own.select("name"), "name", "left_anti").select(*graph.segments.columns)
    instead = own.join(there, "name").withColumn("ord", F.col("place")).select(*graph.segments.columns)
    new = numbered(own.join(there.select("name"), "name", "left_anti"), "name", after=last_ord(graph.segments, graph.links)).select(*graph.segments.columns)
    return graph.then(kept.unionByName(instead).unionByName(new), graph.links)


def add_links(graph: Graph, rows: DataFrame, strict: bool = False) -> Graph:
    """With the links ``(from_name, from_orient, to_name, to_orient, overlap, ...)``; those that the graph has, in either reading,
    stay as they are. A link to a segment that is not there is left out, or with ``strict`` raises."""
    kinds = dict(graph.links.dtypes)
    own = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in graph.links.columns if c != "ord"]).withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    own = numbered(own, *G.ENDS, after=last_ord(graph.segments, graph.links)).select(*graph.links.columns)
    if strict:
        names = graph.segments.select("name")
        ends = own.select(F.explode(F.array("from_name", "to_name")).alias("name"))
        if lost := ends.join(names, "name", "left_anti").first():
            raise ValueError(f"no segment {lost['name']!r}")
    return graph.then(graph.segments, G.dedup_links(graph.links.unionByName(G.drop_dangling(own, graph.segments))))


def delete(graph: Graph, names: DataFrame) -> Graph:
    segments = graph.segments.join(names.select("name"), "name", "left_anti").select(*graph.segments.columns)
    return graph.then(segments, G.drop_dangling(graph.links, segments))


def filter_graph(graph: Graph, *, min_length: int | None = None, min_depth: float | None = None, max_depth: float | None = None, keep_components: int | None = None, min_component_length: int | None = None) -> Graph:
    """An unknown depth fails ``min_depth`` and passes ``max_depth``."""
    keep = F.lit(True)
    if min_length is not None:
        keep &= F.col("length") >= min_length
    if min_depth is not None:
        keep &= F.coalesce(F.col("depth") >= min_depth, F.lit(False))
    if max_depth is not None:
        keep &= F.coalesce(F.col("depth") <= max_depth, F.lit(True))
    segments = graph.segments.where(keep)
    if keep_components is not None or min_component_length is not None:
        member = G.components(graph.segments, graph.links)
        sized = graph.segments.join(member, "name").groupBy("component").agg(F.sum("length").alias("bases"))
        if keep_components is not None:
            sized = sized.where(F.col("component") < keep_components)
        if min_component_length is not None:
            sized = sized.where(F.col("bases") >= min_component_length)
        segments = segments.join(member.join(sized, "component", "left_semi").select("name"), "name", "left_semi").select(*graph.segments.columns)
    return graph.then(segments, G.drop_dangling(graph.links, segments))


def reverse_segment(graph: Graph, names: DataFrame) -> Graph:
    hit = names.select("name", F.lit(True).alias("hit"))
    segments = graph.segments.join(hit, "name", "left").withColumn("sequence", F.when(F.col("hit"), revcomp("sequence")).otherwise(F.col("sequence"))).select(*graph.segments.columns)
    links = graph.links
    for side in ("from", "to"):
        links = links.join(hit.withColumnRenamed("name", f"{side}_name"), f"{side}_name", "left").withColumn(f"{side}_orient", F.when(F.col("hit"), flip(f"{side}_orient")).otherwise(F.col(f"{side}_orient"))).drop("hit")
    return graph.then(segments, links.select(*graph.links.columns))


def _reattach(links: DataFrame, ends: DataFrame) -> DataFrame:
    """Move link ends: ``ends`` maps (name, side) to (new_name, new_side); sides say which end a link touches."""
    out = links
    for side, plus in (("from", "end"), ("to", "start")):
        minus = "start" if plus == "end" else "end"
        touched = F.when(F.col(f"{side}_orient") == "+", plus).otherwise(minus)
        moved = ends.select(F.col("name").alias(f"{side}_name"), F.col("side"), "new_name", "new_side")
        out = out.withColumn("side", touched).join(moved, [f"{side}_name", "side"], "left")
        out = out.withColumn(f"{side}_orient", F.when(F.col("new_side") == plus, "+").when(F.col("new_side") == minus, "-").otherwise(F.col(f"{side}_orient")))
        out = out.withColumn(f"{side}_name", F.coalesce("new_name", f"{side}_name")).drop("side", "new_name", "new_side")
    return out.select(*links.columns)


def split_segments(graph: Graph, cuts: DataFrame) -> Graph:
    """Cut segments at ``(name, pos)``: pieces are ``name_part1``, ... (``_2`` and so on where such a name exists) and linked in
    a row without overlap; links keep to the outer ends, self-loops of a cut segment go. Pieces and their links have
    ids of their own, behind all others."""
    inside = cuts.select("name", "pos").distinct().join(graph.segments.select("name", "ord", "length"), "name").where("pos > 0 and pos < length")
    cut = inside.groupBy("name", F.col("ord").alias("parent"), "length").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("at", lambda x: x.cast("long")), F.array("length"))
    pieces = cut.withColumn("e", edges).select("name", "parent", (F.size("at") + 1).alias("n"), "e", F.posexplode(F.slice("e", F.lit(1), F.size("e") - 1)).alias("i", "st"))
    pieces = pieces.select("name", "parent", "n", "i", "st", F.element_at("e", F.col("i") + 2).alias("en"), F.concat("name", F.lit("_part"), F.col("i") + 1).alias("label"))
    pieces = numbered(pieces, "parent", "i", after=last_ord(graph.segments, graph.links))
    whole = graph.segments.join(pieces.select("name").distinct(), "name", "left_anti").select(*graph.segments.columns)
    named = pieces.join(unique_names(pieces, whole).withColumnRenamed("name", "piece"), "ord")
    named = Scratch(pieces.sparkSession, "split").save(named, "pieces")
    body = F.col("sequence").substr(F.col("st").cast("int") + 1, (F.col("en") - F.col("st")).cast("int"))
    extra = [c for c in graph.segments.columns if c not in ("ord", "name", "sequence", "length")]
    made = named.join(graph.segments.select("name", "sequence", *extra), "name").select("ord", F.col("piece").alias("name"), body.alias("sequence"), (F.col("en") - F.col("st")).alias("length"), *extra).select(*graph.segments.columns)
    ends = named.where("i = 0").select("name", F.lit("start").alias("side"), F.col("piece").alias("new_name"), F.lit("start").alias("new_side"))
    ends = ends.unionByName(named.where("i = n - 1").select("name", F.lit("end").alias("side"), F.col("piece").alias("new_name"), F.lit("end").alias("new_side")))
    own = graph.links.join(named.where("i = 0").select(F.col("name").alias("from_name"), F.lit(True).alias("cut")), "from_name", "left")
    kept = own.where(~((F.col("from_name") == F.col("to_name")) & F.coalesce("cut", F.lit(False)))).select(*graph.links.columns)
    after = named.select("name", (F.col("i") - 1).alias("i"), F.col("piece").alias("to_name"))
    inner = named.join(after, ["name", "i"]).select("ord", F.col("piece").alias("from_name"), F.lit("+").alias("from_orient"), "to_name", F.lit("+").alias("to_orient"), F.lit(0).cast("long").alias("overlap"))
    return graph.then(whole.unionByName(made), _reattach(kept, ends).unionByName(inner, allowMissingColumns=True))


def break_differences(graph: Graph, events: DataFrame, *, extensive_only: bool = True, min_piece: int = 200) -> Graph:
    """Cut at structural differences that leave pieces of ``min_piece`` on both sides."""
    rows = events.where("kind != 'local'") if extensive_only else events
    at = rows.select(F.col("query").alias("name"), F.col("break_pos").alias("pos")).join(graph.segments.select("name", "length"), "name")
    return split_segments(graph, at.where((F.col("pos") >= min_piece) & (F.col("pos") <= F.col("length") - min_piece)).select("name", "pos"))


def merge_chains(graph: Graph, chains: DataFrame, prefix: str = "merged_") -> Graph:
    """Each chain of ``(chain, pos, name, orient)`` becomes one segment: overlaps trimmed, depth the mean weighted by
    length over known depths, links at its two outer ends kept. It takes the smallest id of its members and a name that
    no other segment has."""
    steps = chains.select(F.col("chain").alias("path"), "pos", "name", "orient")
    pieces = G.walk_pieces(steps, graph.links, graph.segments, more=("depth", "ord"))
    body = oriented("sequence", "orient").substr(F.col("overlap").cast("int") + 1, F.length("sequence"))
    rows = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece"))))
    known = F.when(F.col("depth").isNotNull(), F.col("length"))
    made = pieces.withColumn("piece", body).groupBy("path").agg(
        F.min("ord").alias("ord"), F.array_join(F.transform(rows, lambda x: x["piece"]), "").alias("text"), F.sum(F.col("length") - F.col("overlap")).alias("length"), (F.sum(F.col("depth") * F.col("length")) / F.nullif(F.sum(known), F.lit(0))).alias("depth"),
    )
    made = Scratch(chains.sparkSession, "merge").save(made, "merged")
    whole = graph.segments.join(chains.select("name"), "name", "left_anti").select(*graph.segments.columns)
    new = made.select("ord", "path").join(unique_names(made.select("ord", F.concat(F.lit(prefix), "path").alias("label")), whole), "ord")
    made = made.join(new.drop("path"), "ord").select("ord", "name", F.nullif("text", F.lit("")).alias("sequence"), "length", "depth")
    outer = chains.withColumn("last", F.max("pos").over(W.partitionBy("chain"))).join(new.select(F.col("path").alias("chain"), F.col("name").alias("new_name")), "chain")
    first = outer.where("pos = 0").select("name", F.when(F.col("orient") == "+", "start").otherwise("end").alias("side"), "new_name", F.lit("start").alias("new_side"))
    end = outer.where("pos = last").select("name", F.when(F.col("orient") == "+", "end").otherwise("start").alias("side"), "new_name", F.lit("end").alias("new_side"))
    moved = _reattach(graph.links, first.unionByName(end))
    segments = whole.unionByName(made.select(*[c for c in graph.segments.columns if c in made.columns]), allowMissingColumns=True)
    return graph.then(segments, G.drop_dangling(moved, segments))


def merge_path(graph: Graph, steps: list[tuple[str, str]], name: str) -> Graph:
    """The walk ``[(name, orient), ...]`` as one segment ``name``; every step must follow from the one before by a link,
    and no segment may come twice."""
    walk = graph.segments.sparkSession.createDataFrame([(name, k, *step) for k, step in enumerate(steps)], "chain string, pos long, name string, orient string")
    if len(steps) < 2 or len({n for n, _ in steps}) < len(steps):
        raise ValueError("a merge takes two different segments or more")
    if not graph.segments.where(F.col("name") == name).join(walk.select("name"), "name", "left_anti").isEmpty():
        raise ValueError(f"a segment {name!r} exists")
    after = walk.select(F.col("name").alias("dst"), F.col("orient").alias("dst_o"), (F.col("pos") - 1).alias("pos"))
    pairs = walk.select(F.col("name").alias("src"), F.col("orient").alias("src_o"), "pos").join(after, "pos")
    loose = pairs.join(G.adjacency(graph.links), ["src", "src_o", "dst", "dst_o"], "left_anti").orderBy("pos").first()
    if loose:
        raise ValueError(f"no link from {loose['src']}{loose['src_o']} to {loose['dst']}{loose['dst_o']}")
    return merge_chains(graph, walk, "")


def remove_links(graph: Graph, gone: DataFrame) -> Graph:
    """Without the links ``(from_name, from_orient, to_name, to_orient)``, in either reading of them."""
    return graph.then(graph.segments, graph.links.withColumn("key", G.canonical_key()).join(gone.select(G.canonical_key().alias("key")), "key", "left_anti").select(*graph.links.columns))


def simplify(graph: Graph, min_chain: int = 2) -> Graph:
    """Links and chains are written once, as each is read several times."""
    scratch = Scratch(graph.segments.sparkSession, "simplify")
    links = scratch.save(graph.links, "links")
    made = merge_chains(replace(graph, links=links), scratch.save(G.chains(links, graph.segments, min_chain), "chains"))
    return replace(made, past=(*graph.past, replace(graph, past=()))[-40:])
