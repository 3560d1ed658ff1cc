"""Searching a graph: paths between ends, bridges over gaps, scopes, names, and overlaps read off sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandflow.functions.sequence import exact_overlap, oriented
from strandflow.operators import links as G
from strandflow.runtime import Scratch


def match_names(segments: DataFrame, queries: DataFrame, exact: bool = True) -> DataFrame:
    """``(q, name)`` of each query ``(q)`` and the segments it names; ``name`` is null where there is none.
    Exact queries may end in an orientation; others match inside names, with case."""
    names = segments.select("name")
    if exact:
        return queries.select("q", F.regexp_replace("q", r"[+-]$", "").alias("bare")).join(names, (F.col("bare") == F.col("name")), "left").select("q", "name")
    return queries.join(_containing(names, queries.select("q").distinct(), F.col("name"), F.col("q")), "q", "left").select("q", "name")


def find_names(segments: DataFrame, text: str, exact: bool = False) -> DataFrame:
    """``(ord, name)`` of the segments that one of the terms in ``text``, between commas or spaces, is in the name of, whatever their case;
    with ``exact``, is the name of."""
    terms = segments.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(text.replace(",", " ").split())], "q string")
    own = segments.select("ord", "name")
    if exact:
        return own.join(terms.withColumnRenamed("q", "name"), "name", "left_semi").select("ord", "name")
    found = _containing(own.select("name"), terms, F.lower("name"), F.lower("q")).select("name").distinct()
    return own.join(found, "name", "left_semi").select("ord", "name")


def _containing(names: DataFrame, terms: DataFrame, text: Column, term: Column) -> DataFrame:
    """``(q, name)`` of names whose ``text`` contains the ``term`` of a query, by an inverted index of the parts of three characters: a term
    meets the names that have the rarest of its parts, and is then looked for in them. Shorter terms are parts themselves."""
    grams = lambda t, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda k: F.substring(t, k, F.lit(n))))
    wanted = terms.select("q", term.alias("t")).where("length(t) > 0").withColumn("gram", F.explode(F.when(F.length("t") >= 3, grams(F.col("t"), 3)).otherwise(F.array("t"))))
    sizes = F.flatten(F.array(*[F.when(F.length("t") >= n, grams(F.col("t"), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
    index = names.select("name", text.alias("t")).select("name", "t", F.explode(sizes).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    index = Scratch(names.sparkSession, "names").save(index, "index")
    often = wanted.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = often.groupBy("q").agg(F.min_by(F.struct("gram", F.col("t").alias("sought")), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("x")).select("q", "x.*")
    return rarest.join(index, "gram").where(F.col("t").contains(F.col("sought"))).select("q", "name")


def find_paths(links: DataFrame, segments: DataFrame, pairs: DataFrame, *, max_length: int = 50_000, max_nodes: int = 30, max_paths: int = 24) -> DataFrame:
    """Walks between oriented ends: ``pairs`` of ``(pair, a, ao, b, bo)``, with a ``max_length`` of their own if they have that
    column, to ``(pair, hops, walk, length)``, the intermediates only.

    All pairs advance together, one join a hop. A branch ends at its goal, before ``max_length`` bases of intermediates
    or ``max_nodes`` steps are passed, or where a segment would come a third time. Of each pair the first
    ``max_paths`` walks count by hops, then length, then names.

    Where more than ``max_paths`` beginnings of one pair stand at one end after as many hops, only the first ones by length and
    names stay: whatever walk one of the others can become, each of those becomes a better one the same way. That holds as
    long as no segment comes too often in their walks, so beginnings are told apart by the segments of theirs that can come again
    at all, those on a ring; in a graph without rings around the pairs a hop has ``max_paths`` rows for an end.
    """
    scratch = Scratch(links.sparkSession, "paths")
    adj = scratch.save(G.adjacency(links).select(F.col("src").alias("at"), F.col("src_o").alias("at_o"), "dst", "dst_o").join(segments.select(F.col("name").alias("dst"), F.col("length").alias("size")), "dst"), "adj")
    limit = F.col("max_length") if "max_length" in pairs.columns else F.lit(max_length)
    begin = scratch.save(pairs.select("pair", "b", "bo", F.col("a").alias("at"), F.col("ao").alias("at_o"), limit.cast("long").alias("limit")), "begin")
    found = _search(scratch, begin, adj, max_nodes, max_paths, None)
    if found is None:
        found = _search(scratch, begin, adj, max_nodes, max_paths, _on_rings(scratch, begin, adj, max_nodes))
    order = W.partitionBy("pair").orderBy("hops", "length", "text")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_paths).select("pair", "hops", "walk", "length")


def _search(scratch: Scratch, begin: DataFrame, adj: DataFrame, max_nodes: int, max_paths: int, rings: DataFrame | None) -> DataFrame | None:
    """The walks found, or None where beginnings crowd and ``rings``, the segments that can come again, are not known."""
    nothing = F.expr("array()").cast("array<struct<name: string, orient: string>>")
    front = begin.withColumns({"walk": nothing, "length": F.lit(0).cast("long"), "text": F.lit(""), "again": F.expr("array()").cast("array<string>")})
    adj = adj.withColumn("ring", F.lit(True)) if rings is None else scratch.save(adj.join(rings.withColumn("ring", F.lit(True)), "dst", "left"), "ringed")
    found = None
    for hops in range(max_nodes + 1):
        step = scratch.save(front.join(adj, ["at", "at_o"]), "step")
        done = (F.col("dst") == F.col("b")) & (F.col("dst_o") == F.col("bo"))
        hit = step.where(done).select("pair", F.lit(hops).alias("hops"), "walk", "length", "text")
        found = hit if found is None else found.unionByName(hit)
        seen = F.size(F.filter("walk", lambda w: w["name"] == F.col("dst")))
        on = step.where(~done & (F.col("length") + F.col("size") <= F.col("limit")) & (seen < 2))
        on = on.select(
            "pair", "b", "bo", "limit", F.col("dst").alias("at"), F.col("dst_o").alias("at_o"), F.concat("walk", F.array(F.struct(F.col("dst").alias("name"), F.col("dst_o").alias("orient")))).alias("walk"),
            (F.col("length") + F.col("size")).alias("length"), F.concat("text", "dst", "dst_o", F.lit("\t")).alias("text"), F.when(F.col("ring"), F.array_sort(F.concat("again", F.array("dst")))).otherwise(F.col("again")).alias("again"),
        )
        if rings is not None:
            best = W.partitionBy("pair", "at", "at_o", "again").orderBy("length", "text")
            full = found.groupBy("pair").count().where(F.col("count") >= max_paths)
            on = on.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= max_paths).drop("rn").join(full, "pair", "left_anti")
        front = scratch.save(on, "front")
        most = front.groupBy("pair", "at", "at_o").count().agg(F.max("count")).first()[0]
        if most is None:
            break
        if rings is None and most > max_paths:
            return None
    return found


def _on_rings(scratch: Scratch, begin: DataFrame, adj: DataFrame, hops: int) -> DataFrame:
    """Segments within ``hops`` steps of a beginning that a walk may come back to, among others ``(dst)``: what is left
    once all that nothing leads to and all that leads nowhere is taken away, again and again."""
    seen = front = scratch.save(begin.select("at", "at_o").distinct(), "seen")
    for _ in range(hops + 1):
        step = front.join(adj, ["at", "at_o"]).select(F.col("dst").alias("at"), F.col("dst_o").alias("at_o")).distinct()
        front = scratch.save(step.join(seen, ["at", "at_o"], "left_anti"), "ring_front")
        if front.isEmpty():
            break
        seen = scratch.save(seen.unionByName(front), "seen")
    inside = adj.join(seen, ["at", "at_o"]).join(seen.select(F.col("at").alias("dst"), F.col("at_o").alias("dst_o")), ["dst", "dst_o"])
    edges, before = scratch.save(inside.select("at", "dst").distinct(), "edges"), -1
    for _ in range(hops + 2):
        n = edges.count()
        if n in (0, before):
            break
        kept = edges.join(edges.select(F.col("dst").alias("at")).distinct(), "at", "left_semi").join(edges.select(F.col("at").alias("dst")).distinct(), "dst", "left_semi")
        edges, before = scratch.save(kept.select("at", "dst"), "edges"), n
    return edges.select("dst").distinct()


def _spelled(walks: DataFrame, links: DataFrame, segments: DataFrame) -> DataFrame:
    """``(path, sequence, known, n)`` of walks ``(path, a, ao, walk)``: their own bases, and of how many of their ``n`` segments bases are known.
    Of ``segments`` only those of the walks are taken along."""
    names = Scratch(links.sparkSession, "spelled").save(walks.select(F.explode("walk.name").alias("name")).distinct(), "names")
    part = oriented("sequence", "orient").substr(F.col("overlap").cast("int") + 1, F.length("sequence"))
    parts = G.walk_pieces(_steps(walks), links, segments.join(names, "name", "left_semi")).where("pos > 0").withColumn("part", part)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("path").agg(whole.alias("sequence"), F.count("sequence").alias("known"), F.count("*").alias("n"))


def _steps(walks: DataFrame) -> DataFrame:
    """``(path, pos, name, orient)`` of walks ``(path, a, ao, walk)``, from the end they begin at."""
    first = F.array(F.struct(F.col("a").alias("name"), F.col("ao").alias("orient")))
    return walks.select("path", F.posexplode(F.concat(first, F.col("walk"))).alias("pos", "s")).select("path", F.col("pos").cast("long").alias("pos"), "s.name", "s.orient")


def bridges(links: DataFrame, segments: DataFrame, gaps: DataFrame, **options) -> DataFrame:
    """``(pair, walk, sequence)``: :func:`bridge_walks` and their own bases."""
    made = Scratch(links.sparkSession, "bridges").save(bridge_walks(links, segments, gaps, **options).withColumn("path", F.to_json(F.struct("pair", "walk"))), "made")
    spelled = _spelled(made.where("size(walk) > 0"), links, segments).select("path", "sequence")
    return made.join(spelled, "path", "left").select("pair", "walk", F.coalesce("sequence", F.lit("")).alias("sequence"))


def bridge_walks(links: DataFrame, segments: DataFrame, gaps: DataFrame, *, tolerance: float = 0.5, max_length: int = 50_000, max_nodes: int = 20) -> DataFrame:
    """``(pair, a, ao, walk)`` for gaps ``(pair, a, ao, b, bo, gap)`` that the graph fills with confidence.

    Ends with a direct link close to nothing. Otherwise the walk whose own bases (each segment without its overlap with the one
    before) come closest to the gap wins, within the tolerance, unless the next best differs in sequence and is almost as close. Walks are
    measured by the lengths of sequences; bases are only looked at where two come close.
    """
    scratch = Scratch(links.sparkSession, "bridges")
    adj = G.adjacency(links).select(F.col("src").alias("a"), F.col("src_o").alias("ao"), F.col("dst").alias("b"), F.col("dst_o").alias("bo")).distinct()
    told = gaps.join(adj.withColumn("direct", F.lit(True)), ["a", "ao", "b", "bo"], "left")
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("gap") * (1 - tolerance))), F.floor(F.col("gap") * (1 + tolerance)) + 100
    reach = F.least(F.lit(max_length), F.greatest(F.lit(2000), 3 * F.col("gap")), F.greatest(2 * hi, F.lit(2000)))
    told = scratch.save(told.withColumns({"lo": lo, "hi": hi, "max_length": reach}), "gaps")
    direct = told.where("direct").select("pair", "a", "ao", F.expr("array()").cast("array<struct<name: string, orient: string>>").alias("walk"))
    rest = told.where("direct is null").drop("direct")
    walks = find_paths(links, segments, rest, max_nodes=max_nodes, max_paths=16).where("hops > 0").join(rest, "pair")
    walks = scratch.save(walks.withColumn("path", F.to_json(F.struct("pair", "walk"))), "walks")
    sized = segments.select("name", "length", F.lit(None).cast("string").alias("sequence"), F.length("sequence").alias("bases"))
    own = F.greatest(F.col("bases") - F.col("overlap"), F.lit(0))
    sums = G.walk_pieces(_steps(walks), links, sized, more=("bases",)).where("pos > 0").groupBy("path").agg(F.sum(own).alias("size"), F.count("bases").alias("known"), F.count("*").alias("n"))
    scored = walks.join(sums.where("known = n").select("path", "size"), "path").withColumn("off", F.abs(F.col("size") - F.col("gap"))).where((F.col("size") >= F.col("lo")) & (F.col("size") <= F.col("hi")))
    order = W.partitionBy("pair").orderBy("off", "hops", "path")
    near = F.coalesce(F.lead("off").over(order) <= F.col("off") * 1.25, F.lit(False))
    best = scored.withColumns({"rn": F.row_number().over(order), "near": near, "next_path": F.lead("path").over(order), "next_walk": F.lead("walk").over(order)}).where("rn = 1")
    best = scratch.save(best.select("pair", "a", "ao", "walk", "path", "near", "next_path", "next_walk"), "best")
    out = best.where("not near").select("pair", "a", "ao", "walk").unionByName(direct)
    close = best.where("near")
    if close.isEmpty():
        return out
    both = close.select("path", "a", "ao", "walk").unionByName(close.select(F.col("next_path").alias("path"), "a", "ao", F.col("next_walk").alias("walk")))
    texts = scratch.save(_spelled(both, links, segments).select("path", "sequence"), "texts")
    same = close.join(texts, "path").join(texts.select(F.col("path").alias("next_path"), F.col("sequence").alias("other")), "next_path").where("sequence = other")
    return out.unionByName(same.select("pair", "a", "ao", "walk"))


def scope(segments: DataFrame, links: DataFrame, kind: str = "entire", *, seeds: DataFrame | None = None, distance: int = 0, min_depth: float | None = None, max_depth: float | None = None, component: int | None = None, min_length: int = 0, max_nodes: int | None = None) -> DataFrame:
    """``(name, rank)`` of the segments a view shows. ``min_length`` and ``component`` narrow the graph before
    anything is grown in it. A cap keeps whole rings around the seeds, or around the largest segment of each
    component, largest components first; inside a ring longer segments come first."""
    if kind not in ("entire", "around", "depth"):
        raise ValueError(f"unknown scope {kind!r}")
    pool = segments.where(F.col("length") >= min_length)
    if component is not None:
        member = G.components(segments, links).where(F.col("component") == component)
        pool = pool.join(member.select("name"), "name", "left_semi")
    inside = G.drop_dangling(links, pool)
    size = pool.select("name", "length")
    if kind == "around":
        start = pool.join(seeds.select("name"), "name", "left_semi")
        near = G.within_distance(inside, start, distance).join(size, "name").withColumn("first", F.lit(0))
    else:
        if kind == "depth":
            known = F.col("depth").isNotNull()
            for bound, test in ((min_depth, F.col("depth") >= (min_depth or 0)), (max_depth, F.col("depth") <= (max_depth or 0))):
                known = known & test if bound is not None else known
            pool = pool.where(known)
            inside, size = G.drop_dangling(links, pool), pool.select("name", "length")
        if max_nodes is None:
            return size.select("name", F.lit(0).cast("long").alias("rank"))
        member = G.components(pool, inside)
        largest = W.partitionBy("component").orderBy(F.col("length").desc(), "name")
        heads = size.join(member, "name").withColumn("rn", F.row_number().over(largest))
        rings = G.within_distance(inside, heads.where("rn = 1"), max_nodes)
        tops = heads.where("rn = 1").select("component", (-F.col("length")).alias("first"))
        near = rings.join(heads.select("name", "length", "component"), "name").join(tops, "component")
    ordered = near.orderBy("first", "distance", F.col("length").desc(), "name")
    out = ordered.limit(max_nodes) if max_nodes is not None else near
    return out.select("name", F.col("distance").cast("long").alias("rank"))


def _link_sequences(links: DataFrame, segments: DataFrame) -> DataFrame:
    own = segments.where("sequence != ''").select("name", "sequence")
    left = own.select(F.col("name").alias("from_name"), F.col("sequence").alias("l"))
    right = own.select(F.col("name").alias("to_name"), F.col("sequence").alias("r"))
    return links.join(left, "from_name").join(right, "to_name").withColumn("l", oriented("l", "from_orient")).withColumn("r", oriented("r", "to_orient"))


def infer_overlap(links: DataFrame, segments: DataFrame, *, cap: int = 512, sample: int = 120, least: int = 10, consensus: float = 0.6) -> DataFrame:
    """One row ``(overlap)``: what a sample of links measures as exact overlap, if at least ``least`` and the share
    ``consensus`` agree; else 0. The sample are the ``sample`` links whose ends hash lowest, the same in every run."""
    h = F.xxhash64(*G.ENDS)
    some = links.select("ord", *G.ENDS, h.alias("h")).orderBy("h", "ord").limit(sample)
    measured = _link_sequences(some, segments).select(exact_overlap("l", "r", cap).alias("overlap"), "ord")
    counts = measured.groupBy("overlap").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = counts.agg(F.max_by(F.struct("overlap", "n"), F.struct("n", -F.col("first"))).alias("b"), F.sum("n").alias("all"))
    fine = (F.col("b.overlap") >= least) & (F.col("b.n") >= consensus * F.col("all"))
    return best.select(F.when(fine, F.col("b.overlap")).otherwise(0).cast("long").alias("overlap"))


def _borne_out(links: DataFrame, segments: DataFrame, overlap: int) -> DataFrame:
    """``(ord, fits)`` of the links whose two ends share ``overlap`` bases."""
    fits: Column = (F.length("l") >= overlap) & (F.length("r") >= overlap) & (F.right("l", F.lit(overlap)) == F.left("r", F.lit(overlap)))
    return _link_sequences(links, segments).where(fits).select("ord", F.lit(True).alias("fits"))


def apply_overlap(links: DataFrame, segments: DataFrame, overlap: int) -> DataFrame:
    """``links`` with the overlap set where the sequences bear it out; only if no link states one already."""
    if overlap <= 0 or not links.where("overlap != 0").isEmpty():
        return links
    set_ = F.when(F.col("fits"), F.lit(overlap)).otherwise(F.col("overlap")).cast("long")
    return links.join(_borne_out(links, segments, overlap), "ord", "left").withColumn("overlap", set_).select(*links.columns)


def adopt_overlap(links: DataFrame, segments: DataFrame) -> tuple[DataFrame, int]:
    """``links`` with the overlap that a sample of them measures, where none states one, and the overlap to take where no link is known:
    that one, if it fits two links and half of all, else 0."""
    overlap = 0 if links.isEmpty() or not links.where("overlap != 0").isEmpty() else infer_overlap(links, segments).first()[0]
    if not overlap:
        return links, 0
    made = Scratch(links.sparkSession, "overlap").save(apply_overlap(links, segments, overlap), "links")
    all_, good = made.agg(F.count("*"), F.count_if(F.col("overlap") == overlap)).first()
    return made, overlap if good >= max(2, 0.5 * all_) else 0


def _other(node: Column) -> Column:
    """The same segment on the other strand."""
    return F.concat(node.substr(F.lit(1), F.length(node) - 1), F.translate(F.right(node, F.lit(1)), "+-", "-+"))


def _walks(scratch: Scratch, nexts: DataFrame, runs: DataFrame, steps: int, stop: Column) -> DataFrame:
    """All walks of ``runs`` ``(run, forward, home, goal, path)`` by breadth: ``(run, path, end)``. A walk ends where
    ``stop`` (a function of ``home``, ``goal`` and ``nn``) gives a reason, without a way on, or after ``steps`` nodes; a
    node comes at most twice in it."""
    front, done = scratch.save(runs, "front"), None
    for k in range(steps):
        if k == steps - 1:
            ended = front.select("run", "path", F.lit("long").alias("end"))
            done = ended if done is None else done.unionByName(ended)
            break
        step = front.withColumn("node", F.element_at("path", -1)).join(nexts, ["node", "forward"], "left")
        step = scratch.save(step.withColumn("end", F.when(F.col("nn").isNull(), "dead").otherwise(stop)), "walks")
        ended = step.where("end is not null").select("run", "path", "end")
        done = ended if done is None else done.unionByName(ended)
        times = F.size(F.filter("path", lambda p: p == F.col("nn")))
        front = scratch.save(step.where(F.col("end").isNull() & (times < 2)).select("run", "forward", "home", "goal", F.concat("path", F.array("nn")).alias("path")), "front")
        if front.isEmpty():
            break
    return done


def certainty(segments: DataFrame, links: DataFrame, starts: DataFrame, steps: int = 15) -> DataFrame:
    """``(name, status)``: starting, contiguous, maybe or not, as seen from the segments in ``starts``.

    From the forward strand of a start all walks of at most ``steps`` nodes are followed both ways, apart for each
    first link. A segment on some walk may belong with the start; one on all walks of a first link does, on that
    strand or on either; and so does one from which some first link leads nowhere but back to the start. The
    number of walks grows with the branching of the graph around the starts, as the question demands.
    """
    scratch = Scratch(segments.sparkSession, "certainty")
    adj = G.adjacency(links).select(F.concat("src", "src_o").alias("x"), F.concat("dst", "dst_o").alias("y")).distinct()
    nexts = scratch.save(adj.select(F.col("x").alias("node"), F.lit(True).alias("forward"), F.col("y").alias("nn")).unionByName(adj.select(F.col("y").alias("node"), F.lit(False).alias("forward"), F.col("x").alias("nn"))), "nexts")
    homes = starts.join(segments.select("name"), "name", "left_semi").select(F.concat("name", F.lit("+")).alias("home")).distinct()
    firsts = homes.join(nexts, homes.home == nexts.node)
    runs = firsts.select(F.concat_ws(" ", "home", "forward", "nn").alias("run"), "forward", "home", F.col("home").alias("goal"), F.array("nn").alias("path"))
    at_home = F.when(F.col("nn") == F.col("home"), "home")
    walks = scratch.save(_walks(scratch, nexts, runs, steps, at_home).select("run", F.array_distinct("path").alias("path")), "walks")
    total = walks.groupBy("run").agg(F.count("*").alias("n"))
    maybe = scratch.save(walks.select("run", F.explode("path").alias("node")).distinct(), "maybe")
    both = F.array_distinct(F.concat("path", F.transform("path", _other)))
    common = lambda nodes: walks.select("run", F.explode(nodes).alias("node")).groupBy("run", "node").agg(F.count("*").alias("k")).join(total, "run").where("k = n").select("node")
    # from each checked node: does some first link lead only to the start
    home_of = runs.select("run", F.col("home").alias("target"))
    checks = scratch.save(maybe.join(home_of, "run").select("node", "target").distinct(), "checks")
    back = checks.join(nexts, "node").select(F.concat_ws(" ", "node", "target", "forward", "nn").alias("run"), "node", "target", "forward", "nn")
    sure = []
    for either in (False, True):
        hit = lambda n, g: (n == g) | (_other(n) == g) if either else n == g
        begin = back.select("run", "forward", F.col("node").alias("home"), F.col("target").alias("goal"), F.array("node", "nn").alias("path"), F.when(F.col("nn") == F.col("node"), "loop").when(hit(F.col("nn"), F.col("target")), "goal").alias("end"))
        ends = begin.where("end is not null").select("run", "end")
        reason = F.when(F.col("nn") == F.col("home"), "loop").when(hit(F.col("nn"), F.col("goal")), "goal")
        ends = ends.unionByName(_walks(scratch, nexts, begin.where("end is null").drop("end"), steps, reason).select("run", "end"))
        bad = ends.where("end != 'goal'").select("run").distinct()
        sure.append(back.join(bad, "run", "left_anti").select("node"))
    contiguous = common(F.col("path")).unionByName(common(both)).unionByName(sure[0]).unionByName(sure[1])
    name = lambda df, node, rank: df.select(F.expr(f"substring({node}, 1, length({node}) - 1)").alias("name"), F.lit(rank).alias("rank"))
    ranks = name(homes, "home", 0).unionByName(name(contiguous, "node", 1)).unionByName(name(maybe, "node", 2)).groupBy("name").agg(F.min("rank").alias("rank"))
    status = F.when(F.col("rank") == 0, "starting").when(F.col("rank") == 1, "contiguous").when(F.col("rank") == 2, "maybe").otherwise("not")
    return segments.select("name").join(ranks, "name", "left").select("name", status.alias("status"))
