"""Queries about text formats, placements, comparisons, edits and scaffolds."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from strandflow.functions import sequence as fn
from strandflow.operators import blocks as B, compare as D, contiguity as C, edits as E, hits as H, links as G, scaffold as S, tables as R
from strandflow.plans import adapters as A
from strandflow.plans.graphs import _CC, _CHAIN, _FOLD, _L1, _ORDERS, _P, _links
from strandflow.plans.registry import query, rounded
from strandflow.runtime import Scratch, spread
from strandflow.session import load
from strandflow.sources import sinks as K, textio as T

# text formats: lines are written from the tables and parsed back


def _gfa(spark, sf_dir):
    """A GFA of parts and, as text, all orders' steps: k-mer counts instead of depths, a dangling
    link, comments and a repeated name among it."""
    part = A.seg_part(spark, sf_dir)
    s = part.select(F.col("ord").alias("line"), F.concat_ws("\t", F.lit("S"), "name", F.lit("*"), F.concat(F.lit("LN:i:"), "length"), F.concat(F.lit("KC:i:"), F.col("length") * (F.col("ord") % 50))).alias("value"))
    raw = A.links(spark, sf_dir).select((F.col("ord") + 10_000_000).alias("line"), F.concat_ws("\t", F.lit("L"), "from_name", "from_orient", "to_name", "to_orient", F.concat("overlap", F.lit("M2I1D"))).alias("value"))
    glue = F.when(F.col("gap"), ";").otherwise(",")
    steps = A.path_steps(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.concat("name", "orient", glue).alias("t"))))
    p = steps.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("t")).select((F.col("path") + 900_000_000_000).alias("line"), F.concat_ws("\t", F.lit("P"), F.concat(F.lit("path"), "path"), "t", F.lit("*")).alias("value"))
    noise = spark.createDataFrame([(0, "H\tVN:Z:1.0"), (2_000_000_000_000, "# end"), (2_000_000_000_001, "S\tp1\t*\tLN:i:77\tdp:f:5.5"), (2_000_000_000_002, "L\tp1\t?\tp2\t+\t*")], "line long, value string")
    return s.unionByName(raw).unionByName(p).unionByName(noise)


@query(f"""with {A.SEG_PART} select case when ord = 1 then 1 else ord end as ord, name, case when ord = 1 then 77 else length end::bigint as length, case when ord = 1 then 5.5 else length * (ord % 50) / length::double end::double as depth from seg_part""")
def gfa_segments(spark, sf_dir):
    return T.gfa_segments(_gfa(spark, sf_dir)).select("ord", "name", "length", "depth")


@query(f"""with {A.PATH_STEPS}, {A.LINKS} select from_name, from_orient, to_name, to_orient, (overlap + 1)::bigint as overlap, count(*)::bigint as n from links group by all""")
def gfa_links(spark, sf_dir):
    return T.gfa_links(_gfa(spark, sf_dir)).groupBy("from_name", "from_orient", "to_name", "to_orient", "overlap").agg(F.count("*").alias("n"))


@query(f"""with {A.PATH_STEPS} select 'path' || path as path, pos::bigint as pos, name, orient, gap and pos < max(pos) over (partition by path) as gap_after from path_steps""")
def gfa_paths(spark, sf_dir):
    lines = Scratch(spark, "gfa").save(_gfa(spark, sf_dir), "lines")  # read three times, as a file would be
    return T.gfa_path_steps(lines, T.gfa_segments(lines)).select("path", "pos", "name", "orient", "gap_after")


@query(f"""with {A.PATH_STEPS}, {A.LINKS}, c as (select overlap, count(*) as n, min(ord) as first from links group by 1) select overlap from c order by n desc, first limit 1""")
def modal_overlap(spark, sf_dir):
    return T.modal_overlap(A.links(spark, sf_dir))


@query("select 2000000000002::bigint as line, 'L' || chr(9) || 'p1' || chr(9) || '?' || chr(9) || 'p2' || chr(9) || '+' || chr(9) || '*' as value")
def gfa_bad_records(spark, sf_dir):
    return T.bad_records(_gfa(spark, sf_dir))


@query(f"""with {A.SEG_PART}, {A.PATH_STEPS}, {A.LINKS}, {A.CANON}
select 'H' || chr(9) || 'VN:Z:1.0' as value union all select concat_ws(chr(9), 'S', name, '*', 'LN:i:' || length) from seg_part
union all select concat_ws(chr(9), 'L', from_name, from_orient, to_name, to_orient, overlap || 'M') from uniq""")
def gfa_written(spark, sf_dir):
    segments = A.seg_part(spark, sf_dir).withColumn("depth", F.lit(None).cast("double"))
    return K.gfa_text(segments, _links(spark, sf_dir)).select("value")


@query(f"""with {A.SEG_DOCS} select name, upper_len::bigint as length from (select name, length(replace(regexp_replace(sequence, '\\s', '', 'g'), '>', '')) as upper_len from seg_docs) where upper_len > 0""")
def fasta_round_trip(spark, sf_dir):
    docs = A.seg_docs(spark, sf_dir).withColumn("sequence", F.regexp_replace(F.regexp_replace("sequence", r"\s", ""), ">", "")).where("length(sequence) > 0")
    text = K.fasta_text(docs, 60)
    lines = text.select("ord", F.posexplode(F.split("value", "\n")).alias("k", "value")).select((F.col("ord") * 1_000_000 + F.col("k")).alias("line"), "value")
    return T.fasta_records(lines.where("value != ''")).select("name", F.length("sequence").cast("long").alias("length"))


_CIGAR = "c as (select 'q' || l_orderkey || '_' || row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as query, (l_quantity * 50)::bigint as a, (l_partkey % 3000)::bigint as d, (l_suppkey % 700 + 10)::bigint as b from lineitem)"


def _cigars(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    rows = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("q"), "l_orderkey", F.lit("_"), rn).alias("query"), (F.col("l_quantity") * 50).cast("long").alias("a"), (F.col("l_partkey") % 3000).alias("d"), (F.col("l_suppkey") % 700 + 10).alias("b"))
    return rows.withColumn("text", F.concat("a", F.lit("M"), "d", F.lit("D"), "b", F.lit("M3I")))


@query(f"with {_CIGAR} select query, 2::bigint as n_match, (a + d + b)::bigint as overlap, (case when d > 0 then d + 3 else 3 end)::bigint as indel_bases from c")
def cigar_ops(spark, sf_dir):
    ops = fn.cigar("text")
    return _cigars(spark, sf_dir).select("query", F.size(F.filter(ops, lambda x: x["op"] == "M")).cast("long").alias("n_match"), fn.cigar_overlap("text").alias("overlap"), fn.cigar_sum(ops, "ID").alias("indel_bases"))


@query(f"""with {_CIGAR}, s as (select *, a + b + 3 as n, b % 2 = 1 as minus, d >= 1000 as cut from c),
p as (select query, minus, cut, n, 0 as q0, case when cut then a else n end as q1, 0 as r0, case when cut then a else a + d + b end as r1, case when cut then a else a + d + b + 3 end as size, a + b as m, d, n as total,
  case when cut then a || 'M' else a || 'M' || d || 'D' || b || 'M3I' end as cigar from s union all select query, minus, cut, n, a, n, a + d, a + d + b, b + 3, a + b, d, n, b || 'M3I' from s where cut)
select query, (case when minus then n - q1 else q0 end)::bigint as q_st, (case when minus then n - q0 else q1 end)::bigint as q_en, r0::bigint as r_st, r1::bigint as r_en, size::bigint as block_len, cigar,
  case when cut then round_even(m * (size / total::double), 0) else m end::bigint as matches, case when cut then round_even(3 * (size / total::double), 0) else d + 3 end::bigint as nm from p""")
def split_long_indels(spark, sf_dir):
    rows = _cigars(spark, sf_dir)
    zero = F.lit(0).cast("long")
    blocks = rows.select(
        "query", F.lit(1).cast("long").alias("ord"), (F.col("a") + F.col("b") + 3).alias("q_len"), zero.alias("q_st"), (F.col("a") + F.col("b") + 3).alias("q_en"), F.when(F.col("b") % 2 == 1, -1).otherwise(1).alias("strand"), F.lit("r").alias("ref"), F.lit(100_000).cast("long").alias("r_len"),
        zero.alias("r_st"), (F.col("a") + F.col("d") + F.col("b")).alias("r_en"), (F.col("a") + F.col("b")).alias("matches"), (F.col("a") + F.col("d") + F.col("b") + 3).alias("block_len"), (F.col("d") + 3).alias("nm"), F.lit(True).alias("is_primary"), F.lit(60).alias("mapq"), fn.cigar("text").alias("cigar"),
    )
    text = F.array_join(F.transform("cigar", lambda c: F.concat(c["n"].cast("string"), c["op"])), "")
    return B.split_at_long_indels(blocks).select("query", "q_st", "q_en", "r_st", "r_en", "block_len", text.alias("cigar"), "matches", "nm")


# comparison of two assemblies


def _side(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("name"), F.col("o_orderkey").alias("ord"), F.lit(4000).cast("long").alias("length"))


_COV = """o as (select query, q_st as st, q_en as en, max(q_en) over (partition by query order by q_st, q_en rows between unbounded preceding and 1 preceding) as m from blocks),
i as (select *, sum(case when m is null or st > m then 1 else 0 end) over (partition by query order by st, en rows unbounded preceding) as k from o),
cov as (select query, sum(e - s) as covered from (select query, k, min(st) as s, max(en) as e from i group by query, k) group by query),
best as (select query, max(matches / block_len::double) as best_identity, arg_max(ref, ((q_en - q_st) * (matches / block_len::double), -ord)) as best_match from blocks group by query),
diff as (select 'q' || o_orderkey as name, o_orderkey as ord, least(4000, coalesce(covered, 0))::bigint as covered, best_match, best_identity from orders left join cov on cov.query = 'q' || o_orderkey left join best on best.query = 'q' || o_orderkey),
stat as (select *, case when covered / 4000.0 >= 0.95 then 'shared' when covered / 4000.0 >= 0.1 then 'partial' else 'missing' end as status from diff)"""


@query(f"with {A.BLOCKS}, {_COV} select name, 4000::bigint as length, covered, best_match, round(best_identity, 6) as best_identity, status from stat")
def coverage_status(spark, sf_dir):
    return rounded(D.contig_diff(_side(spark, sf_dir), A.blocks(spark, sf_dir)), "best_identity")


@query(f"with {A.BLOCKS} select query, ref, sum(q_en - q_st)::bigint as weight from blocks group by 1, 2")
def match_weights(spark, sf_dir):
    return D.match_weights(A.blocks(spark, sf_dir))


@query(f"""with {A.BLOCKS}, {_COV} select ord % 100 as component, count(*)::bigint as contigs, count(*)::bigint * 4000 as length, sum(covered)::bigint as covered,
  case when sum(covered) / (count(*) * 4000.0) >= 0.95 then 'shared' when sum(covered) / (count(*) * 4000.0) >= 0.1 then 'partial' else 'missing' end as status from stat group by 1""")
def component_diff(spark, sf_dir):
    side = _side(spark, sf_dir)
    return D.component_diff(D.contig_diff(side, A.blocks(spark, sf_dir)), side.select("name", (F.col("ord") % 100).alias("component")))


@query(f"""with {A.BLOCKS}, {_COV} select sum(covered)::bigint as shared_bases, sum(4000 - covered)::bigint as unique_bases, count(*) filter (where status = 'shared') as shared, count(*) filter (where status = 'partial') as partial,
  count(*) filter (where status = 'missing') as missing, (count(*) filter (where status = 'missing') * 4000)::bigint as missing_bases from stat""")
def side_summary(spark, sf_dir):
    return D.side_summary(D.contig_diff(_side(spark, sf_dir), A.blocks(spark, sf_dir)))


# edits


def _graph(spark, sf_dir):
    return E.Graph(A.seg_part(spark, sf_dir), _links(spark, sf_dir))


@query(f"""with {_L1}, kept as (select name from seg_part where length >= 2000 and (depth is null or depth <= 40))
select 'S' as kind, name as a, null as b from kept union all select 'L', from_name || from_orient, to_name || to_orient from uniq where from_name in (select name from kept) and to_name in (select name from kept)""")
def filter_graph(spark, sf_dir):
    g = E.filter_graph(_graph(spark, sf_dir), min_length=2000, max_depth=40.0)
    return g.segments.select(F.lit("S").alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(g.links.select(F.lit("L").alias("kind"), F.concat("from_name", "from_orient").alias("a"), F.concat("to_name", "to_orient").alias("b")))


@query(f"""with {_L1}, cut as (select * from seg_part where ord % 7 = 0 and length > 1000),
p as (select name || '_part1' as name, 1000::bigint as length from cut union all select name || '_part2', length - 1000 from cut union all select name, length from seg_part where not (ord % 7 = 0 and length > 1000)),
l as (select * from uniq where not (from_name = to_name and from_name in (select name from cut)))
select name as a, length::varchar as b from p union all
select case when from_name in (select name from cut) then from_name || case from_orient when '+' then '_part2' else '_part1' end else from_name end || from_orient,
  case when to_name in (select name from cut) then to_name || case to_orient when '+' then '_part1' else '_part2' end else to_name end || to_orient from l
union all select name || '_part1+', name || '_part2+' from cut""")
def split_segments(spark, sf_dir):
    base = _graph(spark, sf_dir)
    g = E.split_segments(base, base.segments.where("ord % 7 = 0").select("name", F.lit(1000).cast("long").alias("pos")))
    return g.segments.select(F.col("name").alias("a"), F.col("length").cast("string").alias("b")).unionByName(g.links.select(F.concat("from_name", "from_orient").alias("a"), F.concat("to_name", "to_orient").alias("b")))


@query(f"""with {_L1}, f as (select case when from_name in (select name from seg_part where ord % 3 = 0) then rf else from_orient end as fo, case when to_name in (select name from seg_part where ord % 3 = 0) then rt else to_orient end as t_o, * from uniq)
select from_name, fo as from_orient, to_name, t_o as to_orient from f""")
def reverse_segments(spark, sf_dir):
    base = _graph(spark, sf_dir)
    return E.reverse_segment(base, base.segments.where("ord % 3 = 0")).links.select("from_name", "from_orient", "to_name", "to_orient")


_MERGED = """select {name} as name, sum(length)::bigint as length, round(sum(depth * length) / sum(length), 6) as depth from chains join seg_orders using (name) group by chain
union all select name, length, round(depth, 6) from seg_orders where name not in (select name from chains)"""


def _order_graph(spark, sf_dir):
    return E.Graph(A.seg_orders(spark, sf_dir), G.dedup_links(A.order_links(spark, sf_dir)))


@query(f"""with recursive {_ORDERS}, {_CHAIN} {_MERGED.format(name="'merged_' || chain")}""")
def simplify(spark, sf_dir):
    return E.simplify(_order_graph(spark, sf_dir)).segments.select("name", "length", F.round("depth", 6).alias("depth"))


#: Orders whose key 7 divides are cut at 1000 and 2000; where 14 does, the second piece is deleted. ``seg2`` and ``adj2`` are what is left.
_CUT = f"""{_ORDERS}, pc as (select name, ord as parent, i, case when length > 2000 then 3 else 2 end as n, (i - 1) * 1000 as st, least(case when i = 3 then length else i * 1000 end, length) as en, depth from seg_orders, range(1, 4) r(i)
  where ord % 7 = 0 and length > 1000 and (i - 1) * 1000 < length),
pn as (select *, name || '_part' || i as piece, (select max(ord) from seg_orders) + row_number() over (order by parent, i) as ord from pc),
seg2 as (select ord, piece as name, (en - st)::bigint as length, depth from pn where not (i = 2 and parent % 14 = 0) union all select ord, name, length, depth from seg_orders where name not in (select name from pn)),
m as (select name, min(piece) filter (where i = 1) as head, min(piece) filter (where i = n) as tail from pn group by name),
l2 as (select coalesce(case from_orient when '+' then x.tail else x.head end, from_name) as f, from_orient as fo, coalesce(case to_orient when '+' then y.head else y.tail end, to_name) as t, to_orient as tt
  from uniq left join m x on x.name = from_name left join m y on y.name = to_name union all select x.piece, '+', y.piece, '+' from pn x join pn y on y.name = x.name and y.i = x.i + 1),
l3 as (select * from l2 where f in (select name from seg2) and t in (select name from seg2)),
adj2 as (select f as src, fo as src_o, t as dst, tt as dst_o from l3 union all select t, translate(tt, '+-', '-+'), f, translate(fo, '+-', '-+') from l3)"""


def _cut_graph(spark, sf_dir):
    graph = _order_graph(spark, sf_dir)
    at = graph.segments.where("ord % 7 = 0").select("name", F.explode(F.array(F.lit(1000).cast("long"), F.lit(2000).cast("long"))).alias("pos"))
    gone = graph.segments.where("ord % 14 = 0").select(F.concat("name", F.lit("_part2")).alias("name"))
    return E.delete(E.split_segments(graph, at), gone)


def _on_pieces(sql):
    return sql.replace("adj", "adj2").replace("seg_orders", "seg2").replace("seg_part", "seg2")


@query(f"""with recursive {_CUT}, {_on_pieces(_CHAIN)} {_on_pieces(_MERGED.format(name="'merged'"))}""")
def split_simplified(spark, sf_dir):
    made = E.simplify(_cut_graph(spark, sf_dir)).segments
    return made.select(F.when(F.col("name").startswith("merged_"), "merged").otherwise(F.col("name")).alias("name"), "length", F.round("depth", 6).alias("depth"))


@query(f"with {_CUT}, {_on_pieces(_CC)} select name, component from roots join comp using (root)")
def split_components(spark, sf_dir):
    graph = _cut_graph(spark, sf_dir)
    return G.components(graph.segments, graph.links)


# scaffolds


def _aligned(spark, sf_dir):
    rows = A.blocks(spark, sf_dir).where("is_primary")
    shift = F.regexp_replace("query", "q", "").cast("long") * 400
    return rows.withColumns({"r_st": F.col("r_st") + shift, "r_en": F.col("r_en") + shift, "q_len": F.lit(2000).cast("long")})


_ORDERED = f"""{_P}, al as (select query, ord, 2000::bigint as q_len, q_st, q_en, strand, ref, r_len, r_st + query[2:]::bigint * 400 as r_st, r_en + query[2:]::bigint * 400 as r_en, matches, block_len, nm, is_primary, mapq from blocks where is_primary and q_en - q_st >= 500 and matches >= 0.8 * block_len),
{_FOLD.format(table='al', back=500, gap=10000)},
pl as (select * from (select * from merged qualify row_number() over (partition by query order by is_primary desc, q_en - q_st desc, matches desc, q_st, ord) = 1) where q_en - q_st >= q_len * 0.3),
sq as (select ref, query, strand, r_st, r_en, q_en - q_st as span, row_number() over (partition by ref order by r_st, q_st - q_en, query) as n from pl),
fd as (select ref, n, query, strand, r_st, r_en, span, null::varchar as gone, 1 as pos from sq where n = 1
  union all select s.ref, s.n, case when keep then f.query else s.query end, case when keep then f.strand else s.strand end, case when keep then f.r_st else s.r_st end, case when keep then f.r_en else s.r_en end, case when keep then f.span else s.span end,
    case when clash then case when keep then s.query else f.query end end, case when clash then f.pos else f.pos + 1 end
  from fd f join sq s on s.ref = f.ref and s.n = f.n + 1, lateral (select f.r_en - s.r_st > 0.5 * least(f.r_en - f.r_st, s.r_en - s.r_st) as clash), lateral (select clash and s.span <= f.span as keep)),
kept as (select * from fd qualify row_number() over (partition by ref, pos order by n desc) = 1),
members as (select ref, pos - 1 as pos, query as segment, case when strand > 0 then '+' else '-' end as orientation, r_st, r_en, lead(r_st) over (partition by ref order by pos) - r_en as raw, span from kept)"""


@query(f"""{_ORDERED} select ref, pos::bigint as pos, segment, orientation, case when raw is null then 0 else greatest(raw, 100) end::bigint as gap_after, case when raw > 0 then 'reference' when raw is not null then 'default' end as evidence, false as redundant from members
union all select ref, null, gone, null, null, null, true from fd where gone is not null""")
def reference_order(spark, sf_dir):
    rows = S.order_by_reference(_aligned(spark, sf_dir))
    return rows.select("ref", "pos", "segment", F.when(~F.col("redundant"), F.col("orientation")).alias("orientation"), "gap_after", "evidence", "redundant")


def _agp(spark, sf_dir):
    segments = _side(spark, sf_dir)
    plan = S.plan_by_reference(_aligned(spark, sf_dir), segments).where("source = 'reference'")
    return S.agp(plan, segments)


@query(f"""{_ORDERED}, e as (select 'scaffold_' || ref as object, pos, 0 as sub, 'W' as kind, 4000 as size, segment as component, orientation as orient from members
  union all select 'scaffold_' || ref, pos, 1, case when raw > 0 then 'N' else 'U' end, greatest(raw, 100), null, null from members where raw is not null)
select object, (sum(size) over w - size + 1)::bigint as beg, (sum(size) over w)::bigint as "end", row_number() over w as part, kind, component, orient from e window w as (partition by object order by pos, sub rows unbounded preceding)""")
def agp_rows(spark, sf_dir):
    return _agp(spark, sf_dir).select("object", "beg", "end", "part", "kind", "component", "orient")


@query(f"""{_ORDERED}, e as (select 'scaffold_' || ref as object, pos, 0 as sub from members union all select 'scaffold_' || ref, pos, 1 from members where raw is not null),
n as (select object, row_number() over (partition by object order by pos, sub) as part from e) select object, part from n where part % 5 = 0 or part % 7 = 0""")
def agp_verify(spark, sf_dir):
    """Of rows with a start moved at every fifth part and an end that is not that of the slice at every seventh: those that do not tile."""
    rows = _agp(spark, sf_dir).withColumn("beg", F.col("beg") + (F.col("part") % 5 == 0).cast("long"))
    rows = rows.withColumns({"c_end": F.col("c_end") + (F.col("part") % 7 == 0).cast("long"), "gap": F.col("gap") - (F.col("part") % 7 == 0).cast("long")})
    return S.verify_agp(rows).select("object", "part")


#: Customers as genomes of 320 bases an order: a segment holds its order's bases and the first 40 of the next one's, every third one turned round.
#: Of most customers every second order is placed and the rest stands in the graph; of every seventh all are placed and nothing is linked, and
#: of as many others every second one is placed and nothing is linked.
_BASES = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_GENOME = f"""core as (select o_orderkey as ord, o_custkey as cust, row_number() over w as i, count(*) over (partition by o_custkey) as m,
  {' || '.join(f"translate(md5(o_orderkey || ':{k}'), {_BASES})" for k in range(10))} as t from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
seg as (select *, t || coalesce(left(lead(t) over (partition by cust order by i), 40), '') as body from core),
own as (select *, 'o' || ord as name, case when ord % 3 = 0 then reverse(translate(body, 'ACGT', 'TGCA')) else body end as sequence, cust % 7 = 0 or i % 2 = 1 as placed from seg)"""


def _genomes(spark, sf_dir):
    """(segments, links, blocks)."""
    by = W.partitionBy("cust").orderBy("day", "ord")
    keys = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("day"))
    # windows see keys alone and are written; bases are made of them where they are asked for
    keys = spread(keys, "cust", rows=100_000)  # few bytes, but much to be made of them
    own = keys.select("ord", "cust", F.row_number().over(by).cast("long").alias("i"), F.count("*").over(W.partitionBy("cust")).alias("m"), F.lead("ord").over(by).alias("after"))
    own = Scratch(spark, "genomes").save(own, "keys")
    t = lambda c, n: F.translate(F.concat(*[F.md5(F.concat(F.col(c).cast("string"), F.lit(f":{k}"))) for k in range(n)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    body = F.concat(t("ord", 10), F.coalesce(F.left(t("after", 2), F.lit(40)), F.lit("")))
    orient = lambda c: F.when(F.col(c) % 3 == 0, "-").otherwise("+")
    own = own.withColumns({"name": F.concat(F.lit("o"), "ord"), "orient": orient("ord"), "length": F.when(F.col("after").isNull(), 320).otherwise(360).cast("long")})
    segments = own.select("ord", "name", fn.oriented(body, "orient").alias("sequence"), "length", F.lit(1.0).alias("depth"))
    links = own.where("after is not null and cust % 7 > 1")
    links = links.select("ord", F.col("name").alias("from_name"), F.col("orient").alias("from_orient"), F.concat(F.lit("o"), "after").alias("to_name"), orient("after").alias("to_orient"), F.lit(40).cast("long").alias("overlap"))
    n, st = F.col("length"), (F.col("i") - 1) * 320
    blocks = own.where("cust % 7 = 0 or i % 2 = 1").select(
        F.col("name").alias("query"), F.lit(1).cast("long").alias("ord"), n.alias("q_len"), F.lit(0).cast("long").alias("q_st"), n.alias("q_en"), F.when(F.col("orient") == "-", -1).otherwise(1).alias("strand"), F.concat(F.lit("c"), "cust").alias("ref"), (F.col("m") * 320).alias("r_len"),
        st.alias("r_st"), (st + n).alias("r_en"), n.alias("matches"), n.alias("block_len"), F.lit(0).cast("long").alias("nm"), F.lit(True).alias("is_primary"), F.lit(60).alias("mapq"),
    )
    return segments, links, blocks


@query(f"""with {_GENOME}, top as (select cust, max(i) as last from own where placed group by cust),
whole as (select 'scaffold_c' || cust as object, case when cust % 7 = 1 then string_agg(case when i % 2 = 1 then body end, repeat('N', 280) order by i)
    else string_agg(case when i < last then t when i = last then body end, '' order by i) end as sequence,
  case when cust % 7 = 1 then 280 * (count(*) filter (where i % 2 = 1) - 1) else 0 end as gap_bases, case when cust % 7 > 1 then 320 * count(*) filter (where i % 2 = 0 and i < last) else 0 end as bridged_bases
  from own join top using (cust) group by cust, last)
select object, length(sequence)::bigint as bases, md5(sequence) as digest, gap_bases::bigint as gap_bases, bridged_bases::bigint as bridged_bases from whole
union all select 'unplaced_' || name, length(sequence)::bigint, md5(sequence), 0, 0 from own join top using (cust) where not placed and (cust % 7 = 1 or i > last)""")
def scaffold_bridged(spark, sf_dir):
    """Scaffolds along the references with walks of the graph in their gaps and overlaps written once: what their AGP rows spell."""
    segments, links, blocks = _genomes(spark, sf_dir)
    segments = Scratch(spark, "bridged").save(segments, "segments")  # bases are made once
    plan = S.scaffold_by_reference(blocks, segments, links, min_align=100)
    rows = Scratch(spark, "bridged").save(S.agp(plan, segments, links), "agp")
    sums = rows.groupBy("object").agg(F.max("end").alias("bases"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gap_bases"), F.coalesce(F.sum(F.when(F.col("bridged"), F.col("end") - F.col("beg") + 1)), F.lit(0)).alias("bridged_bases"))
    return sums.join(S.scaffold_sequences(rows, segments).select(F.col("name").alias("object"), F.md5("sequence").alias("digest")), "object")


@query(f"""with {_L1}, part10 as (select * from seg_part where ord % 10 <> 0),
half as (select * from uniq where from_name in (select name from part10) and to_name in (select name from part10) and ord % 3 <> 0), hadj as (select from_name as a, from_orient as ao, to_name as b, to_orient as bo from half union select to_name, rt, from_name, rf from half),
kept as (select path, pos, s.name, orient, lead(s.name) over w as n2, lead(orient) over w as o2 from path_steps s join part10 p on p.name = s.name window w as (partition by path order by pos))
select 's' || path as scaffold, 'missing' as kind, name as detail from path_steps where name not in (select name from part10)
union all select 's' || path, 'not linked', k.name || orient || ' to ' || n2 || o2 from kept k left join hadj h on h.a = k.name and h.ao = k.orient and h.b = n2 and h.bo = o2 where n2 is not null and h.a is null
union all select null, 'repeated', name || ': ' || count(*) from path_steps group by name having count(*) > 1""")
def scaffold_warnings(spark, sf_dir):
    """Paths as scaffolds over a graph that has lost parts and links."""
    segments = A.seg_part(spark, sf_dir).where("ord % 10 != 0")
    lines = Scratch(spark, "warnings").save(A.lines(spark, sf_dir), "lines")
    links = G.drop_dangling(G.dedup_links(A.links(spark, sf_dir, lines)).where("ord % 3 != 0"), segments)
    plan = A.path_steps(spark, sf_dir, lines).select(F.col("path").alias("ord"), F.concat(F.lit("s"), "path").alias("scaffold"), F.lit("graph").alias("source"), "pos", F.col("name").alias("segment"), F.col("orient").alias("orientation"), F.lit(0).cast("long").alias("gap_after"))
    return S.plan_warnings(plan, segments, links)


@query(f"""with {A.PATH_STEPS} select name as segment, count(*)::bigint as times from path_steps group by 1 having count(*) > 1""")
def repeated_segments(spark, sf_dir):
    return S.repeated_segments(A.path_steps(spark, sf_dir).select(F.col("name").alias("segment")))


@query(f"""with {_GENOME}, g as (select *, count(*) filter (where true) over (partition by cust) as n, cust % 7 > 1 as linked, case when cust % 7 > 1 then -cust else ord end as comp_key, length(sequence) as len,
  length(replace(replace(sequence, 'A', ''), 'T', '')) as strong from own),
c as (select comp_key, row_number() over (order by sum(len) desc, min(ord)) - 1 as component from g group by 1),
d as (select *, (linked and i > 1)::int as before, (linked and i < m)::int as after, ord % 3 = 0 as minus from g)
select name, len::bigint as length, '1.0000' as depth, case when strong = len then '1.00000' else '0.' || lpad(((200000 * strong + len) // (2 * len))::varchar, 5, '0') end as gc, component::bigint as component, (case when minus then after else before end)::bigint as deg_start, (case when minus then before else after end)::bigint as deg_end,
  0 as circular, case when placed then 'c' || cust end as ref, case when placed then (i - 1) * 320 end::bigint as ref_start, case when placed then (i - 1) * 320 + len end::bigint as ref_end, case when placed then '1.00000' end as ref_identity, case when placed then case when minus then -1 else 1 end end as ref_strand,
  case when placed then 'scaffold_c' || cust else 'unplaced_' || name end as scaffold, (case when not placed then 0 when cust % 7 = 0 then i - 1 else (i - 1) // 2 end)::bigint as scaffold_position from d join c using (comp_key)""")
def segment_table(spark, sf_dir):
    segments, links, blocks = _genomes(spark, sf_dir)
    return R.segment_table(segments, links, blocks, S.plan_by_reference(blocks, segments, min_align=100))


_MANY = "format('{:,}', %s::bigint)"


def _metric_sql(table: str) -> str:
    """Label and text of each row of a comparison, of one assembly of lengths and sequences."""
    one = lambda x: _MANY % x
    rows = [
        ("# contigs", one("count(*)")), ("# contigs >= 1 kb", one("count(*) filter (where length >= 1000)")), ("# contigs >= 10 kb", one("count(*) filter (where length >= 10000)")), ("Total length", one("max(total)")), ("Largest contig", one("max(length)")),
        ("N50", one("max(length) filter (where cum >= 0.5 * total)")), ("L50", one("min(k) filter (where cum >= 0.5 * total)")), ("N75", one("max(length) filter (where cum >= 0.75 * total)")), ("auN", one("round_even(sum(length::double * length) / max(total), 0)")),
        ("NG50", one("coalesce(max(length) filter (where cum >= 500000), 0)")), ("LG50", one("coalesce(min(k) filter (where cum >= 500000), 0)")),
    ]
    return " union all ".join(f"select '{label}' as label, {value} as v from {table}" for label, value in rows)


@query(f"""with {A.SEG_DOCS}, {A.SEG_PART}, {', '.join(f"r_{t} as (select length, row_number() over w as k, sum(length) over w as cum, sum(length) over () as total from seg_{t} window w as (order by length desc, ord rows unbounded preceding))" for t in ('docs', 'part'))},
a as ({_metric_sql('r_docs')}), b as ({_metric_sql('r_part')}) select label, a.v as docs, b.v as part from a join b using (label)""")
def comparison_table(spark, sf_dir):
    one = lambda segments: C.contiguity(segments, 1_000_000).crossJoin(F.broadcast(C.size_counts(segments)))
    return R.comparison_table({"docs": one(A.seg_docs(spark, sf_dir)), "part": one(A.seg_part(spark, sf_dir))}).drop("ord")


# hits


_TABULAR = """hit as (select 'q' || l_orderkey as query, 'p' || l_partkey as segment, round(80 + l_discount * 100 + l_tax * 100, 3) as percent, (l_quantity * 10)::bigint as length, (l_partkey % 500 + 1)::bigint as a, (l_suppkey * 3)::bigint as s, l_suppkey % 2 = 0 as turned,
  l_extendedprice::double as score, l_tax::double as evalue from lineitem),
hits as (select query, segment, case when turned then -1 else 1 end as strand, a - 1 as q_st, a + length - 1 as q_en, s - 1 as s_st, s + length - 1 as s_en, percent / 100 as identity, length, score, evalue from hit where length >= 50)"""


def _tabular(spark, sf_dir):
    """Rows of a tabular search; on the minus strand the larger end comes first."""
    c, n = F.col, (F.col("l_quantity") * 10).cast("long")
    a, s = (c("l_partkey") % 500 + 1).cast("long"), (c("l_suppkey") * 3).cast("long")
    turned = c("l_suppkey") % 2 == 0
    ends = F.when(turned, s + n - 1).otherwise(s), F.when(turned, s).otherwise(s + n - 1)
    fields = [F.concat(F.lit("q"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey"), F.round(80 + c("l_discount") * 100 + c("l_tax") * 100, 3), n, a, a + n - 1, *ends, c("l_extendedprice").cast("double"), c("l_tax").cast("double")]
    lines = A.table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *[x.cast("string") for x in fields]).alias("value"))
    return lines.unionByName(spark.createDataFrame([("# query\tsegment",), ("q\tp\tno\t1\t1\t1\t1\t1\t1\t1",), ("q\tp",)], "value string"))


@query(f"with {_TABULAR} select query, segment, strand, q_st, q_en, s_st, s_en, round(identity, 9) as identity, length, score, evalue from hits")
def tabular_hits(spark, sf_dir):
    return H.tabular_hits(_tabular(spark, sf_dir), min_length=50).withColumn("identity", F.round("identity", 9))


@query(f"with {_TABULAR} select segment, arg_max(score, (score, identity, -s_st, -q_st)) as score, round(arg_max(identity, (score, identity, -s_st, -q_st)), 9) as identity, arg_max(s_st, (score, identity, -s_st, -q_st)) as s_st from hits group by segment")
def best_hit_of_segment(spark, sf_dir):
    return H.best_of_segments(H.tabular_hits(_tabular(spark, sf_dir), min_length=50)).select("segment", "score", F.round("identity", 9).alias("identity"), "s_st")


@query(f"""with {A.BLOCKS}, s as (select *, block_len * case when is_primary then 1.5 else 1.0 end::double * case when matches > 0 then matches / block_len::double else 1 end as score from blocks)
select query, arg_max(ref, (score, -ord)) as ref, arg_max(ord, (score, -ord)) as ord, round(max(score), 6) as score from s group by query""")
def best_reference_hit(spark, sf_dir):
    return rounded(H.best_references(A.blocks(spark, sf_dir)).select("query", "ref", "ord", "score"), "score")


@query(f"""with {A.BLOCKS}, s as (select query as name, ref as source, q_st / q_len::double as s, q_en / q_len::double as e, case when strand < 0 then r_en else r_st end / r_len::double as q0, case when strand < 0 then r_st else r_en end / r_len::double as q1 from blocks where q_en > q_st),
n as (select *, greatest(ceil(100 * abs(q1 - q0)), 1)::int as n from s), p as (select *, unnest(range(0, n))::int as part from n)
select name, source, part, round(s + (e - s) / n * part, 9) as s, round(s + (e - s) / n * (part + 1), 9) as e, round(greatest(0, least(1, q0 + (q1 - q0) / n * part)), 9) as q from p""")
def hit_parts(spark, sf_dir):
    made = H.parts(H.reference_spans(A.blocks(spark, sf_dir)))
    return made.select("name", "source", "part", *[F.round(c, 9).alias(c) for c in ("s", "e", "q")])


@query(f"""with {A.BLOCKS} select 'ref' as kind, ref as name, max(r_len)::bigint as extent from blocks group by ref union all select 'query', query, max(q_en)::bigint from blocks group by query""")
def hit_extents(spark, sf_dir):
    blocks = A.blocks(spark, sf_dir)
    part = lambda kind, key, end: H.extents(blocks, key, end).select(F.lit(kind).alias("kind"), F.col(key).alias("name"), "extent")
    return part("ref", "ref", "r_len").unionByName(part("query", "query", "q_en"))


# other formats, written as text and read again


@query(f"with {A.PATH_STEPS} select 'g' || path as path, pos::bigint as pos, name, orient, false as gap_after from path_steps")
def gfa2_groups(spark, sf_dir):
    """Ordered groups for odd paths, unordered ones for even ones, members without an orientation among them."""
    steps = A.path_steps(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.concat("name", "orient").alias("t"))))
    text = F.concat(F.array_join(F.transform(ordered, lambda x: x["t"]), " "), F.lit(" other"))
    lines = steps.groupBy("path").agg(text.alias("t")).select(F.col("path").alias("line"), F.concat_ws("\t", F.when(F.col("path") % 2 == 1, "O").otherwise("U"), F.concat(F.lit("g"), "path"), "t").alias("value"))
    return T.gfa2_path_steps(lines).select("path", "pos", "name", "orient", "gap_after")


@query(f"with {A.BLOCKS} select query, q_len, q_st, q_en, strand, ref, r_len, r_st, r_en, matches::bigint as matches, block_len, nm, is_primary, mapq from blocks")
def paf_read(spark, sf_dir):
    rows = A.blocks(spark, sf_dir)
    text = F.concat_ws("\t", "query", "q_len", "q_st", "q_en", F.when(F.col("strand") < 0, "-").otherwise("+"), "ref", "r_len", "r_st", "r_en", "matches", "block_len", "mapq", F.concat(F.lit("NM:i:"), "nm"), F.concat(F.lit("tp:A:"), F.when(F.col("is_primary"), "P").otherwise("S")))
    found = T.paf_blocks(rows.select(F.monotonically_increasing_id().alias("line"), text.alias("value")))
    return found.select("query", "q_len", "q_st", "q_en", "strand", "ref", "r_len", "r_st", "r_en", "matches", "block_len", "nm", "is_primary", "mapq")


@query(f"""{_ORDERED}, e as (select 'scaffold_' || ref as object, pos, 0 as sub, 'W' as kind, 4000 as size, segment as component, orientation as orient, null::bigint as gap from members
  union all select 'scaffold_' || ref, pos, 1, case when raw > 0 then 'N' else 'U' end, greatest(raw, 100), null, null, greatest(raw, 100) from members where raw is not null)
select object, (sum(size) over w - size + 1)::bigint as beg, (sum(size) over w)::bigint as "end", row_number() over w as part, kind, component, orient, gap::bigint as gap, case kind when 'N' then 'align_genus' when 'U' then 'unspecified' end as evidence from e window w as (partition by object order by pos, sub rows unbounded preceding)""")
def agp_read(spark, sf_dir):
    lines = K.agp_text(_agp(spark, sf_dir), ("made for a test",)).select(F.monotonically_increasing_id().alias("line"), "value")
    return T.agp_rows(lines).select("object", "beg", "end", "part", "kind", "component", "orient", "gap", "evidence")


@query(f"""with {A.PATH_STEPS}, r as (select *, coalesce(sum(gap::int) over (partition by path order by pos rows between unbounded preceding and 1 preceding), 0) as g from path_steps), k as (select * from r where name[2:]::bigint % 10 <> 0)
select 'NODE_' || path as path, (row_number() over w - 1)::bigint as pos, name, orient, coalesce(lead(g) over w > g, false) as gap_after from k window w as (partition by path order by pos)""")
def contig_paths(spark, sf_dir):
    """Names and paths in turn, a line for each stretch between gaps, for both strands, over a graph without every tenth part."""
    steps = A.path_steps(spark, sf_dir)
    glue = F.when(F.col("pos") == F.max("pos").over(W.partitionBy("path")), "").when(F.col("gap"), ";\n").otherwise(",")
    texts = steps.select("path", "pos", F.concat("name", "orient", glue).alias("t")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("t"))
    both = F.concat(F.lit("NODE_"), "path", F.lit("\n"), "t", F.lit("\nNODE_"), "path", F.lit("'\n"), "t")
    lines = texts.select("path", F.posexplode(F.split(both, "\n")).alias("k", "value")).select((F.col("path") * 1000 + F.col("k")).alias("line"), "value")
    return T.contig_paths(lines, A.seg_part(spark, sf_dir).where("ord % 10 != 0"))


@query(f"""with {_L1} select 'S' as kind, name as a, null as b, length as n from seg_part union all select 'L', from_name || from_orient, to_name || to_orient, overlap from uniq""")
def gfa_file_loaded(spark, sf_dir):
    """A GFA of all parts and links, written to the shared folder and loaded from there as a session."""
    at = f"{Scratch(spark, 'files').path}/parts"
    segments = A.seg_part(spark, sf_dir).withColumn("depth", F.lit(None).cast("double"))
    K.write_lines(K.gfa_text(segments, _links(spark, sf_dir)), at, "rank", "ord")
    g = load(spark, at, "gfa").graph
    return g.segments.select(F.lit("S").alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b"), F.col("length").alias("n")).unionByName(g.links.select(F.lit("L").alias("kind"), F.concat("from_name", "from_orient").alias("a"), F.concat("to_name", "to_orient").alias("b"), F.col("overlap").alias("n")))


@query(f"""with {A.BLOCKS}, kept as (select * from blocks where matches >= 0.98 * block_len), o as (select query, q_st as st, q_en as en, max(q_en) over (partition by query order by q_st, q_en rows between unbounded preceding and 1 preceding) as m from kept),
i as (select *, sum(case when m is null or st > m then 1 else 0 end) over (partition by query order by st, en rows unbounded preceding) as k from o), cov as (select query, sum(e - s) as covered from (select query, k, min(st) as s, max(en) as e from i group by query, k) group by query),
n as (select o_orderkey as ord, o_custkey as cust, 'q' || o_orderkey as name, least(4000, coalesce(covered, 0)) as covered from orders left join cov on query = 'q' || o_orderkey),
s as (select cust, count(*) as contigs, count(*) * 4000 as length, sum(covered) as covered, min(ord) as first from n group by cust)
select (row_number() over (order by length desc, first) - 1)::bigint as component, contigs, length::bigint as length, covered::bigint as covered, false as circular, case when covered / length::double >= 0.4 then 'shared' when covered / length::double >= 0.2 then 'partial' else 'missing' end as status from s""")
def diff_components(spark, sf_dir):
    """One side of a comparison, customers' orders in chains as components, over blocks of at least 98 per cent."""
    segments, links = _side(spark, sf_dir), A.order_links(spark, sf_dir)
    turned = links.withColumns({c: F.regexp_replace(c, "^o", "q") for c in ("from_name", "to_name")})
    return D.score_side(segments, G.dedup_links(turned), A.blocks(spark, sf_dir), min_identity=0.98, shared=0.4, present=0.2)["components"]
