"""The driver's tables as segments, links, paths and alignment blocks; every one also as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from strandflow.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments; a depth where a label is known."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("sequence"), F.col("n_chars").alias("length"), F.when(F.col("quality").isNotNull(), F.col("doc_id") % 40 + 1.0).cast("double").alias("depth"))


SEG_DOCS = """seg_docs as (select d.doc_id as ord, 'd' || d.doc_id as name, text as sequence, n_chars as length,
  case when quality is not null then (d.doc_id % 40 + 1)::double end as depth
  from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id))"""


def seg_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), "p_partkey").alias("name"), F.lit(None).cast("string").alias("sequence"), (F.col("p_size") * 100 + F.col("p_partkey") % 97).cast("long").alias("length"), F.round(F.col("p_retailprice") / 30, 3).alias("depth"))


SEG_PART = "seg_part as (select p_partkey as ord, 'p' || p_partkey as name, null::varchar as sequence, (p_size * 100 + p_partkey % 97)::bigint as length, round(p_retailprice / 30, 3) as depth from part)"

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order in their order, from 0 on, each with the part and the status of the next one: one sort for steps and links alike."""
    along = W.partitionBy("l_orderkey").orderBy(*_ORDER)
    rows = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER, "l_linestatus", "l_returnflag"), "l_orderkey")
    return rows.select(
        "l_orderkey", (F.row_number().over(along) - 1).cast("long").alias("pos"), "l_partkey", "l_linestatus", "l_quantity", "l_returnflag", F.lead("l_partkey").over(along).alias("part"), F.lead("l_linestatus").over(along).alias("status"),
    )


def _end(part: str, status: str) -> tuple[Column, Column]:
    return F.concat(F.lit("p"), part), F.when(F.col(status) == "O", "+").otherwise("-")


def path_steps(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """The lines of an order as the steps of a path through parts; ``known`` is what :func:`lines` has told, where it is written."""
    name, orient = _end("l_partkey", "l_linestatus")
    return (lines(spark, sf_dir) if known is None else known).select(F.col("l_orderkey").alias("path"), "pos", name.alias("name"), orient.alias("orient"), F.col("l_quantity").cast("long").alias("overlap"), (F.col("l_returnflag") == "N").alias("gap"))


PATH_STEPS = f"""path_steps as (select l_orderkey as path, row_number() over (partition by l_orderkey order by {', '.join(_ORDER)}) - 1 as pos,
  'p' || l_partkey as name, case when l_linestatus = 'O' then '+' else '-' end as orient, l_quantity::bigint as overlap, l_returnflag = 'N' as gap from lineitem)"""


def links(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Neighbouring steps of all paths as links, before any dedup; names are made behind the sort."""
    (name, orient), (to_name, to_orient) = _end("l_partkey", "l_linestatus"), _end("part", "status")
    rows = (lines(spark, sf_dir) if known is None else known).where("part is not null")
    return rows.select(
        (F.col("l_orderkey") * 100 + F.col("pos")).alias("ord"), name.alias("from_name"), orient.alias("from_orient"), to_name.alias("to_name"), to_orient.alias("to_orient"), F.col("l_quantity").cast("long").alias("overlap"),
    )


LINKS = """links_raw as (select path * 100 + pos as ord, name as from_name, orient as from_orient,
  lead(name) over (partition by path order by pos) as to_name, lead(orient) over (partition by path order by pos) as to_orient, overlap from path_steps),
links as (select * from links_raw where to_name is not null)"""


#: Links without repeats: the first spelling of a link and its reverse.
CANON = """keyed as (select *, translate(from_orient, '+-', '-+') as rf, translate(to_orient, '+-', '-+') as rt from links),
canon as (select *, case when (from_name, from_orient, to_name, to_orient) <= (to_name, rt, from_name, rf) then from_name || from_orient || to_name || to_orient else to_name || rt || from_name || rf end as ck from keyed),
uniq as (select * from canon qualify row_number() over (partition by ck order by ord) = 1),
adj as (select from_name as src, from_orient as src_o, to_name as dst, to_orient as dst_o, overlap from uniq
  union all select to_name, rt, from_name, rf, overlap from uniq where not (from_name = to_name and from_orient <> to_orient))"""


def seg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("name"), F.lit(None).cast("string").alias("sequence"), F.col("o_totalprice").cast("long").alias("length"), F.round(F.col("o_totalprice") / 1000, 3).alias("depth"))


SEG_ORDERS = "seg_orders as (select o_orderkey as ord, 'o' || o_orderkey as name, null::varchar as sequence, trunc(o_totalprice)::bigint as length, round(o_totalprice / 1000, 3) as depth from orders)"


def order_links(spark: SparkSession, sf_dir: str, rings: bool = False) -> DataFrame:
    """From each order of a customer to the next one: chains. With ``rings`` every third customer's last order
    leads to the first one."""
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    node = F.struct(F.concat(F.lit("o"), "o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "O", "+").otherwise("-").alias("orient"))
    after = F.lead(node).over(by)
    if rings:
        after = F.coalesce(after, F.when(F.col("o_custkey") % 3 == 0, F.first(node).over(by)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), node.alias("a"), after.alias("b")).where("b is not null")
    return rows.select("ord", F.col("a.name").alias("from_name"), F.col("a.orient").alias("from_orient"), F.col("b.name").alias("to_name"), F.col("b.orient").alias("to_orient"), F.lit(0).cast("long").alias("overlap"))


def ORDER_LINKS(rings: bool = False) -> str:
    last = "case when o_custkey % 3 = 0 then first(n) over w end" if rings else "null"
    return f"""nodes as (select *, {{'name': 'o' || o_orderkey, 'orient': case when o_orderstatus = 'O' then '+' else '-' end}} as n from orders),
nexts as (select o_orderkey as ord, n as a, coalesce(lead(n) over w, {last}) as b from nodes window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
links as (select ord, a.name as from_name, a.orient as from_orient, b.name as to_name, b.orient as to_orient, 0::bigint as overlap from nexts where b is not null)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as alignment blocks of one query."""
    by = W.partitionBy("l_orderkey").orderBy(*_ORDER)
    span = (F.col("l_quantity") * 50).cast("long")
    end = F.sum(span).over(by.rowsBetween(W.unboundedPreceding, 0))
    shift = F.when(F.col("l_partkey") % 6 == 3, 500).when(F.col("l_partkey") % 6 == 4, 5000).when(F.col("l_partkey") % 6 == 5, -3000).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").withColumn("q_en", end).withColumn("ord", F.row_number().over(by).cast("long"))
    q_st = F.col("q_en") - span
    r_st = F.lit(20_000) + q_st + shift
    nm = (F.round(F.col("l_discount") * 100)).cast("long")
    return rows.select(
        F.concat(F.lit("q"), "l_orderkey").alias("query"), "ord", F.lit(10_000).cast("long").alias("q_len"), q_st.alias("q_st"), "q_en", F.when(F.col("l_suppkey") % 8 == 0, -1).otherwise(1).alias("strand"),
        F.when(F.col("l_partkey") % 11 == 0, "r1").otherwise("r0").alias("ref"), F.lit(100_000).cast("long").alias("r_len"), r_st.alias("r_st"), (r_st + span).alias("r_en"), (span - nm).alias("matches"), span.alias("block_len"), nm.alias("nm"),
        (F.col("l_returnflag") != "A").alias("is_primary"), F.lit(60).alias("mapq"),
    )


BLOCKS = f"""blocks0 as (select *, (l_quantity * 50)::bigint as span, round(l_discount * 100)::bigint as nm,
  (sum((l_quantity * 50)::bigint) over (partition by l_orderkey order by {', '.join(_ORDER)} rows unbounded preceding))::bigint as q_en,
  row_number() over (partition by l_orderkey order by {', '.join(_ORDER)}) as ord from lineitem),
blocks as (select 'q' || l_orderkey as query, ord, 10000::bigint as q_len, q_en - span as q_st, q_en, case when l_suppkey % 8 = 0 then -1 else 1 end as strand,
  case when l_partkey % 11 = 0 then 'r1' else 'r0' end as ref, 100000::bigint as r_len,
  20000 + q_en - span + case l_partkey % 6 when 3 then 500 when 4 then 5000 when 5 then -3000 else 0 end as r_st,
  20000 + q_en + case l_partkey % 6 when 3 then 500 when 4 then 5000 when 5 then -3000 else 0 end as r_en,
  span - nm as matches, span as block_len, nm, l_returnflag <> 'A' as is_primary, 60 as mapq from blocks0)"""


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all orders as spans on the supplier's axis."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    st = (day * 40).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), "l_suppkey").alias("ref"), st.alias("st"), (st + (F.col("l_quantity") * 50).cast("long")).alias("en"))


COVER = "cover as (select 'r' || l_suppkey as ref, datediff('day', date '1995-01-01', l_shipdate::date) * 40 as st, datediff('day', date '1995-01-01', l_shipdate::date) * 40 + (l_quantity * 50)::bigint as en from lineitem)"
