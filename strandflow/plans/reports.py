"""Queries about reports: whole tables as texts and as lines of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.operators import blocks as B, contiguity as C, report as H
from strandflow.plans import adapters as A
from strandflow.plans.graphs import _MIS, _primary
from strandflow.plans.registry import query

_INT = "format('{:,}', %s::bigint)"


def _bp(x: str) -> str:
    """SQL for a count of bases in its scaled form."""
    return f"case when {x} >= 1e9 then printf('%.2f Gb', {x} / 1e9::double) when {x} >= 1e6 then printf('%.2f Mb', {x} / 1e6::double) when {x} >= 1e4 then printf('%.1f kb', {x} / 1e3::double) when {x} >= 1e3 then printf('%.2f kb', {x} / 1e3::double) else {_INT % x} || ' bp' end"


def _span(x: str) -> str:
    """SQL for a count of bases, from 1000 on with its scaled form in brackets."""
    return f"{_INT % x} || case when {x} < 1000 then '' else ' (' || {_bp(x)} || ')' end"


_BREAKS = f"""{_MIS}, shown as (select query || chr(9) || printf('%020d', break_pos) as key, query as contig, kind, case when kind = 'local' then 'no' else 'yes' end as extensive, {_INT % 'break_pos'} as position,
  left_ref || ':' || {_INT % 'left_end'} || ' –> ' || case when left_ref <> right_ref then right_ref || ':' else '' end || {_INT % 'right_start'} as location,
  case when kind in ('relocation', 'local') then {_INT % 'gap'} else '–' end as ref_gap from events where kind is not null)"""


@query(f"{_BREAKS} select * from shown")
def report_breaks(spark, sf_dir):
    return H.break_rows(B.structural_differences(_primary(spark, sf_dir)))


_RANKED = f"""with {A.SEG_DOCS}, k as (select length, row_number() over w as k, sum(length) over w as cum, sum(length) over () as total from seg_docs window w as (order by length desc, ord rows unbounded preceding)),
one as (select count(*) as contigs, count(*) filter (where length >= 1000) as n1, count(*) filter (where length >= 10000) as n10, count(*) filter (where length >= 50000) as n50k, max(total) as total, coalesce(sum(length) filter (where length >= 1000), 0) as b1,
  max(length) as largest, min(length) as smallest, max(length) filter (where cum >= 0.5 * total) as n50, min(k) filter (where cum >= 0.5 * total) as l50, max(length) filter (where cum >= 0.75 * total) as n75, min(k) filter (where cum >= 0.75 * total) as l75 from k)"""
_SHOWN = [
    ("# contigs", _INT % "contigs"), ("# contigs >= 1 kb", _INT % "n1"), ("# contigs >= 10 kb", _INT % "n10"), ("# contigs >= 50 kb", _INT % "n50k"), ("Total length", _span("total")), ("Total length (>= 1 kb)", _span("b1")),
    ("Largest contig", _span("largest")), ("Smallest contig", _span("smallest")), ("N50", _span("n50")), ("L50", _INT % "l50"), ("N75", _span("n75")), ("L75", _INT % "l75"),
]


@query(f"{_RANKED} {' union all '.join(f'''select '{label}' as label, {value} as value from one''' for label, value in _SHOWN)}")
def report_rows(spark, sf_dir):
    docs = A.seg_docs(spark, sf_dir)
    one = C.contiguity(docs).crossJoin(F.broadcast(C.size_counts(docs)))
    return H.labelled(one.select("contigs", "n_1000", "n_10000", "n_50000", "total", "bases_1000", "largest", "smallest", "n50", "l50", "n75", "l75")).select("label", "value")


@query(f"""{_RANKED} select 'Contigs' as label, {_INT % 'contigs'} as value, {_INT % 'n1'} || ' >= 1 kb' as remark from one
  union all select 'Total length', {_bp('total')}, 'largest ' || {_bp('largest')} from one union all select 'N50', {_bp('n50')}, 'L50 ' || {_INT % 'l50'} from one""")
def report_cards(spark, sf_dir):
    docs = A.seg_docs(spark, sf_dir)
    return H.cards(C.contiguity(docs).crossJoin(F.broadcast(C.size_counts(docs)))).select("label", "value", "remark")


@query(f"""{_BREAKS}, named as (select *, case kind when 'inversion' then '<' || contig || ' & "inverted">' else contig end as c from shown)
select 1 as section, 1 as part, key, '<tr><td>' || replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td><td>' || kind || '</td><td>' || extensive || '</td><td>' || position || '</td><td>' || replace(location, '>', '&gt;') || '</td><td>' || ref_gap || '</td></tr>' as value from named""")
def report_page(spark, sf_dir):
    """The lines for all breaks, those of some contigs with a name that HTML must not take for a tag."""
    rows = H.break_rows(B.structural_differences(_primary(spark, sf_dir)))
    odd = F.when(F.col("kind") == "inversion", F.concat(F.lit("<"), "contig", F.lit(' & "inverted">'))).otherwise(F.col("contig"))
    return H.page("Breaks", {"Breaks": rows.withColumn("contig", odd)}).where("part = 1")
