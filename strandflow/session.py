"""A session: an assembly, what it is measured against, and where results go. Sessions are values; every
operation returns a new one."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandflow.functions.sequence import flip
from strandflow.operators import align as L, blocks as B, compare as D, contiguity as C, edits as E, links as G, paths as P, report as H, scaffold as S, tables as R
from strandflow.runtime import Scratch
from strandflow.sources import sinks as K, textio as T


class SessionError(RuntimeError):
    """An operation needs something that the session does not have yet."""


def _within(name: str, value: float, low: float | None = None, high: float | None = None) -> None:
    """Raise for a value that is no number or lies outside; 0 is a value like others."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        raise ValueError(f"{name} must be a number, got {value!r}")
    if (low is not None and value < low) or (high is not None and value > high):
        span = f"between {low} and {high}" if None not in (low, high) else f"at least {low}" if high is None else f"at most {high}"
        raise ValueError(f"{name} must be {span}, got {value}")


def load(spark: SparkSession, path: str, kind: str | None = None) -> Session:
    """Read an assembly from GFA, GFA2, FASTG or FASTA; overlaps that a file leaves out are measured."""
    lines = T.read_lines(spark, path)
    kind = kind or T.sniff([r["value"] for r in lines.limit(200).collect()], path)
    if kind == "unknown":
        raise T.FormatError(path, None, "no known format")
    no_links = spark.createDataFrame([], "ord long, from_name string, from_orient string, to_name string, to_orient string, overlap long")
    paths = None
    if kind == "gfa":
        T.check_strict(lines, path)
        segments, raw = T.gfa_segments(lines), T.gfa_links(lines)
    elif kind == "gfa2":
        segments, raw = T.gfa2_segments(lines), T.gfa2_links(lines)
    elif kind == "fastg":
        T.check_fastg(lines, path)
        segments, raw = T.fastg(lines)
    else:
        T.check_fasta(lines, path)
        segments, raw = T.fasta_segments(lines), no_links
    scratch = Scratch(spark, "loaded")  # every result starts from these tables
    segments = scratch.save(segments.select("ord", "name", "sequence", "length", "depth", *(["tags"] if kind in ("gfa", "gfa2") else [])), "segments")
    if segments.isEmpty():
        raise T.FormatError(path, None, "no segments")
    if kind == "gfa":
        paths = T.gfa_path_steps(lines, segments)
    elif kind == "gfa2":
        paths = T.gfa2_path_steps(lines)
    links = scratch.save(G.drop_dangling(G.dedup_links(raw), segments), "links")
    usual = T.modal_overlap(raw).first()[0] if kind in ("gfa", "gfa2") else None
    if kind in ("gfa", "fastg"):
        links, found = P.adopt_overlap(links, segments)
        usual = found or usual
    return Session(spark, E.Graph(segments, links), paths=paths, default_overlap=usual or 0)


#: of the folders that ``Session.save`` writes
VERSION = 1


def open_session(spark: SparkSession, folder: str) -> Session:
    """The session that ``Session.save`` wrote to ``folder``, with the graphs it can go back to."""
    about = spark.read.json(f"{folder}/about", "version int, tables array<string>, past int, circular boolean, min_contig int, default_overlap long").first()
    if about is None or about["version"] != VERSION:
        raise SessionError(f"{folder} holds no session of version {VERSION}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    past = tuple(E.Graph(read(f"past{k}/segments"), read(f"past{k}/links")) for k in range(about["past"]))
    graph = E.Graph(read("graph/segments"), read("graph/links"), past)
    return Session(spark, graph, circular=about["circular"], min_contig=about["min_contig"], default_overlap=about["default_overlap"], **{t: read(t) for t in about["tables"]})


@dataclass(frozen=True)
class Session:
    spark: SparkSession
    graph: E.Graph
    reference: DataFrame | None = None
    blocks: DataFrame | None = None
    plan: DataFrame | None = None
    paths: DataFrame | None = None
    circular: bool = True
    min_contig: int = 0
    default_overlap: int = 0

    def with_reference(self, path: str, preset: str = "asm10") -> Session:
        """Aligned against the FASTA at ``path``; the blocks are a written table, as every result starts from them."""
        lines = T.read_lines(self.spark, path)
        T.check_fasta(lines, path)
        reference = T.fasta_records(lines).select("name", "sequence")
        blocks = L.align(self.graph.segments, reference, preset, min_length=max(200, self.min_contig))
        return replace(self, reference=reference, blocks=Scratch(self.spark, "session").save(blocks, "blocks"))

    def with_blocks(self, paf: str) -> Session:
        """Alignments of another program, as PAF."""
        return replace(self, blocks=B.split_at_long_indels(T.paf_blocks(T.read_lines(self.spark, paf))))

    def _need(self, what: str) -> DataFrame:
        if (value := getattr(self, what)) is None:
            raise SessionError(f"no {what} yet")
        return value

    def edit(self, operation: str, **options) -> Session:
        """add_segments, add_links, delete, remove_links, filter, simplify, merge_path, split, reverse or break_differences; a plan
        does not outlive an edit. ``attached_paths`` tells which paths do."""
        known = {"add_segments": E.add_segments, "add_links": E.add_links, "delete": E.delete, "filter": E.filter_graph, "simplify": E.simplify, "split": E.split_segments, "reverse": E.reverse_segment, "merge_path": E.merge_path, "remove_links": E.remove_links}
        if operation == "break_differences":
            graph = E.break_differences(self.graph, B.structural_differences(B.usable(self._need("blocks")), circular=self.circular), **options)
        elif operation in known:
            graph = known[operation](self.graph, **options)
        else:
            raise SessionError(f"unknown operation {operation!r}")
        paths = self.paths
        if paths is not None and operation == "reverse":
            hit = options["names"].select("name").distinct().withColumn("hit", F.lit(True))
            turned = F.when(F.col("hit"), flip("orient")).otherwise(F.col("orient"))
            paths = paths.join(hit, "name", "left").withColumn("orient", turned).select(*self.paths.columns)
        return replace(self, graph=graph, plan=None, paths=paths)

    def attach_paths(self, steps: DataFrame) -> Session:
        """With these paths ``(ord, path, pos, name, orient, gap_after)`` in place of the ones so far."""
        return replace(self, paths=steps)

    def attached_paths(self) -> DataFrame | None:
        """The paths whose segments all exist."""
        if self.paths is None:
            return None
        lost = self.paths.join(self.graph.segments.select("name"), "name", "left_anti").select("path").distinct()
        return self.paths.join(lost, "path", "left_anti").select(*self.paths.columns)

    def undo(self) -> Session:
        return replace(self, graph=self.graph.undo(), plan=None)

    def metrics(self, genome_size: int | None = None) -> DataFrame:
        """One row of length, depth, composition and topology statistics."""
        if genome_size is not None:
            _within("genome_size", genome_size, 0)
        own = self.graph.segments.where(F.col("length") >= self.min_contig)
        depths = C.depth_summary(own)
        plain = C.contiguity(own, genome_size).crossJoin(F.broadcast(depths)).crossJoin(F.broadcast(C.composition(own)))
        return plain.crossJoin(F.broadcast(C.size_counts(own))).crossJoin(F.broadcast(G.topology(own, self.graph.links, depths)))

    def evaluation(self, genome_size: int | None = None) -> dict[str, DataFrame]:
        """What the alignments say: coverage of references and contigs, breaks, rates, totals, aligned contiguity."""
        used = B.usable(self._need("blocks"))
        lengths = self._need("reference").select(F.col("name").alias("ref"), F.length("sequence").cast("long").alias("length"))
        contigs = self.graph.segments.select(F.col("name").alias("query"), "length")
        events = B.structural_differences(used, circular=self.circular)
        references, covered = B.reference_coverage(used, lengths), B.query_coverage(used, contigs)
        out = {"references": references, "contigs": covered, "breaks": events, "counts": B.difference_counts(events), "rates": B.rates(used)}
        return {**out, "totals": B.alignment_totals(references, covered, events), "aligned": B.aligned_contiguity(used, genome_size, circular=self.circular)}

    def compare(self, other: Session, preset: str = "asm10", *, min_identity: float = 0.0, shared: float = D.SHARED, present: float = D.PRESENT) -> dict[str, DataFrame]:
        """Both sides of a content comparison: ``contigs_a``, ``components_a``, ``matches_a``, ``uncovered_a``, ``summary_a`` and the same of b.
        Blocks are not cut at long deletions, so what the other side lacks in the middle of a contig counts as uncovered."""
        _within("min_identity", min_identity, 0, 1)
        for side in (self, other):
            if side.graph.segments.where("sequence != ''").isEmpty():
                raise SessionError("a side without sequences, so there is nothing to compare")
        out = {}
        for side, a, b in (("a", self, other), ("b", other, self)):
            blocks = Scratch(self.spark, "compare").save(L.align(a.graph.segments, b.graph.segments, preset, min_indel=None), "blocks")
            found = D.score_side(a.graph.segments, a.graph.links, blocks, min_identity=min_identity, shared=shared, present=present)
            out |= {f"{name}_{side}": table for name, table in found.items()}
        return out

    def write_comparison(self, other: Session, folder: str, labels: tuple[str, str] = ("a", "b"), *, min_span: int = 200, mode: str = "errorifexists", **options) -> None:
        """The comparison as files below ``folder``: for each side what only it has as FASTA, its contigs and its components. Labels keep
        letters, digits, dots, dashes and underscores, and are numbered if they come out alike."""
        made = [re.sub(r"[^\w.-]", "_", x) for x in labels]
        made[1] += "_2" if made[0] == made[1] else ""
        found = self.compare(other, **options)
        for side, label, own in (("a", made[0], self), ("b", made[1], other)):
            K.comparison_files(own.graph.segments, found[f"contigs_{side}"], found[f"uncovered_{side}"], found[f"components_{side}"], folder, label, min_span, mode)

    def scaffold(self, method: str = "reference", **options) -> Session:
        """With a plan along the references, its gaps filled from the graph and its overlaps trimmed, or along the graph's chains."""
        if method == "graph":
            plan = S.plan_by_chains(G.chains(self.graph.links, self.graph.segments), self.graph.segments)
            return replace(self, plan=Scratch(self.spark, "session").save(plan, "plan"))
        return replace(self, plan=S.scaffold_by_reference(self._need("blocks"), self.graph.segments, self.graph.links, **options))

    def scaffold_rows(self, min_gap: int = S.MIN_GAP) -> DataFrame:
        """The plan as AGP rows."""
        return S.agp(self._need("plan"), self.graph.segments, self.graph.links, min_gap)

    def scaffold_warnings(self) -> DataFrame:
        """What to know about the plan: members that are missing, joins without a link, segments written twice."""
        return S.plan_warnings(self._need("plan"), self.graph.segments, self.graph.links)

    def scaffold_preview(self) -> DataFrame:
        """One row about the scaffolds that the plan makes."""
        return S.preview(self._need("plan"), self.scaffold_rows())

    def path_sequences(self) -> DataFrame:
        """``(path, sequence, length)`` of the paths whose segments all exist; steps without a link overlap by the usual number."""
        steps = self.attached_paths()
        if steps is None:
            raise SessionError("no paths yet")
        return G.walk_sequences(steps.select("path", "pos", "name", "orient"), self.graph.links, self.graph.segments, self.default_overlap)

    def search(self, text: str, *, min_identity: float = 0.8, min_length: int = 30, max_hits: int = 500) -> DataFrame:
        """The best hits (see ``operators.hits``) of a sequence or of FASTA text."""
        _within("min_identity", min_identity, 0, 1)
        _within("min_length", min_length, 0)
        _within("max_hits", max_hits, 1)
        return L.search(self.graph.segments, L.parse_query(self.spark, text), min_identity=min_identity, min_length=min_length, max_hits=max_hits)

    def find(self, text: str, exact: bool = False) -> DataFrame:
        """Segments by name (see ``paths.find_names``)."""
        return P.find_names(self.graph.segments, text, exact)

    def status(self) -> dict:
        g = self.graph
        return {"segments": g.segments.count(), "links": g.links.count(), "bases": g.segments.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], "reference": self.reference is not None, "plan": self.plan is not None, "undo": len(g.past), **L.capabilities()}

    def export(self, folder: str, what: tuple[str, ...] = ("gfa", "fasta", "csv"), mode: str = "errorifexists") -> None:
        """Write gfa, fasta, csv, agp or scaffolds below ``folder``."""
        g = self.graph
        for kind in what:
            at = f"{folder}/{kind}"
            if kind == "gfa":
                K.write_lines(K.gfa_text(g.segments, g.links, self.attached_paths()), at, "rank", "ord", mode=mode)
            elif kind == "fasta":
                K.write_lines(K.fasta_text(g.segments.where("sequence != ''")), at, "ord", mode=mode)
            elif kind == "csv":
                self.segment_table().write.mode(mode).option("header", True).csv(at)
            elif kind in ("agp", "scaffolds"):
                rows = self.scaffold_rows()
                if kind == "agp":
                    K.write_lines(K.agp_text(rows), at, "object", "part", mode=mode)
                else:
                    made = S.scaffold_sequences(rows, g.segments).withColumn("ord", F.col("name"))
                    K.write_lines(K.fasta_text(made), at, "ord", mode=mode)
            else:
                raise SessionError(f"unknown export {kind!r}")

    def segment_table(self) -> DataFrame:
        """One row of 15 columns for each segment."""
        return R.segment_table(self.graph.segments, self.graph.links, self.blocks, self.plan)

    def comparison_table(self, others: dict[str, Session], name: str = "this", genome_size: int | None = None) -> DataFrame:
        """The metrics of assemblies side by side, as texts."""
        return R.comparison_table({n: s.metrics(genome_size) for n, s in ({name: self} | others).items()})

    def report(self, folder: str, *, title: str = "Assembly report", genome_size: int | None = None, others: dict[str, Session] | None = None, contigs: int | None = 2000, mode: str = "errorifexists") -> None:
        """Write a page of HTML below ``folder``. Alignments, a plan and other assemblies each add their sections; ``contigs`` is how many
        of the longest segments are listed, None for all."""
        scratch = Scratch(self.spark, "report")
        kept = lambda df, name: scratch.save(df, name)
        metrics, table = kept(self.metrics(genome_size), "metrics"), self.segment_table()
        reference = plan = None
        parts = {"Assembly": H.labelled(metrics), "Contigs": H.contig_rows(kept(table.where(F.col("length") >= self.min_contig), "contigs"), contigs)}
        if self.blocks is not None and self.reference is not None:
            found = self.evaluation(genome_size)
            found = found | {"breaks": kept(found["breaks"], "breaks")}
            reference = kept(H.reference_row(found | {"counts": B.difference_counts(found["breaks"])}), "reference")
            sequences = H.longest(found["references"], {"ref": "", "length": "span", "covered": "span", "percent": "pct"}, "ref", 400)
            parts |= {"Reference": H.labelled(reference, H.REFERENCE), "Coverage of references": sequences, "Misassemblies": H.break_rows(found["breaks"])}
        if self.plan is not None:
            plan = kept(self.scaffold_preview().withColumn("unplaced", F.col("members") - F.col("placed")), "scaffolds")
            warnings = self.scaffold_warnings().select(F.concat_ws("\t", "scaffold", "kind", "detail").alias("key"), "scaffold", "kind", "detail")
            parts |= {"Scaffolds": H.labelled(plan, H.SCAFFOLDS), "Members of scaffolds": H.member_rows(self.plan), "Warnings": warnings}
        if others:
            parts["Comparison"] = self.comparison_table(others, genome_size=genome_size).select(H.number_key(F.col("ord")).alias("key"), "label", "this", *others)
        H.write_page(H.page(title, {"Overview": H.cards(metrics, reference, plan)} | parts), folder, mode)

    def comparison_report(self, other: Session, folder: str, labels: tuple[str, str] = ("a", "b"), *, title: str = "Comparison", components: int = 60, contigs: int = 400, mode: str = "errorifexists", **options) -> None:
        """Write the comparison as a page of HTML below ``folder``: for each side its sums, and the longest components and contigs that the
        other side lacks."""
        found, parts = self.compare(other, **options), {}
        for side, label in zip(("a", "b"), labels, strict=True):
            lacking = lambda name, side=side: found[f"{name}_{side}"].where("status = 'missing'")
            parts |= {
                f"{label}: content": H.labelled(found[f"summary_{side}"], H.SIDE),
                f"{label}: components of its own": H.longest(lacking("components"), {"component": "", "contigs": "int", "length": "span", "covered": "span", "circular": ""}, "component", components),
                f"{label}: contigs of its own": H.longest(lacking("contigs"), {"name": "", "length": "span", "covered": "span", "best_match": "", "best_identity": "float"}, "name", contigs),
            }
        H.write_page(H.page(title, parts), folder, mode)

    def write_plan(self, path: str, mode: str = "errorifexists") -> None:
        """The plan as a document that can be edited: a line of JSON for each member. ``with_plan`` takes it back."""
        self._need("plan").repartitionByRange("ord", "pos").sortWithinPartitions("ord", "pos").write.mode(mode).json(path)

    def with_plan(self, path: str) -> Session:
        """With the plan of a document; scaffolds, order, orientation, gaps and walks may have been edited."""
        return replace(self, plan=self.spark.read.json(path, S.PLAN))

    def save(self, folder: str, mode: str = "errorifexists") -> None:
        """Write all there is, the graphs that ``undo`` goes back to among it, below ``folder``; ``open_session`` reads it."""
        tables = [t for t in ("reference", "blocks", "plan", "paths") if getattr(self, t) is not None]
        for t in tables:
            getattr(self, t).write.mode(mode).parquet(f"{folder}/{t}")
        for at, graph in [("graph", self.graph), *((f"past{k}", g) for k, g in enumerate(self.graph.past))]:
            graph.segments.write.mode(mode).parquet(f"{folder}/{at}/segments")
            graph.links.write.mode(mode).parquet(f"{folder}/{at}/links")
        about = [(VERSION, tables, len(self.graph.past), self.circular, self.min_contig, self.default_overlap)]
        self.spark.createDataFrame(about, "version int, tables array<string>, past int, circular boolean, min_contig int, default_overlap long").write.mode(mode).json(f"{folder}/about")
