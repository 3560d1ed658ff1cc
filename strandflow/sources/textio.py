"""Reading the text formats of assembly graphs: lines become typed tables.

A file is read as ``(line, value)``. ``line`` grows with the position in the file but need not be dense, so
"first" and "last" mean what they mean in the file. Fields are split inside the JVM; nothing is inferred.
Malformed records either raise (``strict``) or are left out; ``bad_records`` lists them.
"""

from __future__ import annotations

import gzip
import os
import stat
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from strandflow.functions.sequence import cigar, cigar_overlap, depth_from_name, depth_from_tags, length_from_name, let, parse_tags, revcomp
from strandflow.operators.names import numbered


class FormatError(ValueError):
    """A malformed record: path, line and the start of its text."""

    def __init__(self, path: str, line: int | None, text: str):
        super().__init__(f"{path}, line {line}: {text[:200]!r}")
        self.path, self.line, self.text = path, line, text[:200]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` of a text file or a folder of them, plain or compressed: by suffix, and gzip without its suffix by its first two
    bytes. A local path must be a regular file or a folder, since it is read more than once."""
    if "://" not in path and os.path.exists(path):
        mode = os.stat(path).st_mode
        if not (stat.S_ISREG(mode) or stat.S_ISDIR(mode)):
            raise FormatError(path, None, "not a regular file")
    plain, zipped = _told_apart(spark, path)
    if not zipped:
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    texts = spark.read.format("binaryFile").load(zipped).select("content").mapInArrow(_unzipped, "value string")
    texts = texts if not plain else spark.read.text(plain).unionByName(texts)
    return texts.select(F.monotonically_increasing_id().alias("line"), "value")


def _told_apart(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files of ``path`` as (others, gzip files without the suffix): two bytes of each are looked at."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found: tuple[list[str], list[str]] = [], []
    for status in fs.globStatus(at) or []:
        for one in fs.listStatus(status.getPath()):
            name = one.getPath().getName()
            if one.isFile() and name[0] not in "._":
                stream = None if name.endswith((".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4", ".xz")) else fs.open(one.getPath())
                magic = (stream.read(), stream.read()) if stream else ()
                if stream:
                    stream.close()
                found[magic == (0x1F, 0x8B)].append(one.getPath().toString())
    return found


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of gzip files, some thousands at a time."""
    for batch in batches:
        for content in batch.column(0):
            with gzip.open(pa.BufferReader(content.as_buffer()), "rt", encoding="utf-8", errors="replace", newline="\n") as text:
                while lines := list(islice(text, 10_000)):
                    yield pa.RecordBatch.from_pydict({"value": [x.rstrip("\n") for x in lines]}, pa.schema([("value", pa.string())]))


def sniff(head: list[str], name: str = "") -> str:
    """gfa, gfa2, fastg, fasta or unknown, from the first lines of a file and its name."""
    for text in head[:200]:
        f = text.rstrip("\r\n").split("\t")
        kind = f[0]
        if kind == "H" and any(x.startswith("VN:Z:2") for x in f[1:]):
            return "gfa2"
        if kind == "S" and len(f) >= 3:
            return "gfa2" if len(f) >= 4 and f[2].isdigit() else "gfa"
        if kind in ("E", "G", "O", "U") and len(f) > 1:
            return "gfa2"
        if kind in ("L", "P", "W") and len(f) > 1:
            return "gfa"
        if text.startswith(">"):
            return "fastg" if name.lower().removesuffix(".gz").endswith(".fastg") or text.rstrip().endswith(";") else "fasta"
    suffix = os.path.splitext(name.lower().removesuffix(".gz"))[1]
    return {".gfa": "gfa", ".gfa1": "gfa", ".gfa2": "gfa2", ".fastg": "fastg", ".fa": "fasta", ".fasta": "fasta", ".fna": "fasta"}.get(suffix, "unknown")


def _fields() -> Column:
    value = F.col("value")
    return F.split(F.rtrim(F.when(value.contains("\r"), F.regexp_replace(value, r"\r$", "")).otherwise(value)), "\t")


def _split(lines: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the lines and their fields ``f``. An explode of one array each: a condition on fields would else be moved before the
    split, and split the line again for every field it asks for."""
    return lines.select(*columns, F.explode(F.array(_fields())).alias("f"))


def records(lines: DataFrame, kind: str) -> DataFrame:
    return _split(lines.where(F.col("value").startswith(kind + "\t")), "line")


def gfa_segments(lines: DataFrame) -> DataFrame:
    """S lines as ``(ord, name, sequence, length, depth, tags)``. Of a name that comes twice the last content
    counts, at the place of the first."""
    f = F.col("f")
    rows = records(lines, "S").where(F.size("f") >= 3).select("line", F.get(f, F.lit(1)).alias("name"), F.upper(F.when(F.get(f, F.lit(2)) != "*", F.get(f, F.lit(2)))).alias("sequence"), parse_tags(F.slice("f", F.lit(4), F.size("f"))).alias("tags"))
    stated = F.coalesce(F.try_element_at("tags", F.lit("LN"))["value"].try_cast("long"), F.try_element_at("tags", F.lit("ln"))["value"].try_cast("long"), length_from_name("name"), F.lit(0))
    rows = rows.withColumn("length", F.when(F.length("sequence") > 0, F.length("sequence").cast("long")).otherwise(stated))
    rows = rows.withColumn("depth", F.coalesce(depth_from_tags(F.col("tags"), F.col("length")), depth_from_name("name")))
    last = F.max_by(F.struct("sequence", "length", "depth", F.map_entries("tags").alias("tags")), "line")
    return rows.groupBy("name").agg(F.min("line").alias("ord"), last.alias("x")).select("ord", "name", "x.sequence", "x.length", "x.depth", F.map_from_entries("x.tags").alias("tags"))


def gfa_links(lines: DataFrame) -> DataFrame:
    """L lines as ``(ord, from_name, from_orient, to_name, to_orient, overlap, cigar)``, before any dedup."""
    f = F.col("f")
    text = F.coalesce(F.get("f", F.lit(5)), F.lit("*"))
    rows = records(lines, "L").where((F.size("f") >= 5) & F.get(f, F.lit(2)).isin("+", "-") & F.get(f, F.lit(4)).isin("+", "-"))
    return rows.select(F.col("line").alias("ord"), F.get(f, F.lit(1)).alias("from_name"), F.get(f, F.lit(2)).alias("from_orient"), F.get(f, F.lit(3)).alias("to_name"), F.get(f, F.lit(4)).alias("to_orient"), cigar_overlap(text).alias("overlap"), text.alias("cigar"))


def _steps(text: Column) -> Column:
    """Steps of a P line: ``;`` is a scaffold gap, ``,`` a neighbour; tokens without an orientation are skipped."""
    runs = F.transform(F.split(text, ";"), lambda run: F.filter(F.split(run, ","), lambda t: t.rlike("^.+[+-]$")))
    step = lambda t, gap: F.struct(t.substr(F.lit(1), F.length(t) - 1).alias("name"), F.right(t, F.lit(1)).alias("orient"), gap.alias("gap_after"))
    inside = lambda r, more: F.transform(r, lambda t, j: step(t, (j == F.size(r) - 1) & more))
    return let(F.filter(runs, lambda r: F.size(r) > 0), lambda full: F.flatten(F.transform(full, lambda r, i: inside(r, i < F.size(full) - 1))))


def gfa_path_steps(lines: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """P and W lines as ``(ord, path, pos, name, orient, gap_after)``; with ``segments``, paths that name an
    unknown one are dropped."""
    f = F.col("f")
    walk = lambda k: F.regexp_extract_all(F.get(f, F.lit(6)), F.lit("([<>])([^<>]+)"), F.lit(k))
    zipped = F.transform(F.arrays_zip(walk(1).alias("o"), walk(2).alias("n")), lambda x: F.struct(x["n"].alias("name"), F.when(x["o"] == ">", "+").otherwise("-").alias("orient"), F.lit(False).alias("gap_after")))
    plain, name = F.get(f, F.lit(0)) == "P", lambda k: F.get(f, F.lit(k))
    both = _split(lines.where(F.col("value").startswith("P\t") | F.col("value").startswith("W\t")), "line").where(F.size("f") >= F.when(plain, 3).otherwise(7))
    made = both.select(F.col("line").alias("ord"), F.when(plain, name(1)).otherwise(F.concat_ws("_", name(1), name(3))).alias("path"), F.when(plain, _steps(name(2))).otherwise(zipped).alias("s"))
    rows = made.select("ord", "path", F.posexplode("s").alias("pos", "x")).select("ord", "path", F.col("pos").cast("long").alias("pos"), "x.*")
    if segments is None:
        return rows
    bad = rows.join(segments.select("name"), "name", "left_anti").select("ord").distinct()
    return rows.join(bad, "ord", "left_anti").select("ord", "path", "pos", "name", "orient", "gap_after")


def modal_overlap(links: DataFrame) -> DataFrame:
    """One row: the most frequent overlap over all links, ties to the one seen first."""
    return links.groupBy("overlap").agg(F.count("*").alias("n"), F.min("ord").alias("first")).agg(F.max_by("overlap", F.struct("n", -F.col("first"))).alias("overlap"))


def bad_records(lines: DataFrame) -> DataFrame:
    """Lines of a GFA that no reader here takes: ``(line, value)``."""
    f, kind = F.col("f"), F.substring("value", 1, 1)
    short = (kind == "S") & (F.size(f) < 3) | (kind == "L") & ((F.size(f) < 5) | ~F.coalesce(F.get(f, F.lit(2)).isin("+", "-") & F.get(f, F.lit(4)).isin("+", "-"), F.lit(False))) | (kind == "P") & (F.size(f) < 3) | (kind == "W") & (F.size(f) < 7)
    return _split(lines.where(kind.isin("S", "L", "P", "W")), "line", "value").where(short).select("line", F.substring("value", 1, 200).alias("value"))


def _line_number(lines: DataFrame, line: int) -> int:
    """Where in the file, from 1 on, the record of this ``line`` stands; asked for when it is to be reported."""
    return lines.where(F.col("line") < line).count() + 1


def check_strict(lines: DataFrame, path: str = "input", kinds: str = "SLPW") -> None:
    """Raise for the first malformed record of these kinds."""
    first = bad_records(lines).where(F.substring("value", 1, 1).isin(*kinds)).orderBy("line").limit(1).collect()
    if first:
        raise FormatError(path, _line_number(lines, first[0]["line"]), first[0]["value"])


def check_fasta(lines: DataFrame, path: str = "input") -> None:
    """Raise for an empty header, for sequence before the first header, for a file without records and for a name
    that comes twice."""
    rows = lines.where(~F.col("value").rlike(r"^\r?$") & ~F.col("value").startswith(";"))
    header = F.col("value").startswith(">")
    first = rows.agg(F.min(F.when(header, F.col("line"))).alias("h"), F.min_by("line", "line").alias("any"), F.min(F.when(header & F.col("value").rlike(r"^>\s*$"), F.col("line"))).alias("bare")).first()
    wrong = first["any"] if first["any"] is not None and (first["h"] is None or first["any"] < first["h"]) else first["bare"]
    if wrong is not None:
        raise FormatError(path, _line_number(lines, wrong), lines.where(F.col("line") == wrong).first()["value"])
    if first["h"] is None:
        raise FormatError(path, None, "no FASTA records")
    name = F.regexp_extract("value", r"^>\s*(\S+)", 1)
    twice = lines.where(header).groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1").orderBy("line").limit(1).collect()
    if twice:
        raise FormatError(path, _line_number(lines, twice[0]["line"]), f"repeated name {twice[0]['name']}")


def gfa2_segments(lines: DataFrame) -> DataFrame:
    f = F.col("f")
    seq = F.upper(F.when(F.get(f, F.lit(3)) != "*", F.get(f, F.lit(3))))
    rows = records(lines, "S").where(F.size("f") >= 4).withColumn("tags", parse_tags(F.slice("f", F.lit(5), F.size("f"))))
    rows = rows.select(F.col("line").alias("ord"), F.get(f, F.lit(1)).alias("name"), seq.alias("sequence"), F.coalesce(F.length(seq).cast("long"), F.get(f, F.lit(2)).try_cast("long"), F.lit(0)).alias("length"), "tags")
    return rows.withColumn("depth", depth_from_tags(F.col("tags"), F.col("length")))


def gfa2_links(lines: DataFrame) -> DataFrame:
    """E lines; the overlap is the span on the first segment, ``$`` ignored."""
    f = F.col("f")
    number = lambda k: F.regexp_replace(F.get(f, F.lit(k)), r"\$$", "").try_cast("long")
    name, orient = (lambda k: F.get(f, F.lit(k)).substr(F.lit(1), F.length(F.get(f, F.lit(k))) - 1)), (lambda k: F.right(F.get(f, F.lit(k)), F.lit(1)))
    rows = records(lines, "E").where(F.size("f") >= 8)
    return rows.select(F.col("line").alias("ord"), name(2).alias("from_name"), orient(2).alias("from_orient"), name(3).alias("to_name"), orient(3).alias("to_orient"), F.greatest(F.lit(0), F.coalesce(number(5) - number(4), F.lit(0))).cast("long").alias("overlap"))


def gfa2_path_steps(lines: DataFrame) -> DataFrame:
    """O and U lines, ordered and unordered groups, as ``(ord, path, pos, name, orient, gap_after)``: their members that state an
    orientation, in the order of the line."""
    f = F.col("f")
    rows = records(lines, "O").unionByName(records(lines, "U")).where(F.size("f") >= 3)
    members = F.filter(F.split(F.get(f, F.lit(2)), r"\s+"), lambda t: t.rlike("^.+[+-]$"))
    steps = rows.select(F.col("line").alias("ord"), F.get(f, F.lit(1)).alias("path"), F.posexplode(members).alias("pos", "t"))
    return steps.select("ord", "path", F.col("pos").cast("long").alias("pos"), F.col("t").substr(F.lit(1), F.length("t") - 1).alias("name"), F.right("t", F.lit(1)).alias("orient"), F.lit(False).alias("gap_after"))


#: Lines are numbered and counted in stretches of 2^24 numbers, of which a partition of a file has one or a few.
_STRETCH = 24


def _counted(rows: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``record``, the running sum of ``flag`` in the order of lines: each stretch counts its own and adds what
    stands before it, so that no task sees the whole file."""
    rows = rows.withColumn("part", F.shiftright("line", _STRETCH))
    counts = rows.groupBy("part").agg(F.sum(flag).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum(flag).over(W.partitionBy("part").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("own", inside).join(F.broadcast(before), "part").withColumn("record", F.col("own") + F.col("before")).drop("own", "before", "part")


def fasta_records(lines: DataFrame) -> DataFrame:
    """``(ord, name, description, sequence)`` of multi-line FASTA; ``;`` lines are comments.

    A record is numbered by the running count of headers.
    """
    rows = lines.where(~F.col("value").startswith(";")).withColumn("head", F.col("value").startswith(">").cast("int"))
    numbered = _counted(rows, "head").where("record > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("line", F.trim("value").alias("v"))))), lambda x: x["v"]), "")
    header = F.max(F.when(F.col("head") == 1, F.expr("substring(value, 2)")))
    out = numbered.groupBy("record").agg(F.min("line").alias("ord"), header.alias("header"), body.alias("sequence"))
    return out.select("ord", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("name"), F.trim(F.regexp_extract("header", r"^\s*\S+\s*(.*)$", 1)).alias("description"), "sequence")


def fasta_segments(lines: DataFrame) -> DataFrame:
    """FASTA as segments without links: upper case, depth from the name."""
    return fasta_records(lines).select("ord", "name", F.upper("sequence").alias("sequence"), F.length("sequence").cast("long").alias("length"), depth_from_name("name").alias("depth"), "description")


def fastg(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and links of FASTG: ``>edge:next1,next2';``; a quote is the reverse strand. Of the two strands
    of an edge the forward one is kept, or the reverse complement of the other."""
    rows = fasta_records(lines).withColumn("h", F.regexp_replace("name", ";$", "")).withColumn("own", F.split("h", ":")[0])
    rows = rows.withColumn("edge", F.regexp_replace("own", "'$", "")).withColumn("minus", F.col("own").endswith("'"))
    best = F.min_by(F.struct(F.when(F.col("minus"), revcomp("sequence")).otherwise(F.col("sequence")).alias("sequence")), F.struct("minus", "ord"))
    segments = rows.groupBy(F.col("edge").alias("name")).agg(F.min("ord").alias("ord"), best.alias("x")).select("ord", "name", F.upper("x.sequence").alias("sequence"), F.length("x.sequence").cast("long").alias("length"), depth_from_name("name").alias("depth"))
    nexts = rows.where(F.col("h").contains(":")).select("ord", "edge", "minus", F.posexplode(F.split(F.split("h", ":")[1], ",")).alias("k", "t")).where("t != ''")
    orient = lambda c: F.when(c, "-").otherwise("+")
    links = numbered(nexts.withColumnRenamed("ord", "line"), "line", "k").select("ord", F.col("edge").alias("from_name"), orient(F.col("minus")).alias("from_orient"), F.regexp_replace("t", "'$", "").alias("to_name"), orient(F.col("t").endswith("'")).alias("to_orient"), F.lit(0).cast("long").alias("overlap"))
    return segments, links


def paf_blocks(lines: DataFrame) -> DataFrame:
    """PAF lines as alignment blocks; shorter lines than twelve fields are skipped."""
    f = F.col("f")
    rows = _split(lines, "line").where(F.size("f") >= 12).withColumn("tags", parse_tags(F.slice("f", F.lit(13), F.size("f"))))
    number = lambda k: F.get(f, F.lit(k)).try_cast("long")
    tag = lambda t: F.try_element_at("tags", F.lit(t))["value"]
    return rows.select(
        F.get(f, F.lit(0)).alias("query"), F.col("line").alias("ord"), number(1).alias("q_len"), number(2).alias("q_st"), number(3).alias("q_en"), F.when(F.get(f, F.lit(4)) == "-", -1).otherwise(1).alias("strand"), F.get(f, F.lit(5)).alias("ref"), number(6).alias("r_len"),
        number(7).alias("r_st"), number(8).alias("r_en"), number(9).alias("matches"), number(10).alias("block_len"), F.coalesce(tag("NM").try_cast("long"), F.lit(0)).alias("nm"), (F.coalesce(tag("tp"), F.lit("P")) == "P").alias("is_primary"),
        number(11).cast("int").alias("mapq"), cigar(F.coalesce(tag("cg"), F.lit(""))).alias("cigar"),
    )


def check_agp(lines: DataFrame, path: str = "input") -> None:
    """Raise for the first row of an AGP that lacks fields or holds something else where a number belongs."""
    f = _fields()
    number = lambda k: F.get(f, F.lit(k)).try_cast("long").isNotNull()
    gap = F.get(f, F.lit(4)).isin("N", "U")
    fine = (F.size(f) >= 9) & number(1) & number(2) & number(3) & F.when(gap, number(5)).otherwise(number(6) & number(7))
    first = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.coalesce(fine, F.lit(False))).orderBy("line").limit(1).collect()
    if first:
        raise FormatError(path, _line_number(lines, first[0]["line"]), first[0]["value"])


def check_fastg(lines: DataFrame, path: str = "input") -> None:
    """Raise for a FASTG none of whose headers tells of a neighbour."""
    if lines.where(F.col("value").startswith(">") & F.col("value").contains(":")).isEmpty():
        raise FormatError(path, None, "no header names a neighbour; is this FASTA?")


def agp_rows(lines: DataFrame) -> DataFrame:
    """AGP rows: ``(line, object, beg, end, part, kind, component, c_beg, c_end, orient, gap, evidence)``."""
    f = F.col("f")
    rows = _split(lines.where(~F.col("value").startswith("#")), "line").where(F.size("f") >= 9)
    gap = F.get(f, F.lit(4)).isin("N", "U")
    number = lambda c: c.try_cast("long")
    return rows.select(
        "line", F.get(f, F.lit(0)).alias("object"), number(F.get(f, F.lit(1))).alias("beg"), number(F.get(f, F.lit(2))).alias("end"), number(F.get(f, F.lit(3))).alias("part"), F.get(f, F.lit(4)).alias("kind"), F.when(~gap, F.get(f, F.lit(5))).alias("component"), F.when(~gap, number(F.get(f, F.lit(6)))).alias("c_beg"),
        F.when(~gap, number(F.get(f, F.lit(7)))).alias("c_end"), F.when(~gap, F.get(f, F.lit(8))).alias("orient"), F.when(gap, number(F.get(f, F.lit(5)))).alias("gap"), F.when(gap, F.get(f, F.lit(8))).alias("evidence"),
    )


def contig_paths(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """``(path, pos, name, orient, gap_after)`` of a file of name lines and path lines in turn, where a path line
    that ends in ``;`` goes on in the next. Names that end in a quote are the other strand and are skipped;
    steps that the graph lacks are dropped and gaps move to the step before.

    A line goes on the one before if that one ends in ``;``; counting the others in the order of the file pairs the names, odd,
    with the paths, even.
    """
    rows = lines.select("line", F.trim(F.regexp_replace("value", r"[\r\t]", "")).alias("v")).where("v != ''").withColumns({"part": F.shiftright("line", _STRETCH), "open": F.col("v").endswith(";")})
    ends = rows.groupBy("part").agg(F.max_by("open", "line").alias("last"))
    carried = ends.select("part", F.lag("last").over(W.orderBy("part")).alias("carried"))
    before = F.coalesce(F.lag("open").over(W.partitionBy("part").orderBy("line")), F.col("carried"), F.lit(False))
    rows = rows.join(F.broadcast(carried), "part").withColumn("begins", (~before).cast("int")).select("line", "v", "begins")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda x: x["v"]), "")
    texts = _counted(rows, "begins").groupBy("record").agg(whole.alias("text"))
    names = texts.where("record % 2 = 1").select((F.col("record") + 1).alias("record"), F.col("text").alias("path")).where(~F.col("path").endswith("'"))
    df = names.join(texts, "record").select("path", F.posexplode(_steps(F.col("text"))).alias("at", "x")).select("path", "at", "x.*")
    along = W.partitionBy("path").orderBy("at")
    gaps = F.coalesce(F.sum(F.col("gap_after").cast("int")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = df.withColumn("gaps", gaps).join(segments.select("name"), "name", "left_semi")
    gap = F.coalesce(F.lead("gaps").over(along) > F.col("gaps"), F.lit(False))
    return known.select("path", (F.row_number().over(along) - 1).cast("long").alias("pos"), "name", "orient", gap.alias("gap_after"))
