"""WARC archives as a PySpark Python data source, for reading and writing.

Reading: ``spark.read.format("warc").load(folder)``. Files are the unit of work: whole files are packed
into partitions of ``partition_bytes``. A record's headers are parsed first; where its type or another header
fails a predicate the rest is not read: a plain file is sought past it, and so is a member of a .gz file whose 'sl'
extra field gives its length, of which a kilobyte or so, with the headers, is read. ``payload`` set to ``false`` leaves payloads undecoded.
Predicates on the header columns arrive through filter pushdown (see :func:`register`) or the options
``types``, ``target_prefix`` and ``record_ids``. Spark 4.1 keeps what it pushed with the loaded DataFrame: call ``load``
again for another query over the same folder.

Writing: ``df.write.format("warc").mode("append").save(folder)``. Each task writes files of its own, one gzip
member per record, and the driver then writes a manifest of the files of the tasks that counted; files that this
writer named and no manifest lists are of lost or repeated tasks and are not read. Others' files always are, as are
all of a folder without a manifest.

Paths are local or whatever pyarrow's file systems reach. Header values are percent-encoded where one of them
holds control characters, spaces or ``%``, so no text can break a header, and a header of the record says so; others'
values are taken as they are. A record that breaks off raises.

Inputs: null values leave their header out and meet no predicate, a null payload is empty, payloads are kept whole; rows
that repeat an id and a payload are one page, all of whose records are responses; an empty table gives an archive without
records; columns beside those of the schema cannot be written, and :func:`with_revisits` drops them.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from strandflow.runtime import Scratch

SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary, file string, offset long"
#: columns and the headers that carry them
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Says that the values of a record's headers are percent-encoded; only this writer's are.
ENCODED = "X-Header-Values: percent-encoded"
_UNSAFE = re.compile(r"[\x00-\x20\x7f%]")


def encode(value: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def decode(value: str) -> str:
    return re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), value)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_bytes(row: dict) -> bytes:
    """A record of HTTP kind: a response with its payload, or a revisit with the HTTP headers alone."""
    payload, kind = row["payload"] or b"", row["warc_type"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (row["payload_length"] if kind == "revisit" else len(payload))
    block = http if kind == "revisit" else http + payload
    values = {name: row[c] for c, name in HEADERS.items() if row.get(c) is not None}
    odd = any(_UNSAFE.search(v) for v in values.values())
    head = ["WARC/1.1"] + [f"{name}: {encode(v) if odd else v}" for name, v in values.items()] + [ENCODED] * odd
    head += [f"WARC-Profile: {PROFILE}"] * (kind == "revisit") + ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """A gzip member that states its own length and that of its content in an 'sl' extra field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if total >> 32:  # a length that does not fit is left out
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Inflating:
    """The content of a gzip member of ``total`` bytes, of which ``begun`` are read: read and inflated only as far as it is asked for."""

    def __init__(self, f, total: int, begun: bytes):
        self.f, self.left, self.raw, self.d, self.out = f, total - len(begun), begun, zlib.decompressobj(31), b""

    def _more(self, n: int, step: int) -> bytes:
        """At most ``n`` more bytes of content, none at the end; the file is read ``step`` bytes at a time."""
        while not self.d.eof:
            if not self.raw and self.left:
                self.raw = self.f.read(min(step, self.left))
                self.left = self.left - len(self.raw) if self.raw else 0
            ending = not self.raw
            data, self.raw = self.d.decompress(self.raw, n), self.d.unconsumed_tail
            if data or ending:
                return data
        return b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not (more := self._more(4096, 1024)):
                raise ValueError("truncated WARC record")
            self.out += more
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n:
            if not (more := self._more(n - have, 1 << 16)):
                raise ValueError("truncated WARC record")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]


class Plain:
    """The same over a file."""

    def __init__(self, f):
        self.f, self.out = f, b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not (more := self.f.read(4096)):
                raise ValueError("truncated WARC record")
            self.out += more
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        if n > len(self.out):
            self.out += self.f.read(n - len(self.out))
        got, self.out = self.out[:n], self.out[n:]
        if len(got) < n:
            raise ValueError("truncated WARC record")
        return got

    def skip(self, n: int) -> None:
        if n > len(self.out):
            self.f.seek(n - len(self.out), 1)
        self.out = self.out[n:]


class Unzipped:
    """The content of a file's gzip members from one of them on, as a file that is read in order."""

    def __init__(self, f, offset: int):
        f.seek(offset)
        self.f, self.d, self.raw, self.read_raw = f, zlib.decompressobj(31), b"", offset
        self.at, self.members = 0, [(0, offset)]  # bytes given out; where members begin in them and in the file

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if not self.raw and not self.d.unconsumed_tail:
                self.raw = self.f.read(1 << 16)
                self.read_raw += len(self.raw)
                if not self.raw:
                    if not self.d.eof and (self.at + len(out) > self.members[-1][0]):
                        raise ValueError("truncated gzip member")
                    break
            if self.d.eof:
                self.members.append((self.at + len(out), self.read_raw - len(self.raw)))
                self.d = zlib.decompressobj(31)
            data, self.raw = self.d.unconsumed_tail + self.raw, b""
            out += self.d.decompress(data, n - len(out))
            self.raw = self.d.unused_data if self.d.eof else b""
        self.at += len(out)
        return out

    def seek(self, n: int, _) -> None:
        while n > 0 and (got := self.read(min(n, 1 << 16))):
            n -= len(got)

    def member(self, at: int) -> int:
        """The offset in the file of the member that holds byte ``at``; asked in order."""
        while len(self.members) > 1 and self.members[1][0] <= at:
            self.members.pop(0)
        return self.members[0][1]


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _value(head: dict[str, str], name: str) -> str | None:
    value = head.get(name.lower())
    return decode(value) if value is not None and head.get("x-header-values") == "percent-encoded" else value


def _row(head: dict[str, str], source, payload: bool, length: int) -> dict:
    row = {c: _value(head, name) for c, name in HEADERS.items()}
    row |= {"payload": None, "payload_length": None}
    if "http" in head.get("content-type", ""):
        http = source.until(b"\r\n\r\n")
        own = _headers(http).get("content-length")
        rest = length - len(http) - 4
        row["payload_length"] = int(own) if own else rest
        if row["warc_type"] != "revisit" and payload:
            row["payload"] = source.take(rest)
            return row | {"left": 0}
        return row | {"left": rest}
    if payload:
        row["payload"] = source.take(length)
        return row | {"payload_length": length, "left": 0}
    return row | {"payload_length": length, "left": length}


def read_records(f, gz: bool, wanted, payload: bool) -> Iterator[dict]:
    """Rows of a file for the records whose headers satisfy ``wanted``.

    Of a gzip member that states its length only what holds the headers is read and inflated if it is not wanted, or if its payload is
    not; then the file is sought to the next member. From the first member on that does not state its length, the file is
    inflated in order, with any number of records in a member.
    """
    if not gz:
        yield from _in_order(f, wanted, payload, lambda at: at)
        return
    offset = 0
    while fixed := f.read(24):
        if fixed[:4] != b"\x1f\x8b\x08\x04" or fixed[12:14] != b"sl":
            rest = Unzipped(f, offset)
            yield from _in_order(rest, wanted, payload, rest.member)
            return
        total = struct.unpack("<I", fixed[16:20])[0]
        source = Inflating(f, total, fixed)
        head = _headers(source.until(b"\r\n\r\n"))
        if wanted(head):
            row = _row(head, source, payload, int(head["content-length"]))
            row.pop("left")
            yield row | {"offset": offset}
        offset += total
        f.seek(offset)


def _in_order(f, wanted, payload: bool, place) -> Iterator[dict]:
    source, offset, ended = Plain(f), 0, True
    while True:
        while source.out[:2] == b"\r\n" or len(source.out) < 2:
            if source.out[:2] == b"\r\n":
                source.out, ended = source.out[2:], True
                offset += 2
            elif more := f.read(4096):
                source.out += more
            elif ended and not source.out:
                return
            else:
                raise ValueError("truncated WARC record")
        block = source.until(b"\r\n\r\n")
        head = _headers(block)
        length = int(head["content-length"])
        if wanted(head):
            row = _row(head, source, payload, length)
            source.skip(row.pop("left"))
            yield row | {"offset": place(offset)}
        else:
            source.skip(length)
        offset += len(block) + 4 + length
        ended = False


#: Names of this writer's files: those that no manifest lists are of jobs that did not end.
_OWN = re.compile(r"part-[0-9a-f]{32}\.warc")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.bytes = int(options.get("partition_bytes", 128 << 20))
        self.equal: dict[str, set] = {}
        self.prefix: dict[str, str] = {}
        if "types" in options:
            self.equal["warc_type"] = set(options["types"].split(","))
        if "record_ids" in options:
            self.equal["record_id"] = set(options["record_ids"].split(","))
        if "target_prefix" in options:
            self.prefix["target_uri"] = options["target_prefix"]

    def pushFilters(self, filters: list) -> Iterator:
        for x in filters:
            column = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(x, EqualTo | In):
                values = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.equal[column] = self.equal.get(column, values) & values
            elif column in HEADERS and isinstance(x, StringStartsWith) and column not in self.prefix:
                self.prefix[column] = x.value
            else:
                yield x

    def wanted(self, head: dict[str, str]) -> bool:
        get = lambda c: _value(head, HEADERS[c])
        return all(get(c) is not None and get(c) in values for c, values in self.equal.items()) and all(get(c) is not None and get(c).startswith(p) for c, p in self.prefix.items())

    def partitions(self) -> list[Files]:
        system, at = _place(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file] if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        manifests = [x for x in found if x.base_name.startswith("_manifest-")]
        listed = {name for x in manifests for name in json.loads(system.open_input_stream(x.path).readall())}
        files = [x for x in found if x.base_name.endswith((".warc", ".warc.gz")) and (not _OWN.match(x.base_name) or not manifests or x.base_name in listed)]
        out, size = [[]], 0
        for x in sorted(files, key=lambda x: x.path):
            if out[-1] and size + x.size > self.bytes:
                out.append([])
                size = 0
            out[-1].append(x.path)
            size += x.size
        return [Files(p) for p in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c, kinds[k]) for c, k in map(str.split, SCHEMA.split(", "))])
        system, _ = _place(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                for row in read_records(f, path.endswith(".gz"), self.wanted, self.payload):
                    rows.append(row | {"file": path})
                    held += len(row["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.gz = options["path"], options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _place(self.path)
        system.create_dir(at, recursive=True)
        names, f, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if f is None or size > self.limit:
                    if f:
                        f.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gz)
                    f, size = system.open_output_stream(f"{at}/{names[-1]}", compression=None), 0
                data = record_bytes(row)
                data = gzip_member(data) if self.gz else data
                f.write(data)
                size += len(data)
        if f:
            f.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, at = _place(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list) -> None:
        system, at = _place(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.delete_file(f"{at}/{name}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and let Spark push predicates into it."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, *, least: int = 1000) -> DataFrame:
    """Rows ``(id, uri, payload)`` to records: of equal payloads of ``least`` bytes or more the largest id
    is the response and the others revisit it. Rows with a null id neither are revisited nor revisit."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("length") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count("id").alias("n"))
    several = scratch.save(large.where("n > 1").select("digest", "first"), "several")
    rows = rows.join(several, "digest", "left")
    again = F.coalesce(F.col("id") < F.col("first"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), F.coalesce(name(F.col("id")), F.lit("<urn:page:none>")).alias("record_id"), F.col("uri").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.when(again, name(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.col("length").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads them back; a response's digest is that of what was read."""
    register(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = with_revisits(pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")))
    folder = f"{Scratch(spark, 'archives').path}/warc"
    records.write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").option("partition_bytes", 16 << 20).load(folder).where(F.col("warc_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    first = F.col("warc_type") == "response"
    digest = F.when(first, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    size = F.when(first, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length"))
    return back.select(page(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), F.when(~first, page(F.col("refers_to"))).alias("refers_to"))


QUERIES = {"op5_warc": op5_warc}
SQL = {
    "op5_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as n, sha1(b) as digest from p),
f as (select *, max(page_id) over (partition by digest) as first from d)
select page_id, n as payload_bytes, digest as payload_digest,
       case when n >= 1000 and page_id < first then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id < first then first end as refers_to
from f
""",
}
