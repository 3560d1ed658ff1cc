"""Fill-in-the-middle examples by run-length class encoding.

A text is n units: a maximal run of ASCII letters is one, any other code point is one of its own. What is kept of a
text is its maximal runs of letters and of other code points, where each begins and how many units end before it. A
cut after u units is found by binary search over those counts: in a run of others it lies as many code points
after the run's start as units are left, in a run of letters at its start. No list of units is ever made.

Seed and id decide where the cuts lie and which form a text takes, so reruns agree wherever a row is computed:
h1 to h4 are the first four groups of eight digits of the hex sha256 of ``<seed>:<id>``. The prefix ends after the smaller of h1 and
h2 modulo n + 1 units, the middle after the larger. :func:`restored` takes an output apart at its markers; texts that
hold a marker stay plain, so it gives every text back.

Inputs: a null text is an empty one and stays plain; a null id is hashed as ``null``; rows that repeat an id are cut by
the same hashes; very long texts are handled whole; an empty table gives an empty result; columns of an added name are
replaced, others pass through; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


class Runs:
    """The class runs of a text: ``start`` (code points), ``letters`` and ``before``, the units that end before each run."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = (codes | np.uint32(32)) - np.uint32(97) < 26
        self.start = np.flatnonzero(np.append(True, letter[1:] != letter[:-1])) if len(codes) else np.empty(0, np.int64)
        self.letters = letter[self.start]
        units = np.where(self.letters, 1, np.diff(np.append(self.start, len(codes))))
        self.before = np.concatenate([[0], np.cumsum(units)])
        self.chars, self.n = len(codes), int(self.before[-1])

    def offset(self, units: int) -> int:
        """Code points that the first ``units`` units take."""
        k = int(np.searchsorted(self.before, units, side="right")) - 1
        if k >= len(self.start):
            return self.chars
        return int(self.start[k]) + (0 if self.letters[k] else units - int(self.before[k]))


def transform(text: str, digest: str, keep_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle in code points, output) of one text; ``digest`` holds 32 hex digits or more."""
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    runs = Runs(text)
    if not text or h3 % 100 >= 100 - keep_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return runs.n, "plain", None, None, text
    a, b = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    a, b = runs.offset(a), runs.offset(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return runs.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return runs.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, seed: int = 1, keep_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``keep_percent`` of the ids stay plain, ``spm_percent`` of the others put the suffix first. A narrow pass without a shuffle.
    """
    new = {f.name for f in ADDED}
    kept = [c for c in docs.columns if c.lower() not in new]
    spare = "own_" + "_" * max(map(len, docs.columns))  # longer than any of docs' names
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))), 256)
    body = docs.select(*[F.col(f"`{c}`") for c in kept], F.substring(digest, 1, 32).alias(spare), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias(spare + "_"))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *ADDED.fields])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                digests, texts = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
                made = [transform(t.decode("utf-8", "replace"), d, keep_percent, spm_percent) for d, t in zip(digests, texts, strict=True)]
                columns = [pa.array(list(x), kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *ADDED.names])

    return body.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    part = F.split(output, "<[PSM]>", -1)
    text = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(text)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's example, as digests of the output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {"op12_fill_middle": op12_fill_middle}
SQL = {
    "op12_fill_middle": r"""
with own as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as unit,
           sha256('1:' || coalesce(doc_id::varchar, 'null')) as digest
    from documents),
hashed as (
    select *, len(unit) as n, ('0x' || digest[1:8])::bigint as h1, ('0x' || digest[9:16])::bigint as h2,
           ('0x' || digest[17:24])::bigint as h3, ('0x' || digest[25:32])::bigint as h4
    from own),
formed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
                when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from hashed),
cut as (
    select *, array_to_string(unit[1:a], '') as prefix, array_to_string(unit[a + 1:b], '') as middle, array_to_string(unit[b + 1:], '') as suffix
    from formed)
select doc_id, n, form, case when form != 'plain' then length(prefix) end as prefix_chars, case when form != 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from cut
""",
}
