"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Its blocks are the windows of
``WINDOW`` words that start at every ``STEP``-th word, so any passage of WINDOW - STEP + 1 words, and so any template,
fits into one; line breaks and punctuation play no part. A block and a template are compared as sets of word pairs,
which keeps the order of words that plain sets of words lose. A template is found in a block that holds at least
``threshold`` hundredths of its pairs.

The join: pairs are ordered by how often they stand in all the texts, rarest first; pairs that no template has cannot
count and are left out, so the order covers the templates' vocabulary. If a block holds ``need`` of a template's pairs
then it holds one of the template's ``size - need + 1`` rarest, its prefix; an index from prefix pairs to templates finds
the candidates. A block with fewer pairs than ``need`` is passed over (length filter), and so is one where the pairs that remain on the
shorter side from a match on cannot make up ``need`` (positional filter). What is left is counted exactly. No filter loses a block.

Two narrow passes over the texts: one counts the templates' pairs (a row for each pair and task is shuffled), one joins. The
templates, a parameter of some kilobytes, are all that goes to every task, and no text leaves its row.

Beside the join, the places of base phrases are counted: a phrase's words standing one after the other.

Inputs: a null or empty text has no words, no labels and score 0; ids are never looked at; equal rows have equal results;
very long texts are scanned whole; an empty table gives an empty result; columns of an added name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandflow.llm._text import with_columns

WINDOW, STEP, THRESHOLD = 64, 32, 90

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices of public licenses as they are worded there, in lower case without punctuation, and labels.
TEMPLATES = (
    ("spdx:mit", "released under the mit license"),
    ("spdx:mit", "licensed under the mit license"),
    ("spdx:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("spdx:apache-2.0", "apache license version 2 0"),
    ("spdx:apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("spdx:gpl-2.0", "gnu general public license version 2"),
    ("spdx:gpl-3.0", "gnu general public license version 3"),
    ("spdx:gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("spdx:lgpl", "gnu lesser general public license"),
    ("spdx:bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("spdx:isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("spdx:mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("spdx:unlicense", "this is free and unencumbered software released into the public domain"),
    ("spdx:cc0-1.0", "cc0 1 0 universal public domain dedication"),
    ("spdx:cc-by-4.0", "licensed under cc by 4 0"),
    ("spdx:cc-by-4.0", "creative commons attribution 4 0 international license"),
    ("spdx:cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("spdx:cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license"),
    ("spdx:cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("spdx:cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)

#: capitals to small letters, other ASCII that is no letter or digit to spaces
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x80 and not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A) else c for c in range(256))

FOUND = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("containment", T.DoubleType())])
ADDED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("found", T.ArrayType(FOUND))]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Templates:
    """Templates and phrases as numbers: ``known`` (word to number), pairs of neighbouring words, sizes and needs."""

    def __init__(self, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD, phrases: Iterable[tuple[str, str]] = PHRASES):
        self.templates, self.phrases = tuple(templates), tuple(phrases)
        texts = [words_of(t.encode()) for _, t in self.templates]
        if any(not 2 <= len(w) <= WINDOW - STEP + 1 for w in texts):
            raise ValueError(f"a template has 2 to {WINDOW - STEP + 1} words; give a longer text as several templates")
        if not 0 < threshold <= 100:
            raise ValueError("the threshold lies between 1 and 100 hundredths")
        self.known: dict[bytes, int] = {}
        number = lambda words: [self.known.setdefault(w, len(self.known)) for w in words]
        self.phrase_words = [number(words_of(t.encode())) for t, _ in self.phrases]
        numbered = [number(w) for w in texts]
        pairs: dict[tuple[int, int], int] = {}
        self.sets = [sorted({pairs.setdefault(p, len(pairs)) for p in zip(w, w[1:], strict=False)}) for w in numbered]
        self.needs = [-(-threshold * len(s) // 100) for s in self.sets]
        self.pairs = len(pairs)
        self.pair = np.full((len(self.known) + 1, len(self.known) + 1), -1, np.int32)  # the last row and column: other words
        for (a, b), k in pairs.items():
            self.pair[a, b] = k
        self.order([0] * self.pairs)

    def order(self, counts: list[int]) -> Templates:
        """Set the global order, rarest first, and index the prefixes by it."""
        rank = {k: r for r, k in enumerate(sorted(range(self.pairs), key=lambda k: (counts[k], k)))}
        self.rank = np.array([rank[k] for k in range(self.pairs)], np.int32)
        self.ranked = [frozenset(rank[k] for k in s) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (s, need) in enumerate(zip(self.ranked, self.needs, strict=True)):
            for i, r in enumerate(sorted(s)[: len(s) - need + 1]):
                self.index.setdefault(r, []).append((t, i))
        self.in_prefix = np.zeros(self.pairs, bool)
        self.in_prefix[list(self.index)] = True
        return self

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.known.get
        return np.array([get(w, -1) for w in words], np.int32)

    def pairs_in(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, pair numbers) of the templates' pairs in a text."""
        token = self.pair[ids[:-1], ids[1:]]
        at = np.flatnonzero(token >= 0)
        return at, token[at]

    def join(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of all templates found in a block: its ranks, ascending and distinct."""
        seen: dict[int, int] = {}
        for j, r in enumerate(block):
            for t, i in self.index.get(r, ()):
                before = seen.get(t, 0)
                if before < 0 or len(block) < self.needs[t]:
                    continue
                rest = min(len(self.ranked[t]) - i, len(block) - j)
                seen[t] = before + 1 if before + rest >= self.needs[t] else -1
        if not seen:
            return []
        held = set(block)
        counted = ((t, len(held & self.ranked[t])) for t, n in seen.items() if n > 0)
        return [(t, c / len(self.ranked[t])) for t, c in counted if c >= self.needs[t]]

    def blocks(self, at: np.ndarray, token: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(window, ranks) of the windows that hold a pair of some prefix."""
        rank = self.rank[token]
        if not self.in_prefix[rank].any():
            return
        last = at // STEP
        back = at - (last - 1) * STEP <= WINDOW - 2
        back &= last > 0
        window, rank = np.concatenate([last, last[back] - 1]), np.concatenate([rank, rank[back]])
        hit = np.unique(window[self.in_prefix[rank]])
        some = np.isin(window, hit)
        window, rank = window[some], rank[some]
        order = np.lexsort((rank, window))
        window, rank = window[order], rank[order]
        cuts = np.searchsorted(window, hit, side="left").tolist()
        for w, a, b in zip(hit.tolist(), cuts, [*cuts[1:], len(window)], strict=True):
            yield w, np.unique(rank[a:b]).tolist()


def _places(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after the other."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    same = ids[:n] == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        same &= ids[k : n + k] == w
    return np.flatnonzero(same)


def pair_counts(docs: DataFrame, templates: Templates, text: str = "text") -> list[int]:
    """How often each of the templates' pairs stands in all the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(templates.pairs, np.int64)
        for batch in batches:
            for value in batch.column(0):
                words = words_of(value.as_py())
                if len(words) > 1:
                    total += np.bincount(templates.pairs_in(templates.numbers(words))[1], minlength=templates.pairs)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["pair", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "pair long, n long")
    found = {r["pair"]: r["n"] for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # one row for each pair of the templates
    return [found.get(k, 0) for k in range(templates.pairs)]


def scan(docs: DataFrame, text: str = "text", *, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD, phrases: Iterable[tuple[str, str]] = PHRASES) -> DataFrame:
    """``docs`` with the columns of ``ADDED``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` tell of the base phrases, ``found`` of templates by block: the label, the template's number,
    the block's first word and the containment. ``labels`` has both kinds; ``score`` is 1 with a base phrase, else the greatest containment found.
    """
    own = Templates(templates, threshold, phrases)
    own.order(pair_counts(docs, own, text))

    def scanned(value: bytes | None) -> tuple:
        words = words_of(value)
        if len(words) < 2:
            return len(words), 0, None, None, "", "", 0.0, []
        ids = own.numbers(words)
        places = [_places(ids, p) for p in own.phrase_words]
        starts = np.concatenate(places)
        base = {label for (_, label), p in zip(own.phrases, places, strict=True) if len(p)}
        found = [(own.templates[t][0], t, w * STEP, c) for w, block in own.blocks(*own.pairs_in(ids)) for t, c in sorted(own.join(block))]
        score = 1.0 if base else max((f[3] for f in found), default=0.0)
        ends = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
        return len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | {f[0] for f in found})), score, found

    def make():
        def run(texts: list) -> dict:
            made = [scanned(t) for t in texts]
            out = {name: [m[k] for m in made] for k, name in enumerate(ADDED.names)}
            out["found"] = [[dict(zip(FOUND.names, f, strict=True)) for f in found] for found in out["found"]]
            return out

        return run

    return with_columns(docs, text, make, ADDED)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license templates in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("text", "found")


def _sql() -> str:
    own = Templates()
    rows = [(t, label, f"{a.decode()} {b.decode()}") for t, (label, text) in enumerate(own.templates) for a, b in sorted(set(zip(words_of(text.encode()), words_of(text.encode())[1:], strict=False)))]
    listed = ", ".join(f"({t}, '{label}', '{pair}')" for t, label, pair in rows)
    return rf"""
with template(t, label, pair) as (values {listed}),
sized as (select t, label, count(*) as size from template group by t, label),
own as (
    select row_number() over () as r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as word
    from documents),
place as (select r, unnest(word) as w0, generate_subscripts(word, 1) - 1 as n from own),
three as (select r, n, w0, lead(w0) over (partition by r order by n) as w1, lead(w0, 2) over (partition by r order by n) as w2 from place),
base as (
    select r, n, case when w0 = 'general' then 'gpl' else w0 end as label
    from three where (w1 = 'license' and w0 in ('mit', 'apache')) or (w0 = 'general' and w1 = 'public' and w2 = 'license')),
based as (select r, count(*) as n_base, min(n) as first_word, max(n) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by r),
held as (select r, n, t, p.pair from three join template p on p.pair = w0 || ' ' || w1),
blocked as (
    select r, t, pair, n // {STEP} as k from held
    union all select r, t, pair, n // {STEP} - 1 from held where n >= {STEP} and n - (n // {STEP} - 1) * {STEP} <= {WINDOW - 2}),
found as (
    select r, label, count(distinct pair) / any_value(size)::double as c
    from blocked join sized using (t) group by r, k, t, label having 100 * count(distinct pair) >= {THRESHOLD} * any_value(size)),
labelled as (select r, label, 1.0::double as c from base union all select r, label, c from found),
summed as (select r, string_agg(distinct label, ',' order by label) as labels, max(c) as score from labelled group by r)
select doc_id, len(word) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
       coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from own left join based using (r) left join summed using (r)
"""


QUERIES = {"op11_license_scan": op11_license_scan}
SQL = {"op11_license_scan": _sql()}
