from __future__ import annotations

import random
import re

import numpy as np
import pytest

from strandflow.llm import license_scan
from strandflow.llm.license_scan import PHRASES, SQL, STEP, TEMPLATES, WINDOW, Templates, op11_license_scan, scan
from tests.conftest import SF, rows_of


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def pairs(w: list[str]) -> set:
    return set(zip(w, w[1:], strict=False))


def plain(text: str | None, templates=TEMPLATES, threshold: int = 90) -> tuple:
    """Every window against every template, no filters."""
    w = words(text)
    base = [(k, label) for phrase, label in PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    found = set()
    for at in range(0, len(w), STEP):
        block = pairs(w[at : at + WINDOW])
        for t, (label, template) in enumerate(templates):
            own = pairs(words(template))
            if 100 * len(own & block) >= threshold * len(own):
                found.add((label, t, at, len(own & block) / len(own)))
    places, labels = [k for k, _ in base], {x for _, x in base}
    score = 1.0 if base else max((f[3] for f in found), default=0.0)
    return len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f[0] for f in found})), score, found


def texts(seed: int, n: int) -> list[str]:
    """Pieces of templates, changed words and the templates' own words in any order."""
    rng = random.Random(seed)
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()} | {"x", "y", "ñu", "日本"})
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            own = rng.choice(TEMPLATES)[1].split()
            if kind < 0.4:
                own = [rng.choice(vocabulary) if rng.random() < 0.06 else w for w in own]
            elif kind < 0.6:
                own = own[rng.randrange(len(own)) :]
            else:
                own = rng.choices(vocabulary, k=rng.randint(1, 90))
            parts.append(rng.choice([" ", ", ", "\n# "]).join(w.title() if rng.random() < 0.2 else w for w in own))
        out.append(rng.choice([" ", ".\n", " - "]).join(parts))
    return out


@pytest.mark.parametrize("threshold", [60, 90, 100])
def test_scan_equals_all_windows_against_all_templates(spark, threshold):
    given = [*texts(threshold, 300), None, "", " \n", "MIT", "mit license", "MIT-License, mit license", "general public", "Apache  LICENSE " * 2000, "the of " * 30_000]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in scan(df, threshold=threshold).collect()}
    assert len(got) == len(given)
    for k, text in enumerate(given):
        r = got[k]
        found = {(f["label"], f["template"], f["first_word"], f["containment"]) for f in r["found"]}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], found) == plain(text, threshold=threshold), text


def test_any_order_finds_the_same_blocks():
    rng = random.Random(3)
    own, other = Templates(threshold=70), Templates(threshold=70)
    other.order([rng.randrange(50) for _ in range(other.pairs)])
    for text in texts(9, 200):
        w = license_scan.words_of(text.encode())
        if len(w) > 1:
            found = [{(k, *f) for k, block in x.blocks(*x.pairs_in(x.numbers(w))) for f in x.join(block)} for x in (own, other)]
            assert found[0] == found[1]


def test_query_equals_sql(spark, duck):
    assert rows_of(op11_license_scan(spark, SF)) == rows_of(duck.sql(SQL["op11_license_scan"]).df())


def test_query_finds_the_lines_of_the_documents(spark):
    got = op11_license_scan(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for line, label in (("Released under the MIT License", "spdx:mit"), ("Licensed under CC BY-NC 4.0", "spdx:cc-by-nc-4.0"), ("General Public License, version 3", "spdx:gpl-3.0"), ("All rights reserved", "all-rights-reserved")):
        assert all((label in r["labels"].split(",")) == (line in (r["text"] or "")) for r in got)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, "x", 1), (1, "All rights reserved", "x", 1), (1, "All rights reserved", "x", 1)], "doc_id long, text string, labels string, pair int")
    out = scan(df)
    assert out.columns == ["doc_id", "text", "pair", *license_scan.ADDED.names]
    assert sorted((r["labels"], r["score"], r["pair"]) for r in out.collect()) == [("", 0.0, 1), ("all-rights-reserved", 1.0, 1), ("all-rights-reserved", 1.0, 1)]
    assert scan(df.limit(0)).collect() == []
    for bad in ([("a", "one")], [("a", "w " * 40)]):
        with pytest.raises(ValueError):
            scan(df, templates=bad)
    assert np.array_equal(Templates().order([1] * Templates().pairs).rank, Templates().rank)
