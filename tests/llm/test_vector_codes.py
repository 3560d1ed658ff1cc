from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from strandflow.llm import vector_codes
from strandflow.llm.vector_codes import SQL, Codebook, compress, op13_vector_codes
from tests.conftest import SF, rows_of

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def plain(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[tuple], str]:
    """Lists and whole numbers, every part against every entry; all vectors of one length."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]

    def near(x: list[int], book: list[list[int]]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [near(x[p], books[p])[1] for x in cut]
            for k in range(len(books[p])):
                own = [x[p] for x, a in zip(cut, at, strict=True) if a == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    errors: dict = {}
    for (_, _, label), f in zip(kept, found, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label]) for (i, _, label), f in zip(kept, found, strict=True)], digest


def show(rows) -> list[tuple]:
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 12])
def test_bounds_lose_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    for scale in (3, 4000, 1 << 27):
        x = rng.integers(-scale, scale + 1, (500, width))
        entries = np.concatenate([x[:12], x[:2], rng.integers(-scale, scale + 1, (4, width))])
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        at, error, exact = Codebook(entries).nearest(x)
        assert (at == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all() and exact <= d.size


def test_bounds_leave_out_most_entries():
    rng = np.random.default_rng(1)
    entries = rng.integers(-3000, 3000, (16, 8))
    x = entries[rng.integers(0, 16, 2000)] + rng.integers(-200, 200, (2000, 8))
    assert Codebook(entries).nearest(x)[2] < 0.2 * 16 * len(x)


def test_equals_comparing_all(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 24))
    rows = [(k, [float(x) for x in centres[k % 20] + rng.normal(size=24) * 0.1], None if k % 7 == 0 else k % 3) for k in range(300)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], 2), (900, None, 1), (901, [*rows[1][1][:-1], None], 1), (902, [*rows[1][1][:-1], float("nan")], None), (903, [*rows[1][1][:-1], float("inf")], None)]
    rng.shuffle(rows)
    got = compress(spark.createDataFrame([(i, v, x, "clash") for i, v, x in rows], SCHEMA).repartition(5)).collect()
    want, digest = plain(rows)
    assert show(got) == sorted(want, key=repr)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_query_equals_sql(spark, duck):
    assert rows_of(op13_vector_codes(spark, SF)) == rows_of(duck.sql(SQL["op13_vector_codes"]).df())


def test_many_labels_are_met_by_salt(spark, monkeypatch):
    rows = [(k, [float(k % 11), float(k % 5)] * 4, k % 9 or None, "x") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = show(compress(df).collect())
    monkeypatch.setattr(vector_codes, "FEW", 3)
    assert show(compress(df).collect()) == want == sorted(plain([r[:3] for r in rows])[0], key=repr)


def test_odd_tables(spark):
    few = [(k, [float(k)] * 8, 1) for k in range(3)]
    df = spark.createDataFrame([(*r, "x") for r in few], SCHEMA)
    assert show(compress(df).collect()) == sorted(plain(few)[0], key=repr)
    assert compress(df.limit(0)).collect() == []

    other = [(10, [1.0] * 16, 1, "x"), (11, [2.0] * 16, 1, "x"), (12, [1.0] * 9, 5, "x"), (13, [], 5, "x"), (14, [1e30] * 8, 5, "x"), (15, [-1e308] * 8, 5, "x")]
    got = {r["vec_id"]: r for r in compress(df.union(spark.createDataFrame(other, SCHEMA))).collect()}
    assert len(got) == 9 and [got[k]["code"] for k in (0, 1, 2)] == ["00" * 8, "01" * 8, "02" * 8] and [got[k]["code"] for k in (10, 11)] == ["00" * 8, "01" * 8]
    assert all(got[k]["code"] is None and got[k]["error"] is None and got[k]["label_error"] is None for k in (12, 13, 14, 15))
    assert got[10]["codebooks_sha256"] != got[0]["codebooks_sha256"] and got[12]["codebooks_sha256"] is None
