from __future__ import annotations

import numpy as np

from strandflow.llm import embedding_dedup
from strandflow.llm.embedding_dedup import near_duplicates, op8_embedding_dedup
from tests.conftest import SF


def brute(rows) -> dict:
    ids = [r[0] for r in rows]
    fine = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = {k: [] for k in range(len(rows))}
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if f else None for r, f in zip(rows, fine, strict=True)]
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].append(b)
                links[b].append(a)
    least = dict(enumerate(ids))
    for _ in rows:
        least = {k: min([least[k], *(least[j] for j in links[k])]) for k in links}
    return {ids[k]: (len(links[k]), least[k], least[k] == ids[k]) for k in links}


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(12):
        base = rng.normal(size=16)
        for noise in [0.0, 0.0, 0.01, 0.02, 0.03, 0.03, 0.03, 0.5]:
            rows.append((k, (base + noise * rng.normal(size=16)).tolist(), int(k % 2 if noise == 0.5 else 1)))
            k += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [float("inf")] * 16, 1), (906, [], 1), (907, [1.0] * 8, 1), (908, [2.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    want = brute(rows)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
    assert all(got[k] == want[k] for k in range(900, 909))


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op8_embedding_dedup(spark, SF).collect()}
    assert got == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(-1, 0, None, False), (4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_the_exact_way_loses_no_border_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for _ in range(60):
        base = rng.normal(size=12)
        base /= np.linalg.norm(base)
        off = rng.normal(size=12)
        off -= (off @ base) * base
        off /= np.linalg.norm(off)
        for c in (1.0, 0.9801, 0.9799):
            rows.append((k, (c * base + np.sqrt(1 - c * c) * off).tolist(), int(k % 2)))
            k += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, exact=True).collect()}
    assert got == brute(rows)


def test_labels_of_any_kind_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0], "a b", "x", 1), (2, [1.0, 2.0], "a b", "x", 1), (3, [1.0, 2.0], "c", "x", 1), (4, [1.0, 2.0], None, "x", 1), (5, [1.0, 2.001], "a b", "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node string, key int")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 2, 1)]
