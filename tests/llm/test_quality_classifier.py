from __future__ import annotations

import zlib

import numpy as np

from strandflow.llm import quality_classifier as q
from tests.conftest import SF


def test_context_vectors_equal_a_plain_count(spark):
    texts = ["a b c a", "b", "", None, "C a!! b b " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    table = np.zeros((q.ROWS, q.WIDTH))
    for t in texts:
        code = q._words.of(t.encode() if t else None)
        for k in range(len(code)):
            for j in range(max(0, k - q.REACH), min(len(code), k + q.REACH + 1)):
                if j != k:
                    table[code[k] % q.ROWS] += q.FORM_INDEX[code[j] % q.ROWS] + q.SHAPE_INDEX[code[j] // q.ROWS]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    assert np.allclose(q.word_vectors(df), table / np.maximum(norm, 1e-9), atol=1e-6)


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = q.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    aside = [(r["score"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in aside if y == 1], [s for s, y in aside if y == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    assert np.mean([s >= 0.5 for s in good]) >= 0.95


def test_temperature_fits_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8000, q.N_FEATURES))
    y = (rng.random(8000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = q.Network.fitted(x[:3000], y[:3000])
    p, y = net.probability(x[3000:]), y[3000:]
    for lo in (0.1, 0.4, 0.7):
        some = (p >= lo) & (p < lo + 0.2)
        assert abs(p[some].mean() - y[some].mean()) < 0.08


def test_odd_rows_and_missing_labels(spark):
    schema = "doc_id long, text string, score string"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "w " * 60_000, "x"), (3, "w " * 60_000, "x")], schema)
    vectors = q.word_vectors(df)
    net = q.fit(q.features(df, vectors), spark.createDataFrame([], "doc_id long, quality int"))
    scores = [r["score"] for r in q.QualityModel(vectors, net).score(df).collect()]
    assert scores == [0.5] * 5
    assert q.QualityModel(q.word_vectors(df.limit(0)), net).score(df.limit(0)).collect() == []
    assert np.allclose(q.Network.fitted(np.zeros((3, q.N_FEATURES)), np.array([1, 1, 1])).probability(np.zeros((2, q.N_FEATURES))), 1.0)
