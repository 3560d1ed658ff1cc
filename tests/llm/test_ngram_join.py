from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from strandflow.llm.ngram_join import Ranges, _Gathered, _shared, jaccard_components, near, ngram_set, sketch, tree_join

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text: str | None, n: int = 3) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts: dict, threshold: int = 90, n: int = 3) -> dict:
    sets, root = {k: shingles(t, n) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def edited(rng, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + rng.choice([0, 1])] = [f"new{rng.random()}"]
    return out


def corpus(seed: int) -> dict:
    rng = random.Random(seed)
    texts, k = {}, 0
    for _ in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 150, 400]))]
        for edits in [0] + [rng.choice([0, 0, 1, 2, 3, 5]) for _ in range(rng.randrange(5))]:
            texts[k] = " ".join(edited(rng, base, edits)) if base else ""
            k += 1
    # one group of near copies of which many do not link with each other
    base = [f"g{x}" for x in range(200)]
    for _ in range(60):
        texts[k] = " ".join(edited(rng, base, rng.choice([2, 4, 6])))
        k += 1
    return texts


def test_components_equal_brute_force(spark, monkeypatch):
    from strandflow.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks in one cluster
    monkeypatch.setattr(ngram_join, "SKETCHES", 16)
    texts = corpus(4) | {900: None, 901: "", 902: "  \n\t", 903: "One", 904: "ONE", 905: "one two", 906: "É x", 907: "é x"}
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert got == brute(texts)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d", "x"), (5, "a b c d", "x"), (5, "a b c d", "x"), (3, "a b c d", "x")], SCHEMA)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard_components(df).collect()) == [(-1, None), (3, 3), (5, 3), (5, 3)]
    assert jaccard_components(df.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([80, 90]))
def test_linked_sets_share_signatures_of_a_class(size, lost, gained, seed, threshold):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x[min(lost, len(x) - 1) :], rng.integers(0, 2**63, gained, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
    same = len(np.intersect1d(x, y))
    if 100 * same >= threshold * (len(x) + len(y) - same):
        r = Ranges(threshold)
        p, q = ({c: (need, set(sigs.tolist())) for c, need, sigs in r.signatures(z)} for z in (x, y))
        assert any(len(p[c][1] & q[c][1]) >= max(p[c][0], q[c][0]) >= 1 for c in p.keys() & q.keys())


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6))
def test_blocks_find_what_two_sets_have(seed, n_sets, tasks):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64 - 1, 30, dtype=np.uint64)
    sets = [(k // 2, [(k % 2, 1, rng.choice(base, rng.integers(1, 9), replace=False))]) for k in range(n_sets)]
    found = set()
    blocks = {}
    for t in range(tasks):
        gathered = _Gathered(4)
        for k in range(t, n_sets, tasks):
            gathered.add(*sets[k])
        for batch in gathered.rows():
            for r in batch.to_pylist():
                if r["bucket"] is None:
                    found.add((r["sig"], r["fp"]))
                else:
                    blocks.setdefault(r["bucket"], []).append({"bucket": r["bucket"], "data": r["data"]})
    for rows in blocks.values():
        found |= {(r["sig"], r["fp"]) for r in _shared(pa.Table.from_pylist(rows)).to_pylist()}
    owners = {}
    # of two entries of a fingerprint in one task the first counts
    seen = set()
    for t in range(tasks):
        for k in range(t, n_sets, tasks):
            fp, ((_, _, sigs),) = sets[k]
            if (t, fp) not in seen:
                seen.add((t, fp))
                for s in sigs.tolist():
                    owners.setdefault((((s & 0xFFFFFFFF) * 4 >> 32) << 32) + (s >> 32), set()).add(fp)
    assert found == {(s, fp) for s, fps in owners.items() if len(fps) > 1 for fp in fps}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 12))
def test_tree_join_equals_all_pairs(seed, n_probes, n_sets):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 1000, 60).astype(np.uint64))
    some = lambda: np.unique(np.concatenate([base[rng.random(len(base)) > 0.04], rng.integers(0, 1000, rng.integers(0, 4)).astype(np.uint64)]))
    probes, sets = [some() for _ in range(n_probes)], [some() for _ in range(n_sets)]
    want = {(i, j) for i, p in enumerate(probes) for j, s in enumerate(sets) if 100 * len(np.intersect1d(p, s)) >= 90 * len(np.union1d(p, s))}
    assert set(tree_join(probes, sets, 90)) == want


def test_ngram_sets_follow_the_words():
    assert len(ngram_set(b"a b c a b c a")) == 3
    assert ngram_set(b"A b").tolist() == ngram_set(b"a\tB").tolist() != ngram_set(b"a").tolist()
    assert len(ngram_set(None)) == len(ngram_set(b" \n")) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([60, 80, 90]))
def test_sketches_lose_no_link_and_most_others(seed, threshold):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
    some = lambda: np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.6])], rng.integers(0, 2**63, rng.integers(1, 40), dtype=np.uint64)]))
    x, y = [some() for _ in range(12)], [some() for _ in range(9)]
    p, q = near([sketch(s) for s in x], np.array([len(s) for s in x]), [sketch(s) for s in y], np.array([len(s) for s in y]), threshold)
    got = set(zip(p.tolist(), q.tolist(), strict=True))
    overlap = {(i, j): 100 * len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for i, a in enumerate(x) for j, b in enumerate(y)}
    assert {k for k, v in overlap.items() if v >= threshold} <= got
    assert not {k for k in got if overlap[k] < threshold / 3 and min(len(x[k[0]]), len(y[k[1]])) > 100}
