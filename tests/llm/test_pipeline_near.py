"""The near-duplicate stage against all pairs of texts, by 5-word shingles and a similarity of 0.8."""

from __future__ import annotations

import random

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.test_ngram_join import edited, shingles


def kept(texts: dict) -> set:
    """The smallest id of each component."""
    sets, root = {k: shingles(t, 5) for k, t in texts.items()}, {k: k for k in texts}
    for _ in texts:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {k for k in texts if root[k] == k}


def substituted(words: list[str], times: int) -> list[str]:
    out, step = list(words), len(words) // times
    for k in range(times):
        out[k * step + step // 2] = f"other{k}"
    return out


def test_near_copies_between_the_limits_go(spark):
    rng = random.Random(4)
    texts = {}
    for size, times in ((200, 4), (500, 10), (500, 11), (200, 5), (60, 1), (30, 1), (1500, 33)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts[len(texts)] = " ".join(words)
        texts[len(texts)] = " ".join(substituted(words, times))
    for _ in range(8):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(4, 400))]
        for edits in (0, 1, 4, 9, 16):
            texts[len(texts)] = " ".join(edited(rng, words, edits))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r["doc_id"] for r in P.near_duplicates(spark, docs, SF).collect()}
    assert not {1, 3, 5} & got and got == kept(texts)
