"""Passages of just over 50 words, pasted inside sentences and lines, are always found and go but for their edges."""

from __future__ import annotations

import random

import pytest

from strandflow.llm.substring_dedup import repeated_spans

EDGE = 5  # words at either end that may stay


def _passage(rng, size: int, kind: str) -> str:
    words = [f"p{rng.randrange(10**7)}" for _ in range(size)]
    every, sign = {"plain": (size, ""), "thirds": (17, "."), "short": (5, "!"), "lines": (17, ".\n"), "tiny lines": (2, "\n"), "mixed": (rng.randint(1, 20), " -- ")}[kind]
    return " ".join(w + sign if k % every == every - 1 and k < size - 1 else w for k, w in enumerate(words))


@pytest.mark.parametrize("kind", ["plain", "thirds", "short", "lines", "tiny lines", "mixed"])
def test_every_passage_of_over_50_words_is_found(spark, kind):
    rng, texts, where = random.Random(kind), {}, {}
    own = lambda n: " ".join(f"o{rng.randrange(10**7)}" for _ in range(n))
    for case in range(200):
        passage = _passage(rng, 51 + case % 10, kind)
        for _ in range(2):
            left = own(rng.randint(1, 30)) + rng.choice([" ", " ", ". ", ".\n"])
            where[len(texts)] = (len(left), len(left) + len(passage))
            texts[len(texts)] = left + passage + rng.choice([" ", ", ", "\n"]) + own(rng.randint(1, 30))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in repeated_spans(df).collect()}
    assert set(found) == {d for d in texts if d % 2}
    for d, r in found.items():
        a, b = where[d]
        assert a <= r["start"] < r["stop"] <= b + 1 and r["kept_in"] == d - 1
        if kind not in ("lines", "tiny lines"):
            assert len(texts[d][a : r["start"]].replace("--", "").split()) <= EDGE and len(texts[d][r["stop"] : b].replace("--", "").split()) <= EDGE
