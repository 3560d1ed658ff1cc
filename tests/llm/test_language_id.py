from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from strandflow.llm.language_id import START, fit, letter_runs, op9_language_id, piece_vocabulary_path, pieces_of, word_scores
from tests.conftest import SF


def brute_word(word: str, names: dict, logp: np.ndarray) -> np.ndarray:
    """Sum over all ways to cut the word; a single character outside the vocabulary is the last piece."""
    text, total = START + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(text[at:k])
                at = k
        ids = [names.get(p, len(logp) - 1 if len(p) == 1 else None) for p in parts]
        if None not in ids:
            total = total + np.exp(logp[ids].sum(axis=0))
    return np.log(total)


def test_forward_sums_all_segmentations():
    import sentencepiece

    pieces = pieces_of(piece_vocabulary_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary_path())
    kept = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    names = {p: k for k, p in enumerate(kept) if len(p) <= pieces.longest}
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(pieces.n), 2).T)
    words = ["the", "straße", "señor", "ab", "zzyx", "日x", "a"]
    got = word_scores(pieces, words, logp)
    for w, x in zip(words, got, strict=True):
        assert x == pytest.approx(brute_word(w, names, logp))


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = op9_language_id(spark, SF).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    aside = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in aside) >= 0.97 * len(aside)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    teach = [(k, t, lang, "x") for k in range(60) for t, lang in [("the cat and the dog were there", "en")] if k % 2] + [(k, "der Hund und die Katze sind nicht hier", "de", "x") for k in range(0, 60, 2)]
    df = spark.createDataFrame(teach, schema)
    model = fit(df)
    odd = [(1, None, None, "x"), (2, "", None, "x"), (3, "123 !!! ", None, "x"), (None, "the dog", None, "x"), (5, "die Katze " * 20_000, None, "x"), (6, "q" * 5000, None, "x"), (6, "q" * 5000, None, "x"), (7, "½ ² ① Ⅷ", None, "x")]
    got = [(r["doc_id"], r["lang_pred"]) for r in model.predict(spark.createDataFrame(odd, schema)).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de")] and len(got) == 8 and got[7] == (7, "und")
    assert model.predict(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in fit(df.limit(0)).predict(df).collect()} == {"und"}


def test_letters_are_those_of_isalpha():
    assert letter_runs("a½b Ⅷ Ünï_x 3c ①") == ["a", "b", "ünï", "x", "c"]
    assert all((letter_runs(chr(c)) != []) == chr(c).lower()[0].isalpha() for c in range(0x3000))
