"""Language identification by unigram pieces, marginalised over segmentations.

The pieces are a fixed public vocabulary. Each language has a probability for each piece; a word's
probability is the sum over all its segmentations of the products of their pieces' probabilities, which the
forward algorithm gives without listing them. A text's score is the sum of the logarithms over its words
(letter runs, lower case, with the word-start mark in front), and the posterior of the best language.

Fitting: words are counted by language on at most about ``sample`` labelled rows (picked by a hash of the
id, over all rows), and two rounds of expectation maximisation share each word's count among the pieces of
its segmentations. Both run as Spark jobs; what reaches the driver is at most one number for each piece and
language. Scoring reads every whole text; each task keeps a bounded memo of word scores.

Inputs: a null text, or one without a letter, is ``und`` with score 0; null ids teach nothing; labels other
than those seen in teaching rows cannot be predicted, and without any teaching row all is ``und``; an empty
table gives an empty result; a column of an added name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandflow.llm._text import chosen, held_out, mix, with_columns
from strandflow.runtime import Scratch

START = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_LATTICE = 1 << 17  # characters of equally long words that are scored at once
_BASE = 0x9E3779B97F4A7C15


def piece_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters, in lower case; signs like a half or a Roman numeral are none."""
    out = []
    for run in _LETTERS.findall(text.lower()):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


class Pieces:
    """The vocabulary's pieces by length, found in many words at once by rolling hashes."""

    def __init__(self, path: str, longest: int = 16):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.n = len(names) + 1  # the last is any single character without a piece
        self.longest = min(longest, max(map(len, names)))
        self.tables = {}
        by_length = defaultdict(list)
        for i, name in enumerate(names):
            by_length[len(name)].append((i, name))
        for length in range(1, self.longest + 1):
            own = by_length.get(length, [])
            keys = np.array([self.prefixes(np.array([[*map(ord, name)]]))[0, -1] for _, name in own], np.uint64)
            order = np.argsort(keys)
            self.tables[length] = (keys[order], np.array([i for i, _ in own], np.int32)[order])

    @staticmethod
    def prefixes(chars: np.ndarray) -> np.ndarray:
        """Hash of the first k characters of each row, k from 0."""
        codes = mix(chars.astype(np.uint64) + np.uint64(1))
        out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        for k in range(chars.shape[1]):
            out[:, k + 1] = out[:, k] * np.uint64(_BASE) + codes[:, k]
        return out

    def lattice(self, words: list[str]) -> tuple[int, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """For words of one length: by (start, stop), the rows that have a piece there and its number."""
        chars = np.array([[*map(ord, w)] for w in words], np.int64)
        n, size = chars.shape
        pre, power, found = self.prefixes(chars), 1, {}
        for length in range(1, min(self.longest, size) + 1):
            power = power * _BASE % (1 << 64)
            keys, ids = self.tables[length]
            if not len(keys) and length > 1:
                continue
            windows = pre[:, length:] - pre[:, : size + 1 - length] * np.uint64(power)
            at = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
            hit = keys[at] == windows
            got = np.where(hit, ids[at], self.n - 1)
            for start in range(size + 1 - length):
                rows = np.arange(n) if length == 1 else np.flatnonzero(hit[:, start])
                if len(rows):
                    found[start, start + length] = (rows, got[rows, start])
        return size, found


def forward(size: int, found: dict, n: int, logp: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each prefix: (row, prefix length, language)."""
    alpha = np.full((n, size + 1, logp.shape[1]), -np.inf)
    alpha[:, 0] = 0.0
    for (start, stop), (rows, ids) in sorted(found.items(), key=lambda x: x[0][1]):
        alpha[rows, stop] = np.logaddexp(alpha[rows, stop], alpha[rows, start] + logp[ids])
    return alpha


def word_scores(pieces: Pieces, words: list[str], logp: np.ndarray) -> np.ndarray:
    """(word, language): log of the probability, marginalised over segmentations."""
    out, by_size = np.zeros((len(words), logp.shape[1])), defaultdict(list)
    for k, w in enumerate(words):
        by_size[len(w)].append(k)
    for length, own in by_size.items():
        step = max(1, min(4096, _LATTICE // (length + 1)))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            size, found = pieces.lattice([START + words[k] for k in some])
            out[some] = forward(size, found, len(some), logp)[:, size]
    return out


def expected_pieces(pieces: Pieces, words: list[str], languages: np.ndarray, counts: np.ndarray, logp: np.ndarray) -> dict[tuple[int, int], float]:
    """Expected number of each (language, piece), each word's count shared among its segmentations."""
    total: dict[tuple[int, int], float] = defaultdict(float)
    by_size = defaultdict(list)
    for k, w in enumerate(words):
        by_size[len(w)].append(k)
    for length, own in by_size.items():
        step = max(1, min(4096, _LATTICE // (length + 1)))
        for at in range(0, len(own), step):
            some = np.array(own[at : at + step])
            lang, count, rows_all = languages[some], counts[some], np.arange(len(some))
            size, found = pieces.lattice([START + words[k] for k in some])
            alpha = forward(size, found, len(some), logp)[rows_all[:, None], np.arange(size + 1), lang[:, None]]
            beta = np.full((len(some), size + 1), -np.inf)
            beta[:, size] = 0.0
            ordered = sorted(found.items(), key=lambda x: -x[0][0])
            for (start, stop), (rows, ids) in ordered:
                beta[rows, start] = np.logaddexp(beta[rows, start], beta[rows, stop] + logp[ids, lang[rows]])
            for (start, stop), (rows, ids) in ordered:
                share = np.exp(alpha[rows, start] + logp[ids, lang[rows]] + beta[rows, stop] - alpha[rows, size]) * count[rows]
                keys, back = np.unique(lang[rows].astype(np.int64) * pieces.n + ids, return_inverse=True)
                for key, x in zip(keys.tolist(), np.bincount(back, share).tolist(), strict=True):
                    total[divmod(key, pieces.n)] += x
    return total


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[lang].update(letter_runs(text))
            if len(total[lang]) > 500_000:
                yield _counted(total)
                total.clear()
    if total:
        yield _counted(total)


def _counted(total: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, w, n) for lang, words in total.items() for w, n in words.items()]
    return pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})


class LanguageModel:
    """Languages and the log probability of each piece in each: (piece, language)."""

    def __init__(self, languages: list[str], logp: np.ndarray, path: str):
        self.languages, self.logp, self.path = languages, logp, path

    def predict(self, docs: DataFrame, text: str = "text", memo: int = 300_000) -> DataFrame:
        """``docs`` with ``lang_pred`` and ``score``."""
        languages, path, shared = self.languages, self.path, docs.sparkSession.sparkContext.broadcast(self.logp.astype(np.float32))
        added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

        def make():
            logp, pieces = shared.value.astype(np.float64), pieces_of(path)
            place: dict[str, int] = {}
            known = np.zeros((1024, max(1, len(languages))))

            def predict(texts: list) -> dict:
                nonlocal known
                words = [letter_runs(t.decode()) if t and languages else [] for t in texts]
                if len(place) > memo:
                    place.clear()
                new = list(set().union(*words).difference(place)) if words else []
                if new:
                    need = len(place) + len(new)
                    if need > len(known):
                        known = np.concatenate([known, np.zeros((max(need, 2 * len(known)) - len(known), known.shape[1]))])
                    at = len(place)
                    known[at:need] = word_scores(pieces, new, logp)
                    place.update(zip(new, range(at, need), strict=True))
                names, scores = [], []
                for own in words:
                    if not own:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = known[np.fromiter(map(place.__getitem__, own), np.int64, len(own))].sum(axis=0)
                    best = int(total.argmax())
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                return {"lang_pred": names, "score": scores}

            return predict

        return with_columns(docs, text, make, added)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", *, sample: int = 12_000, rounds: int = 2, path: str | None = None) -> LanguageModel:
    """Learn from rows with a language whose id may teach (see ``chosen``)."""
    spark, path = docs.sparkSession, path or piece_vocabulary_path()
    scratch = Scratch(spark, "language")
    able = docs.where(F.col(lang).isNotNull() & chosen(doc_id))
    n = able.count()
    draw = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)) + 1)
    rows = able.where(draw & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.save(counted, "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    size = pieces_of(path).n
    if not languages:
        return LanguageModel([], np.zeros((size, 1)), path)
    logp = np.full((size, len(languages)), -np.log(size))
    number = {x: k for k, x in enumerate(languages)}
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], float] = defaultdict(float)
            for batch in batches:
                d = batch.to_pydict()
                made = expected_pieces(pieces_of(path), d["word"], np.array([number[x] for x in d["lang"]], np.int64), np.array(d["n"], float), now.value)
                for key, x in made.items():
                    total[key] += x
            if total:
                keys = list(total)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.int32()), "piece": pa.array([k[1] for k in keys], pa.int32()), "x": pa.array([total[k] for k in keys], pa.float64())})

        got = words.mapInArrow(expect, "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).toPandas()
        count = np.zeros((size, len(languages)))
        count[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["x"].to_numpy()
        share = count / np.maximum(count.sum(axis=0), 1e-9)
        pooled = 0.9 * share.mean(axis=1, keepdims=True) + 0.1 / size
        # a language that lacks a piece backs off to its probability in all of them
        logp = np.log(0.99 * share + 0.01 * pooled)
    scratch.drop(words)
    return LanguageModel(languages, logp, path)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every whole text of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return model.predict(docs.select("doc_id", "text", held_out().alias("held_out"))).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
