"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing: every word form has a fixed sparse index vector, drawn from its hash, and so has its shape
(capitals, digits, attached symbols). A word's context vector is the sum of the index vectors of the words
within ``REACH`` places of it, over all documents. Forms share ``ROWS`` hashed rows, so the table has one
size for any corpus; it is summed in tasks and across tasks, and only the sums reach the driver.

Pooling: a document's features are the mean context vector of its words (rows of unit length), the mean
index vectors of its forms and of its shapes, the squared lengths of these three, the mean agreement of
neighbouring words, the share of repeated forms and the logarithm of its length.

Network: one hidden layer, in numpy, fitted on at most about ``sample`` labelled rows, picked by a hash of
the id over all of them; a fifth of these is kept aside to choose the epoch and then the temperature that
makes the probabilities fit.

Inputs: null and empty texts have zero features and get the score that the network gives those; null labels
and ids teach nothing; several labels of an id count as their largest; without labels, or with one class
only, every score is that class's share (0.5 without any); an empty table gives an empty result; a column of
an added name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandflow.llm._text import U64, chosen, held_out, lists, mix, with_columns
from strandflow.runtime import Scratch

ROWS, WIDTH, REACH = 8192, 32, 2
CHUNKS = 256  # of rows of the table, each summed by itself
SHAPES = 64
N_FEATURES = 3 * WIDTH + 6


def _index(keys: np.ndarray, salt: int) -> np.ndarray:
    """Sparse ternary vectors: four entries of +1 or -1 each, drawn by hash."""
    out = np.zeros((len(keys), WIDTH), np.float32)
    for k in range(4):
        h = mix(keys.astype(U64) + U64(salt * 16 + k + 1))
        np.add.at(out, (np.arange(len(keys)), (h % U64(WIDTH)).astype(int)), np.where((h >> U64(40)) & U64(1), 1.0, -1.0))
    return out


FORM_INDEX, SHAPE_INDEX = _index(np.arange(ROWS), 1), _index(np.arange(SHAPES), 2)


class _Words(dict):
    """word -> shape * ROWS + hashed form; a memo of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        n = len(word)
        symbols = n - len(word.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        digits = n - len(word.translate(None, b"0123456789"))
        text = word.decode(errors="replace")
        kind = 3 if not text.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") else 2 if n > 1 and text.upper() == text and text.lower() != text else 1 if text[:1].isupper() else 0
        shape = kind + 4 * min(symbols, 3) + 16 * (digits > 0) + 32 * (n > 24)
        self[word] = code = shape * ROWS + xxhash.xxh32_intdigest(word) % ROWS
        return code

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_words = _Words()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's context sums, by chunk of rows: compressed 64-bit integers."""
    table = np.zeros((ROWS, WIDTH))
    for batch in batches:
        todo: list[np.ndarray] = []
        held = 0
        for text in batch.column(0).to_pylist():
            if len(code := _words.of(text)) > 1:
                todo.append(code)
                held += len(code)
            if held > 100_000:
                _add(table, todo)
                todo, held = [], 0
        if todo:
            _add(table, todo)
    per = ROWS // CHUNKS
    whole = table.astype(np.int64)
    chunks = [k for k in range(CHUNKS) if whole[k * per : (k + 1) * per].any()]
    yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int32()), "sums": pa.array([zlib.compress(whole[k * per : (k + 1) * per].tobytes(), 1) for k in chunks], pa.binary())})


def _add(table: np.ndarray, docs: list[np.ndarray]) -> None:
    code = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    form = code % ROWS
    own = FORM_INDEX[form] + SHAPE_INDEX[code // ROWS]
    near = np.zeros_like(own)
    for k in range(1, REACH + 1):
        same = (doc[k:] == doc[:-k])[:, None]
        near[:-k] += own[k:] * same
        near[k:] += own[:-k] * same
    order = np.argsort(form.astype(np.uint16), kind="stable")
    rows, start = np.unique(form[order], return_index=True)
    table[rows] += np.add.reduceat(near[order], start, axis=0)


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table["sums"].to_pylist())
    return pa.table({"chunk": table["chunk"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context vectors over all documents: ``ROWS`` rows of unit length (or zero)."""
    parts = docs.select(F.col(text).cast("binary")).mapInArrow(_contexts, "chunk int, sums binary")
    table, per = np.zeros((ROWS, WIDTH)), ROWS // CHUNKS
    for chunk, sums in parts.groupBy("chunk").applyInArrow(_sum, "chunk int, sums binary").collect():
        table[chunk * per : (chunk + 1) * per] = np.frombuffer(sums, np.int64).reshape(per, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    """The features of one document."""
    out = np.zeros(N_FEATURES, np.float32)
    code = _words.of(text)
    n = len(code)
    if not n:
        return out
    form = code % ROWS
    context = vectors[form]
    means = [context.mean(axis=0), FORM_INDEX[form].mean(axis=0), (np.bincount(code // ROWS, minlength=SHAPES) @ SHAPE_INDEX) / n]
    out[: 3 * WIDTH] = np.concatenate(means)
    out[3 * WIDTH : 3 * WIDTH + 3] = [float(m @ m) for m in means]
    out[-3] = float((context[1:] * context[:-1]).sum(axis=1).mean()) if n > 1 else 0.0
    out[-2] = 1 - len(np.unique(code)) / n
    out[-1] = np.log1p(n)
    return out


class Network:
    """Two layers and a temperature; ``prior`` stands in where there was nothing to learn."""

    def __init__(self, prior: float = 0.5, weights: list[np.ndarray] | None = None, center=0.0, scale=1.0, temperature: float = 1.0):
        self.prior, self.weights, self.center, self.scale, self.temperature = prior, weights, center, scale, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.center) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 80, seed: int = 7) -> Network:
        if not len(y) or y.min() == y.max():
            return cls(float(y.mean()) if len(y) else 0.5)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        aside, own = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
        net = cls(float(y.mean()), None, x[own].mean(axis=0), x[own].std(axis=0) + 1e-3)
        w = net.weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.array(np.log(net.prior / (1 - net.prior)))]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        z, t, best, step = (x - net.center) / net.scale, y.astype(float), (np.inf, None), 0
        loss = lambda a, q, temp=1.0: float(np.mean(np.logaddexp(0, a / temp) - q * a / temp))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // 256)):
                if not len(part):
                    continue
                pre = z[part] @ w[0] + w[1]
                act = np.maximum(pre, 0)
                err = (1 / (1 + np.exp(-np.clip(act @ w[2] + w[3], -40, 40))) - t[part]) / len(part)
                back = np.outer(err, w[2]) * (pre > 0)
                grads = [z[part].T @ back + 1e-4 * w[0], back.sum(axis=0), act.T @ err + 1e-4 * w[2], err.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            now = loss(net.logits(x[aside]), t[aside])
            if now < best[0]:
                best = (now, [p.copy() for p in w])
        net.weights = best[1] or w
        kept = net.logits(x[aside])
        net.temperature = min(np.exp(np.linspace(-1.5, 1.5, 61)), key=lambda temp: loss(kept, t[aside], temp))
        return net


class QualityModel:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score``, the probability of label 1."""
        shared, net = docs.sparkSession.sparkContext.broadcast(self.vectors), self.network

        def make():
            def score(texts: list) -> dict:
                x = np.array([pooled(t, shared.value) for t in texts]).reshape(len(texts), N_FEATURES)
                return {"score": net.probability(x.astype(float))}

            return score

        return with_columns(docs, text, make, T.StructType([T.StructField("score", T.DoubleType())]))


def features(docs: DataFrame, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without its text, and ``features``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        def run(texts: list) -> dict:
            x = np.array([pooled(t, shared.value) for t in texts], np.float32)
            return {"features": lists(x.reshape(-1), [N_FEATURES] * len(texts))}

        return run

    return with_columns(docs, text, make, T.StructType([T.StructField("features", T.ArrayType(T.FloatType()))])).drop(text)


def fit(table: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", *, sample: int = 20_000) -> Network:
    """The network for a table of ``(doc_id, features)``, from labels of rows that may teach."""
    able = labels.where(F.col(label).isin(0, 1) & chosen(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("y"))
    n = able.count()
    draw = F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)) + 1)
    rows = table.join(able.where(draw), F.col(doc_id) == F.col("__id")).select("features", "y", F.col("__id").cast("long").alias("id")).toPandas()
    rows = rows.sort_values("id", kind="stable")
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), N_FEATURES)
    return Network.fitted(x, rows["y"].to_numpy())


def scored(table: DataFrame, network: Network) -> DataFrame:
    """A table of :func:`features` with ``score``, the probability of label 1, in their place."""
    kept = [c for c in table.columns if c.lower() not in ("features", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept)).flatten().to_numpy().astype(float).reshape(batch.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(network.probability(x), pa.float64())], names=[*kept, "score"])

    own = table.select(*[F.col(f"`{c}`") for c in kept], "features")
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; the features are computed once, for fitting and scoring."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table = Scratch(spark, "quality").save(features(docs, word_vectors(docs)), "features")
    net = fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(table, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}
