"""Quality classifier (operator 1): random-indexing word vectors, pooled, and a two-layer network.

1. A bounded sample of labelled learning documents (``Settings.sample_docs``, those of the smallest
   id hashes) gives the vocabulary: its most frequent tokens, at most ``vocabulary``. Every other
   token stands for its shape (upper case, lower case, capitalised, number, sign, other).
2. Random indexing: each token has a sparse ternary index vector drawn from its hash; the vector of
   a token is the sum of the index vectors of the tokens up to ``window`` places around it in the
   sample, brought to length 1. Sums are of whole numbers and are made by Spark, so the vectors do
   not depend on how the sample is partitioned.
3. A document is pooled over all its tokens: mean and spread of their vectors, and the mean product
   of neighbouring vectors. Dense random sign vectors, drawn from each token itself and pooled the
   same way, tell how often tokens repeat at distances of one to three and over the whole text.
4. A network of two layers (numpy, Adam) learns the label from the pooled sample; one fifth of the
   sample is held back to fit the temperature that calibrates its probabilities.

The model is of fixed size, whatever the corpus, and goes to the executors as a broadcast.

Defined results: a null or empty text is pooled as zeros and scored like any other; documents with
a null id are scored and never learned from; several labels for one id count as the smallest;
without any labels every score is the prior, 0.5; repeated rows are scored one by one; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, known_id, null_id, slices


@dataclass(frozen=True)
class Settings:
    sample_docs: int = 8_000     # labelled documents learned from, at most
    vocabulary: int = 20_000     # words with a vector of their own, at most
    dims: int = 32
    nonzero: int = 4             # entries of an index vector
    window: int = 2
    hidden: int = 24
    epochs: int = 60
    batch: int = 128
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 17


#: Rare tokens of a shape are told apart by so many hash values, and by sign vectors of so many entries.
HASHES, SIGNS, LAGS = 512, 16, 3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Stand-ins for rare tokens, by shape; their names can't be tokens of a text.
SHAPES = ("shape upper", "shape lower", "shape title", "shape number", "shape sign", "shape other")


def shape_of(token: str) -> int:
    if token.isupper():
        return 0
    if token.islower():
        return 1
    if token.istitle():
        return 2
    if token.isnumeric():
        return 3
    return 5 if token.isalnum() else 4


def index_vector(token: str, s: Settings) -> np.ndarray:
    rng = np.random.default_rng([s.seed, zlib.crc32(token.encode())])
    v = np.zeros(s.dims, np.int64)
    v[rng.choice(s.dims, s.nonzero, replace=False)] = rng.choice([-1, 1], s.nonzero)
    return v


class Vocabulary:
    """Token to row number; after the words come the shapes, each with HASHES rows."""

    def __init__(self, words: list[str], seed: int = 0) -> None:
        self.words = words
        self.row = {w: i for i, w in enumerate(words)}
        n = len(words)
        #: Of every row, the word or shape whose vector it has.
        self.base = np.concatenate([np.arange(n), n + np.repeat(np.arange(len(SHAPES)), HASHES)])
        rng = np.random.default_rng(seed)
        self.signs = (rng.integers(0, 2, (len(self.base), SIGNS)) * 2 - 1).astype(np.float32) / SIGNS**0.5

    def __len__(self) -> int:
        return len(self.words) + len(SHAPES)

    def rows(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text) if text else []
        n = len(self.words)
        get = self.row.get
        return np.array([r if (r := get(t)) is not None else
                         n + shape_of(t) * HASHES + zlib.crc32(t.encode("utf-8", "surrogatepass")) % HASHES
                         for t in tokens], np.int64)


def pooled(rows: np.ndarray, vocabulary: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and neighbour product of the vectors of ``rows``, and how tokens repeat."""
    dims = vectors.shape[1]
    if not len(rows):
        return np.zeros(3 * dims + LAGS + 1, np.float32)
    mean, square, product = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    sign, repeats = np.zeros(SIGNS), np.zeros(LAGS)
    step = 20_000
    for i in range(0, len(rows), step):  # very long texts in parts, with the next part's first rows
        part = rows[i:i + step + LAGS]
        v, q = vectors[vocabulary.base[part[:step + 1]]], vocabulary.signs[part]
        own = v[:step]
        mean += own.sum(0)
        square += np.einsum("ij,ij->j", own, own)
        product += np.einsum("ij,ij->j", v[:-1], v[1:])
        sign += q[:step].sum(0)
        for k in range(1, LAGS + 1):
            near = q[k:step + k]
            repeats[k - 1] += np.einsum("ij,ij->", q[: len(near)], near)
    mean /= len(rows)
    spread = np.sqrt(np.maximum(square / len(rows) - mean**2, 0))
    return np.concatenate([
        mean, spread, product / max(1, len(rows) - 1), repeats / np.maximum(1, len(rows) - np.arange(1, LAGS + 1)),
        [np.sum((sign / len(rows)) ** 2)]]).astype(np.float32)


@dataclass
class Network:
    """Two layers, and the temperature its logits are divided by."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.centre) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5:]
    centre, scale = x[learn].mean(0), x[learn].std(0) + 1e-6
    net = Network(centre, scale, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], s.hidden)),
                  np.zeros(s.hidden), rng.normal(0, (1 / s.hidden) ** 0.5, s.hidden), 0.0)
    z = (x - centre) / scale
    parts = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(s.epochs):
        rng.shuffle(learn)
        for i in range(0, len(learn), s.batch):
            rows = learn[i:i + s.batch]
            h = np.maximum(z[rows] @ parts[0] + parts[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3], -35, 35))) - y[rows]) / len(rows)
            back = np.outer(error, parts[2]) * (h > 0)
            slopes = [z[rows].T @ back + s.decay * parts[0], back.sum(0), h.T @ error + s.decay * parts[2],
                      np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(parts, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(parts[3][0])
    if len(held):
        net.temperature = fit_temperature(net.logits(x[held]), y[held])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss on held-back rows, between 1/4 and 16."""
    def loss(t: float) -> float:
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return float(min(np.geomspace(0.25, 16, 121), key=loss))


class QualityModel:
    def __init__(self, vocabulary: Vocabulary, vectors: np.ndarray, network: Network | None) -> None:
        self.vocabulary, self.vectors, self.network = vocabulary, vectors, network

    def pool(self, texts: pd.Series) -> np.ndarray:
        return np.stack([pooled(self.vocabulary.rows(t), self.vocabulary, self.vectors) for t in texts])

    def score(self, texts: pd.Series) -> np.ndarray:
        return np.full(len(texts), 0.5) if self.network is None else self.network.probability(self.pool(texts))


def learning_sample(docs: DataFrame, labels: DataFrame, learn_from: Column, s: Settings) -> DataFrame:
    """At most ``sample_docs`` labelled documents (text, y) of the learning rows."""
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(learn_from)
           .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_docs))
    # Bounded by sample_docs rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, s: Settings | None = None) -> QualityModel:
    """Learn from the rows of ``labels`` (doc_id, quality) for which ``learn_from`` holds."""
    s = s or Settings()
    bound_batches(docs.sparkSession)
    # The bounded sample is read by three passes: keep it, it is some megabytes.
    sample = learning_sample(docs, labels, learn_from, s).repartition(12, "doc_id").cache()
    try:
        return _fit(sample, s)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame, s: Settings) -> QualityModel:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"].dropna():
                met.update(TOKEN.findall(t))
        if met:
            yield pd.DataFrame({"token": list(met), "n": list(met.values())})

    words = [r["token"] for r in sample.select("text").mapInPandas(count, "token string, n long")
             .groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
             .orderBy(F.desc("n"), "token").limit(s.vocabulary).collect()]
    vocabulary = Vocabulary(words, s.seed)
    index = np.stack([index_vector(w, s) for w in [*words, *SHAPES]])

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(vocabulary), s.dims), np.int64)
        for pdf in slices(batches):
            for t in pdf["text"]:
                rows = vocabulary.base[vocabulary.rows(t)]
                for k in range(1, s.window + 1):
                    np.add.at(total, rows[:-k], index[rows[k:]])
                    np.add.at(total, rows[k:], index[rows[:-k]])
        used = np.flatnonzero(np.abs(total).sum(1))
        if len(used):
            yield pd.DataFrame({"row": used, **{f"d{j}": total[used, j] for j in range(s.dims)}})

    dims = [f"d{j}" for j in range(s.dims)]
    sums = (sample.select("text").mapInPandas(contexts, "row long, " + ", ".join(f"{d} long" for d in dims))
            .groupBy("row").agg(*[F.sum(d).alias(d) for d in dims]).toPandas())  # vocabulary rows at most
    vectors = np.zeros((len(vocabulary), s.dims), np.float32)
    vectors[sums["row"].to_numpy(np.int64)] = sums[dims].to_numpy(np.float32)
    # Frequent neighbours weigh on all words alike; their common part tells nothing.
    vectors -= vectors.mean(0) if len(vectors) else 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    model = QualityModel(vocabulary, vectors, None)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": list(model.pool(pdf["text"]))})

    got = sample.mapInPandas(features, "doc_id long, y int, x array<float>").toPandas()
    if len(got):
        got = got.sort_values("doc_id", kind="stable")  # the same order however tasks end
        model.network = train(np.stack(got["x"].to_numpy()).astype(float), got["y"].to_numpy(float), s)
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted; ids are carried, not looked at."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: vocabulary x dims and the network

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            p = shared.value.score(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": p, "predicted": (p >= 0.5).astype(int)})

    return (docs.select(known_id(), "text")
            .mapInPandas(score, "doc_id long, score double, predicted int").withColumn("doc_id", null_id()))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with their own columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [shared.value.score(p["text"]) for p in slices([texts.to_frame("text")])]
        return pd.Series(np.concatenate(parts) if parts else [])

    return docs.where(score("text") >= least)
