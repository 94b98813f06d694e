"""A quality classifier on random-indexing word vectors.

Every word has a fixed sparse index vector, derived from its hash. Its context vector is the sum of the index vectors of
its neighbours, up to ``WINDOW`` words away, over all texts of the corpus. Words are counted over the whole corpus first;
all down to the frequency at which there are no more than ``OWN`` of them have a vector of their own, and the rarer ones,
which together are few of the tokens, share ``SHARED`` vectors by their hash. So the table of vectors has a fixed bound,
however many different words there are, and every word counts. Tasks send the rows that they met; these are added by
block in two shuffles. Runs of punctuation are words too, and case counts. A document is the mean and the spread of its
words' centred unit vectors. A two-layer network is fitted on a bounded sample of labelled documents, and a temperature is
fitted on documents held out from it.

Cases. Null text is scored as empty text; a text without words has the features 0. A null ``doc_id`` is scored and stays
null. Labels that are null, contradictory or of no document are ignored. With fewer than ``MIN_LABELS`` usable labels of
either class, every document has the probability 0.5 and is kept. Repeated rows are each scored, equally. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.text import mix, slices, word_hashes
from corpusflow.llm.toxicity import labelled
from corpusflow.session import materialize

#: Words that have vectors of their own, at most, and vectors that all others share.
OWN = 1 << 17
SHARED = 1 << 14
#: Classes of word frequencies for each doubling.
STEPS = 16
WIDTH = 32
WINDOW = 2
NONZERO = 2
BLOCKS = 64
PER_SUM = 64
#: Labelled rows that training may use; the sample is the rows of least hash.
MAX_LABELS = 24_000
MIN_LABELS = 8
HIDDEN = 32
#: Bytes of text handled at once.
SLICE = 1 << 20
THRESHOLD = 0.5
_SEED = 11


@dataclass
class Vocabulary:
    """The hashes of the words that have rows of their own, ascending; others share the rows after these."""

    own: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.own) + SHARED

    def of(self, hashes: np.ndarray) -> np.ndarray:
        shared = len(self.own) + (hashes & np.uint64(SHARED - 1)).astype(np.int64)
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, at, shared)


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of the words' index vectors (words x NONZERO)."""
    bits = np.stack([mix(hashes + np.uint64(k + 1)) for k in range(NONZERO)], axis=1)
    return (bits % np.uint64(WIDTH)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words, which of them each word is, and the offset of each text's first word."""
    hashes, offsets = word_hashes(texts, marks=True)
    different, words = np.unique(hashes, return_inverse=True)
    return different, words, offsets


def vocabulary(docs: DataFrame, most: int = OWN) -> Vocabulary:
    """All words down to the frequency class at which there are at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, n = np.unique(word_hashes(part.column("text"), marks=True)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.select("word", F.floor(F.log2("n") * STEPS).cast("int").alias("class")), "quality-words")
    total, least = 0, None
    for r in counts.groupBy("class").count().orderBy(F.desc("class")).collect():  # STEPS a doubling
        total += r["count"]
        if total > most:
            break
        least = r["class"]
    words = counts.where(F.lit(least is not None) & (F.col("class") >= F.lit(least))).select("word").toArrow()  # ``most`` rows at most
    return Vocabulary(np.sort(words.column("word").to_numpy().view(np.uint64)))


def contexts(texts: pa.Array, known: Vocabulary, total: np.ndarray) -> None:
    """Add the index vectors of all neighbours to ``total`` (rows x WIDTH + 1), and their number in its last column."""
    different, words, offsets = _distinct(texts)
    places, signs = index_vectors(different)
    text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    part = np.zeros((len(different), WIDTH + 1))
    for step in range(1, WINDOW + 1):
        same = text_of[step:] == text_of[:-step]
        left, right = words[:-step][same], words[step:][same]
        for one, other in ((left, right), (right, left)):
            part[:, WIDTH] += np.bincount(one, minlength=len(different))
            for j in range(NONZERO):
                part[:, :WIDTH] += np.bincount(one * WIDTH + places[other, j], weights=signs[other, j], minlength=len(different) * WIDTH).reshape(-1, WIDTH)
    np.add.at(total, known.of(different), part.astype(total.dtype))


def _packed(x: np.ndarray) -> bytes:
    """The rows of ``x`` that are not 0, with their numbers."""
    at = np.flatnonzero(x[:, -1])
    return np.int64(len(at)).tobytes() + at.astype(np.int64).tobytes() + x[at].tobytes()


def _unpacked(x: bytes, rows: int, dtype: type) -> np.ndarray:
    n = int(np.frombuffer(x, np.int64, 1)[0])
    out = np.zeros((rows, WIDTH + 1), dtype=np.int64)
    out[np.frombuffer(x, np.int64, n, 8)] = np.frombuffer(x, dtype, n * (WIDTH + 1), 8 + 8 * n).reshape(n, WIDTH + 1)
    return out


def word_vectors(docs: DataFrame, known: Vocabulary) -> np.ndarray:
    """Centred unit vectors of all rows of words (rows x WIDTH)."""
    shape = "block int, part int, x binary"
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most OWN hashes
    size = -(-known.rows // BLOCKS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((BLOCKS * size, WIDTH + 1), dtype=np.int32)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                contexts(part.column("text"), shared.value, total)
        of = TaskContext.get().partitionId() // PER_SUM
        for block in range(BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([of], pa.int32()), pa.array([_packed(total[block * size : (block + 1) * size])], pa.binary())], names=["block", "part", "x"])

    def add(dtype: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for block, part, x in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "x"))):
                    value = _unpacked(x, size, dtype)
                    key = (block, part)
                    totals[key] = totals[key] + value if key in totals else value
            for (block, part), value in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([_packed(value)], pa.binary())], names=["block", "part", "x"])

        return run

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(gather, shape)
    sums = parts.repartition("block", "part").mapInArrow(add(np.int32), shape)
    sums = sums.withColumn("part", F.lit(0)).repartition("block").mapInArrow(add(np.int64), shape)
    total = np.zeros((BLOCKS * size, WIDTH + 1))
    for r in sums.collect():
        total[r["block"] * size : (r["block"] + 1) * size] = _unpacked(r["x"], size, np.int64)
    total = total[: known.rows]
    seen = total[:, WIDTH]
    mean = total[:, :WIDTH].sum(axis=0) / max(seen.sum(), 1)
    vectors = total[:, :WIDTH] / np.maximum(seen, 1)[:, None] - mean
    vectors[seen == 0] = 0
    norm = np.sqrt((vectors**2).sum(axis=1))
    return (vectors / np.maximum(norm, 1e-12)[:, None]).astype(np.float32)


def pooled(texts: pa.Array, known: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the logarithm of its number of words."""
    different, words, offsets = _distinct(texts)
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 2 * WIDTH + 1), dtype=np.float32)
    if len(full):
        x = vectors[known.of(different)][words]
        first, count = offsets[:-1][full], n[full][:, None]
        mean = np.add.reduceat(x, first, axis=0, dtype=np.float64) / count
        np.multiply(x, x, out=x)
        out[full, :WIDTH] = mean
        out[full, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(x, first, axis=0, dtype=np.float64) / count - mean**2, 0))
        out[full, -1] = np.log1p(n[full])
    return out


class Network:
    """One hidden layer of rectified units and a logistic output, fitted by Adam with weight decay."""

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, batch: int = 128, rate: float = 0.003, decay: float = 1e-3) -> Network:
        rng = np.random.default_rng(_SEED)
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.shift) / self.scale
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        step = 0
        epochs = max(epochs, -(-2000 * batch // len(x)))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), batch):
                at = order[start : start + batch]
                h = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[at]) / len(at)
                back = np.outer(g, self.w[2]) * (h > 0)
                grads = [x[at].T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]
                step += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.w[k])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.shift) / self.scale
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that gives held-out labels the greatest likelihood, by golden section on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    while b - a > 1e-4:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    known: Vocabulary
    vectors: np.ndarray
    network: Network | None = None
    heat: float = 1.0

    def probability(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        z = self.network.logits(pooled(texts, self.known, self.vectors).astype(np.float64)) / self.heat
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> Model:
    known = vocabulary(docs)
    vectors = word_vectors(docs, known)
    shared = docs.sparkSession.sparkContext.broadcast(Model(known, vectors))  # at most OWN + SHARED vectors, whatever the corpus
    sample = materialize(labelled(docs, labels, most, "quality"), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = pooled(part.column("text"), shared.value.known, shared.value.vectors)
                yield pa.RecordBatch.from_arrays([part.column("fold"), part.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], names=["fold", "quality", "x"])

    rows = sample.mapInArrow(run, "fold int, quality int, x binary").collect()
    rows.sort(key=lambda r: (r["fold"], r["quality"], bytes(r["x"])))
    y = np.array([r["quality"] for r in rows], dtype=float)
    if min(y.sum(), (1 - y).sum()) < MIN_LABELS if len(y) else True:
        return Model(known, vectors)
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows]).astype(np.float64)
    held = np.array([r["fold"] for r in rows]) == 0
    if held.all() or not held.any() or len(np.unique(y[~held])) < 2:
        held = np.arange(len(y)) % 5 == 0
    network = Network().fit(x[~held], y[~held])
    return Model(known, vectors, network, temperature(network.logits(x[held]), y[held]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality (a calibrated probability), keep (whether it reaches ``threshold``) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                p = shared.value.probability(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "quality", "keep"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, quality double, keep boolean")
