"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word falls into a bucket and every bucket has a sparse random index vector of signs. A bucket's
word vector sums the index vectors of the words around its occurrences, over all documents; the sums
are whole numbers, so they are the same in whatever order tasks end. A document is the mean of its
words' vectors, once by occurrence and once by distinct word, with a few shape figures. A network of
two layers in numpy, fitted on a bounded sample of labelled rows, scores it; one temperature
calibrates the probabilities on rows set aside.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphveil.llm.common import by_place, others, place_of, quoted, with_fields
from glyphveil.llm.op10_langid import temperature

#: Words: runs of letters, runs of digits, single signs.
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


@dataclass(frozen=True)
class Settings:
    """buckets: hashed words. dims: of a word vector. signs: entries of an index vector. window: neighbours on each side. sample: labelled rows to fit on, at most. hidden: units. steps, rate, batch: the optimiser's. aside: one row of so many calibrates."""

    buckets: int = 1 << 13
    dims: int = 32
    signs: int = 4
    window: int = 2
    sample: int = 6000
    hidden: int = 32
    steps: int = 3000
    rate: float = 0.005
    batch: int = 256
    aside: int = 5


class Hasher(dict):
    """The bucket of a word; at most `keep` words are remembered."""

    def __init__(self, buckets: int, keep: int = 400_000) -> None:
        self.buckets, self.keep = buckets, keep

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        self[word] = b
        return b

    def text(self, text: str | None) -> np.ndarray:
        found = _WORDS.findall(text or "")
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))


_hashers: dict[int, Hasher] = {}


def hasher(buckets: int) -> Hasher:
    return _hashers.setdefault(buckets, Hasher(buckets))


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector, from a fixed seed."""
    r = np.random.default_rng(5)
    return r.integers(0, s.dims, (s.buckets, s.signs)), r.choice(np.array([-1, 1]), (s.buckets, s.signs))


def context_sums(docs: DataFrame, s: Settings) -> np.ndarray:
    """The word vectors' sums over all documents (buckets x dims, whole numbers).

    A task sums its rows; one row a bucket and task is shuffled, after combining within the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_vectors(s)
        h = hasher(s.buckets)
        total = np.zeros(s.buckets * s.dims)
        seen = np.zeros(s.buckets, dtype=bool)

        def add(parts: list[np.ndarray]) -> None:
            # Texts lie end to end, `window` empty places apart, so that no window spans two texts.
            a = np.concatenate(parts)
            for k in range(1, s.window + 1):
                left, right = a[:-k], a[k:]
                both = (left >= 0) & (right >= 0)
                left, right = left[both], right[both]
                for word, near in ((left, right), (right, left)):
                    for j in range(s.signs):
                        total[:] += np.bincount(word * s.dims + at[near, j], weights=sign[near, j], minlength=len(total))

        gap, parts, n = np.full(s.window, -1, dtype=np.int64), [], 0
        for batch in batches:
            for t in batch.column(0):
                codes = h.text(t.as_py())
                seen[codes] = True
                for k in range(0, len(codes), 1 << 18):
                    parts += [codes[max(0, k - s.window) if k else 0 : k + (1 << 18)], gap] if k == 0 else [codes[k : k + (1 << 18)], gap]
                n += len(codes)
                if n > 1 << 18:
                    add(parts)
                    parts, n = [], 0
        if parts:
            add(parts)
        rows = np.flatnonzero(seen)
        sums = np.rint(total).astype(np.int64).reshape(s.buckets, s.dims)[rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(sums[:, d]) for d in range(s.dims))], names=["bucket", *(f"v{d}" for d in range(s.dims))])

    ddl = "bucket long, " + ", ".join(f"v{d} long" for d in range(s.dims))
    got = docs.select("text").mapInArrow(run, ddl).groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(s.dims)]).toPandas()
    out = np.zeros((s.buckets, s.dims))
    out[got["bucket"].to_numpy(dtype=np.int64)] = got.drop(columns="bucket").to_numpy(dtype=float)
    return out


def word_vectors(sums: np.ndarray, s: Settings) -> np.ndarray:
    """Unit vectors: the context's direction, and half as much of the word's own index vector, which tells rare words apart."""
    at, sign = index_vectors(s)
    own = np.zeros_like(sums)
    for j in range(s.signs):
        np.add.at(own, (np.arange(s.buckets), at[:, j]), sign[:, j])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return unit(unit(sums) + 0.5 * unit(own)).astype(np.float32)


def pooled(codes: np.ndarray, vectors: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """A document's input: mean vector by occurrence, mean by distinct bucket, log of words, share of distinct buckets, largest share of one bucket."""
    dims = vectors.shape[1]
    n = len(codes)
    if not n:
        return np.zeros(2 * dims + 3, dtype=np.float32)
    counts = np.bincount(codes, minlength=len(vectors))
    kinds = np.flatnonzero(counts)
    share = counts[kinds] / n
    return np.concatenate([share @ vectors[kinds], vectors[kinds].mean(axis=0), [np.log1p(n) / 10, len(kinds) / n, share.max()]]).astype(np.float32)


@dataclass
class Network:
    """Two layers, the inputs' mean and deviation, and the temperature; prior holds where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, s: Settings) -> Network:
    """The network by Adam on the rows not set aside, then the temperature on the others. One class or no row gives a constant score."""
    d = x.shape[1]
    none = Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0)
    if len(y) < 2 or y.min() == y.max():
        none.prior = float(y.mean()) if len(y) else 0.5
        return none
    r = np.random.default_rng(3)
    own = ~aside if (~aside).any() and y[~aside].min() != y[~aside].max() else np.ones(len(y), dtype=bool)
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z, t = (x[own] - mean) / scale, y[own]
    p = [r.normal(0, 1 / np.sqrt(d), (d, s.hidden)), np.zeros(s.hidden), r.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, s.steps + 1):
        k = r.integers(0, len(t), s.batch)
        h = np.tanh(z[k] @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - t[k]) / s.batch
        back = err[:, None] * p[2] * (1 - h * h)
        grads = [z[k].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])]
        rate = s.rate * (1 - step / (s.steps + 1))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if (~own).any():
        logit = net.logits(x[~own])
        net.temperature = temperature(np.stack([np.zeros_like(logit), logit], axis=1), y[~own].astype(int))
    return net


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors from all docs (doc_id, text), and the network from those docs that labels (doc_id, label) covers.

    Null labels don't count; of several labels of one document the least holds. Fitted are at most
    s.sample documents, those of the lowest hashed doc_id, joined by broadcast; and of their rows, where
    ids repeat, the s.sample of the lowest hash of id and text, rows that repeat both counting once.
    """
    vectors = word_vectors(context_sums(docs, s), s)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    n = known.count()
    hashed = lambda seed, *cols: F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40))
    # A first cut by hash leaves twice as many as wanted, so that ranking them is bounded work.
    at = hashed(50, F.col("doc_id").cast("string"))
    chosen = known.withColumn("at", at).where(F.col("at") < min(1 << 40, int(2 * s.sample / max(1, n) * (1 << 40)))).orderBy("at", "doc_id").limit(s.sample).drop("at")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(51)), F.lit(s.aside)).cast("int")
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", part.alias("part"), h.alias("h"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher(s.buckets)
        for batch in batches:
            x = [pooled(h.text(t.as_py()), sent.value).tobytes() for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(x, type=pa.binary())], names=["doc_id", "label", "part", "h", "x"])

    made = rows.mapInArrow(run, "doc_id long, label int, part int, h long, x binary").dropDuplicates(["doc_id", "h"])
    got = made.orderBy(hashed(52, "h"), "h", "doc_id").limit(s.sample).toPandas()
    got = got.sort_values(["doc_id", "x"]) if len(got) else got
    x = np.array([np.frombuffer(b, dtype=np.float32) for b in got["x"]], dtype=float).reshape(-1, 2 * s.dims + 3)
    return vectors, fit(x, got["label"].to_numpy(dtype=float), got["part"].to_numpy(dtype=int) == 0, s)


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text", cut: float = 0.3) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int, 1 from cut on), replacing columns so named.

    Whole texts are scored; null and empty ones get the network's score of no words. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))
    keep = others(docs, "score", "predicted")
    picked = docs.select(*quoted(keep))
    at = place_of(picked, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, n = sent.value
        h = hasher(len(vec))
        for batch in batches:
            x = np.array([pooled(h.text(t.as_py()), vec) for t in batch.column(at)], dtype=float).reshape(-1, 2 * vec.shape[1] + 3)
            p = n.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    return by_place(picked).mapInArrow(run, with_fields(picked, "score double, predicted int"))
