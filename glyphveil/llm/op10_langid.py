"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters and single spaces; their 1- to 3-grams are hashed into slots. The
document frequencies cover every learning row, summed by slot before the shuffle. The regression is
fitted on a bounded sample by follow-the-regularised-leader with elastic-net penalties, which leaves
most weights at zero, and its probabilities are calibrated by one temperature on rows set aside.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphveil.llm.common import by_place, others, place_of, quoted, small_batches, with_fields

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """slots: hashed n-grams, halved while slots times languages are more than `weights`, the model's bound. per_lang: learning rows of each language at most, fewer if there were more than `sample` in all, the sample's bound. Every language is learned, so more of them than `sample` are refused. alpha to l2: the optimiser's. epochs: passes over the sample. aside: one row of so many calibrates."""

    slots: int = 1 << 16
    weights: int = 1 << 23
    per_lang: int = 400
    sample: int = 80_000
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 3
    aside: int = 5


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point below U+20000 its lower-case letter, or a space if it is none; made once in a worker."""
    if not _letters:
        t = np.full(0x20000, 32, dtype=np.uint32)
        for c in range(0x20000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters.append(t)
    return _letters[0]


def letters(text: str) -> np.ndarray:
    """Code points of the text's lower-case letters, other runs as one space, with a space at both ends; empty without a letter."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    t = letter_table()
    if len(raw) and raw.max() < len(t):
        a = t[raw]
    else:
        a = np.array([t[c] if c < len(t) else (c if chr(c).isalpha() else 32) for c in raw], dtype=np.uint32)
    a = np.concatenate([[32], a, [32]]).astype(np.uint32)
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    return a if len(a) > 1 else a[:0]


def ngram_counts(text: str, slots: int, block: int = 1 << 20) -> np.ndarray | None:
    """How often the text's n-grams fall into each slot; None if it has no letter. Long texts are counted in blocks."""
    a = letters(text)
    if not len(a):
        return None
    out = np.zeros(slots, dtype=np.int64)
    shift = np.uint64(64 - int(slots).bit_length() + 1)
    for k in range(0, len(a), block):
        part = a[k : k + block + 2].astype(np.uint64)
        code = np.zeros(len(part), dtype=np.uint64)
        for n in (1, 2, 3):
            m = min(block, len(part) - n + 1)
            if m <= 0:
                break
            code = code[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            slot = (code[:m] * np.uint64(0x9E3779B97F4A7C15)) >> shift
            out += np.bincount(slot.astype(np.int64), minlength=slots)
    return out


def document_frequencies(rows: DataFrame, slots: int) -> tuple[np.ndarray, int]:
    """In how many texts of rows each slot occurs, and how many have letters. One row a slot and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(slots, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                c = ngram_counts(t.as_py() or "", slots)
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, slots)), pa.array(np.append(df[at], n))], names=["slot", "n"])

    got = rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(slots + 1, dtype=np.int64)
    df[got["slot"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return df[:-1], int(df[-1])


@dataclass
class Model:
    """langs, idf by slot, weights by slot and language (the last row is the bias), temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and unit-length TF-IDF values, with the bias last."""
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        x = x / max(float(np.sqrt(x @ x)), 1e-12)
        return np.append(at, len(self.idf)), np.append(x, 1.0)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.vector(counts)
        return softmax((x @ self.weights[at]) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text or "", len(self.idf)) if self.langs else None
        if counts is None:
            return UNKNOWN, 0.0
        p = self.probabilities(counts)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, max(0.0, p[k])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, classes: int, s: Settings) -> np.ndarray:
    """Weights by follow-the-regularised-leader: each coordinate has its own rate, and is zero until its gradients outweigh the l1 penalty."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    order = np.random.default_rng(7)

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z[at]) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least mean negative log-likelihood, by a search on a fine grid of its logarithm."""
    if not len(labels):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(-4, 3, 141)):
        z = logits / t
        top = z.max(axis=1)
        loss = float(np.mean(top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(labels)), labels]))
        best = min(best, (loss, float(t)))
    return best[1]


def train(rows: DataFrame, s: Settings = Settings(), key: str = "doc_id") -> Model:
    """A Model learned from rows (key, text, lang); rows with a null lang or without a letter don't count.

    The statistics (rows by language, document frequencies) cover all rows; the weights are fitted on
    rows chosen by the lowest hashes of key and text together, per_lang of each language at most. Rows
    that repeat both count once there, so no repetition crowds others out.
    """
    rows = rows.where(F.col("lang").isNotNull()).select(F.xxhash64(F.col(key).cast("string"), "text").alias("h"), "text", "lang")
    by_lang = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(s.sample + 1).collect()
    langs = sorted(r["lang"] for r in by_lang)
    if not langs:
        return Model([], np.zeros(s.slots), np.zeros((s.slots + 1, 0)), 1.0)
    if len(langs) > s.sample:
        raise ValueError(f"more than {s.sample} languages")
    while s.slots * len(langs) > s.weights and s.slots > 64:
        s = replace(s, slots=s.slots // 2)
    df, n = document_frequencies(rows, s.slots)
    idf = np.log((1 + n) / (1 + df)) + 1
    most = max(1, min(s.per_lang, s.sample // len(langs)))
    at = F.pmod(F.xxhash64("h", F.lit(10)), F.lit(1 << 40))
    # A first cut by hash leaves four times as many as wanted, so that ranking them is bounded work.
    shares = [(r["lang"], min(1 << 40, int(4 * most / max(1, r["n"]) * (1 << 40)))) for r in by_lang]
    below = rows.sparkSession.createDataFrame(shares, "lang string, below long")
    near = rows.withColumn("at", at).join(F.broadcast(below), "lang").where("at < below").dropDuplicates(["lang", "h"])
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "h"))).where(F.col("rank") <= most)
    chosen = ranked.select("text", "lang", F.pmod(F.xxhash64("h", F.lit(11)), F.lit(s.aside)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, lang, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = ngram_counts(t or "", s.slots)
                if c is not None:
                    k = np.flatnonzero(c)
                    out.append((lang, part, k.astype(np.int32).tobytes(), c[k].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "part", "at", "n"])

    got = chosen.mapInArrow(run, "lang string, part long, at binary, n binary").toPandas()
    got = got.iloc[np.lexsort([got["at"].map(bytes), got["lang"]])] if len(got) else got
    model = Model(langs, idf, np.zeros((s.slots + 1, len(langs))), 1.0)
    vectors, labels, aside = [], [], []
    for lang, part, slot, count in got.itertuples(index=False):
        counts = np.zeros(s.slots, dtype=np.int64)
        counts[np.frombuffer(slot, dtype=np.int32)] = np.frombuffer(count, dtype=np.int32)
        vectors.append(model.vector(counts))
        labels.append(langs.index(lang))
        aside.append(part == 0)
    y, aside = np.array(labels, dtype=int), np.array(aside, dtype=bool)
    fit = np.flatnonzero(~aside)
    model.weights = ftrl([vectors[i] for i in fit], y[fit], s.slots + 1, len(langs), s)
    held = np.flatnonzero(aside)
    model.temperature = temperature(np.array([x @ model.weights[k] for k, x in (vectors[i] for i in held)]).reshape(-1, len(langs)), y[held])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (string) and score (double, the calibrated probability), replacing columns so named.

    A null text, or one without a letter, is `und` with score 0, as are all if nothing was learned.
    Whole texts are read, one after the other; no shuffle. The model's size is bounded by Settings.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = others(docs, "lang_pred", "score")
    picked = docs.select(*quoted(keep))
    at = place_of(picked, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64())], names=[*keep, "lang_pred", "score"])

    return by_place(picked).mapInArrow(run, with_fields(picked, "lang_pred string, score double"))
