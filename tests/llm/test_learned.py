"""Language ID and quality scores: held-out accuracy and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from glyphveil.llm import op05_quality, op10_langid
from glyphveil.llm.common import remainder

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    from glyphveil.llm.queries import op10_language

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = op10_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert set(got.held_out.groupby(got.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 4 == 2)).nunique()) == {1}


def plain_grams(text, slots):
    """Slots of the 1- to 3-grams, by the rule: one polynomial code a gram, multiplied and cut."""
    kept = "".join(c.lower() if c.isalpha() else " " for c in text)
    kept = " " + " ".join(kept.split()) + " "
    out = {}
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            code = 0
            for k, c in enumerate(kept[i : i + n], 1):
                code = (code * 0x100000001B3 + ord(c) + k) % 2**64
            slot = code * 0x9E3779B97F4A7C15 % 2**64 >> (64 - slots.bit_length() + 1)
            out[slot] = out.get(slot, 0) + 1
    return out


def test_op10_language_statistics_by_hand(spark):
    """n-gram counts, document frequencies, TF-IDF, a step of the optimiser and the temperature behind op10_language, recomputed plainly."""
    r = random.Random(4)
    texts = ["".join(r.choice("abc dé,Ü1ß") for _ in range(r.randrange(1, 60))) for _ in range(40)] + ["x" * 5000]
    slots = 1 << 10
    for t in texts:
        got = op10_langid.ngram_counts(t, slots, block=100)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == plain_grams(t, slots) if got is not None else not any(c.isalpha() for c in t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    freq, n = op10_langid.document_frequencies(df, slots)
    seen = [plain_grams(t, slots) for t in texts if any(c.isalpha() for c in t)]
    assert n == len(seen) and all(freq[k] == sum(k in g for g in seen) for k in range(slots))
    m = op10_langid.Model(["a", "b"], np.log((1 + n) / (1 + freq)) + 1, np.zeros((slots + 1, 2)), 1.0)
    at, x = m.vector(op10_langid.ngram_counts(texts[0], slots))
    plain = {k: (1 + np.log(c)) * (np.log((1 + n) / (1 + sum(k in g for g in seen))) + 1) for k, c in plain_grams(texts[0], slots).items()}
    norm = np.sqrt(sum(v * v for v in plain.values()))
    assert at[-1] == slots and x[-1] == 1 and np.allclose(x[:-1], [plain[k] / norm for k in at[:-1]])
    # One row, one epoch: from zero weights the gradient is x (p - y) with p = 1/2.
    s = op10_langid.Settings(epochs=1)
    w = op10_langid.ftrl([(np.array([0, 1]), np.array([0.6, 1.0]))], np.array([1]), 3, 2, s)
    for i, v in ((0, 0.6), (1, 1.0)):
        for c, sign in ((0, 1), (1, -1)):
            z = sign * v / 2
            want = 0 if abs(z) <= s.l1 else -(z - np.sign(z) * s.l1) / ((s.beta + abs(z)) / s.alpha + s.l2)
            assert np.isclose(w[i, c], want)
    assert (w[2] == 0).all()
    logits, y = np.random.default_rng(2).normal(size=(200, 3)) * 4, np.random.default_rng(3).integers(0, 3, 200)

    def loss(t):
        z = logits / t
        return np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(200), y])

    best = op10_langid.temperature(logits, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(-4, 3, 141)))


def test_samples_are_of_rows(spark):
    """Repeated, clashing and null ids, and many languages: the samples keep their bounds, no language is lost."""
    df = spark.range(3000).select((F.col("id") % 7).alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "the and of ").otherwise("der und mit "), (F.col("id") % 900).cast("string"), F.translate((F.col("id") % 900).cast("string"), "0123456789", "abcdefghij")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    m = op10_langid.train(df.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id"))))
    got = op10_langid.identify(df, m)
    assert got.where("lang_pred = lang").count() == 3000
    many = spark.range(900).select("id", F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("lang"), F.translate(F.concat(F.lit("qq"), (F.col("id") % 300 * 7919).cast("string")), "0123456789", "abcdefghij").alias("text"))
    m = op10_langid.train(many, op10_langid.Settings(weights=1 << 18, sample=600, epochs=1), key="id")
    assert len(m.langs) == 300 and m.weights.size <= (1 << 18) + 300 * 2 and m.weights.any(axis=0).all()
    labels = df.select("doc_id").distinct().withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    s = op05_quality.Settings(sample=200, steps=5)
    seen = []
    op05_quality.fit, fit = lambda x, y, aside, s: seen.append(len(y)) or fit(x, y, aside, s), op05_quality.fit
    try:
        op05_quality.train(df.select("doc_id", "text"), labels, s)
    finally:
        op05_quality.fit = fit
    assert seen == [200]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the words", "en", 0, 0, "x")], "doc_id long, text string, lang string, Score int, Lang_Pred int, `a b.c` string")
    m = op10_langid.train(df)
    assert op10_langid.identify(df, m).columns == ["doc_id", "text", "lang", "a b.c", "lang_pred", "score"]
    vectors, net = op05_quality.train(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), op05_quality.Settings(steps=1))
    assert op05_quality.score(df, vectors, net).columns == ["doc_id", "text", "lang", "Lang_Pred", "a b.c", "score", "predicted"]
    assert op10_langid.identify(df, m).first()["lang_pred"] == "en" and op05_quality.score(df, vectors, net).count() == 1


def test_op5_quality_context_sums_by_double_loop(spark):
    """The word vectors behind op5_quality, recomputed occurrence by occurrence, and its network's pooled input."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["ab", "c", "7", "!", "dé"]) for _ in range(r.randrange(40))) for _ in range(25)] + [None]
    s = op05_quality.Settings(buckets=32, dims=6, signs=2, window=2)
    at, sign = op05_quality.index_vectors(s)
    want = np.zeros((s.buckets, s.dims))
    codes = [op05_quality.hasher(s.buckets).text(t) for t in texts]
    for c in codes:
        for i in range(len(c)):
            for j in range(max(0, i - s.window), min(len(c), i + s.window + 1)):
                if i != j:
                    for k in range(s.signs):
                        want[c[i], at[c[j], k]] += sign[c[j], k]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert np.array_equal(op05_quality.context_sums(df, s), want)
    v = op05_quality.word_vectors(want, s)
    x = op05_quality.pooled(codes[0], v)
    assert np.allclose(x[: s.dims], np.mean([v[c] for c in codes[0]], axis=0), atol=1e-5)
    assert np.allclose(x[s.dims : 2 * s.dims], np.mean([v[c] for c in set(codes[0].tolist())], axis=0), atol=1e-5)


def test_op5_quality_gradient_by_differences():
    """One step of the network's optimiser goes against the numeric gradient's signs, which is what Adam's first step is."""
    r = np.random.default_rng(8)
    x, y = r.normal(size=(50, 7)), (r.random(50) > 0.5).astype(float)
    s = op05_quality.Settings(hidden=3, steps=1, rate=1e-3, batch=50)
    net = op05_quality.fit(x, y, np.zeros(50, dtype=bool), s)
    k = np.random.default_rng(3)
    w1, w2 = k.normal(0, 1 / np.sqrt(7), (7, 3)), k.normal(0, 1 / np.sqrt(3), 3)
    at = k.integers(0, 50, 50)
    z, t = ((x - net.mean) / net.scale)[at], y[at]

    def loss(a, b):
        o = np.tanh(z @ a) @ b
        return np.mean(np.log1p(np.exp(o)) - t * o) + 0.5e-4 * ((a * a).sum() + (b * b).sum())

    for i, j in ((0, 0), (3, 1), (6, 2)):
        d = np.zeros_like(w1)
        d[i, j] = 1e-5
        slope = (loss(w1 + d, w2) - loss(w1 - d, w2)) / 2e-5
        assert np.isclose(net.w1[i, j] - w1[i, j], -1e-3 * 0.5 * np.sign(slope), rtol=1e-2)


def test_language_odd_rows(spark):
    r = random.Random(1)
    say = lambda ws: " ".join(r.choice(ws) for _ in range(30))
    rows = [(i, say(["the", "and", "of", "with"]), "en", 1) for i in range(40)] + [(i, say(["der", "und", "mit", "über"]), "de", 1) for i in range(40, 80)] + [(80, None, "en", 1), (81, "", "en", 1), (82, "12 !?", None, 1), (83, "THE AND OF", None, 1), (84, "über " * 300_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = op10_langid.train(df)
    got = {x["doc_id"]: x for x in op10_langid.identify(df, m).collect()}
    assert [got[i]["lang_pred"] for i in (0, 50, 80, 81, 82, 83, 84)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert got[80]["score"] == 0.0
    none = op10_langid.train(df.where("false"))
    assert {x["lang_pred"] for x in op10_langid.identify(df, none).collect()} == {"und"}
    assert op10_langid.identify(df.where("false"), m).count() == 0
    share = (m.weights == 0).mean()
    assert share > 0.5, "the elastic net leaves most weights at zero"


def test_quality_held_out(spark):
    from glyphveil.llm.queries import op5_quality

    got = op5_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and (held.predicted == held.quality).mean() > 0.93
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()


def test_quality_odd_rows(spark):
    rows = [(i, "good words in a row" if i % 2 else "%%% ### %%%", 7) for i in range(60)] + [(60, None, 7), (61, "", 7), (62, "word " * 200_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (99, 1)], "doc_id long, quality int")
    vectors, net = op05_quality.train(df, labels)
    got = {x["doc_id"]: x for x in op05_quality.score(df, vectors, net).collect()}
    assert got[1]["score"] > 0.8 > 0.2 > got[0]["score"] and 0 <= got[60]["score"] <= 1 and got[60]["score"] == got[61]["score"]
    assert op05_quality.score(df.where("false"), vectors, net).count() == 0
    _, flat = op05_quality.train(df, labels.where("quality = 1"))
    assert flat.prior == 1.0
    _, none = op05_quality.train(df.where("false"), labels.where("false"))
    assert none.prior == 0.5


def test_context_sums_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"a b c d{i} e f") for i in range(30)], "doc_id long, text string")
    s = op05_quality.Settings(buckets=64, dims=8)
    assert np.array_equal(op05_quality.context_sums(df.repartition(1), s), op05_quality.context_sums(df.repartition(7), s))


def test_remainders(spark):
    import zlib

    got = spark.range(200).select("id", remainder(F.col("id"), 5).alias("r")).collect()
    assert all(x["r"] == zlib.crc32(str(x["id"]).encode()) % 5 for x in got)
