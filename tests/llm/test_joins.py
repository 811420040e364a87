"""Near duplicates of texts and vectors against all pairs; the pipeline's stages on planted documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from glyphveil.llm import op01_embeddings, op06_jaccard
from glyphveil.llm.common import connected_components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(200 + r.randrange(40), 300) for _ in range(60)] + [(400, 401), (402, 401), (500, 500)]
    got = {x["node"]: x["root"] for x in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {n: got[n] for n in nodes} == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted():
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = [" ".join(fresh(60)) for _ in range(40)]
    base = fresh(120)
    for _ in range(90):
        near = list(base)
        for _ in range(r.randrange(4)):
            near[r.randrange(120)] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(near))
    passage = " ".join(fresh(50))
    texts += [" ".join(fresh(100)) + " " + passage for _ in range(60)]
    texts += [texts[0]] * 30 + ["one two three", "one two three", "one two", "", None, " \n", "a b c d e", "a b c d e f"]
    return texts


def test_texts_against_all_pairs(spark):
    texts = planted()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rep int").repartition(4)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    root = roots(range(len(texts)), links)
    n = [0] * len(texts)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for s in (op06_jaccard.Settings(), op06_jaccard.Settings(small=8, block=16)):
        got = op06_jaccard.near_duplicates(df, s).collect()
        assert len(got) == len(texts)
        for x in got:
            i = x["doc_id"]
            assert (x["component_id"], x["n_links"], x["kept"]) == (root[i], n[i], root[i] == i), (i, x)


def test_texts_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op06_jaccard.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["n_links"], x["kept"]) for x in op06_jaccard.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 0, True), (None, 0, True)]


def brute(rows):
    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    links = [(a, b) for k, (a, x, la) in enumerate(ok) for b, y, lb in ok[:k] if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, roots(list(n), links)


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(1)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(50):
            base = r.normal(size=16)
            for _ in range(int(r.integers(1, 9))):
                rows.append((i, (base + r.normal(size=16) * 0.09).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 1) for k in range(20)]
    i += 20
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(i + k, v, 1) for k, v in enumerate(odd)] + [(i + 10, rows[0][1], None), (i + 11, [1.0, 2.0], 1), (i + 12, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0))
    n, root = brute(rows)
    for s in (op01_embeddings.Settings(), op01_embeddings.Settings(shard=60, beam=16, degree=12, sample=16)):
        got = op01_embeddings.near_duplicates(df, s).collect()
        assert len(got) == len(rows)
        found = sum(x["n_links"] for x in got)
        assert found >= 0.98 * sum(n.values()) and all(x["n_links"] <= n[x["vec_id"]] for x in got)
        if s == op01_embeddings.Settings():
            assert all((x["n_links"], x["component_id"], x["kept"]) == (n[x["vec_id"]], root[x["vec_id"]], root[x["vec_id"]] == x["vec_id"]) for x in got)
    assert op01_embeddings.near_duplicates(df.where("false")).count() == 0


def near_group(n, dims=64, seed=5):
    """Differing unit vectors, all pairs of which have a cosine above 0.98."""
    r = np.random.default_rng(seed)
    e = r.normal(size=(n, dims))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    x = np.eye(dims)[0] + 0.09 * e
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_classes(spark, x):
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    return op01_embeddings.unit_vectors(df).select("shard", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("n"), "vec")


def linked_pairs(spark, x):
    return op01_embeddings.linked(vector_classes(spark, x), op01_embeddings.Settings())[0].agg(F.sum("links")).first()[0]


def test_vectors_audit_sees_what_is_lost(spark):
    """A sparse table: pairs of near vectors, found by a crippled search, which fails the audit and is then mended."""
    r = np.random.default_rng(9)
    base = r.normal(size=(700, 24))
    x = np.concatenate([base, base[:120] + 0.03 * r.normal(size=(120, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.98).sum(axis=1) - 1
    s = op01_embeddings.Settings(shard=100, overlap=1, sample=4, beam=1, degree=1, candidates=1)
    classes = vector_classes(spark, x)
    links, _ = op01_embeddings.linked(classes, s)
    got, seen = op01_embeddings.audit(classes, links.where("rep % 2 = 0"), s)
    assert got < 0.9 and seen >= 100
    got, seen = op01_embeddings.audit(classes, links.where("false"), s)
    assert got == 0.0 and seen > 0
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    told = {r["vec_id"]: r["n_links"] for r in op01_embeddings.near_duplicates(df, s).collect()}
    assert sum(told.values()) >= 0.97 * true.sum() and all(told[i] <= true[i] for i in told)
    exact, _ = op01_embeddings.linked(classes, s, exact=True)
    assert {r["rep"]: r["links"] for r in exact.where("links > 0").collect()} == {i: int(k) for i, k in enumerate(true) if k}


def test_vectors_of_a_large_near_group(spark):
    x = near_group(3000)
    assert (x @ x.T).min() > 0.98
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    classes = op01_embeddings.unit_vectors(df).select("shard", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("n"), "vec")
    links, _ = op01_embeddings.linked(classes, op01_embeddings.Settings())
    found = links.agg(F.sum("links")).first()[0]
    assert found == 3000 * 2999, found / (3000 * 2999)
    assert linked_pairs(spark, near_group(6000, seed=8)) == 6000 * 5999
    # Beside others, which a split does take apart.
    y = np.random.default_rng(6).normal(size=(4000, 64))
    df = df.where("vec_id < 2000").union(spark.createDataFrame([(5000 + i, v.tolist(), 1) for i, v in enumerate(y)], df.schema))
    got = {r["vec_id"]: r["n_links"] for r in op01_embeddings.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.9999 * 2000 * 1999 and max(got.values()) == 1999 and len(got) == 6000


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    words = {"en": ["the", "and", "of", "with", "this", "that"], "de": ["der", "und", "mit", "nicht", "über", "das"]}
    text = lambda lang, n=60: " ".join(r.choice(words[lang]) + str(r.randrange(50)) for _ in range(n))
    rows = [(i, text("de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", f"s{i % 3}") for i in range(90)]
    rows += [(90, rows[4][1], "en", "s0"), (91, "mail a.b@mail.example.com now " + text("en"), "en", "s1"), (92, "12 34 !!", "en", "s1"), (93, None, None, None), (94, text("en"), None, "s2")]
    docs = spark.createDataFrame([(*x, len(x[1]) if x[1] else None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"{tmp_path}/sf"
    docs.write.parquet(f"{folder}/documents.parquet")
    got, seen = docs, {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, got, folder)
        assert name == "tokens" or out.columns == docs.columns
        got = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = got
    ids = lambda n: {x["doc_id"] for x in seen[n].select("doc_id").collect()}
    assert ids("language") == set(range(95)) - {92, 93} and ids("near_duplicates") == ids("language") - {90}
    assert "example.com" not in seen["personal_data"].where("doc_id = 91").first()["text"]
    assert seen["language"].where("doc_id = 94").first()["lang"] == "en"
    assert ids("tokens") == ids("mixing") and seen["mixing"].count() > seen["personal_data"].count()
    assert corpus_pipeline.run(spark, folder).count() == seen["tokens"].count()
