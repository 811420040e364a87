"""Similarity join of documents by the Jaccard index of their word 5-grams: a chosen-path join.

Documents with the same set of 5-grams form a class first, so exact copies are never paired. The sets
of the classes are embedded as MinHash values: value i of two sets agrees with the probability of
their similarity, so "value i is x" is a sampled token that similar sets share. Each run splits all
classes by one token; buckets that stay large are split again by tokens sampled from the bucket's own
path, until they are small, or until a split leaves most of a bucket together. Small buckets are
compared by brute force, dense ones by brute force over pairs of blocks. Runs repeat until the target
recall. Candidates are verified on the full sets; a pair is counted in the first bucket that its two
classes share and nowhere else. Tasks return link counts and local roots, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphveil.llm.common import Bloom, connected_components, scratch_scope, small_batches, staged

WORDS = 5
#: Rows of a pair matrix that are worked on at once.
_ROWS = 128


@dataclass(frozen=True)
class Settings:
    """threshold as a fraction of whole numbers; recall wanted for pairs just at it; values: of the embedding; small: rows of a bucket that isn't split on; block: rows of a block; depth: of the recursion; fork: tokens by which a large bucket is split at once; dense: share of a bucket that stays together, from which it isn't split on; slack: deviations below the threshold at which a pair is still verified."""

    over: int = 4
    under: int = 5
    recall: float = 0.99999
    values: int = 64
    small: int = 256
    block: int = 1024
    depth: int = 8
    fork: int = 2
    dense: float = 0.5
    slack: float = 5.5

    @property
    def runs(self) -> int:
        """Runs until the chance that a pair at the threshold is lost is below 1 - recall, if every path goes to full depth: it never meets, or too few of its values agree."""
        t = self.over / self.under
        met = t * (1 - (1 - t) ** self.fork) ** (self.depth - 1)
        unlike = sum(math.comb(self.values, k) * t**k * (1 - t) ** (self.values - k) for k in range(self.agree))
        if unlike >= 1 - self.recall:
            raise ValueError("so little slack loses more pairs than the recall allows")
        return math.ceil(math.log(1 - self.recall - unlike) / math.log(1 - met))

    @property
    def agree(self) -> int:
        """How many of the values must agree for a pair to be verified."""
        t = self.over / self.under
        return max(1, math.floor(self.values * t - self.slack * math.sqrt(self.values * t * (1 - t))))


class _Words(dict):
    """64-bit hashes of words, the same in every worker; at most 100,000 are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of n words; of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(codes))
    m = len(codes) - k + 1
    mix = np.full(m, k, dtype=np.uint64)
    for i in range(k):
        mix = (mix ^ codes[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(32)
    return np.unique(mix)


def _coefficients(values: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(6)
    return r.integers(1, 1 << 63, (values, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, (values, 1), dtype=np.uint64)


def embed(s: np.ndarray, values: int, coefficients=None) -> np.ndarray:
    """The set's MinHash values (uint32)."""
    a, b = coefficients or _coefficients(values)
    least = np.full(values, ~np.uint64(0))
    for k in range(0, len(s), 2048):
        least = np.minimum(least, (s[None, k : k + 2048] * a + b).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of numbers."""
    out = np.zeros(np.broadcast(*parts).shape, dtype=np.uint64)
    for p in parts:
        out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def text_key(text: Column) -> Column:
    """Tells the texts of rows that repeat a doc_id apart."""
    return F.xxhash64(text)


def _set_hashes(x: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(x.tobytes())
    return h & (1 << 63) - 1, h >> 65


def embedded(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_key, h1, h2, sig): the two hashes identify the set, null with sig for a document without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        co = _coefficients(s.values)
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column(2):
                x = shingles(t.as_py())
                out.append((*_set_hashes(x), embed(x, s.values, co).tobytes()) if len(x) else (None, None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([o[i] for o in out], type=k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "text_key", "h1", "h2", "sig"])
        _words.clear()  # idle workers hold nothing

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, h1 long, h2 long, sig binary")


def _split(rows: DataFrame, s: Settings, first: bool) -> DataFrame:
    """The next buckets of rows: of (rep, sig), one for each run; of (rep, sig, path, size), fork for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rep = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, s.values)
            if first:
                k = np.arange(s.runs)[None, :]
                # Runs take the values in turn, from a shuffled order.
                at = np.random.default_rng(8).permutation(s.values)[np.arange(s.runs) % s.values]
                token, parent, size = sig[:, at], np.zeros((n, 1)), np.zeros(n, dtype=np.int64)
                path = _mixed(k + 1, at[None, :], token)
            else:
                parent = batch.column(2).to_numpy().view(np.uint64)[:, None]
                k = np.arange(s.fork)[None, :]
                at = (_mixed(parent, k + 1) % np.uint64(s.values)).astype(np.int64)
                path = _mixed(parent, at, np.take_along_axis(sig, at, axis=1))
                size = batch.column(3).to_numpy()
            width = path.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, width)), pa.array(path.reshape(-1).view(np.int64)), pa.array(np.repeat(size, width))], names=["rep", "path", "above"])

    return rows.mapInArrow(run, "rep long, path long, above long")


def leaves(sets: DataFrame, s: Settings) -> DataFrame:
    """(rep, leaf, size): the buckets of two and more in which classes (rep, sig) are compared."""
    rows, done, n = _split(sets.select("rep", "sig"), s, True), None, s.runs * sets.count()
    for depth in range(1, s.depth + 1):
        rows = staged(rows.distinct() if depth > 1 else rows, "paths", n)
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        sized = staged(rows.join(sizes, "path"), "paths", rows.count())
        dense = (F.col("above") > 0) & (F.col("size") > F.col("above") * s.dense)
        stop = (F.col("size") <= s.small) | dense | F.lit(depth == s.depth)
        ended = sized.where(stop).select("rep", F.col("path").alias("leaf"), "size")
        done = ended if done is None else done.unionByName(ended)
        large = sized.where(~stop)
        if depth == s.depth or not (n := s.fork * large.count()):
            break
        rows = _split(large.select("rep", "path", "size").join(sets.select("rep", "sig"), "rep").select("rep", "sig", "path", "size"), s, False)
    return done


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for end in ends.tolist():
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held, start = [], end
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _unshared(leaf: int, of: list[list[int]]) -> np.ndarray:
    """For all pairs of rows whether they share no leaf that comes before this one."""
    n = len(of)
    flat = np.array([x for row in of for x in row], dtype=np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in of])
    before = flat < leaf
    ids, at, counts = np.unique(flat[before], return_inverse=True, return_counts=True)
    if not len(ids):
        return np.ones((n, n), dtype=bool)
    kept = np.flatnonzero(counts > 1)
    place = np.full(len(ids), -1)
    place[kept] = np.arange(len(kept))
    row, at = row[before][counts[at] > 1], place[at[counts[at] > 1]]
    m = np.zeros((n, len(kept)), dtype=np.float32)
    m[row, at] = 1
    out = np.ones((n, n), dtype=bool)
    for k in range(0, n if m.shape[1] else 0, _ROWS):
        out[k : k + _ROWS] = (m[k : k + _ROWS] @ m.T) == 0
    return out


def _asked(cross: bool, side: np.ndarray) -> np.ndarray:
    """Which pairs of rows a group compares: all, or only those between its two blocks."""
    n = len(side)
    return side[:, None] != side[None, :] if cross else ~np.eye(n, dtype=bool)


def _similar(t: pa.Table, s: Settings) -> np.ndarray:
    """Which pairs agree in so many values that they must be verified."""
    n = t.num_rows
    sig = np.frombuffer(b"".join(t.column("data").to_pylist()), dtype=np.uint32).reshape(n, s.values)
    out = np.zeros((n, n), dtype=bool)
    for k in range(0, n, _ROWS):
        agree = np.zeros((min(_ROWS, n - k), n), dtype=np.uint8)
        for i in range(s.values):
            agree += sig[k : k + _ROWS, i, None] == sig[None, :, i]
        out[k : k + _ROWS] = agree >= s.agree
    return out


def _linked(t: pa.Table, s: Settings, width: int = 512) -> np.ndarray:
    """Which pairs reach the threshold, from their full sets.

    Set members that lie in the same rows are one column with a weight, so near copies need few
    columns; the product of the columns, in bands, gives all intersections.
    """
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("data").to_pylist()]
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        ok = (s.under + s.over) * both >= s.over * sizes.sum()
        return np.array([[False, ok], [ok, False]])
    row = np.repeat(np.arange(n), sizes)
    _, member, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = counts[member] > 1
    row, member = row[kept], member[kept]
    mark = np.random.default_rng(9).integers(0, 1 << 63, n, dtype=np.uint64)
    pattern = np.zeros(len(counts), dtype=np.uint64)
    np.add.at(pattern, member, mark[row])
    _, first, column, weight = np.unique(pattern[counts > 1], return_index=True, return_inverse=True, return_counts=True)
    shown = np.flatnonzero(counts > 1)[first]
    place = np.full(len(counts), -1, dtype=np.int64)
    place[shown] = np.arange(len(shown))
    own = place[member] >= 0
    row, col = row[own], place[member[own]]
    inter = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for k in range(0, len(shown), width):
        a, b = np.searchsorted(col, [k, k + width])
        m = np.zeros((n, min(width, len(shown) - k)), dtype=np.float32)
        m[row[a:b], col[a:b] - k] = 1
        weighted = m * weight[k : k + width].astype(np.float32)
        for r in range(0, n, _ROWS):
            inter[r : r + _ROWS] += weighted[r : r + _ROWS] @ m.T
    out = np.zeros((n, n), dtype=bool)
    for r in range(0, n, _ROWS):
        out[r : r + _ROWS] = (s.under + s.over) * inter[r : r + _ROWS].astype(np.int64) >= s.over * (sizes[r : r + _ROWS, None] + sizes[None, :])
    return out


def _local_roots(rep: np.ndarray, adjacent: np.ndarray) -> np.ndarray:
    """For each row the smallest rep that it reaches within the group; adjacent is symmetric. Roots are hooked to smaller ones and paths halved, so rounds grow with the logarithm of the longest path."""
    order = np.argsort(rep, kind="stable")
    up = np.empty(len(rep), dtype=np.int64)
    up[order] = np.arange(len(rep))  # ranks stand for rows: up[row] is the rank of the row's root
    while True:
        least = up.copy()
        for k in range(0, len(rep), _ROWS):
            least[k : k + _ROWS] = np.minimum(up[k : k + _ROWS], np.where(adjacent[k : k + _ROWS], up[None, :], len(rep)).min(axis=1, initial=len(rep)))
        if (least == up).all():
            return rep[order][up]
        root = np.arange(len(rep))
        np.minimum.at(root, up, least)
        while (root[root] != root).any():
            root = root[root]
        up = np.minimum(root[up], least)


_ROW = "gid long, leaf long, crossed boolean, side int, rep long, n long, leaves array<long>"


def _compare(rows: DataFrame, s: Settings, verify: bool) -> DataFrame:
    """Groups of rows (gid, leaf, crossed, side, rep, n, leaves, data) compared: the rows that have a similar partner; or, verified, (rep, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        slices: list[pa.RecordBatch] = []
        for t in _groups(batches):
            rep = t.column("rep").to_numpy()
            if len(rep) < 2:
                continue
            found = _linked(t, s) if verify else _similar(t, s)
            found &= _asked(t.column("crossed")[0].as_py(), t.column("side").to_numpy()) & (rep[:, None] != rep[None, :])
            if not found.any():
                continue
            found &= _unshared(t.column("leaf")[0].as_py(), t.column("leaves").to_pylist())
            hit = found.any(axis=1)
            if not hit.any():
                continue
            if verify:
                links = found @ t.column("n").to_numpy().astype(np.float64)
                root = _local_roots(rep, found)
                out += zip(rep[hit].tolist(), links[hit].astype(np.int64).tolist(), root[hit].tolist(), strict=True)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=pa.int64()) for i in range(3)], names=["rep", "links", "root"])
                    out = []
            else:
                slices += t.select(t.column_names[:-1]).take(pa.array(np.flatnonzero(hit))).combine_chunks().to_batches()
                if len(slices) > 500:
                    yield from pa.Table.from_batches(slices).combine_chunks().to_batches()
                    slices = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=pa.int64()) for i in range(3)], names=["rep", "links", "root"])
        if slices:
            yield from pa.Table.from_batches(slices).combine_chunks().to_batches()

    picked = rows.select("gid", "leaf", "crossed", "side", "rep", "n", "leaves", "data").repartition("gid").sortWithinPartitions("gid")
    return picked.mapInArrow(run, "rep long, links long, root long" if verify else _ROW)


def _grouped(at: DataFrame, s: Settings) -> DataFrame:
    """Rows (rep, n, data, leaves of struct leaf, size) for each group that compares them: one a leaf, or of a large leaf one a pair of blocks."""
    one = at.select("rep", "n", "data", F.transform("leaves", lambda x: x["leaf"]).alias("leaves"), F.explode("leaves").alias("x"))
    blocks = F.ceil(F.col("x.size") / s.block).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("rep"), blocks).cast("int")).otherwise(0)
    one = one.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    gid = F.when(blocks > 1, F.xxhash64("x.leaf", low, high)).otherwise(F.col("x.leaf"))
    return one.select(gid.alias("gid"), F.col("x.leaf").alias("leaf"), (low != high).alias("crossed"), F.when(F.col("own") == high, 1).otherwise(0).alias("side"), "rep", "n", "leaves", "data")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, data): the sets of the classes wanted (rep, h1, h2), one row each.

    Texts are never shuffled: a Bloom filter of the ids rules most rows out as they are read, the
    others become sets, and an exact join by id and the set's hashes keeps those wanted.
    """
    ids = Bloom(wanted, "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.filter(pa.array(ids.maybe(batch.column(0).to_numpy())))
            made = [shingles(t.as_py()) for t in near.column(1)]
            made = [(x.tobytes(), *_set_hashes(x)) for x in made]
            yield pa.RecordBatch.from_arrays([near.column(0), *(pa.array([m[i] for m in made], type=k) for i, k in ((1, pa.int64()), (2, pa.int64()), (0, pa.binary())))], names=["rep", "h1", "h2", "data"])
        _words.clear()

    found = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("rep"), "text").mapInArrow(sets, "rep long, h1 long, h2 long, data binary")
    # The hashes are compared in a form that leaves rep the only key, so the rows lie as the next join by rep needs them.
    same = (found["rep"] == wanted["rep"]) & ((found["h1"].bitwiseXOR(wanted["h1"])).bitwiseOR(found["h2"].bitwiseXOR(wanted["h2"])) == 0)
    return found.join(wanted, same, "left_semi").select("rep", "data").dropDuplicates(["rep"])


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, component_id, n_links, kept, text_key.

    class_id: the smallest doc_id with the same set of 5-grams. n_links: other documents whose sets
    have at least the similarity, those of the class included. component_id: the smallest doc_id
    reachable by links. kept: whether doc_id is component_id. A document without words has no links
    and is a component of its own. One of fewer than five words has one gram, of all its words. Rows
    that repeat a doc_id are copies of it; text_key (a hash of the text) tells them apart. A null
    doc_id takes part in no class. An empty table gives no rows; other columns aren't read.
    """
    with scratch_scope() as keep:
        return keep(_near_duplicates(docs, s), "near_duplicates")


def _near_duplicates(docs: DataFrame, s: Settings) -> DataFrame:
    all_ = staged(embedded(docs, s), "embedded")
    full = all_.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = staged(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig")), "classes")
    at = staged(leaves(classes, s), "leaves", s.runs * classes.count())
    lists = at.groupBy("rep").agg(F.collect_set(F.struct("leaf", "size")).alias("leaves"))
    rows = classes.select("rep", "n", F.col("sig").alias("data")).join(lists, "rep")
    near = staged(_compare(_grouped(rows, s), s, False), "near")
    wanted = staged(classes.join(near.select("rep").distinct(), "rep", "left_semi").select("rep", "h1", "h2"), "wanted")
    found = staged(_compare(near.join(full_sets(docs, wanted), "rep"), s, True), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(docs.sparkSession, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("h1", "h2", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = all_.select("doc_id", "text_key", "h1", "h2").join(told, ["h1", "h2"], "left")
    own = F.col("doc_id")
    out = out.select("doc_id", *[F.when(own.isNotNull(), F.coalesce(c, own)).alias(c) for c in ("class_id", "component_id")], F.when(own.isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), "text_key")
    return out.withColumn("kept", own.isNull() | (own == F.col("component_id"))).select("doc_id", "class_id", "component_id", "n_links", "kept", "text_key")


def measured_recall(docs: DataFrame, told: DataFrame, sample: int = 100) -> tuple[float, int]:
    """The share of true links that told (near_duplicates of docs) counts for a sample of linked documents, and how many true links those have.

    About `sample` documents that have links, by hashed doc_id, are compared on their full sets with
    every document, in one pass; the sample and its sets are all that is sent. With no link told, as
    many of all documents are taken, so that links that were all missed show.
    """
    some = told.where("n_links > 0 AND doc_id IS NOT NULL")
    n = some.count()
    some, n = (some, n) if n else (told.where("doc_id IS NOT NULL"), told.count())
    at = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 40)) / float(1 << 40)
    counted = {r["doc_id"]: r["n_links"] for r in some.where(at < min(1.0, sample / max(1, n))).select("doc_id", "n_links").distinct().limit(4 * sample).collect()}
    mine = docs.where(F.col("doc_id").isin(list(counted))).select("doc_id", "text").collect() if counted else []
    sent = docs.sparkSession.sparkContext.broadcast([(r["doc_id"], shingles(r["text"])) for r in mine])
    s = Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(i, x) for i, x in sent.value if len(x)]
        members = np.concatenate([x for _, x in queries]) if queries else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(queries)), [len(x) for _, x in queries])
        order = np.argsort(members, kind="stable")
        members, owner = members[order], owner[order]
        sizes = np.array([len(x) for _, x in queries], dtype=np.int64)
        ids = np.array([i for i, _ in queries], dtype=np.int64)
        total = np.zeros(len(queries), dtype=np.int64)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = shingles(t.as_py())
                lo, hi = np.searchsorted(members, x, "left"), np.searchsorted(members, x, "right")
                hit = np.flatnonzero(hi > lo)
                if len(hit):
                    places = np.concatenate([np.arange(lo[k], hi[k]) for k in hit])
                    both = np.bincount(owner[places], minlength=len(queries))
                    total += ((s.under + s.over) * both >= s.over * (sizes + len(x))) & (ids != i)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["doc_id", "true"])

    true = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, true long").groupBy("doc_id").agg(F.sum("true").alias("true")).collect()
    links = sum(r["true"] for r in true)
    return (sum(min(counted[r["doc_id"]], r["true"]) for r in true) / links if links else 1.0), links
