"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping cluster shards.

Vectors with equal components form a class first. The classes of a label are dealt into shards around
centroids that are fitted on a bounded sample; each lies in the shards of its nearest centroids, one
of which is its home. Centroids whose sampled vectors link with each other count as one, so a group of
near vectors isn't cut through; a shard that stays large for that is compared exactly, in pairs of
blocks. In each other shard every vector is joined to neighbours chosen by robust pruning
(a candidate goes if a chosen neighbour is nearer to it, by a factor, than the vector itself). The
adjacency lists of all shards are united. Every vector then searches its home shard over the united
graph: greedily from the medoid, and on from every vector in range until no new one is. Two vectors of
different homes are counted in one of them only, told from their lists of shards, so tasks return
counts and local roots and never a pair. Cosines are exact, so nothing below the threshold is ever
linked; what the graph misses is measured by an audit against brute force, and shards overlap more,
with no more centroids, until the audit is passed. If it never is, all pairs of blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphveil.llm.common import connected_components, scratch_scope, staged
from glyphveil.llm.op06_jaccard import _groups, _local_roots, _mixed


@dataclass(frozen=True)
class Settings:
    """least: cosine of a link. shard: rows above which a shard is split, to a third of that on average with the copies. overlap: centroids that a vector goes to. fan: centroids a shard is split into at most, each fitted on `sample` rows on average. joined: share of links between the samples of two centroids from which they count as one. block: rows of a block of a shard that stays large. candidates, degree, alpha: of the pruning. beam: of the search. levels: of splitting. stuck: share of a shard that a part of it may hold at most to be split on. audited: queries of the audit among classes without links, and a quarter of it among those of each power of two of links. recall: wanted of it. sent: centroids broadcast at once, at most."""

    least: float = 0.98
    shard: int = 1500
    overlap: int = 3
    fan: int = 64
    sample: int = 32
    joined: float = 0.005
    block: int = 2048
    candidates: int = 64
    degree: int = 24
    alpha: float = 1.2
    beam: int = 32
    levels: int = 8
    stuck: float = 0.7
    audited: int = 256
    recall: float = 0.98
    sent: int = 16384


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, shard, h1, h2, vec) of rows (vec_id, embedding, label): vec holds the unit vector's doubles; all but vec_id null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for label, v in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.array(v, dtype=np.float64) if label is not None and v and None not in v else np.zeros(1)
                norm = float(np.sqrt(a @ a)) if np.isfinite(a).all() else 0.0
                if not np.isfinite(norm):
                    a = a / np.abs(a).max()
                    norm = float(np.sqrt(a @ a))
                if norm == 0.0:
                    out.append((None,) * 4)
                    continue
                a = a / norm
                h = xxhash.xxh3_128_intdigest(a.tobytes())
                out.append((int(_mixed(np.array([label]), np.array([len(a)])).view(np.int64)[0]), h & (1 << 63) - 1, h >> 65, a.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], type=k) for i, k in enumerate(kinds))], names=["vec_id", "shard", "h1", "h2", "vec"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")).mapInArrow(run, "vec_id long, shard long, h1 long, h2 long, vec binary")


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    c = x[np.random.default_rng(1).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def _merged(x: np.ndarray, c: np.ndarray, s: Settings) -> np.ndarray:
    """For each centroid of rows x the number of its group, from 0: centroids between whose rows many links run are one group."""
    own = np.zeros((len(x), len(c)), dtype=np.float32)
    own[np.arange(len(x)), (x @ c.T).argmax(axis=1)] = 1
    links = np.zeros((len(c), len(c)), dtype=np.float32)
    for k in range(0, len(x), 512):
        links += own[k : k + 512].T @ ((x[k : k + 512] @ x.T >= s.least).astype(np.float32) @ own)
    sizes = own.sum(axis=0)
    joined = (links > 0) & (links >= s.joined * sizes[:, None] * sizes[None, :]) | np.eye(len(c), dtype=bool)
    return np.unique(_local_roots(np.arange(len(c)), joined), return_inverse=True)[1]


_DEALT = ["shard", "rep", "home", "n", "vec", "above"]


def _dealt(rows: DataFrame, sizes: list[tuple[int, int]], s: Settings) -> DataFrame:
    """Rows (shard, rep, home, n, vec, above) of large shards dealt to new shards around centroids; above: the size of the shard they come from."""
    fan = {shard: min(s.fan, max(2, -(-3 * s.overlap * size // s.shard))) for shard, size in sizes}
    share = {shard: min(1.0, s.sample * fan[shard] / size) for shard, size in sizes}
    sc = rows.sparkSession.sparkContext
    plan = sc.broadcast((fan, share, dict(sizes)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = _mixed(rep, np.array(3)) / 2.0**64
            yield batch.filter(pa.array(at < np.array([plan.value[1].get(x, 0.0) for x in shard.tolist()])))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            x = _matrix(t.column("vec"))
            shard = t.column("shard")[0].as_py()
            c = _centroids(x[np.argsort(t.column("rep").to_numpy())], plan.value[0][shard])
            group = _merged(x, c, s)
            order = np.argsort(group, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([c[order].tobytes()]), pa.array([c.shape[1]]), pa.array([np.searchsorted(group[order], np.arange(group.max() + 1)).tolist()], type=pa.list_(pa.int64()))], names=["shard", "c", "dim", "starts"])

    sampled = rows.select("shard", "rep", "vec").mapInArrow(pick, "shard long, rep long, vec binary").repartition("shard").sortWithinPartitions("shard")
    fitted = {r["shard"]: (np.frombuffer(r["c"]).reshape(-1, r["dim"]), np.array(r["starts"])) for r in sampled.mapInArrow(fit, "shard long, c binary, dim long, starts array<long>").toLocalIterator()}
    sent = sc.broadcast(fitted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, home = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            vecs = batch.column(4).to_pylist()
            for x in np.unique(shard).tolist():
                rows_ = np.flatnonzero(shard == x)
                above = plan.value[2][x]
                c, starts = sent.value.get(x, (None, ()))
                if len(starts) < 2:  # it is one group, or no row of it was sampled: it stays whole
                    part = batch.take(pa.array(rows_))
                    yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(np.full(len(rows_), above))], names=_DEALT)
                    continue
                sims = np.frombuffer(b"".join(vecs[i] for i in rows_), dtype=np.float64).reshape(len(rows_), -1) @ c.T
                sims = np.maximum.reduceat(sims, starts, axis=1)
                near = np.argsort(-sims, axis=1, kind="stable")[:, : s.overlap]
                new = _mixed(np.array([x]).view(np.uint64), near).view(np.int64)
                at = np.repeat(rows_, near.shape[1])
                first = np.tile(np.arange(near.shape[1]) == 0, len(rows_))
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(new.reshape(-1)), part.column(1), pa.array(first & home[at]), part.column(3), part.column(4), pa.array(np.full(len(at), above))], names=_DEALT)

    return rows.mapInArrow(deal, "shard long, rep long, home boolean, n long, vec binary, above long")


def shards(classes: DataFrame, s: Settings) -> DataFrame:
    """Rows (shard, rep, home, n, vec, whole) of all classes; whole: of a large shard that splitting doesn't make smaller."""
    rows = classes.select("shard", "rep", F.lit(True).alias("home"), "n", "vec", F.lit(0).cast("long").alias("above"))
    done = None
    for level in range(s.levels + 1):
        rows = staged(rows, "shards")
        counts = rows.groupBy("shard").agg(F.count("*").alias("size"), F.max("above").alias("above"))
        whole = (F.col("above") > 0) & (F.col("size") > F.col("above") * s.stuck) | F.lit(level == s.levels)
        large = staged(counts.where(F.col("size") > s.shard).select("shard", "size", whole.alias("whole")), "large")
        told = rows.join(large.select("shard", "whole"), "shard", "left")
        ended = told.where("whole IS NULL OR whole").select("shard", "rep", "home", "n", "vec", F.coalesce("whole", F.lit(False)).alias("whole"))
        done = ended if done is None else done.unionByName(ended)
        open_ = large.where("NOT whole")
        n = open_.count()
        if not n:
            return done
        parts = -(-n * s.fan // s.sent)
        next_ = None
        for i in range(parts):
            mine = F.pmod(F.xxhash64("shard"), F.lit(parts)) == i
            sizes = [(r["shard"], r["size"]) for r in open_.where(mine).toLocalIterator()]
            if sizes:
                dealt = _dealt(rows.where(mine).join(open_, "shard", "left_semi").select("shard", "rep", "home", "n", "vec"), sizes, s)
                next_ = dealt if next_ is None else next_.unionByName(dealt)
        rows = next_
    return done


def pruned(x: np.ndarray, s: Settings, block: int = 512) -> list[np.ndarray]:
    """Each row's neighbours: of its nearest candidates those that no chosen neighbour covers, the nearest first."""
    m = len(x)
    out: list[np.ndarray] = []
    c = min(s.candidates, m - 1)
    if c < 1:
        return [np.zeros(0, dtype=np.int64)] * m
    for k in range(0, m, block):
        sims = x[k : k + block] @ x.T
        sims[np.arange(len(sims)), np.arange(k, k + len(sims))] = -2
        cand = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        own = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
        # Squared distances of unit vectors are 2 - 2 cos.
        near = x[cand]
        apart = 2 - 2 * np.einsum("qcd,qed->qce", near, near)
        dist = 2 - 2 * own
        open_, chosen = np.ones(cand.shape, dtype=bool), np.zeros(cand.shape, dtype=bool)
        for _ in range(min(s.degree, c)):
            some = open_.any(axis=1)
            if not some.any():
                break
            at = open_.argmax(axis=1)
            q = np.flatnonzero(some)
            chosen[q, at[q]] = True
            open_[q, at[q]] = False
            open_[q] &= ~(s.alpha * apart[q, at[q]] <= dist[q])
        out += [cand[i][chosen[i]] for i in range(len(cand))]
    return out


def search(x: np.ndarray, adjacent: np.ndarray, queries: np.ndarray, s: Settings, block: int = 128, width: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of queries (rows of x), the queries and a matrix of which rows are in range of each.

    adjacent: neighbours of each row, -1 for none. Greedy search from the medoid with a beam; each turn
    opens the best rows not opened yet that lie in the beam or in range, until there are none.
    """
    m = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    for k in range(0, len(queries), block):
        q = queries[k : k + block]
        n = len(q)
        sim, opened = np.full((n, m), -2.0), np.zeros((n, m), dtype=bool)
        sim[:, medoid] = x[q] @ x[medoid]
        sim[np.arange(n), q] = 1.0
        live = np.arange(n)
        while len(live):
            cur = sim[live]
            edge = np.partition(cur, m - s.beam, axis=1)[:, m - s.beam] if m > s.beam else np.full(len(live), -2.0)
            free = np.where(opened[live], -3.0, cur)
            w = min(width, m)
            pick = np.argpartition(-free, w - 1, axis=1)[:, :w]
            value = np.take_along_axis(free, pick, axis=1)
            use = (value > -2) & ((value >= edge[:, None]) | (value >= s.least))
            going = use.any(axis=1)
            live, pick, use = live[going], pick[going], use[going]
            if not len(live):
                break
            rows, cols = live[np.nonzero(use)[0]], pick[use]
            opened[rows, cols] = True
            near = adjacent[cols]
            r = np.repeat(rows, near.shape[1])
            to = near.reshape(-1)
            new = (to >= 0) & (sim[r, to] == -2.0)
            r, to = r[new], to[new]
            if len(r):
                _, first = np.unique(r * m + to, return_index=True)
                r, to = r[first], to[first]
                for j in range(0, len(r), 1 << 15):
                    a, b = r[j : j + (1 << 15)], to[j : j + (1 << 15)]
                    sim[a, b] = np.einsum("nd,nd->n", x[q[a]], x[b])
        hit = sim >= s.least
        hit[np.arange(n), q] = False
        yield q, hit


def _build(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches):
        rep = t.column("rep").to_numpy()
        near = pruned(_matrix(t.column("vec")), s)
        for k in range(0, len(rep), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(rep[k : k + 4096]), pa.array([rep[x].tolist() for x in near[k : k + 4096]], type=pa.list_(pa.int64()))], names=["rep", "near"])


def _times(hit: np.ndarray, n: np.ndarray, band: int = 512) -> np.ndarray:
    """hit @ n for a matrix of truth values, in bands."""
    return np.concatenate([hit[k : k + band] @ n.astype(np.float64) for k in range(0, len(hit), band)] or [np.zeros(0)]).astype(np.int64)


def _tally(t: pa.Table, hit: np.ndarray) -> pa.RecordBatch:
    """(rep, links, root) of a group of rows of one shard, from the symmetric matrix of pairs in range.

    A pair counts here if one of the two is at home here; but not if the other's home has a smaller
    number and sees both too, for there it counts.
    """
    shard = t.column("shard")[0].as_py()
    rep, n, own = (t.column(c).to_numpy() for c in ("rep", "n", "own"))
    at_home = t.column("home").to_numpy(zero_copy_only=False)
    here, away = np.flatnonzero(at_home), np.flatnonzero(~at_home)
    links = np.zeros(len(rep), dtype=np.int64)
    links[here] = _times(hit[np.ix_(here, here)], n[here])
    if len(away):
        homes, place = np.unique(own[away], return_inverse=True)
        lists = t.column("shards").combine_chunks().take(pa.array(here))
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        at = np.searchsorted(homes, flat).clip(max=len(homes) - 1)
        seen = (homes[at] == flat) & (flat < shard)
        there = np.zeros((len(here), len(homes)), dtype=bool)
        there[np.repeat(np.arange(len(here)), sizes)[seen], at[seen]] = True
        cross = hit[np.ix_(here, away)] & ~there[:, place]
        links[here] += _times(cross, n[away])
        links[away] = _times(np.ascontiguousarray(cross.T), n[here])
    root = _local_roots(rep, hit)
    told = np.flatnonzero((links > 0) | (root != rep))
    return pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (rep, links, root)], names=["rep", "links", "root"])


_TALLY = "rep long, links long, root long"


def _search(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The tally of each shard by search over the graph from every row at home in it."""
    for t in _groups(batches):
        rep, home = t.column("rep").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        if len(rep) < 2 or not home.any():
            continue
        order = np.argsort(rep, kind="stable")
        lists = t.column("near").to_pylist()
        sizes = np.array([len(v or ()) for v in lists])
        flat = np.array([y for v in lists for y in v or ()], dtype=np.int64)
        at = np.searchsorted(rep[order], flat).clip(max=len(rep) - 1)
        place = np.where(rep[order][at] == flat, order[at], -1)
        row = np.repeat(np.arange(len(rep)), sizes)
        inside = place >= 0
        row, place = row[inside], place[inside]
        # Edges both ways, so that every row can be reached.
        both = np.unique(np.concatenate([row * len(rep) + place, place * len(rep) + row]))
        row, place = both // len(rep), both % len(rep)
        degree = np.bincount(row, minlength=len(rep))
        adjacent = np.full((len(rep), max(1, degree.max(initial=0))), -1, dtype=np.int64)
        adjacent[row, np.arange(len(row)) - np.repeat(np.cumsum(degree) - degree, degree)] = place
        hit = np.zeros((len(rep), len(rep)), dtype=bool)
        for q, found in search(_matrix(t.column("vec")), adjacent, np.flatnonzero(home), s):
            hit[q] = found
        hit |= hit.T
        yield _tally(t, hit)


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings, band: int = 512) -> Iterator[pa.RecordBatch]:
    """The tally of each group (gid) of one block or two of a shard, all pairs of it compared."""
    for t in _groups(batches):
        if t.num_rows < 2 or not t.column("home").to_numpy(zero_copy_only=False).any():
            continue
        x, side = _matrix(t.column("vec")), t.column("side").to_numpy()
        hit = np.zeros((len(x), len(x)), dtype=bool)
        if t.column("crossed")[0].as_py():
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for k in range(0, len(a), band):
                hit[np.ix_(a[k : k + band], b)] = x[a[k : k + band]] @ x[b].T >= s.least
        else:
            for k in range(0, len(x), band):
                hit[k : k + band] = x[k : k + band] @ x.T >= s.least
            hit = np.triu(hit, 1)
        hit |= hit.T
        yield _tally(t, hit)


def _in_blocks(rows: DataFrame, s: Settings) -> DataFrame:
    """Rows (shard, rep, home, n, vec, own, shards, size) for each pair of blocks of their shard: (gid, crossed, side, ...)."""
    blocks = F.ceil(F.col("size") / s.block).cast("int")
    at = rows.withColumn("part", F.pmod(F.xxhash64("rep", "shard"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return at.select(F.xxhash64("shard", low, high).alias("gid"), (low != high).alias("crossed"), F.when(F.col("part") == high, 1).otherwise(0).alias("side"), "shard", "rep", "home", "n", "vec", "own", "shards")


def linked(classes: DataFrame, s: Settings, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rep, links) and edges (a, b) of the classes (rep, n, shard, vec), by shards, graph and search; or exact, by all pairs of blocks."""
    if exact:
        rows = classes.select("shard", "rep", F.lit(True).alias("home"), "n", "vec", F.lit(True).alias("whole"))
    else:
        rows = staged(shards(classes, s), "shards")
    # A class lies in few shards, so its list is short, whatever its links.
    lists = staged(rows.groupBy("rep").agg(F.collect_set("shard").alias("shards"), F.max(F.when(F.col("home"), F.col("shard"))).alias("own")), "lists")
    whole = staged(rows.where("whole").groupBy("shard").agg(F.count("*").alias("size")), "whole")
    placed = rows.join(lists, "rep")
    paired = _in_blocks(placed.where("whole").join(whole, "shard"), s).repartition("gid").sortWithinPartitions("gid")
    found = paired.mapInArrow(lambda b: _blocks(b, s), _TALLY)
    if not exact:
        small = rows.where("NOT whole").select("shard", "rep", "vec").repartition("shard").sortWithinPartitions("shard")
        graph = staged(small.mapInArrow(lambda b: _build(b, s), "rep long, near array<long>").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
        laid = placed.where("NOT whole").join(graph, "rep", "left").select("shard", "rep", "home", "n", "vec", "own", "shards", "near").repartition("shard").sortWithinPartitions("shard")
        found = found.unionByName(laid.mapInArrow(lambda b: _search(b, s), _TALLY))
    found = staged(found, "found")
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b")


def audit(classes: DataFrame, links: DataFrame, s: Settings) -> tuple[float, int]:
    """The mean share of its true links that a class was told, over classes that have any, and how many true links that rests on.

    Classes are drawn apart by how many links they were told: none, one, two or three, up to seven,
    and so on; so a large group outweighs no others and there are true links to see wherever any were
    found. Each is compared with all rows of its label and stands for its share of those alike.
    """
    told = classes.select("rep").join(links, "rep", "left").select("rep", F.coalesce("links", F.lit(0)).alias("links"))
    told = told.withColumn("level", F.when(F.col("links") > 0, F.length(F.bin("links"))).otherwise(0))
    sizes = {r["level"]: r["count"] for r in told.groupBy("level").count().collect()}
    at = F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for level, n in sizes.items():
        share = F.when(F.col("level") == level, F.lit(min(1.0, (s.audited if level == 0 else s.audited // 4) / n))).otherwise(share)
    chosen = {r["rep"]: r for r in told.where(at < share).limit(4 * s.audited * (1 + len(sizes))).collect()}
    if not chosen:
        return 1.0, 0
    by: dict[int, list] = {}
    for r in classes.where(F.col("rep").isin(list(chosen))).select("rep", "shard", "vec").collect():
        by.setdefault(r["shard"], []).append((r["rep"], np.frombuffer(r["vec"])))
    sent = classes.sparkSession.sparkContext.broadcast({x: (np.array([r for r, _ in v]), np.array([u for _, u in v])) for x, v in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            shard, rep, n = (batch.column(i).to_numpy() for i in range(3))
            vec = batch.column(3).to_pylist()
            for x in np.unique(shard).tolist():
                if x in sent.value:
                    rows = np.flatnonzero(shard == x)
                    reps, q = sent.value[x]
                    hit = q @ np.frombuffer(b"".join(vec[i] for i in rows), dtype=np.float64).reshape(len(rows), -1).T >= s.least
                    hit &= reps[:, None] != rep[rows][None, :]
                    for r, k in zip(reps.tolist(), (hit @ n[rows]).tolist(), strict=True):
                        total[r] = total.get(r, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int64()), pa.array(list(total.values()), type=pa.int64())], names=["rep", "true"])

    true = classes.select("shard", "rep", "n", "vec").mapInArrow(run, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true")).collect()
    drawn: dict[int, int] = {}
    for r in chosen.values():
        drawn[r["level"]] = drawn.get(r["level"], 0) + 1
    part = weight = seen = 0.0
    for r in true:
        if r["true"]:
            of = chosen[r["rep"]]
            w = sizes[of["level"]] / drawn[of["level"]]
            part += w * min(1.0, of["links"] / r["true"])
            weight += w
            seen += r["true"]
    return (part / weight if weight else 1.0), int(seen)


def near_duplicates(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label and length link from cosine s.least on. A vector that is null, empty, zero or
    holds a null or non-finite component, or has a null label, links with nothing. Equal vectors link
    with each other; rows that repeat a vec_id count as copies. A null vec_id links with nothing. An
    empty table gives no rows. If the audit isn't passed, shards overlap twice as much, twice at most;
    then all pairs of a label are compared, in blocks.
    """
    with scratch_scope() as keep:
        return keep(_near_duplicates(vectors, s), "near_duplicates")


def _near_duplicates(vectors: DataFrame, s: Settings) -> DataFrame:
    units = staged(unit_vectors(vectors), "units")
    valid = units.where("h1 IS NOT NULL AND vec_id IS NOT NULL")
    classes = staged(valid.groupBy("shard", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    for wider in (1, 2, 4, None):
        if wider is None:
            links, edges = linked(classes, s, exact=True)
            break
        links, edges = linked(classes, replace(s, overlap=s.overlap * wider, shard=s.shard * wider))
        links = staged(links, "links")
        if audit(classes, links, s)[0] >= s.recall:
            break
    roots = connected_components(vectors.sparkSession, edges).withColumnRenamed("node", "rep")
    told = classes.select("shard", "h1", "h2", "rep", "n").join(links, "rep", "left").join(roots, "rep", "left")
    told = told.select("shard", "h1", "h2", F.coalesce("root", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("k"))
    out = units.select("vec_id", "shard", "h1", "h2").join(told, ["shard", "h1", "h2"], "left")
    none = F.col("vec_id").isNull()
    out = out.select("vec_id", F.when(none, 0).otherwise(F.coalesce("k", F.lit(0))).cast("long").alias("n_links"), F.when(~none, F.coalesce("c", "vec_id")).alias("component_id"))
    return out.withColumn("kept", none | (F.col("vec_id") == F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id
"""
