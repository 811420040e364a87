"""What several operators of this package share: scratch tables, word rules and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space between words: space and U+0009 to U+000D, as the contracts' pattern has it.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from spark.checkpoint.dir.

    Where it is unset (tests in one JVM) a temporary folder is set; on a cluster that would be
    wrong, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="glyphveil-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below scratch_root(), removed when the driver's Python ends or by release()."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: computed once, and independent of lost executors.

    rows: how many are expected at most, if known; then they are dealt out to no more files than they
    need, by a shuffle of their own, so that the stage before keeps its width.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(max(4, -(-rows // 250_000)))
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended already; then nothing can be removed
        pass


def release(since: int = 0) -> None:
    """Removes the scratch tables made so far, but for the first `since` of them."""
    while len(_made) > since:
        _remove(*_made.pop())


@contextmanager
def scratch_scope() -> Iterator:
    """Gives a function keep(df, name): df staged to outlive the scope; all else staged within is removed at its end.

    An operator stages its result through keep(), so that what it wrote on the way doesn't add up
    over the stages of a pipeline.
    """
    since, left = len(_made), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        left.append(_made.pop())
        return out

    try:
        yield keep
    finally:
        release(since)
        _made.extend(left)


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, whatever file system it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df that have none of these names; capitals don't tell names apart, as for Spark."""
    told = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in told]


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, whatever signs they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named by place: for Python workers, which can't be sent all names that tables may have."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> int:
    """At which place df has a column."""
    return [c.lower() for c in df.columns].index(name.lower())


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df and, after it, the fields of ddl."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


#: Rows of texts that go to a Python worker at once.
_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that lie in a worker and, off its heap, in the executor at once; a session that asks for fewer is left alone.

    It is the session's setting, read when a plan is made, so it holds for what the session runs later too.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > _BATCH:
        spark.conf.set(name, str(_BATCH))


def remainder(col: Column, by: int) -> Column:
    """crc32 of an integer as text, modulo by: how rows are held out of learning."""
    return F.crc32(col.cast("string")) % by


#: Bytes of a Bloom filter at most, and the places that an id marks in it.
_BLOOM_BYTES, _BLOOM_PLACES = 8 << 20, 4


def _places(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    for k in range(_BLOOM_PLACES):
        h = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        yield (h ^ (h >> np.uint64(31))) & np.uint64(bits - 1)


class Bloom:
    """A Bloom filter of the long ids of a table, for executors: what it rules out is none of them.

    It has 16 bits an id or more up to 8 MB in all; beyond that it rules out less and less, and what
    it leaves is for an exact join. Words of it are united by key before and after the shuffle.
    """

    def __init__(self, ids: DataFrame, column: str) -> None:
        n = ids.count()
        self.bits = bits = min(8 * _BLOOM_BYTES, max(1 << 13, 1 << (16 * n).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(bits // 64, dtype=np.uint64)
            for batch in batches:
                for at in _places(batch.column(0).to_numpy(), bits):
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            set_ = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(set_), pa.array(words[set_].view(np.int64))], names=["at", "word"])

        got = ids.select(F.col(column).cast("long")).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
        words = np.zeros(bits // 64, dtype=np.int64)
        if n:
            table = got.toArrow()
            words[table.column("at").to_numpy()] = table.column("word").to_numpy()
        self.sent = ids.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        """For each id whether it may be one of the table's."""
        words, out = self.sent.value, np.ones(len(ids), dtype=bool)
        for at in _places(ids, self.bits):
            out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def column(self, id_: Column) -> Column:
        """Whether an id may be one of the table's, as a column; null is none. Only the ids go to Python."""

        @F.arrow_udf("boolean")
        def told(x: pa.Array) -> pa.Array:
            return pa.array(self.maybe(x.to_numpy(zero_copy_only=False)))

        return id_.isNotNull() & told(F.coalesce(id_.cast("long"), F.lit(0).cast("long")))


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps, each one aggregation for the smallest neighbour and
    one join back to the edges. The adjacency of a hub is never collected: its minimum is combined
    before the shuffle and the join back may be split. Edges go to a scratch table after each round,
    so neither lineage nor lost executors matter. Rounds grow with the logarithm of the longest path.
    """
    cur = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    n = cur.count()
    nodes = cur.select(F.col("a").alias("node")).union(cur.select(F.col("b").alias("node"))).distinct()
    for _ in range(max_rounds):
        # Large star: every neighbour larger than the node is linked to the node's smallest neighbour.
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new = staged(small, "edges", 2 * n)
        # It is done when every node has one edge and no root has an edge of its own.
        open_ = new.groupBy("a").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        cur = new
        if not open_:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
