"""Token stores: which token stands for which value, by tenant.

A store takes and gives DataFrames, so minting and resolving are joins rather than look-ups one at a
time. Tables are Parquet, partitioned by tenant; an upsert rewrites the partitions of the tenants it
touches, from a staging folder beside them, and needs to be the only writer meanwhile. Tenants are
joined, never listed by the driver. A change of the whole table is written beside it and swapped in by
renaming; what a swap that was cut short left behind is put right when the store is opened next.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphveil.fixed import LEGACY_TENANT, TOKEN, TOKEN_WHOLE
from glyphveil.functions.spans import SPANS, matches, weave
from glyphveil.operators.strategies import Tokenise, token_detector

COLUMNS = "tenant_id string, token string, original string, detector string, created_at timestamp"


def token_entries(df: DataFrame, spans: str, strategy: Tokenise, tenant: Column | None = None) -> DataFrame:
    """The distinct (tenant_id, token, original, detector) that redacting df's spans mints."""
    t = tenant if tenant is not None else F.lit(LEGACY_TENANT)
    long = df.select(t.alias("tenant_id"), F.explode(F.transform(spans, lambda x: F.struct(x["value"].alias("original"), x["detector"].alias("detector"), strategy.apply(x["value"], x["detector"]).alias("token")))).alias("e"))
    return long.select("tenant_id", "e.token", "e.original", "e.detector").distinct()


def entries(spark: SparkSession, pairs: Mapping[str, str], tenant: str) -> DataFrame:
    rows = [(tenant, k, v) for k, v in pairs.items()]
    return spark.createDataFrame(rows, "tenant_id string, token string, original string").withColumn("detector", token_detector(F.col("token")))


def _last(new: DataFrame, order: str | None) -> DataFrame:
    """One entry for each tenant and token: the last by the column order, or else by value; with the detector that the token names if none is told."""
    if "detector" not in new.columns:
        new = new.withColumn("detector", token_detector(F.col("token")))
    rank = F.struct(*([F.col(order)] if order else []), "original", "detector")
    last = new.groupBy("tenant_id", "token").agg(F.max_by(F.struct("original", "detector"), rank).alias("x"))
    return last.select("tenant_id", "token", "x.original", "x.detector")


class Store:
    """What stores share. frame(): all live entries; _replace(df, tenant): df in place of the entries of the tenants that it names, and of tenant."""

    def __init__(self, spark: SparkSession, legacy: str = LEGACY_TENANT) -> None:
        self.spark, self.legacy = spark, legacy

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def _replace(self, df: DataFrame, tenant: str | None = None) -> None:
        raise NotImplementedError

    def _now(self) -> Column:
        return F.current_timestamp()

    def put(self, new: DataFrame, order: str | None = None) -> None:
        """Adds entries (tenant_id, token, original, and detector if known). A token that is there is updated; of several new ones the last by order holds, by value without it."""
        last = _last(new, order).withColumn("created_at", self._now())
        old = self.frame().join(last.select("tenant_id").distinct(), "tenant_id", "left_semi").join(last.select("tenant_id", "token"), ["tenant_id", "token"], "left_anti")
        self._replace(old.select(*last.columns).unionByName(last))

    def put_one(self, token: str, original: str, tenant: str = LEGACY_TENANT) -> None:
        self.put(entries(self.spark, {token: original}, tenant))

    def get(self, token: str, tenant: str = LEGACY_TENANT) -> str | None:
        row = self.frame().where((F.col("tenant_id") == tenant) & (F.col("token") == token)).select("original").first()
        return row[0] if row else None

    def has(self, token: str, tenant: str = LEGACY_TENANT) -> bool:
        return self.get(token, tenant) is not None

    def known(self, tokens: DataFrame) -> DataFrame:
        """The rows of tokens (tenant_id, token) that the store has."""
        return tokens.join(self.frame().select("tenant_id", "token"), ["tenant_id", "token"], "left_semi")

    def clear(self, tenant: str = LEGACY_TENANT) -> None:
        self._replace(self.frame().where("false"), tenant)

    def dump(self, tenant: str = LEGACY_TENANT) -> DataFrame:
        return self.frame().where(F.col("tenant_id") == tenant).select("token", "original")

    def load(self, pairs: Mapping[str, str] | DataFrame, tenant: str = LEGACY_TENANT, order: str | None = None) -> None:
        """The pairs in place of all that the tenant had; of several of one token the last by order holds, by value without it."""
        new = pairs if isinstance(pairs, DataFrame) else entries(self.spark, pairs, tenant)
        new = new.drop("tenant_id", "detector").withColumn("tenant_id", F.lit(tenant))
        self._replace(_last(new, order).withColumn("created_at", self._now()), tenant)


class MemoryStore(Store):
    """Entries held by the driver: for tests and small maps only."""

    def __init__(self, spark: SparkSession, legacy: str = LEGACY_TENANT) -> None:
        super().__init__(spark, legacy)
        self.rows: dict[str, list] = {}

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([r for rows in self.rows.values() for r in rows], COLUMNS)

    def _replace(self, df: DataFrame, tenant: str | None = None) -> None:
        got = [tuple(r) for r in df.select("tenant_id", "token", "original", "detector", "created_at").collect()]
        for t in {r[0] for r in got} | ({tenant} if tenant is not None else set()):
            self.rows[t] = [r for r in got if r[0] == t]


class TableStore(Store):
    """A Parquet table partitioned by tenant_id."""

    def __init__(self, spark: SparkSession, path: str, legacy: str = LEGACY_TENANT) -> None:
        super().__init__(spark, legacy)
        self.path = path.rstrip("/")
        self._recover()

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._file(path)
        return fs.exists(p)

    def _remove(self, path: str) -> None:
        fs, p = self._file(path)
        fs.delete(p, True)

    def _rename(self, old: str, new: str) -> None:
        fs, p = self._file(old)
        if not fs.rename(p, self._file(new)[1]):
            raise OSError(f"{old} can't be renamed to {new}")

    def _recover(self) -> None:
        """After a swap that was cut short: the old table comes back if there is no new one, else it goes."""
        old = f"{self.path}.old"
        if self._exists(old):
            if self._exists(self.path):
                self._remove(old)
            else:
                self._rename(old, self.path)

    def _swap(self, df: DataFrame, *by: str) -> None:
        """df as the whole table: written beside it, then renamed into its place."""
        staging = f"{self.path}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(staging)
        self._rename(self.path, f"{self.path}.old")
        self._rename(staging, self.path)
        self._remove(f"{self.path}.old")

    def create(self) -> None:
        """The empty table, if there is none."""
        if not self._exists(self.path):
            self.spark.createDataFrame([], COLUMNS).write.mode("ignore").parquet(self.path)

    def migrate(self, legacy: str | None = None) -> None:
        """A table of times without tenants gets them: all entries are the legacy tenant's. Does nothing a second time."""
        if self._exists(self.path):
            df = self.spark.read.parquet(self.path)
            if "tenant_id" not in df.columns:
                self._swap(df.withColumn("tenant_id", F.lit(legacy or self.legacy)), "tenant_id")

    def revert(self, keep: str | None = None) -> None:
        """Without tenants again: one tenant's entries stay."""
        self._swap(self.frame().where(F.col("tenant_id") == (keep or self.legacy)).drop("tenant_id"))

    def frame(self) -> DataFrame:
        self.create()
        return self.spark.read.schema(COLUMNS).parquet(self.path)

    def _replace(self, df: DataFrame, tenant: str | None = None) -> None:
        staging = f"{self.path}-{uuid.uuid4().hex}"
        df.write.parquet(staging)
        staged = self.spark.read.schema(df.schema).parquet(staging)
        if tenant is not None:
            # A tenant left without entries has no partition that the write could overwrite.
            name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)
            self._remove(f"{self.path}/tenant_id={name}")
        staged.repartition("tenant_id", F.pmod(F.xxhash64("token"), F.lit(32))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(self.path)
        self._remove(staging)


class ExpiringStore(TableStore):
    """A table whose entries end `ttl` seconds after they were last put (0: never). Tokens are kept under hashed keys, which other tenants' namespaces don't share."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "pii_token:", ttl: int = 0, legacy: str = LEGACY_TENANT, clock=time.time) -> None:
        super().__init__(spark, path, legacy)
        self.prefix, self.ttl, self.clock = prefix, ttl, clock

    def key(self, token: Column, tenant: Column) -> Column:
        return F.concat(F.lit(self.prefix), F.when(tenant == self.legacy, F.lit("")).otherwise(F.concat(tenant, F.lit(":"))), F.sha2(token, 256))

    def _now(self) -> Column:
        return F.timestamp_seconds(F.lit(int(self.clock())))

    def frame(self) -> DataFrame:
        df = super().frame()
        if self.ttl > 0:
            df = df.where(F.unix_timestamp("created_at") + self.ttl > F.lit(int(self.clock())))
        return df

    def keyed(self) -> DataFrame:
        return self.frame().withColumn("key", self.key(F.col("token"), F.col("tenant_id")))


def tokens_in(text: Column) -> Column:
    """The distinct tokens of a text, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def resolve_token(df: DataFrame, store: Store, token: str = "token", tenant: Column | None = None) -> DataFrame:
    """df with resolved: the original of the column token, null if it has another form or isn't known."""
    t = tenant if tenant is not None else F.lit(store.legacy)
    known = store.frame().select(F.col("tenant_id").alias("__gv_t"), F.col("token").alias("__gv_k"), F.col("original").alias("resolved"))
    return df.withColumn("__gv_tenant", t).join(known, F.col(token).rlike(TOKEN_WHOLE) & (F.col("__gv_tenant") == F.col("__gv_t")) & (F.col(token) == F.col("__gv_k")), "left").drop("__gv_tenant", "__gv_t", "__gv_k")


def detokenise(df: DataFrame, store: Store, text: str = "text", tenant: Column | None = None) -> DataFrame:
    """df with detokenised: struct(output, token_count, resolved_count, unresolved_tokens), counts of distinct tokens.

    Only tokens that texts mention are looked up, by one join; then the pairs of a text meet again by
    the text's digest and tenant. Unknown tokens stay as they are. Hot tokens are looked up once.
    """
    t = tenant if tenant is not None else F.lit(store.legacy)
    base = df.withColumn("__gv_tenant", t).withColumn("__gv_tokens", F.coalesce(tokens_in(F.col(text)), F.array().cast("array<string>"))).withColumn("__gv_text", F.sha2(F.col(text), 256))
    asked = base.where(F.size("__gv_tokens") > 0).select("__gv_tenant", "__gv_text", F.explode("__gv_tokens").alias("token")).distinct()
    known = store.frame().select(F.col("tenant_id").alias("__gv_tenant"), "token", "original")
    pairs = asked.join(known, ["__gv_tenant", "token"]).groupBy("__gv_tenant", "__gv_text").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("__gv_pairs"))
    out = base.join(pairs, ["__gv_tenant", "__gv_text"], "left")
    have = F.coalesce(F.col("__gv_pairs"), F.create_map().cast("map<string,string>"))
    spans = F.coalesce(F.transform(matches(F.col(text), TOKEN), lambda m: F.struct(F.lit("").alias("detector"), m["value"].alias("value"), m["offset"].alias("offset"), m["length"].alias("length"))), F.array().cast(SPANS))
    woven = weave(F.col(text), spans, lambda x: F.coalesce(F.try_element_at(have, x["value"]), x["value"]))
    missing = F.filter("__gv_tokens", lambda k: ~F.map_contains_key(have, k))
    done = F.struct(woven.alias("output"), F.size("__gv_tokens").alias("token_count"), (F.size("__gv_tokens") - F.size(missing)).alias("resolved_count"), missing.alias("unresolved_tokens"))
    return out.withColumn("detokenised", done).drop("__gv_tenant", "__gv_tokens", "__gv_text", "__gv_pairs")


def first_seen(long: DataFrame, order: str) -> DataFrame:
    """Of entries with a column order, the first of each tenant and token: what minting row by row would have stored."""
    w = Window.partitionBy("tenant_id", "token").orderBy(order)
    return long.withColumn("__gv_n", F.row_number().over(w)).where("__gv_n = 1").drop("__gv_n", order)
