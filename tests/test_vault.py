"""Token stores, detokenising and streams."""

import pytest
from pyspark.sql import functions as F

from glyphveil.errors import RedactorError
from glyphveil.operators.engine import default_engine
from glyphveil.operators.strategies import Tokenise
from glyphveil.sources import vault
from glyphveil.sources.config import Config, build_store
from glyphveil.streaming.redaction import audit_stream, mint_stream, redact_stream


@pytest.fixture(params=["memory", "table", "expiring"])
def store(request, spark, tmp_path):
    if request.param == "memory":
        return vault.MemoryStore(spark)
    if request.param == "table":
        return vault.TableStore(spark, f"file://{tmp_path}/v")
    return vault.ExpiringStore(spark, f"file://{tmp_path}/v")


def test_contract(spark, store):
    store.put_one("[tok:email:aa]", "a")
    store.put_one("[tok:email:aa]", "b")
    store.put_one("[tok:email:aa]", "other", "007")
    assert store.get("[tok:email:aa]") == "b" and store.get("[tok:email:aa]", "007") == "other" and store.get("[tok:email:bb]") is None
    assert store.has("[tok:email:aa]") and not store.has("[tok:email:aa]", "t3")
    store.load({"[tok:iban:cc]": "c", "odd": "d"})
    assert {tuple(r) for r in store.dump().collect()} == {("[tok:iban:cc]", "c"), ("odd", "d")}
    assert {r["token"]: r["detector"] for r in store.frame().collect()} == {"[tok:iban:cc]": "iban", "odd": "unknown", "[tok:email:aa]": "email"}
    asked = spark.createDataFrame([("default", "odd"), ("default", "none")], "tenant_id string, token string")
    assert [r["token"] for r in store.known(asked).collect()] == ["odd"]
    store.clear()
    assert store.dump().count() == 0 and store.get("[tok:email:aa]", "007") == "other"


def test_expiry_and_keys(spark, tmp_path):
    import time

    now = [time.time()]
    s = vault.ExpiringStore(spark, f"file://{tmp_path}/v", ttl=60, clock=lambda: now[0])
    s.put_one("[tok:email:aa]", "a")
    keys = s.keyed().select("key").first()[0]
    assert keys.startswith("pii_token:") and len(keys) == 10 + 64
    now[0] += 120
    assert s.get("[tok:email:aa]") is None and s.dump().count() == 0


def test_migration(spark, tmp_path):
    path = f"file://{tmp_path}/old"
    spark.createDataFrame([("[tok:email:aa]", "a", "email")], "token string, original string, detector string").withColumn("created_at", F.current_timestamp()).write.parquet(path)
    s = vault.TableStore(spark, path)
    s.migrate("first")
    s.migrate("second")
    assert s.get("[tok:email:aa]", "first") == "a"
    s.revert("first")
    assert "tenant_id" not in spark.read.parquet(path).columns


def test_cut_short_swap(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    s = vault.TableStore(spark, path)
    s.put_one("[tok:email:aa]", "a")
    s._rename(path, f"{path}.old")  # as a crash between the two renames leaves it
    assert vault.TableStore(spark, path).get("[tok:email:aa]") == "a"
    spark.range(1).write.parquet(f"{path}.old")  # as a crash before the old table was removed
    again = vault.TableStore(spark, path)
    assert again.get("[tok:email:aa]") == "a" and not again._exists(f"{path}.old")


def test_last_by_order(spark, store):
    rows = [("t", "[tok:email:aa]", "z", 1), ("t", "[tok:email:aa]", "a", 2)]
    df = spark.createDataFrame(rows, "tenant_id string, token string, original string, at int")
    store.put(df, order="at")
    assert store.get("[tok:email:aa]", "t") == "a"
    store.load(df.drop("tenant_id"), "t")
    assert store.get("[tok:email:aa]", "t") == "z"


def test_callers_columns_stay(spark, store):
    store.put_one("[tok:email:aa]", "a")
    df = spark.createDataFrame([("x [tok:email:aa]", 1, 2, 3, 4)], "text string, _t int, _tenant int, _tokens int, _text int")
    got = vault.detokenise(df, store)
    assert got.drop("detokenised").first() == df.first() and got.first()["detokenised"]["output"] == "x a"


def test_round_trip(spark, store):
    e = default_engine(strategy=Tokenise("salt", tenant=F.col("tenant")))
    docs = spark.createDataFrame([(1, "default", "a@x.io è a@x.io b@y.io"), (2, "t2", "a@x.io"), (3, "t2", "none"), (4, "t2", None), (5, "t2", "a@x.io")], "id int, tenant string, text string")
    out = e.apply(docs)
    store.put(vault.token_entries(out, "detections", e.strategy, F.col("tenant")))
    back = vault.detokenise(out.select("id", "tenant", F.col("redacted").alias("text")), store, "text", F.col("tenant")).orderBy("id").collect()
    assert [r["detokenised"]["output"] for r in back] == ["a@x.io è a@x.io b@y.io", "a@x.io", "none", None, "a@x.io"]
    assert back[0]["detokenised"]["token_count"] == 2 and back[0]["detokenised"]["resolved_count"] == 2
    swapped = vault.detokenise(out.select("id", F.col("redacted").alias("text")), store, "text", F.lit("t3")).orderBy("id").first()["detokenised"]
    assert swapped["resolved_count"] == 0 and len(swapped["unresolved_tokens"]) == 2
    one = vault.resolve_token(spark.createDataFrame([("odd",), ("[tok:email:00]",)], "token string"), store).collect()
    assert [r["resolved"] for r in one] == [None, None]


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a@x.io"), (2, "none")], "id int, text string").withColumn("ts", F.current_timestamp()).write.parquet(src)
    e = default_engine(strategy=Tokenise("salt"))
    s = vault.TableStore(spark, f"file://{tmp_path}/vault")
    stream = spark.readStream.schema("id int, text string, ts timestamp").parquet(src)
    red = redact_stream(stream, e)
    q = mint_stream(red, s, e.strategy).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert [tuple(r)[1] for r in s.dump().collect()] == ["a@x.io"]
    q = audit_stream(red, "ts").writeStream.format("memory").queryName("audit").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["detector"], r["n"]) for r in spark.table("audit").collect()] == [("email", 1)]


def test_choice(spark):
    assert isinstance(build_store(spark, Config()), vault.MemoryStore)
    assert isinstance(build_store(spark, Config(token_store="cache")), vault.ExpiringStore)
    with pytest.raises(RedactorError):
        build_store(spark, Config(token_store="odd"))
