"""The same columns on streams: redaction is stateless, so batches and streams share their plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphveil.operators.engine import Engine
from glyphveil.operators.strategies import Tokenise
from glyphveil.scratch import shared_path
from glyphveil.sources.vault import Store, token_entries


def redact_stream(stream: DataFrame, engine: Engine, text: str = "text") -> DataFrame:
    """stream with detections, redacted and audit; no state is kept."""
    return engine.apply(stream, text)


def mint_stream(redacted: DataFrame, store: Store, strategy: Tokenise, tenant: Column | None = None):
    """A writer that puts the tokens of each micro-batch into the store. Putting them again after a failure changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        store.put(token_entries(batch, "detections", strategy, tenant))

    return redacted.writeStream.foreachBatch(put)


def audit_stream(redacted: DataFrame, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Detections by detector and time window, for streams with an event time."""
    found = redacted.withWatermark(at, late).select(at, F.explode("detections.detector").alias("detector"))
    return found.groupBy(F.window(at, window), "detector").agg(F.count("*").alias("n"))


def available(stream: DataFrame, name: str = "stream") -> DataFrame:
    """What a stream holds by now, run once to its end into a table in the shared scratch folder, and read from there."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
