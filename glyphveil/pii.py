"""Module functions on one engine: pii.redact(df), pii.scan(df), pii.extend(...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphveil.operators.engine import Engine
from glyphveil.operators.strategies import Strategy
from glyphveil.sources.config import Config, build_engine, from_environment

_engine: list[Engine] = []


def configure(config: Config | Engine | None = None) -> Engine:
    """Sets the engine: given, or built from a Config, or from the environment."""
    _engine[:] = [config if isinstance(config, Engine) else build_engine(config or from_environment())]
    return _engine[0]


def engine() -> Engine:
    return _engine[0] if _engine else configure()


def extend(alias: str, detector) -> None:
    _engine[:] = [engine().extend(alias, detector)]


def redact(df: DataFrame, text: str = "text", strategy: Strategy | None = None) -> DataFrame:
    """df with its text redacted in place."""
    return df.withColumn(text, engine().redact(F.col(text), strategy))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with report: total, counts, samples."""
    return df.withColumn("report", engine().scan(F.col(text)))
