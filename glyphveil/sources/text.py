"""Texts to scan: a string, whole files, standard input."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession


def from_strings(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """A row a file of path (a file, a folder or a pattern, in any file system): text, path."""
    return spark.read.text(path, wholetext=True).selectExpr("value AS text", "_metadata.file_path AS path")


def from_stdin(spark: SparkSession, stream=None) -> DataFrame:
    return from_strings(spark, [(stream or sys.stdin).read()])
