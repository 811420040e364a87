"""Reports on detections: of one row as a struct, of a corpus as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphveil.fixed import SAMPLES
from glyphveil.functions.kernels import once


def counts(spans: Column) -> Column:
    """How many spans each detector has, in order of first sight."""
    names = F.array_distinct(F.transform(spans, lambda x: x["detector"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.size(F.filter(spans, lambda x: x["detector"] == n)).alias("value"))))


def samples(spans: Column, cap: int = SAMPLES) -> Column:
    """The first distinct values of each detector."""
    names = F.array_distinct(F.transform(spans, lambda x: x["detector"]))

    def values(n: Column) -> Column:
        return F.slice(F.array_distinct(F.transform(F.filter(spans, lambda x: x["detector"] == n), lambda x: x["value"])), 1, cap)

    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), values(n).alias("value"))))


def report(spans: Column) -> Column:
    return F.struct(F.size(spans).alias("total"), counts(spans).alias("counts"), samples(spans).alias("samples"))


def safe(rep: Column, raw: bool = False) -> Column:
    """A report with [detector] in place of each sample, unless raw values are asked for."""
    if raw:
        return rep
    return once(rep, lambda r: F.struct(r["total"].alias("total"), r["counts"].alias("counts"), F.transform_values(r["samples"], lambda k, v: F.transform(v, lambda _: F.concat(F.lit("["), k, F.lit("]")))).alias("samples")))


def detections_long(df: DataFrame, spans: str = "detections", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a detection."""
    return df.select(*keep, F.explode(spans).alias("d")).select(*keep, "d.*")


def corpus_counts(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Detections and distinct values by detector and the columns of by, with subtotals (null) from the right."""
    return long.rollup(*by, "detector").agg(F.count("*").alias("n")) if by else long.groupBy("detector").agg(F.count("*").alias("n"))


def corpus_samples(long: DataFrame, order: tuple[str, ...], cap: int = SAMPLES) -> DataFrame:
    """The first distinct values of each detector over a corpus, by order; values are made distinct before they meet in one task."""
    first = long.groupBy("detector", "value").agg(F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy("detector").orderBy("first", "value")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("detector", "rank", "value")
