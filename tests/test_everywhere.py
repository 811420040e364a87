"""Found values are hidden wherever else they occur in their text."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphveil.operators import detectors as d
from glyphveil.operators.engine import Engine, default_engine
from glyphveil.operators.strategies import FunctionStrategy, Mask, PythonStrategy, Tokenise
from glyphveil.plans import queries

CARD = "4242424242424242"
TEXTS = (
    f"card {CARD}. order 132 {CARD} è ref_{CARD}",
    f"order 132 {CARD} alone is left as it was",
    f"x{CARD}9 and {CARD}, 📧 a@x.io a@x.io",
    f"{CARD}\n{CARD} {CARD}\n4242 4242 4242 4242 é4242 4242 4242 4242",
    "",
    None,
    "nothing",
)


def redacted(spark, engine, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(engine.redact(F.col("text"))).collect()]


@pytest.mark.parametrize("name", ["streaming_redact", "mask_documents"])
def test_query_hides_found_values_like_its_sql(spark, tmp_path, name):
    """A card that stands on its own, and again behind a number or within a word, where its pattern doesn't take it."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select("doc_id", "redacted").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, redacted FROM ({queries.ORACLE[name]})").fetchall())
    assert got[0][1] == "card [REDACTED]. order 132 [REDACTED] è ref_[REDACTED]" and CARD in got[1][1]


def test_only_where_asked_for(spark):
    e = default_engine(strategy=Mask("[X]"))
    assert redacted(spark, e, f"{CARD}. _{CARD}") == [f"[X]. _{CARD}"]
    assert redacted(spark, e.with_everywhere(True), f"{CARD}. _{CARD}", None, "") == ["[X]. _[X]", None, ""]


def test_values_are_no_patterns_and_replacements_stay(spark):
    """Values with signs of patterns, a value within another, and one that a replacement holds."""
    rule = d.PatternDetector("r", (r"(?<=<)[^>]+(?=>)",))
    told = Engine(FunctionStrategy("told", lambda v, n: F.concat(F.lit("[r "), F.upper(v), F.lit("]")))).register(rule).with_everywhere(True)
    assert redacted(spark, told, r"<a.c> abc a.c", r"<x\Ey|z> x\Ey|z x", "<ab> <abc> abcab", "<r> <$1> r $1é") == ["<[r A.C]> abc [r A.C]", r"<[r X\EY|Z]> [r X\EY|Z] x", "<[r AB]> <[r ABC]> [r ABC][r AB]", "<[r R]> <[r $1]> [r R] [r $1]é"]
    python = Engine(PythonStrategy("p", lambda v, n: v[::-1] + n)).register(rule).with_everywhere(True)
    assert redacted(spark, python, "<ab> ab") == ["<bar> bar"]


def test_one_token_a_value(spark):
    [got] = redacted(spark, default_engine(strategy=Tokenise("s")).with_everywhere(True), f"{CARD}. _{CARD}")
    first, second = got.split(". _")
    assert first == second and first.startswith("[tok:credit_card:")
