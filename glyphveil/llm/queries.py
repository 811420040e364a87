"""The registered queries opN_<name> of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphveil.llm import op01_embeddings, op02_mix, op03_rules, op04_pii, op05_quality, op06_jaccard, op07_warc, op08_chat, op10_langid
from glyphveil.llm.common import remainder, table
from glyphveil.llm.op09_bpe import bpe_round_trip, default_vocabulary


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return op01_embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return op02_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return op03_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms."""
    return op04_pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; rows with remainder 0 modulo 5 are held out of learning labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder(F.col("doc_id"), 5) != 0)
    vectors, net = op05_quality.train(docs, labels)
    return op05_quality.score(docs, vectors, net).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, component and number of links of every document."""
    return op06_jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say, read back."""
    return op07_warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text; and of conversation -7."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = op08_chat.canonical_turns(op08_chat.records(rows.unionByName(probe)))
    return op08_chat.digests(op08_chat.read_back(op08_chat.format_chat(turns).drop("turns")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, default_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows with remainder 2 modulo 4 are held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = op10_langid.train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return op10_langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_mix": op2_mix,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_jaccard": op6_jaccard,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
}

ORACLE: dict[str, str] = {
    "op1_embeddings": op01_embeddings.SQL,
    "op2_mix": op02_mix.SQL,
    "op3_quality_rules": op03_rules.SQL,
    "op7_warc": op07_warc.SQL,
    "op8_chat": op08_chat.SQL,
}
