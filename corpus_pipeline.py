"""The corpus pipeline: language ID, near duplicates, personal data, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphveil.llm import op02_mix, op04_pii, op06_jaccard, op09_bpe, op10_langid
from glyphveil.llm.common import Bloom, remainder, scratch_scope, staged, table

#: A prediction of a lower probability than this is no language.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned go on, those without letters or of no clear language go; a null lang is filled in.

    Null and empty texts have no letters, so they go. Rows that repeat an id or a text are judged each
    by its text. An empty table, or one without any lang, gives none. Other columns, whatever their
    names, go along.
    """
    model = op10_langid.train(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), 4) != 2))
    told = op10_langid.identify(docs, model)
    kept = told.where((F.col("lang_pred") != op10_langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id.

    Of rows that repeat a doc_id each text is judged by itself, and of one that repeats its text too one
    stays. Null ids and texts without words stay; an empty table gives none; other columns, whatever
    their names, go along. Texts of documents that stay aren't shuffled: a Bloom filter of at most
    8 MB, of the ids that don't, rules them out as they are read, and only the rest is joined.
    """
    told = op06_jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id IS NOT NULL")
    judged = told.groupBy("doc_id", "text_key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    gone = staged(judged.where("NOT kept OR n > 1"), "gone")
    ids = Bloom(gone, "doc_id")
    maybe, key = ids.column(F.col("doc_id")), op06_jaccard.text_key(F.col("text"))
    out = gone.where("NOT kept").select(F.col("doc_id").alias("__gv_id"), F.col("text_key").alias("__gv_key"))
    rest = docs.where(maybe).withColumn("__gv_text", key)
    rest = rest.join(out, (rest["doc_id"] == out["__gv_id"]) & (rest["__gv_text"] == out["__gv_key"]), "left_anti")
    return docs.where(~maybe).unionByName(rest.dropDuplicates(["doc_id", "__gv_text"]).drop("__gv_text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data under pseudonyms; n_chars, if there is one, follows.

    Null and empty texts stay as they are, equal rows get equal texts, an empty table gives none.
    Other columns, whatever their names, go along.
    """
    done = op04_pii.pseudonymise(docs, found="__gv_n")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__gv_n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated by epoch, or left out.

    A null source is one of the sources. Texts without words, null ones too, cost a budget nothing: they come and
    go with the documents around them in the hash order. Rows that repeat an id go by size. An empty
    table gives none. Other columns, whatever their names, go along.
    """
    return op02_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text in place of it, with n_tokens and the digests of ids and of the decoded text.

    A null or empty text has no ids. Repeated rows are encoded each. An empty table gives none. Other
    columns go along, but for those named ids, n_tokens, ids_sha256 or decoded_sha256, in any case.
    """
    return op09_bpe.bpe_round_trip(docs, op09_bpe.default_vocabulary(), ids="ids").drop("text")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("tokens", tokens)]

#: Trained models, the join and the tokenizer are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all documents."""
    docs = table(spark, sf_dir, "documents")
    with scratch_scope() as keep:  # each stage's table goes once the last stage is written
        for name, stage in STAGES[:-1]:
            with scratch_scope() as keep_stage:
                docs = keep_stage(stage(spark, docs, sf_dir), f"stage-{name}")
        return keep(STAGES[-1][1](spark, docs, sf_dir), "stage-tokens")
