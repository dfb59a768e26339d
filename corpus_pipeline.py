"""A training-corpus pipeline over `documents`: five stages, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadmill.llm import bpe, exact_dedup, jaccard, mixing, quality
from threadmill.llm.common import small, stored, table


def _without(docs: DataFrame, dropped: DataFrame, text_key: Column) -> DataFrame:
    """docs but for the rows of dropped (id, key: of the text), told apart by both, since an id may have several texts.
    A row with a null id stays."""
    drop = small(stored(dropped.where("id is not null").distinct(), "dropped"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key.alias("key"))
    return rows.join(drop, ["id", "key"], "left_anti").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good. A null or empty text is scored as an empty line; repeated rows fare
    alike; an empty table stays empty, and without labels all documents stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, docs.columns).where(F.col("score") >= quality.CUT).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id. Null and empty texts are equal to each
    other. Rows that repeat id and text are one document and stay together; rows without an id stay."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), exact_dedup.SPACES, " ")
    return _without(docs, exact_dedup.exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key")), F.sha2(text, 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates. Texts without words are in no class but with
    their copies; rows that repeat id and text stay together; rows without an id stay."""
    classes = jaccard.jaccard_classes(docs).where("not stays")
    return _without(docs, classes.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")), jaccard.text_key(F.col("text")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their calibrated probabilities. Null sources and languages are empty strings; rows that
    repeat an id in one cell fare alike; a null id is drawn as an empty one."""
    return mixing.sampled(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every row; null and empty texts have no tokens."""
    return bpe.bpe_digests(docs, bpe.ranks_path())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The line field and tiktoken's merges have no SQL; tests hold each stage against a plain computation of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
