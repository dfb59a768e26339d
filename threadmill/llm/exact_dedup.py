"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups. DataFrame only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import small, stored, table

SPACES = r"[\x20\x09-\x0D]+"
#: Members of one group that are compared with one copy of its kept text; a larger group gets more copies of it.
MEMBERS_PER_COPY = 256


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once runs of white space are one space; null counts as empty, and empty texts are
    equal to each other. The smallest id of equal texts stays; a null id loses to any other and stays only if all are
    null. Rows that repeat id and text can't be told apart: each counts in group_size and shares the verdict. Other
    columns of docs are ignored. An empty table gives an empty result.

    Hashes and counts move as narrow rows. Texts move only for groups of two and more: every member meets its group's
    kept text in slices of MEMBERS_PER_COPY, so that no group lands in one task. Texts that share a hash but differ in
    bytes are grouped anew by the text itself."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).withColumn("h", hashed(F.col("norm")))
    narrow = stored(rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "hashed")
    groups = stored(narrow.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "groups")

    shared = stored(
        rows.join(small(groups), "h").select("doc_id", "h", "least", "norm", F.ceil(F.col("n") / MEMBERS_PER_COPY).cast("int").alias("k")), "shared"
    )
    first = shared.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("h", "k").agg(F.min("norm").alias("first_norm"))
    first = first.select("h", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("slice"), "first_norm")
    member = shared.select("doc_id", "h", "norm", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int").alias("slice"))
    same = F.col("norm") == F.col("first_norm")
    compared = stored(
        member.join(first, ["h", "slice"]).select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.when(same, "").otherwise(F.concat(F.lit("="), "norm")).alias("other")),
        "compared",
    )
    classes = stored(compared.groupBy("h", "other").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "classes")
    alone = narrow.join(small(groups.select("h")), "h", "left_anti").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    grouped = compared.join(small(classes), ["h", "other"]).select("doc_id", "sha", "keep_id", "group_size")
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
