"""Fill-in-middle: a Split pre-tokenizer isolates the units of a text; its offsets cut prefix, middle and suffix."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import PreTokenizer, Split

from .common import ship, table

#: The unit, the marks, shares of texts that stay plain and of the others that put the suffix first, in
#: percent, and what the hash of an id begins with.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
PLAIN_FROM, SUFFIX_FIRST, SEED = 90, 20, "1:"
#: Code points that are pre-tokenised at once: longer texts go piece by piece, so that no list of units is longer.
PIECE = 1 << 16

_BETWEEN = re.compile("[^A-Za-z]")


def unit_ends(splitter: PreTokenizer, text: str) -> np.ndarray:
    """The code-point offset at which each unit of text ends, from the pre-tokenizer's splits."""
    whole = PreTokenizedString(text)
    splitter.pre_tokenize(whole)
    return np.fromiter((at[1] for _, at, _ in whole.get_splits("original", "char")), np.int64)


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """text in pieces of about size code points, each with its offset; a piece ends before no letter that goes on."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = _BETWEEN.search(text, end)
            end = found.start() if found else len(text)
        yield at, text[at:end]
        at = end


def cuts(splitter: PreTokenizer, text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """The number n of units, and the code points before the smaller and the larger of h1 % (n + 1) and h2 % (n + 1)
    units. A text of several pieces is counted first; then the pieces with the two cuts are split again."""
    if len(text) <= PIECE:
        ends = unit_ends(splitter, text)
        n = len(ends)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, int(ends[a - 1]) if a else 0, int(ends[b - 1]) if b else 0
    held = [(at, piece, len(unit_ends(splitter, piece))) for at, piece in pieces(text)]
    before = np.cumsum([0, *(n for _, _, n in held)])
    n = int(before[-1])

    def offset(units: int) -> int:
        if not units:
            return 0
        k = int(np.searchsorted(before, units)) - 1
        return held[k][0] + int(unit_ends(splitter, held[k][1])[units - before[k] - 1])

    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, offset(a), offset(b)


def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    splitter = Split(Regex(UNIT), behavior="isolated")
    for text, h1, h2 in batches:
        yield pd.DataFrame([cuts(splitter, *x) for x in zip(text, h1, h2)], columns=["n", "first", "second"], dtype="int64")


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the hash of an id; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Cuts and form are drawn from the id's hash alone, so that a row fares alike wherever it is. Null texts are empty;
    an empty text, or one that has a mark in it, stays plain with null lengths. Repeated rows fare alike; a null id is
    drawn as an empty one; other columns are ignored; an empty table gives an empty result. Only a text's counts and
    cuts come back from Python; very long texts are split piece by piece there, and sliced whole in the JVM."""
    ship(docs.sparkSession)
    find = F.pandas_udf(_cut, "n long, first long, second long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    rows = rows.withColumn("cut", find("text", "h1", "h2"))
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.col("text").contains(mark)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), F.col("cut.n").alias("n"), F.col("cut.first").cast("int").alias("first"), F.col("cut.second").cast("int").alias("second"))
    part = {
        "prefix": F.col("text").substr(F.lit(1), F.col("first")),
        "middle": F.col("text").substr(F.col("first") + 1, F.col("second") - F.col("first")),
        "suffix": F.substring("text", F.col("second") + 1, F.length("text")),
    }

    def joined(*order: str) -> Column:
        return F.concat(*(x for k in order for x in (F.lit(MARKS[k]), part[k])))

    split = F.col("form") != "plain"
    output = F.when(~split, F.col("text")).when(F.col("form") == "psm", joined("prefix", "suffix", "middle")).otherwise(joined("suffix", "prefix", "middle"))
    return rows.select(
        "doc_id", "n", "form", F.when(split, F.col("first").cast("long")).alias("prefix_chars"),
        F.when(split, (F.col("second") - F.col("first")).cast("long")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form. A cut text has no mark in it, and no mark overlaps another, so the first
    of each mark is the one that was put there."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        at, last = F.locate(MARKS[two], output), F.locate(MARKS["middle"], output)
        skip = len(MARKS[one])
        return F.substring(output, F.lit(skip + 1), at - 1 - skip), F.substring(output, at + len(MARKS[two]), last - at - len(MARKS[two])), F.substring(output, last + len(MARKS["middle"]), F.length(output))

    prefix, suffix, middle = parts("prefix", "suffix")
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts("suffix", "prefix")
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over documents, with output and rebuilt text as digests."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    ('0x' || h[17:24])::BIGINT % 100 AS z, ('0x' || h[25:32])::BIGINT % 100 AS w
  FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(u[greatest(x, y) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 90 THEN 'plain'
      WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
