"""From pages and articles to a corpus: what is kept and why the rest is not, and whether its documents hang together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import candidates
from .evaluate import upper_median
from .store import settled, small


def screened(pages: DataFrame, dropped: dict[str, str] | list[str], least: int = 400, wanted: str | None = None, label: str = "title", anchor: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents kept of pages (title, body), and (title, reason) of the others: named in the drop
    list (its reason, if it has one), without a wanted word in the title, shorter than `least`, or without an anchor in
    the body. What is skipped is named by the column `label`."""
    reasons = dropped if isinstance(dropped, dict) else dict.fromkeys(dropped, "on the drop list")
    listed = F.create_map(*(F.lit(x) for kv in reasons.items() for x in kv)) if reasons else F.lit(None).cast("map<string,string>")
    size = F.char_length(F.coalesce("body", F.lit("")))
    lacks = lambda column, pattern: ~F.coalesce(F.rlike(column, F.lit(pattern or "")), F.lit(not pattern))
    why = F.coalesce(F.element_at(listed, F.col("title")), F.when(lacks("title", wanted), "title off topic"), F.when(size < least, F.format_string("%d characters", size)), F.when(lacks("body", anchor), "no anchor in the body"))
    rows = pages.withColumn("reason", why)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select(F.col(label).alias("title"), "reason")


def manifest(kept: DataFrame, kind: Column, url: Column) -> DataFrame:
    """K2: a row for each document kept: title, type, chars, source and its distinct codes, sorted."""
    return kept.select("title", kind.alias("type"), F.char_length("body").alias("chars"), url.alias("source"), T.codes(F.col("body")).alias("categories"))


def overlaps(docs: DataFrame, prefixes: tuple[str, ...] = (), code: str = r"\(([A-H]-\d{1,2}(?:-\d)?)\)") -> DataFrame:
    """(title, by_title, by_code, n_codes) of documents (title, body): whether the body contains a key term of
    another document's title, or else a code in parentheses that another body has too.

    Terms meet bodies by an automaton that reads each body once for a set of terms; codes by how many documents have them."""
    bodies = settled(docs.select("title", "body", F.array_distinct(F.regexp_extract_all("body", F.lit(code), F.lit(1))).alias("codes")))
    terms = settled(bodies.select(F.col("title").alias("of"), F.explode(F.array_distinct(T.key_terms(F.col("title"), prefixes))).alias("term")))
    # a term counts if another title has it: of its titles, the least and the greatest tell
    owners = terms.groupBy("term").agg(F.min("of").alias("least"), F.max("of").alias("most"))
    said = candidates.containing(bodies, ["title"], "body", terms, "term", 3).join(owners, "term")
    said = said.where((F.col("least") != F.col("title")) | (F.col("most") != F.col("title"))).select("title").distinct()
    each = bodies.select("title", F.explode("codes").alias("code"))
    shared = each.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    coded = each.join(small(settled(shared)), "code", "left_semi").select("title").distinct()
    out = bodies.join(said.withColumn("by_title", F.lit(True)), "title", "left").join(coded.withColumn("shares", F.lit(True)), "title", "left")
    by_title = F.coalesce("by_title", F.lit(False))
    return out.select("title", by_title.alias("by_title"), (~by_title & F.coalesce("shares", F.lit(False))).alias("by_code"), F.size("codes").alias("n_codes"))


def gate(docs: DataFrame, prefixes: tuple[str, ...] = (), least: int = 50, ratio: float = 0.6) -> DataFrame:
    """One row: n, median length, documents that overlap another, their ratio, documents of several codes, and
    whether the corpus passes."""
    found = overlaps(docs, prefixes)
    share = F.avg((F.col("by_title") | F.col("by_code")).cast("int"))
    row = found.agg(F.count("*").alias("n"), F.count_if(F.col("by_title") | F.col("by_code")).alias("n_overlap"), F.round(share, 6).alias("ratio"), F.count_if(F.col("n_codes") >= 2).alias("n_several"), ((F.count("*") >= least) & (share >= ratio)).alias("passes"))
    return row.crossJoin(upper_median(docs.select(F.char_length("body").alias("chars")), "chars"))  # one row each
