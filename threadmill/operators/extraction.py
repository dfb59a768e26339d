"""Triples that a model reads from documents, within a closed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.readers import kept_in_cache
from .answers import Model, replied
from .store import settled

REPLY = "array<struct<head: string, head_type: string, relation: string, tail: string, tail_type: string>>"
ASK = "Facts of the document as a JSON array of objects with head, head_type, relation, tail, tail_type."


def prompt(title: Column, body: Column, types: list[str], relations: list[tuple[str, str, str]], rules: str = "") -> Column:
    """What a model is asked of a document: the schema, the rules of the domain, and the document under its title."""
    allowed = ["Types: " + ", ".join(types), *(f"({a}) -[{r}]-> ({b})" for a, r, b in relations)]
    head = "\n".join([ASK, *allowed, *([rules] if rules else [])])
    return F.concat(F.lit(head + "\n\n# "), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def extracted(docs: DataFrame, types: list[str], relations: list[tuple[str, str, str]], model: Model, rules: str = "", cache: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Triples (ord, h, r, t, origin, src) of documents (doc_ord, title, body), and (doc_ord, title) of those whose
    call failed, or whose reply isn't JSON of that form, null, or empty; an empty array is a reply, of no facts. Calls
    run several at once in each task; one that fails is a row of these, and is asked again by the next run.

    Documents of the same title and body are asked once. cache is a folder for replies, by a hash of the prompt: what is
    there isn't asked again, so a changed document or schema is; force asks for all. Without it replies are checkpointed. Facts outside
    the schema are left out: both types and the relation must stand together in relations, whatever their case; so are
    those without a head or tail. A null title or body counts as empty."""
    told = prompt(F.col("title"), F.col("body"), types, relations, rules)
    asked = docs.withColumn("key", F.sha2(told, 256))
    todo = asked.select("key", told.alias("told")).dropDuplicates(["key"])
    # the reply takes the prompt's place, so that a prompt goes to Python once and doesn't come back
    ask = lambda rows: replied(rows.select("key", F.col("told").alias("reply")), F.col("reply"), model, "reply", failed="why").where("why is null").select("key", "reply")
    replies = settled(ask(todo)) if cache is None else kept_in_cache(todo, cache, "key", ask, force)
    read = settled(asked.join(replies, "key", "left").select("doc_ord", "title", F.from_json("reply", REPLY).alias("facts")))
    rows = read.select("doc_ord", F.coalesce("title", F.lit("")).alias("src"), F.posexplode("facts").alias("pos", "x")).select("doc_ord", "src", "pos", "x.*")
    name = lambda c: F.upper(F.regexp_replace(F.trim(c), r"\s+", "_"))
    shape = F.concat_ws("\t", name("head_type"), name("relation"), name("tail_type"))
    declared = ["\t".join((a.upper(), r.upper(), b.upper())) for a, r, b in relations]
    fine = shape.isin(declared) & (F.trim("head") != "") & (F.trim("tail") != "")
    order = F.struct(F.lit(100).alias("rule"), "doc_ord", F.col("pos").cast("long").alias("pos"))  # after all rules
    triples = rows.where(fine).select(order.alias("ord"), F.trim("head").alias("h"), name("relation").alias("r"), F.trim("tail").alias("t"), F.lit("llm").alias("origin"), "src")
    return triples, read.where("facts is null").select("doc_ord", "title")
