"""G1: from questions to the nodes they name, in stages from codes over names to loose matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity
from . import candidates
from .retrieve import expand_words
from .store import settled, small

CODE = r"(?i)([A-H]\s*-\s*\d{1,2}(?:-\d)?)"
#: Distinct characters of a long name that a question must have; how alike the best name must be where there is no other.
COVERAGE, LOOSE = 0.75, 85.0


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def _ranked(rows: DataFrame, size: Column, stage: int, most: int | None = None) -> DataFrame:
    """(qid, node, stage, rank): longer names first, of equal ones the last by name."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(size.desc(), F.desc("node"))))
    return (out.where(F.col("rank") <= most) if most else out).select("qid", "node", F.lit(stage).alias("stage"), "rank")


def best_windows(questions: DataFrame, nodes: DataFrame, least: float = LOOSE) -> DataFrame:
    """(qid, node, stage, rank): of the nodes (node, ord) that are like some window of a question (id, name) by `least`
    or more, the one most alike, the first by ord of several.

    Pairs come from the rarest 2-grams that alike strings must share, with the highest ratio that what they share
    allows. The pair of the highest bound is compared first; then only those that can still beat it."""
    score = similarity.udfs()["partial_ratio"]
    pairs = candidates.like_windows(questions, nodes.select(F.col("node").alias("id"), F.col("node").alias("name")), least)
    pairs = settled(pairs.join(nodes.select(F.col("node").alias("right_id"), "ord"), "right_id"))
    first = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("bound"), "ord"))
    high = pairs.withColumn("rn", first).where("rn = 1").select("left_id", score("left_name", "right_name").alias("high"))
    rest = pairs.join(settled(high), "left_id").where(F.col("bound") >= F.greatest("high", F.lit(least)) - 1e-9)
    found = settled(rest.select("left_id", "right_id", "ord", score("left_name", "right_name").alias("score"))).where(F.col("score") >= least)
    best = found.groupBy(F.col("left_id").alias("qid")).agg(F.max_by("right_id", F.struct("score", -F.col("ord"))).alias("node"))
    return best.select("qid", "node", F.lit(4).alias("stage"), F.lit(1).alias("rank"))


def link_entities(questions: DataFrame, nodes: DataFrame, blocked: DataFrame, vocabulary: list[tuple[str, str]] = (), code: str = CODE, most: int = 5, loose: float | None = LOOSE) -> DataFrame:
    """(qid, node, stage, place): the nodes (node, label, ord) that questions (qid, question) name, `most` at most.

    In this order: codes as they stand in the question (white space and case aside); nodes whose label (two characters
    or more), id (three) or id without spaces (six) the question contains, longer ids first; two nodes of eight
    characters or more of whose distinct characters the question has three in four. Only for questions without any:
    the node, blocked ones included, with the best partial ratio if that is `loose` or more, first by ord (None: left
    out). Only for those still without any: two nodes of four distinct characters or more that the question has all.
    Blocked nodes are else passed over. Official words of the vocabulary are added to the question first.

    Names are found by an automaton that reads each question once for a set of them, shares of characters by bits in the
    order of the names; codes and loose matches are equi joins, on codes and rarest 2-grams."""
    q = questions.select("qid", expand_words(F.col("question"), list(vocabulary)).alias("q")).withColumn("bare", _bare(F.col("q")))
    q = settled(q.withColumn("chars", candidates.characters(F.col("q"))))
    nodes = settled(nodes.select("node", F.coalesce("label", F.lit("")).alias("label"), "ord"))
    free = settled(nodes.join(small(settled(blocked.select("node").distinct())), "node", "left_anti"))

    said = q.select("qid", F.posexplode(F.regexp_extract_all("q", F.lit(code), F.lit(1))).alias("pos", "said"))
    said = said.select("qid", "pos", F.upper(_bare(F.col("said"))).alias("node")).join(nodes.select("node"), "node")
    codes = settled(said.groupBy("qid", "node").agg(F.min("pos").alias("rank")).select("qid", "node", F.lit(1).alias("stage"), "rank"))

    label = free.select("node", "label")
    named = candidates.containing(q, ["qid"], "q", label, "label", 2).join(label, "label").select("qid", "node")
    named = named.unionByName(candidates.containing(q, ["qid"], "q", free, "node", 3))
    long = free.where(F.char_length("node") >= 6).select("node", _bare(F.col("node")).alias("bare_name"))
    named = named.unionByName(candidates.containing(q, ["qid"], "bare", long, "bare_name").join(long, "bare_name").select("qid", "node"))
    named = settled(_ranked(named.distinct().join(codes, ["qid", "node"], "left_anti"), F.char_length("node"), 2))

    sets = settled(free.select("node", candidates.characters(F.col("node")).alias("items"), F.char_length(_bare(F.col("node"))).alias("size")))
    seeds = settled(codes.unionByName(named))
    had = seeds.groupBy("qid").agg(F.collect_set("node").alias("had"))
    long = sets.where("size >= 8").select("node", "items", F.ceil(F.size("items") * COVERAGE).alias("need"), F.char_length("node").alias("size"))
    extra = candidates.first_covered(q.select("qid", "chars").join(had, "qid", "left"), long, 2)
    seeds = settled(seeds.unionByName(_ranked(extra, F.char_length("node"), 3, 2)))

    if loose is not None:
        left = q.join(seeds.select("qid").distinct(), "qid", "left_anti").select(F.col("qid").alias("id"), F.col("q").alias("name"))
        seeds = settled(seeds.unionByName(best_windows(left, nodes, loose)))

    left = q.join(seeds.select("qid").distinct(), "qid", "left_anti").select("qid", "chars", F.array().cast("array<string>").alias("had"))
    whole = sets.where(F.size("items") >= 4).select("node", "items", F.size("items").alias("need"), F.size("items").alias("size"))
    last = candidates.first_covered(left, whole, 2).join(sets.select("node", "items"), "node")
    seeds = seeds.unionByName(_ranked(last, F.size("items"), 5, 2))

    first = seeds.groupBy("qid", "node").agg(F.min(F.struct("stage", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("qid", "node", "at.stage", "place")
