"""Scoring of evidence against expected paths, failure layers, reports and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import similarity, text
from . import candidates
from .graph import FACT
from .store import settled, small

#: Pairs of nodes of the same digits by node, where all are compared.
FEW = 16


def path_scores(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, recall, precision, f1, missing) of expected and evidence facts (qid, src, relation, dst). Precision is the
    expected facts found, over all evidence. Null without expectation comes from the caller's left join."""
    hit = expected.join(evidence.select("qid", *FACT).distinct().withColumn("hit", F.lit(1)), ["qid", *FACT], "left")
    n = hit.groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    rows = evidence.groupBy("qid").agg(F.count("*").alias("rows"))
    out = n.join(rows, "qid", "left").select("qid", (F.col("found") / F.col("n")).alias("recall"), F.when(F.col("rows") > 0, F.col("found") / F.col("rows")).otherwise(0.0).alias("precision"), (F.col("n") - F.col("found")).alias("missing"))
    r, p = F.col("recall"), F.col("precision")
    return out.withColumn("f1", F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0))


def cap_scores(expected: DataFrame, placed: DataFrame, caps: list[int]) -> DataFrame:
    """(qid, n, cap, recall, precision, f1) of expected facts (qid, src, relation, dst), n of them, for every
    cap on evidence (qid, src, relation, dst, place), whose facts are distinct. Facts meet once: a cap only says which
    places count."""
    placed = placed.select("qid", *FACT, "place")
    within = lambda c: F.count_if(F.col("place") <= c)
    found = expected.select("qid", *FACT).join(placed, ["qid", *FACT], "left").groupBy("qid").agg(F.count("*").alias("n"), *(within(c).alias(f"found_{c}") for c in caps))
    rows = placed.groupBy("qid").agg(*(within(c).alias(f"rows_{c}") for c in caps))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("cap"), F.col(f"found_{c}").alias("found"), F.coalesce(f"rows_{c}", F.lit(0)).alias("rows")) for c in caps)))
    out = found.join(rows, "qid", "left").select("qid", "n", each.alias("x")).select("qid", "n", "x.*")
    r, p = F.col("recall"), F.col("precision")
    out = out.select("qid", "n", "cap", (F.col("found") / F.col("n")).alias("recall"), F.when(F.col("rows") > 0, F.col("found") / F.col("rows")).otherwise(0.0).alias("precision"))
    return out.withColumn("f1", F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0))


def alike_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node, other) of the distinct nodes (node) of left and right that match: equal, or of the same digits and alike
    by their best window or by their words. Nodes of the same digits are compared, all of them where that is FEW times
    their number at most; of more only those that share enough of their rarest parts."""
    sides = [settled(x.select("node").where("node is not null").distinct().select(F.col("node").alias("id"), F.col("node").alias("name"), text.digit_key(F.col("node")).alias("digits"))) for x in (left, right)]
    counts = [x.groupBy("digits").agg(F.count("*").alias(n)) for x, n in zip(sides, ("n_left", "n_right"))]
    n, m = F.col("n_left"), F.col("n_right")
    blocks = settled(counts[0].join(counts[1], "digits").select("digits", (n * m <= FEW * (n + m)).alias("few")))
    every = sides[0].join(blocks.where("few"), "digits").select("digits", F.col("name").alias("left_name"))
    pairs = every.join(sides[1].select("digits", F.col("name").alias("right_name")), "digits").where("left_name <> right_name").select("left_name", "right_name")
    large = blocks.where("not few").select("digits")
    if not large.isEmpty():
        sides_of = [settled(x.join(small(large), "digits", "left_semi")) for x in sides]
        alike = candidates.like_windows(*sides_of, similarity.PARTIAL, ["digits"]).select("left_name", "right_name")
        pairs = pairs.unionByName(alike.unionByName(candidates.like_words(*sides_of, similarity.TOKENS, ["digits"]).select("left_name", "right_name")).distinct())
    pairs = settled(pairs.withColumn("same", similarity.udfs()["node_match"]("left_name", "right_name")))
    equal = sides[0].select(F.col("name").alias("node"), F.col("name").alias("other")).join(sides[1].select(F.col("name").alias("other")), "other", "left_semi")
    return pairs.where("same").select(F.col("left_name").alias("node"), F.col("right_name").alias("other")).unionByName(equal).distinct()


def matched(expected: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Expected facts (keys, src, relation, dst) with hit: some found fact of the same keys and relation matches both
    ends, equal or alike as node_match has it.

    Equal facts meet by a join. For the others, nodes are matched first, each distinct one once; then a fact meets the
    found ones by its keys, its relation and both of the nodes that match: no pair shares a relation alone."""
    there = [*keys, *FACT]
    equal = expected.select(*there).distinct().join(found.select(*there).distinct(), there, "left_semi")
    rest = settled(expected.select(*there).distinct().join(equal, there, "left_anti"))
    facts = settled(found.select(*there).distinct())
    ends = lambda rows: rows.select(F.explode(F.array("src", "dst")).alias("node"))
    same = settled(alike_nodes(ends(rest), ends(facts)))
    pairs = rest.join(same.select(F.col("node").alias("src"), F.col("other").alias("found_src")), "src").join(same.select(F.col("node").alias("dst"), F.col("other").alias("found_dst")), "dst")
    there_too = facts.select(*keys, "relation", F.col("src").alias("found_src"), F.col("dst").alias("found_dst"))
    alike = pairs.join(there_too, [*keys, "relation", "found_src", "found_dst"], "left_semi").select(*there).distinct()
    return expected.join(equal.unionByName(alike).withColumn("hit", F.lit(True)), there, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def fuzzy_path_scores(questions: DataFrame, expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, recall, precision, f1, n_missing) of questions (qid). Recall is the share of expected facts matched,
    precision the matched ones over all evidence rows; all null where nothing is expected."""
    n = matched(expected, evidence).groupBy("qid").agg(F.count("*").alias("n"), F.count_if("hit").alias("found"))
    rows = evidence.groupBy("qid").agg(F.count("*").alias("rows"))
    out = questions.select("qid").join(n, "qid", "left").join(rows, "qid", "left")
    recall = F.col("found") / F.col("n")
    precision = F.when(F.col("n").isNotNull(), F.when(F.col("rows") > 0, F.col("found") / F.col("rows")).otherwise(0.0))
    out = out.select("qid", recall.alias("recall"), precision.alias("precision"), (F.col("n") - F.col("found")).alias("n_missing"))
    r, p = F.col("recall"), F.col("precision")
    return out.withColumn("f1", F.when(r + p > 0, 2 * r * p / (r + p)).when(r.isNotNull(), 0.0))


def missing_facts(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """The expected facts that no evidence matches."""
    return matched(expected, evidence).where("not hit").drop("hit")


def layers(questions: DataFrame, expected: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, layer) of questions that something is expected of: index if an expected fact matches none of the
    graph's, traversal if one matches no evidence, else generation."""
    qid_of = expected.select("qid", *FACT)
    indexed = matched(qid_of.select(*FACT).distinct(), edges, keys=()).where("hit").drop("hit")
    known = qid_of.join(indexed.withColumn("known", F.lit(True)), list(FACT), "left").groupBy("qid").agg(F.every(F.coalesce("known", F.lit(False))).alias("all_indexed"))
    return failure_layers(fuzzy_path_scores(questions, expected, evidence).where("recall is not null"), known)


def failures_by_layer(layered: DataFrame, order: tuple[str, ...] = ("index", "traversal", "generation"), per_row: int = 1000) -> DataFrame:
    """(place, part, layer, n, ids): ids of failed questions by layer, in order, layers in a fixed order with empty
    ones too. A row has per_row ids at most: a layer of more has several rows, part by part, and n of all in each."""
    names = layered.sparkSession.createDataFrame(list(enumerate(order)), "place int, layer string")
    ranges = settled(layered.select("layer", "qid").repartitionByRange("layer", "qid").withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("layer", "range").agg(F.count("*").alias("c"))
    before = Window.partitionBy("layer").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("layer")))
    rn = F.row_number().over(Window.partitionBy("layer", "range").orderBy("qid")) - 1
    placed = ranges.withColumn("rn", rn).join(F.broadcast(counts), ["layer", "range"]).withColumn("part", F.floor((F.col("before") + F.col("rn")) / per_row).cast("int"))
    found = placed.groupBy("layer", "part").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("qid")).alias("ids"))
    return names.join(found, "layer", "left").select("place", F.coalesce("part", F.lit(0)).alias("part"), "layer", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.array()).alias("ids"))


def failure_layers(scores: DataFrame, indexed: DataFrame) -> DataFrame:
    """(qid, layer): index if an expected fact isn't in the graph, else traversal if recall is short, else generation."""
    return scores.join(indexed, "qid", "left").select("qid", F.when(~F.coalesce("all_indexed", F.lit(False)), "index").when(F.col("recall") < 1, "traversal").otherwise("generation").alias("layer"))


def scoreboard(rows: DataFrame, group: str, ok: str, means: list[str]) -> DataFrame:
    """Count, successes and means (nulls aside) by group, and a total whose group is null."""
    return rows.rollup(group).agg(F.count("*").alias("n"), F.sum(F.col(ok).cast("int")).alias("n_ok"), *(F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The value at place n // 2 from 0. Values are counted, counts added up by range, and only the range that holds the
    place is looked into: no task sees all values."""
    counts = rows.groupBy(value).agg(F.count("*").alias("c"))
    parts = settled(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = parts.groupBy("part").agg(F.sum("c").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    total = ranges.agg(F.floor(F.sum("n") / 2).alias("place"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy(value))
    at = parts.withColumn("upto", upto).join(F.broadcast(ranges), "part").join(F.broadcast(total))
    return at.where(F.col("before") + F.col("upto") > F.col("place")).agg(F.min(value).alias("median"))


def probe_counts(rows: DataFrame, routes: tuple[str, ...] = ("local", "path", "global")) -> DataFrame:
    """(route, n, n_no_seeds, n_refused) of probe rows (route, seeds, refused), a row for each route."""
    names = rows.sparkSession.createDataFrame([(r,) for r in routes], "route string")
    counts = rows.groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.size("seeds") == 0).alias("n_no_seeds"), F.count_if("refused").alias("n_refused"))
    return names.join(counts, "route", "left").select("route", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_no_seeds", "n_refused")))
