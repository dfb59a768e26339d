"""What a model is given: quotes from the sources of evidence, context, mentions, and summaries of communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .store import settled, small

SUMMARY = "SUMMARY"


def found_documents(titles: DataFrame, docs: DataFrame) -> DataFrame:
    """(title, ord) of the document (ord, title) for each title: the one of that title, else the first by ord of those
    of which one title begins with the other. Both beginnings are equi joins on all beginnings of one side."""
    titles = settled(titles.select("title").distinct())
    exact = settled(titles.join(docs.groupBy("title").agg(F.min("ord").alias("ord")), "title"))
    rest = titles.join(exact.select("title"), "title", "left_anti")
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.substr(c, F.lit(1), i))
    longer = rest.select(F.col("title").alias("asked"), F.explode(starts(F.col("title"))).alias("title")).join(docs.where("title <> ''"), "title").select("asked", "ord")
    shorter = docs.where("title <> ''").select("ord", F.explode(starts(F.col("title"))).alias("asked")).join(rest.withColumnRenamed("title", "asked"), "asked").select("asked", "ord")
    near = longer.unionByName(shorter).groupBy(F.col("asked").alias("title")).agg(F.min("ord").alias("ord"))
    return exact.unionByName(near.where("title <> ''"))


def quotes(evidence: DataFrame, docs: DataFrame, labels: DataFrame, most: int = 6, sources: int = 2, least: int = 3) -> DataFrame:
    """(qid, place, term, title, quote) of evidence (qid, place, src, relation, dst, sources: array).

    For every row in its place, the label of dst and then that of src, without what stands in parentheses, is looked for
    in the first `sources` documents (ord, title, body); the first that has it is quoted around its first place. A term
    is quoted once in a question, and `most` terms at most."""
    named = small(settled(labels.select("node", T.label(F.col("node"), F.col("label")).alias("name"))))
    side = lambda c: F.trim(F.regexp_replace(F.coalesce(f"{c}_name", c), r"\(.*?\)", ""))
    rows = evidence.where(F.col("relation") != SUMMARY)
    for c in ("dst", "src"):
        rows = rows.join(named.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name")), c, "left")
    terms = rows.select("qid", "place", F.posexplode(F.array(side("dst"), side("src"))).alias("side", "term"), F.slice("sources", 1, sources).alias("sources"))
    terms = terms.where(F.char_length("term") >= least).select("qid", "place", "side", "term", F.posexplode("sources").alias("nth", "title"))
    terms = settled(terms)
    found = small(settled(found_documents(terms.select("title"), docs.select("ord", "title"))))
    at = F.instr(F.col("body"), F.col("term"))
    hits = terms.join(found, "title").join(docs.select("ord", "body"), "ord").where(F.contains("body", F.col("term")))
    hits = hits.select("qid", "term", F.struct("place", "side", "nth").alias("at"), "title", T.snippet(F.col("body"), at).alias("quote"))
    first = hits.groupBy("qid", "term").agg(F.min(F.struct("at", "title", "quote")).alias("x"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("x.at", "term"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("qid", "place", "term", "x.title", "x.quote")


def evidence_line(src: Column, relation: Column, dst: Column, hop: Column, sources: Column, form: str = "(%s) -[%s]-> (%s)   [%d hops, source: %s]") -> Column:
    """a fact as a line of the context; form is configuration."""
    return F.format_string(form, src, relation, dst, hop, F.array_join(sources, "; "))


def contexts(evidence: DataFrame, labels: DataFrame, quoted: DataFrame, before: DataFrame | None = None, heads: tuple[str, str] = ("Facts:", "Quotes:")) -> DataFrame:
    """E5: (qid, context): what was there before (qid, context), the lines of evidence in their order but for summaries,
    and the quotes. A question without such evidence keeps what was there before. All lines are there: evidence
    has a cap of its own."""
    named = small(settled(labels.select("node", T.label(F.col("node"), F.col("label")).alias("name"))))
    rows = evidence.where(F.col("relation") != SUMMARY)
    for c in ("src", "dst"):
        rows = rows.join(named.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name")), c, "left")
    line = evidence_line(F.coalesce("src_name", "src"), F.col("relation"), F.coalesce("dst_name", "dst"), F.col("hop"), F.col("sources"))
    in_order = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", x.alias("line")))), lambda y: y["line"]), "\n")
    lines = rows.groupBy("qid").agg(in_order(line).alias("lines"))
    cited = quoted.groupBy("qid").agg(in_order(F.concat(F.lit("- "), F.col("quote"), F.lit("   (source: "), F.col("title"), F.lit(")"))).alias("quotes"))
    out = lines.join(cited, "qid", "left")
    out = out.join(before, "qid", "full") if before is not None else out.withColumn("context", F.lit(None).cast("string"))
    had, some = F.coalesce("context", F.lit("")), F.col("lines").isNotNull()
    parts = [had, F.lit("\n"), F.lit(heads[0]), F.lit("\n"), F.col("lines"), F.coalesce(F.concat(F.lit("\n\n"), F.lit(heads[1]), F.lit("\n"), F.col("quotes")), F.lit(""))]
    return out.select("qid", F.when(some, F.regexp_replace(F.concat(*parts), r"(?U)^\s+|\s+$", "")).otherwise(had).alias("context"))


def mentioned(evidence: DataFrame, labels: DataFrame, answers: DataFrame, least: int = 2) -> DataFrame:
    """(qid, node): ends of a question's evidence that its answer (qid, answer) names, by id or by a label of `least`
    characters or more; an empty label names nothing."""
    ends = evidence.select("qid", F.explode(F.array("src", "dst")).alias("node")).distinct()
    rows = ends.join(small(settled(labels.select("node", "label"))), "node", "left").join(answers.select("qid", "answer"), "qid")
    by_label = F.coalesce((F.char_length("label") >= least) & F.contains("answer", F.col("label")), F.lit(False))
    return rows.where(F.contains("answer", F.col("node")) | by_label).select("qid", "node")


def community_list(membership: DataFrame, degrees: DataFrame, least: int = 3, most: int = 40) -> DataFrame:
    """(id, size, members) of communities (node, community) of `least` nodes or more: ids from 0 by size, larger
    first and then by name; the `most` members of the highest degree, and the size of all."""
    sized = membership.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    order = [F.desc("size"), F.col("community")]
    parts = settled(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = parts.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    ids = parts.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(offset), "part").select("community", "size", (F.col("offset") + F.col("rn") - 1).alias("id"))
    rn = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    top = membership.join(ids.select("community"), "community", "left_semi").join(degrees, "node").withColumn("rn", rn).where(F.col("rn") <= most)
    listed = top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "node"))), lambda x: x["node"]).alias("members"))
    return ids.join(listed, "community").select("id", "size", "members", "community")


def summary_inputs(listed: DataFrame, facts: DataFrame, most: int = 60, members: int = 30) -> DataFrame:
    """(id, input): up to `most` inner facts (community, place, src, relation, dst) of each community as lines, or, of
    one without any, its first members."""
    line = F.concat(F.lit("("), F.col("src"), F.lit(") -["), F.col("relation"), F.lit("]-> ("), F.col("dst"), F.lit(")"))
    own = facts.where(F.col("place") <= most).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return listed.join(own, "community", "left").select("id", F.coalesce("lines", F.array_join(F.slice("members", 1, members), "\n")).alias("input"))


def community_title(reply: Column, number: Column, mark: str = r"제목:\s*(.+)", default: str = "Community ") -> Column:
    """the title that a summary states behind its mark (configuration), or a default with its number."""
    found = F.trim(F.regexp_extract(reply, mark, 1))
    return F.when(found != "", found).otherwise(F.concat(F.lit(default), number.cast("string")))


def global_evidence(questions: DataFrame, communities: DataFrame, least: int = 4, most: int = 400) -> DataFrame:
    """G14, first part: for each global question (qid) a SUMMARY row (qid, src, relation, dst, hop, place) of every
    community (id, size, title, summary) of `least` nodes or more, its summary on one line and cut. Communities are a
    table of summaries, small next to the graph; it is broadcast if it is."""
    rows = communities.where(F.col("size") >= least).select(F.concat(F.lit("Community #"), "id", F.lit(" "), "title").alias("src"), F.lit(SUMMARY).alias("relation"), F.substring(F.regexp_replace("summary", "\n", " "), 1, most).alias("dst"), F.lit(0).alias("hop"), F.col("id").alias("place"))
    return questions.select("qid").join(small(settled(rows)))


def global_prompts(evidence: DataFrame) -> DataFrame:
    """G14, second part: (qid, parts): the summaries of each question in order, to be reduced by a model."""
    rows = evidence.where(F.col("relation") == SUMMARY)
    part = F.struct("place", F.concat("src", F.lit("\n"), "dst").alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda y: y["x"]), "\n\n").alias("parts"))


def with_summaries(evidence: DataFrame, summaries: DataFrame) -> DataFrame:
    """Evidence and summary rows as one table."""
    return evidence.unionByName(summaries, allowMissingColumns=True)
