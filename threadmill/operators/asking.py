"""Questions in batches from route to result. A model's replies and each walk are checkpointed, so that no question is
asked twice and a lost executor repeats no call that is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from . import answers, context, paths
from .graph import FACT
from .store import settled

Walk = Callable[[DataFrame, int], DataFrame]


def deepened(questions: DataFrame, seeds: DataFrame, walk: Walk, first: int = 2, most: int = 3, again: int = 1) -> tuple[DataFrame, DataFrame]:
    """The evidence that walk finds for questions (qid) from their seeds (qid, node, ...), and (qid, depth, next).

    All are walked `first` hops; those without evidence once more and one hop deeper, up to `again` times and `most` hops.
    depth is the last number of hops, 0 for a question without seeds. next is build, or global where there are seeds
    but no evidence: without seeds nothing is known, and summaries would only mislead. Each time one plan walks all
    questions that are still open. Rows that repeat a qid are one question."""
    asked = questions.select("qid").distinct()
    left = settled(asked.join(seeds.select("qid").distinct(), "qid", "left_semi"))
    found, depths = None, asked.join(left, "qid", "left_anti").select("qid", F.lit(0).alias("depth"), F.lit("build").alias("next"))
    for n in range(again + 1):
        hops = min(most, first + n)
        got = settled(walk(seeds.join(left, "qid", "left_semi"), hops))
        found = got if found is None else found.unionByName(got)
        done = got.select("qid").distinct()
        depths = depths.unionByName(left.join(done, "qid", "left_semi").select("qid", F.lit(hops).alias("depth"), F.lit("build").alias("next")))
        left = settled(left.join(done, "qid", "left_anti"))
        if left.isEmpty():
            break
    return found, depths.unionByName(left.select("qid", F.lit(hops).alias("depth"), F.lit("global").alias("next")))


def ask(questions: DataFrame, model: answers.Model, seeds: Callable[[DataFrame], DataFrame], walk: Walk, docs: DataFrame, labels: DataFrame, communities: DataFrame, first: int = 2, most: int = 3, again: int = 1) -> DataFrame:
    """(qid, question, route, depth, seeds, answer, reply, path, all_path, evidence, sources, flags) of questions (qid,
    question), qid being unique.

    seeds gives (qid, node, place) of questions; walk gives (qid, place, src, relation, dst, hop, sources) from seeds
    and a number of hops. docs: (ord, title, body). labels: (node, label). communities: (id, size, title, summary). A question that the model routes as global, or whose seeds lead to
    nothing, is given the model's reduction of all summaries; the others their evidence with quotes. The path is what
    leads from seeds to nodes that the answer names, else all_path, which is all evidence. reply is the structured one
    (D14), null where the model gave none that can be read or where the answer was rewritten because of numbers that its
    context lacks; these are the flags. A null question has no seeds."""
    routed = settled(answers.routed(questions, model))
    here = routed.where("route <> 'global'")
    starts = settled(seeds(here.select("qid", "question")))
    evidence, depths = deepened(here, starts, walk, first, most, again)
    depths = settled(depths.unionByName(routed.where("route = 'global'").select("qid", F.lit(0).alias("depth"), F.lit("global").alias("next"))))

    wide = routed.join(depths.where("next = 'global'").select("qid"), "qid", "left_semi")
    parts = context.global_prompts(context.global_evidence(wide, communities)).join(wide.select("qid", "question"), "qid")
    reduced = settled(answers.replied(parts, F.concat(F.lit("One overview of these for the question, from them alone: "), F.coalesce("question", F.lit("")), F.lit("\n\n"), F.col("parts")), model, "overview"))
    before = reduced.select("qid", F.concat(F.lit("Overview:\n"), F.trim("overview")).alias("context"))

    given = context.contexts(evidence, labels, context.quotes(evidence, docs, labels), before)
    rows = routed.join(depths.select("qid", "depth"), "qid").join(given, "qid", "left")
    said = settled(answers.verified(settled(answers.synthesised(rows, model, structured=True)), model))
    goals = context.mentioned(evidence, labels, said)
    ways = paths.key_paths(evidence, starts.select("qid", "node"), goals)
    ways = evidence.select("qid", "place", "src", "relation", "dst").join(ways, ["qid", "src", "relation", "dst"], "left_semi")
    out = answers.assembled(said, evidence, ways)
    in_order = lambda *what: F.array_sort(F.collect_list(F.struct("place", *what)))
    named = starts.groupBy("qid").agg(F.transform(in_order("node"), lambda x: x["node"]).alias("seeds"))
    shown = evidence.groupBy("qid").agg(in_order(*FACT, "hop", "sources").alias("evidence"))
    out = out.join(named, "qid", "left").join(shown, "qid", "left")
    out = out.withColumns({"seeds": F.coalesce("seeds", F.array().cast("array<string>")), "evidence": F.coalesce("evidence", F.array().cast(shown.schema["evidence"].dataType)), "reply": F.when(F.size("flags") == 0, F.col("reply"))})
    return out.select("qid", "question", "route", "depth", "seeds", "answer", "reply", "path", "all_path", "evidence", "sources", "flags")
