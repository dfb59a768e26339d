"""Stages of answering in batches of questions. A model is a function from prompts to replies; each stage calls it for
the rows that need it, in tasks, so that many questions are one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from .retrieve import bm25
from .store import settled, ship

Model = Callable[[list[str]], list[str]]
REFUSAL = "The sources don't say."
#: Calls that a task has open at once, and how often a prompt is tried.
WORKERS, TRIES = 8, 2
#: Prompts that a task holds as texts at once.
ROWS_AT_ONCE = 64
#: What a structured reply has.
REPLY = "struct<verdict: string, steps: array<string>, details: string, unknown: string>"
ASK_REPLY = "\n\nReply as a JSON object with verdict, steps (an array), details and unknown."


def _told(model: Model, prompt: str, tries: int) -> tuple[str | None, str | None]:
    """A reply, or what went wrong the last time."""
    wrong = None
    for _ in range(max(1, tries)):
        try:
            return model([prompt])[0], None
        except Exception as e:  # a model may fail in any way
            wrong = f"{type(e).__name__}: {e}"
    return None, wrong


def _asked(batches: Iterator[pa.RecordBatch], places: tuple[int, int], model: Model, loud: bool, workers: int, tries: int) -> Iterator[pa.RecordBatch]:
    """Rows with the reply in place of the prompt, the first of two places, and why there is none in the second. The other
    columns stay as they came, and prompts are texts a few at a time."""
    with ThreadPoolExecutor(workers) as pool:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(lo, ROWS_AT_ONCE)
                got = list(pool.map(lambda p: (None, None) if p is None else _told(model, p, tries), b.column(places[0]).to_pylist()))
                replies, wrong = zip(*got)
                if loud and any(wrong):
                    raise RuntimeError(next(x for x in wrong if x))
                columns = b.columns
                columns[places[0]], columns[places[1]] = pa.array(replies, pa.string()), pa.array(wrong, pa.string())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)


def replied(rows: DataFrame, prompt: Column, model: Model, name: str, failed: str | None = None, workers: int = WORKERS, tries: int = TRIES) -> DataFrame:
    """rows with a column `name`: the model's reply to the prompt; a null prompt isn't sent and stays null.

    Each task has at most `workers` calls open, of one prompt each, and tries each prompt `tries` times; rows keep their
    order. With `failed`, a prompt that fails is a null reply and a column of that name tells why; else the job fails."""
    ship(rows.sparkSession)
    why = failed or "why_no_reply"
    asked = rows.withColumn(name, prompt.cast("string")).withColumn(why, F.lit(None).cast("string"))

    places = asked.columns.index(name), asked.columns.index(why)
    schema = StructType([f if f.name not in (name, why) else StructField(f.name, StringType()) for f in asked.schema])
    out = asked.mapInArrow(partial(_asked, places=places, model=model, loud=failed is None, workers=workers, tries=tries), schema)
    return out if failed else out.drop(why)


def routed(questions: DataFrame, model: Model) -> DataFrame:
    """Questions (qid, question) with route: global, path or local."""
    said = replied(questions, F.concat(F.lit("Is this about one thing (local), a way between things (path) or all (global)?\n"), "question"), model, "route")
    return said.withColumn("route", T.route(F.lower(F.coalesce("route", F.lit("")))))


def basic_answers(docs: DataFrame, questions: DataFrame, model: Model, top: int = 3, most: int = 1500) -> DataFrame:
    """(qid, docs, answer) from the best documents (doc, terms, text) for questions (qid, terms, question), `most`
    characters of each as context."""
    best = bm25(docs.select("doc", "terms"), questions.select("qid", "terms"), top)
    texts = best.join(docs.select("doc", F.substr("text", F.lit(1), F.lit(most)).alias("part")), "doc")
    listed = F.array_sort(F.collect_list(F.struct("place", "doc", "part")))
    context = texts.groupBy("qid").agg(listed.alias("x")).select("qid", F.col("x.doc").alias("docs"), F.array_join("x.part", "\n\n").alias("context"))
    return synthesised(questions.select("qid", "question").join(context, "qid", "left"), model).select("qid", "docs", "answer")


def synthesised(rows: DataFrame, model: Model, structured: bool = False) -> DataFrame:
    """Rows (question, context) with answer. A context of white space alone is none: the answer is the refusal, and
    the model isn't asked. structured adds reply (D14), asked for as JSON, and the answer is its text (F15); where a call
    fails or its reply can't be read, the model is asked once more for plain text, and reply is null."""
    has = F.coalesce(F.rlike("context", F.lit(r"(?U)\S")), F.lit(False))
    told = F.when(has, F.concat("context", F.lit("\n\n"), F.coalesce("question", F.lit(""))))
    if not structured:
        said = replied(rows, told, model, "answer")
        return said.withColumn("answer", F.coalesce("answer", F.lit(REFUSAL)))
    said = replied(rows, F.concat(told, F.lit(ASK_REPLY)), model, "said", failed="why_no_reply").withColumn("reply", F.from_json("said", REPLY))
    some = F.coalesce(F.col("reply.verdict"), F.col("reply.details"), F.col("reply.unknown"), F.array_join("reply.steps", "")).isNotNull()
    said = settled(said.withColumn("reply", F.when(some, F.col("reply"))).drop("said", "why_no_reply"))
    plain = replied(said, F.when(F.col("reply").isNull(), told), model, "answer")
    shown = T.render(F.col("reply.verdict"), F.coalesce("reply.steps", F.array().cast("array<string>")), F.col("reply.details"), F.col("reply.unknown"))
    return plain.withColumn("answer", F.coalesce(F.when(F.col("reply").isNotNull(), shown), F.trim("answer"), F.lit(REFUSAL)))


def verified(rows: DataFrame, model: Model, units: str = "year|month|day|%") -> DataFrame:
    """Rows (answer, context) whose numbers the context lacks are rewritten once; flags lists these numbers, and
    unsupported what is left of such in the new answer."""
    bad = T.unsupported_numbers(F.col("answer"), F.coalesce("context", F.lit("")), units)
    ask = F.when(F.size(bad) > 0, F.concat(F.lit("Not in the sources: "), F.array_join(bad, ", "), F.lit("\n"), "context", F.lit("\n\n"), "answer"))
    again = replied(rows.withColumn("flags", bad), ask, model, "rewritten").withColumn("answer", F.coalesce("rewritten", "answer")).drop("rewritten")
    return again.withColumn("unsupported", bad)


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (question, expected, answer) with ok: the judge's reply starts with O, whatever its case, white space
    aside."""
    said = replied(rows, F.concat_ws("\n", "question", "expected", "answer"), model, "ok")
    return said.withColumn("ok", F.coalesce(F.startswith(F.upper(F.regexp_replace("ok", r"(?U)^\s+", "")), F.lit("O")), F.lit(False)))


def assembled(answers: DataFrame, evidence: DataFrame, paths: DataFrame) -> DataFrame:
    """Answers (qid, ...) with path, the facts of its key paths or else of all its evidence (qid, place, src,
    relation, dst, sources), all_path, which is all of its evidence, and the distinct sources, sorted."""
    order = lambda df: df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "src", "relation", "dst"))), lambda x: F.concat_ws(" ", x["src"], x["relation"], x["dst"])).alias("path"))
    sources = evidence.select("qid", F.explode("sources").alias("s")).groupBy("qid").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    none = F.array().cast("array<string>")
    out = answers.join(order(paths), "qid", "left").join(order(evidence).withColumnRenamed("path", "walked"), "qid", "left").join(sources, "qid", "left")
    return out.withColumns({"path": F.coalesce("path", "walked", none), "all_path": F.coalesce("walked", none), "sources": F.coalesce("sources", none)}).drop("walked")
