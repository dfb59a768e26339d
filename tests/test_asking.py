import json

from pyspark.sql import functions as F
from tests import compare
from threadmill.operators import answers, asking, extraction, graph
from threadmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_closed_schema_and_cache(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "a", "x"), (4, None, "bad"), (5, "e", "")], "doc_ord int, title string, body string")
    fact = {"head": " F-5 ", "head_type": "visa", "relation": "converts to", "tail": "E-9", "tail_type": "VISA"}
    replies = {"x": json.dumps([fact, {**fact, "relation": "OTHER"}, {**fact, "tail_type": "Fee"}, {**fact, "tail": " "}]), "": "[]", "bad": "I can't"}
    log = tmp_path / "asked"
    log.mkdir()

    def model(prompts):
        for p in prompts:
            (log / f"{abs(hash(p))}").touch(exist_ok=False)  # a prompt is asked once
        assert all("(Visa) -[CONVERTS_TO]-> (Visa)" in p and "no fees" in p for p in prompts)
        return [replies[p.rsplit("\n", 1)[1]] for p in prompts]

    for _ in range(2):
        got, failed = extraction.extracted(docs, ["Visa"], [("Visa", "CONVERTS_TO", "Visa")], model, "no fees", str(tmp_path / "cache"))
        assert sorted((r.ord.doc_ord, r.h, r.r, r.t, r.origin, r.src) for r in got.collect()) == [(i, "F-5", "CONVERTS_TO", "E-9", "llm", "a") for i in (1, 3)]
        assert [r.doc_ord for r in failed.collect()] == [4]
    none, bad = extraction.extracted(docs.where("false"), ["Visa"], [("Visa", "CONVERTS_TO", "Visa")], model)
    assert none.collect() == [] and bad.collect() == []


def test_ask_in_batches(spark):
    edges = spark.createDataFrame([("A-1", "NEEDS", "paper"), ("paper", "FROM", "office"), ("far", "NEEDS", "middle"), ("middle", "NEEDS", "end"), ("end", "AT", "goal")], "src string, relation string, dst string")
    questions = spark.createDataFrame([(1, "A-1 what paper"), (2, "what of far"), (3, "nothing known"), (4, "everything?"), (5, "lonely"), (6, None)], "qid int, question string")
    docs = spark.createDataFrame([(1, "guide", "the paper takes 30 days")], "ord int, title string, body string")
    groups = spark.createDataFrame([(0, 5, "papers", "all about\npapers"), (1, 3, "tiny", "left out")], "id int, size int, title string, summary string")
    labels = spark.createDataFrame([("A-1", "first")], "node string, label string")
    closed = spark.createDataFrame([], "node string")
    told = []

    def seeds(qs):
        told.append(sorted(r.qid for r in qs.collect()))
        named = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(spark.createDataFrame([("lonely",)], "node string")).distinct()
        return qs.join(named.where("node in ('A-1', 'far', 'lonely')"), F.contains("question", F.col("node"))).select("qid", "node", F.lit(0).alias("place"))

    def walk(starts, hops):
        rows = graph.walk(edges, starts, closed, hops).where("src = 'A-1' or dst = 'paper' or relation = 'AT'")
        return rows.select("qid", F.lit(1).alias("place"), *graph.FACT, "hop", F.array(F.lit("guide")).alias("sources"))

    def model(prompts):
        out = []
        for p in prompts:
            if p.startswith("Is this about"):
                out.append("global" if "everything" in p else "local")
            elif p.startswith("One overview"):
                out.append(" overview of " + ("papers" if "all about papers" in p and "left out" not in p else "wrong"))
            elif p.startswith("Overview:"):
                out.append(p.split("\n")[1])
            elif p.startswith("Not in the sources"):
                out.append("paper within 30 days")
            elif p.endswith(answers.ASK_REPLY) and "takes 30 days" not in p:
                out.append(json.dumps({"verdict": "goal", "steps": ["end"]}))
            else:
                out.append("paper within 99 days" if "takes 30 days" in p else "asked in vain")
        return out

    got = {r.qid: r for r in asking.ask(questions, model, seeds, walk, docs, labels, groups).collect()}
    assert told == [[1, 2, 3, 5, 6]] and len(got) == 6
    assert {q: (r.route, r.depth) for q, r in got.items()} == {1: ("local", 2), 2: ("local", 3), 3: ("local", 0), 4: ("global", 0), 5: ("local", 3), 6: ("local", 0)}
    assert got[1].answer == "paper within 30 days" and got[1].path == ["A-1 NEEDS paper"] and got[1].sources == ["guide"]
    assert got[1].flags == ["99 day"] and got[1].reply is None and got[1].seeds == ["A-1"] and len(got[1].all_path) == len(got[1].evidence) == 1
    assert got[2].answer == "goal\n\n1. end" and got[2].path == ["end AT goal"] and (got[2].reply.verdict, got[2].reply.steps, got[2].flags) == ("goal", ["end"], [])
    assert [(x.place, x.src, x.relation, x.dst, x.hop, x.sources) for x in got[2].evidence] == [(1, "end", "AT", "goal", 3, ["guide"])]
    assert got[3].seeds == got[3].evidence == got[3].all_path == [] and got[4].reply is None
    assert got[3].answer == got[6].answer == answers.REFUSAL and got[3].path == []
    assert got[4].answer == got[5].answer == "overview of papers" and got[5].sources == []


def test_depths_without_questions(spark):
    rows = spark.createDataFrame([], "qid int, node string")
    found, depths = asking.deepened(rows, rows, lambda s, hops: s)
    assert found.collect() == [] and depths.collect() == []


def test_new_queries_as_sql(spark):
    for name in ("model_triples", "model_failures", "walk_depths"):
        compare.assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
