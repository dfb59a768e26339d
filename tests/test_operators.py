import json

import pytest
from pyspark.sql import functions as F
from threadmill.functions import similarity, text
from threadmill.operators import facts, graph, retrieve
from threadmill.plans import registry
from threadmill.sources import readers


def test_similarities():
    assert similarity.indel("abcd", "abcd") == 100 and similarity.indel("abc", "xyz") == 0
    assert similarity.indel("abcd", "abd") == pytest.approx(600 / 7)
    assert similarity.best_window("lo wor", "hello world") == 100
    assert similarity.token_sets("a b c", "c a") == 100 and similarity.token_sets("", "a") == 0
    assert similarity.same_node("3 years stay", "3 years stays") and not similarity.same_node("3 years stay", "5 years stay")


def test_leaders_as_the_greedy_loop(spark):
    import random

    rng = random.Random(1)
    pairs = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)})
    want = {}
    for n in range(25):
        earlier = [a for a, b in pairs if b == n and want[a] == a]
        want[n] = min(earlier, default=n)
    names = spark.createDataFrame([(n,) for n in range(25)], "rank int")
    got = facts.leaders(names, spark.createDataFrame(pairs, "early int, late int"))
    assert {r["rank"]: r.leader for r in got.collect()} == want


def test_text_functions(spark):
    row = spark.createDataFrame([("from (D-7) to E-7, see (D-7)", "after 3 years or 5 years", "only 5  years")], "a string, b string, c string")
    r = row.select(text.codes(F.col("a")).alias("codes"), text.unsupported_numbers(F.col("b"), F.col("c")).alias("bad"), text.split_sources(F.lit("x; ;y")).alias("s"),
        text.render(F.lit("Yes"), F.array(F.lit("go"), F.lit("ask")), F.lit(""), F.lit(None).cast("string")).alias("t"), text.label(F.lit("E-9"), F.lit("work")).alias("l"), text.route(F.lit("a path")).alias("r"),
        text.safe_name(F.lit("a/b:c")).alias("n"), retrieve.expand_words(F.lit("find a job"), [("job", "employment"), ("employment", "permit")]).alias("q"), facts.normalised(F.lit(' "a ㆍ  b" ')).alias("m")).first()
    assert r.codes == ["D-7", "E-7"] and r.bad == ["3 year"] and r.s == ["x", "y"] and r.t == "Yes\n\n1. go\n2. ask"
    assert (r.l, r.r, r.n, r.q, r.m) == ("E-9(work)", "path", "a_b_c", "find a job employment permit", "a · b")


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\n분류: 안내, D-2\n\nbody\n\nmore")
    (tmp_path / "b.md").write_text("# Two\n\nno tags\n\nx")
    rows = {r.title: r for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert rows["One"].tags == ["안내", "D-2"] and rows["One"].body == "body\n\nmore" and rows["Two"].tags == []
    (tmp_path / "x.xml").write_text("<r><art><t>A</t><b>one\n <i>two</i></b></art><art><t>B</t><b>c</b><b>d</b></art></r>")
    assert [tuple(r) for r in readers.read_articles(spark, str(tmp_path / "x.xml"), "art", ["t", "b"]).collect()] == [("A", "one two"), ("B", "c d")]
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"id": "q1"}, {"id": "q2"}]}))
    assert [(r.ord, r.id) for r in readers.read_items(spark, str(tmp_path / "g.json"), "items", "struct<id: string>").collect()] == [(0, "q1"), (1, "q2")]
    todo = spark.createDataFrame([("a",), ("b",)], "k string")
    cache = spark.createDataFrame([("a", 1)], "k string, v int")
    assert {tuple(r) for r in readers.through_cache(todo, cache, "k", lambda d: d.withColumn("v", F.lit(2))).collect()} == {("a", 1), ("b", 2)}


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['threadmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 20 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_types_and_degrees_in_one_pass(spark):
    """A node's type and degree come from one aggregation; loops and parallel edges count at each end."""
    edges = spark.createDataFrame([("a", "R", "b"), ("a", "R", "b"), ("b", "S", "b"), ("c", "S", None)], "src string, relation string, dst string")
    got = graph.node_types(edges, [("Head", "out", "R"), ("Loop", "in", "S")], sized=True)
    assert {tuple(r) for r in got.collect()} == {("a", "Head", 2), ("b", "Loop", 4), ("c", "Other", 1), (None, "Loop", 1)}
    plan = registry.queries()["node_view"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
