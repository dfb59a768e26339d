import random

import pytest
from pyspark.sql import functions as F

from threadmill.operators import graph, store
from threadmill.plans import answering

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed, slice_rows, hops", [(1, 100_000, 2), (4, 3, 3), (7, 3, 2)])
def test_accepted_walk_as_walk_and_accepted(spark, monkeypatch, seed, slice_rows, hops):
    """Random graphs with hubs, loops, parallel relations and ties between nodes of one hop, with and without slices: the
    facts and their order are those that accepted() finds in the walk's facts."""
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(16)}", rng.choice("RS"), f"n{rng.randrange(16)}") for _ in range(70)})
    e = store.settled(spark.createDataFrame(edges, "src string, relation string, dst string"))
    shut = spark.createDataFrame([("n3",), ("n8",)], "node string")
    seeds = spark.createDataFrame([(1, "n0", 0, "5"), (1, "n5", 1, "5"), (2, "n3", 0, "1"), (3, "n12", 0, "n2"), (3, None, 1, "n2")], "qid int, node string, place int, word string")
    base = lambda: F.when(F.contains("src", F.col("word")) | F.contains("dst", F.col("word")), 1.5).otherwise(0.0) + F.when(F.col("relation") == "S", 2.0).otherwise(0.0)
    walked = graph.walk(e, seeds, shut, hops).join(seeds.select("qid", "word").distinct(), "qid").select("qid", *graph.FACT, base().alias("base"))
    monkeypatch.setattr(store, "ROWS_PER_SLICE", slice_rows)
    order = lambda df: sorted(map(tuple, df.select("qid", "ord", *graph.FACT, "hop", "score").collect()))
    want, got = order(graph.accepted(walked, seeds, shut, hops, 2)), order(graph.accepted_walk(e, seeds, shut, hops, base(), 2))
    assert want and got == want


def test_evidence_walks_once(spark, monkeypatch):
    """No walk goes before the one that accepts."""
    monkeypatch.setattr(graph, "walk", lambda *_: pytest.fail("walked beforehand"))
    rows = answering.question_evidence(spark, SF).collect()
    assert rows and max(r.place for r in rows) <= answering.CAP and {r.hop for r in rows} == {1, 2}
    assert answering.seed_evidence(spark, SF).count()


def test_degrees_of_edges_with_copies(spark):
    e = spark.createDataFrame([("a", "R", "b", 3), ("b", "R", "c", 1), ("c", "R", "c", 2)], "src string, relation string, dst string, copies long")
    every = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("k", "copies")
    assert {tuple(r) for r in graph.degrees(e).collect()} == {tuple(r) for r in graph.degrees(every).collect()} == {("a", 3), ("b", 4), ("c", 5)}
