"""Work that grows with the input: names as codes, nodes compared in small blocks, pages by their number."""

import random

import duckdb
from pyspark.sql import functions as F

from threadmill.functions import similarity
from threadmill.operators import candidates, evaluate, graph, paths
from threadmill.plans import registry

from .compare import assert_same
from .test_star_graph import brute


def frame(spark, pairs):
    return spark.createDataFrame([(a, "R", b) for a, b in pairs], "src string, relation string, dst string")


def test_names_of_one_code(spark):
    """Two names of one hash are two nodes still, and null ends none."""
    edges = frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), (None, "z")])
    for ordered in (False, True):
        nodes, pairs = graph.coded(edges, ordered, code=F.length)
        names = {r.node: r["name"] for r in nodes.collect()}
        assert sorted(names.values()) == ["a", "b", "c", "x", "y"]
        assert sorted((names[r.node], names[r.other]) for r in pairs.collect()) == [("a", "b"), ("b", "c"), ("x", "y")]
    nodes, pairs = graph.coded(edges, ordered=True)
    assert {r["name"]: r.id for r in nodes.collect()} == {n: i for i, n in enumerate("abcxy")} and pairs.count() == 3


def test_components_of_chains(spark):
    """Chains in order, against it and in no order; a loop is a component of its own."""
    rng = random.Random(2)
    names = [f"n{i:03}" for i in range(150)]
    mixed = rng.sample(names, len(names))
    pairs = [(f"{k}{a}", f"{k}{b}") for k, x in zip("abc", (names, names[::-1], mixed)) for a, b in zip(x, x[1:])] + [("loop", "loop")]
    got = {r.node: r.component for r in graph.components(frame(spark, pairs)).collect()}
    assert got == {n: f"{n[0]}n000" if n != "loop" else n for p in pairs for n in p}
    assert {r.node: r.component for r in graph.components(frame(spark, [("x", "x")])).collect()} == {"x": "x"}


def test_labels_of_many_nodes_and_hubs(spark, monkeypatch):
    """The same labels where nodes are heavy and joined in slices."""
    from threadmill.operators import store

    monkeypatch.setattr(store, "ROWS_PER_SLICE", 20)
    rng = random.Random(9)
    pairs = [(f"h{rng.randrange(3)}", f"n{rng.randrange(90):02}") for _ in range(160)] + [(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(60)]
    got = paths.communities(frame(spark, pairs))
    assert {r.node: (r.community, r.settled) for r in got.collect()} == brute(pairs)


def test_pages_of_one_url(spark, tmp_path):
    """Pages are left out by their number, whatever their url; those without a text are not short."""
    duckdb.sql(f"""COPY (SELECT * FROM (VALUES (10, 'u', repeat('x', 500)), (11, 'u', repeat('x', 500)), (12, 'u', 'short'), (13, 'v', NULL), (20, 'v', NULL), (14, 'dropped', repeat('x', 500)))
        t(page_id, url, html)) TO '{tmp_path}/pages.parquet' (FORMAT parquet)""")
    assert_same(registry.queries()["skipped_pages"](spark, str(tmp_path)), registry.oracle_sql()["skipped_pages"], str(tmp_path))
def test_small_blocks_are_compared_at_once(spark, monkeypatch):
    """Few nodes of the same digits take no join on parts of names."""
    monkeypatch.setattr(candidates, "like_windows", None)
    monkeypatch.setattr(candidates, "like_words", None)
    left = spark.createDataFrame([(f"customer C-{k}",) for k in range(50)] + [(f"in N-{k}",) for k in range(50)], "node string")
    right = spark.createDataFrame([(f"{c}-{k}",) for k in range(50) for c in "CNO"], "node string")
    got = {tuple(r) for r in evaluate.alike_nodes(left, right).select("node", "other").collect()}
    names = [[r.node for r in x.collect()] for x in (left, right)]
    assert got == {(a, b) for a in names[0] for b in names[1] if similarity.same_node(a, b)} and len(got) >= 100


def test_a_walk_stores_only_frontiers(spark, monkeypatch):
    """One hop stores nothing; facts from both ends and loops have their direction and their least hop."""
    kept = []
    real = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: kept.append(df) or real(df))
    edges = frame(spark, [("a", "b"), ("c", "a"), ("a", "a"), ("b", "c"), ("b", "d"), ("a", "b")])
    seeds, closed = spark.createDataFrame([(1, "a")], "qid long, node string"), spark.createDataFrame([("b",)], "node string")
    one = graph.walk(edges, seeds, closed, 1)
    assert not kept and sorted(tuple(r) for r in one.collect()) == [(1, "a", "R", "a", 1), (1, "a", "R", "b", 1), (1, "c", "R", "a", 1)]
    two = graph.walk(edges, seeds, closed, 2)
    assert sorted(tuple(r)[1::2] + (r.hop,) for r in two.select("qid", "src", "relation", "dst", "hop").collect()) == [("a", "a", 1), ("a", "b", 1), ("b", "c", 2), ("c", "a", 1)]
