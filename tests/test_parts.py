"""Graphs dealt into parts: rounds move arrays between parts, with the same results as rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from threadmill.operators import parts, paths
from threadmill.plans import registry

from .test_louvain import worth
from .test_star_graph import SF, brute


def frame(spark, pairs, relations="R"):
    return spark.createDataFrame([(a, relations[i % len(relations)], b) for i, (a, b) in enumerate(pairs)], "src string, relation string, dst string")


def odd_graph(seed):
    """Hubs, loops, edges that repeat and in both directions."""
    rng = random.Random(seed)
    pairs = [(f"h{rng.randrange(3)}", f"n{rng.randrange(90):02}") for _ in range(160)] + [(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(60)]
    return pairs + [("h0", "h1"), ("h1", "h0"), ("h2", "h2"), ("n01", "n01"), *pairs[:9], *((b, a) for a, b in pairs[:9])]


def test_arrays_are_packed_and_found_again():
    rng = np.random.default_rng(1)
    for x in (np.empty(0, "int32"), rng.integers(-5, 5, 1000), rng.integers(0, 2**62, 77), rng.random(9) < 0.5):
        again = parts.unpacked(parts.packed(x))
        assert again.dtype == x.dtype and (again == x).all()
    assert len(parts.packed(np.repeat(7, 100_000))) < 200


def test_labels_of_many_parts_and_hubs(spark, monkeypatch):
    """The labels of brute force in one part and in many, hubs apart; a round stores a row for two parts, not for an edge."""
    stored, real = [], paths.settled
    monkeypatch.setattr(paths, "settled", lambda df: stored.append(real(df)) or stored[-1])
    for seed in (1, 2):
        pairs = odd_graph(seed)
        expected = brute(pairs)
        for per_part in (None, 60):
            got = paths.communities(frame(spark, pairs), per_part=per_part)
            assert {r.node: (r.community, r.settled) for r in got.collect()} == expected
    rounds = [df.count() for df in stored if "mark" in df.columns]
    assert rounds and max(rounds) <= 16**2 and min(rounds) <= 1


def test_a_null_end_and_no_edges(spark):
    got = paths.communities(frame(spark, [("a", "b"), (None, "c"), ("d", None)]), per_part=1)
    assert {r.node for r in got.collect()} == {"a", "b"}
    assert paths.communities(frame(spark, [("a", "b")]).where("false")).collect() == []


def test_modularity_by_parts(spark):
    """By the definition, with loops and repeated edges, and of rows that count once where they are flagged."""
    for per_part in (None, 60):
        pairs = odd_graph(3)
        p = paths.passed(frame(spark, pairs), per_part=per_part)
        assert (per_part is None) == (p.full is None)
        label = {n: c for n, (c, _) in brute(pairs).items()}
        assert abs(paths.worth(p.parts, p.labels).first().modularity - worth(pairs, label)) < 1e-12
    rows = spark.createDataFrame([(1, 2, True), (1, 2, True), (2, 3, False), (2, 3, False), (4, 5, True)], "node long, other long, once boolean")
    p = paths.passed(rows, name=lambda n: n.cast("string"))
    plain, label = [("1", "2"), ("2", "3"), ("2", "3"), ("4", "5")], {r.node: r.id for r in paths.unpacked(p.parts, p.labels).collect()}
    assert abs(paths.worth(p.parts, p.labels).first().modularity - worth(plain, {str(n): c for n, c in label.items()})) < 1e-12


def test_first_facts_as_by_windows(spark):
    kind = lambda a, b: F.when(a < b, "UP").otherwise("DOWN")
    pairs = odd_graph(4)
    edges = frame(spark, pairs).withColumn("relation", kind(F.col("src"), F.col("dst")))
    by_rows = paths.community_facts(edges, paths.communities(edges).select("node", "community"), most=7)
    for per_part in (None, 60):
        got = paths.first_facts(paths.passed(edges, out_only=True, per_part=per_part), kind, most=7)
        assert sorted(map(tuple, got.select(by_rows.columns).collect())) == sorted(map(tuple, by_rows.collect()))


def test_star_pairs_are_star_edges(spark):
    """Numbers of nodes lead to the names, relations and multiplicities of star_edges."""
    rows = registry.star_pairs(spark, SF)
    once = rows.where("once").distinct().unionByName(rows.where("not once"))
    src, dst = registry.star_name(F.col("node")), registry.star_name(F.col("other"))
    got = once.select(src.alias("src"), registry.star_relation(src, dst).alias("relation"), dst.alias("dst"))
    edges = registry.star_edges(spark, SF, supplied=True)
    assert got.count() == edges.count() and got.exceptAll(edges).isEmpty()
    odd = spark.createDataFrame([((ord("P") << 56) - 5,), ((ord("O") << 56) + 2**54,), (ord("N") << 56,)], "node long")
    assert [r[0] for r in odd.select(registry.star_name(F.col("node"))).collect()] == ["P--5", f"O-{2**54}", "N-0"]
