import random
from collections import Counter

from threadmill.operators import paths
from threadmill.plans import registry

SF = "/root/testdata/sf0.001"


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    labels, seen = {n: n for n in near}, []
    while True:
        new = {}
        for n, others in near.items():
            votes = Counter(labels[o] for o in others)
            new[n] = min(votes, key=lambda c: (-votes[c], c))
        if new == labels or new in seen:
            return {n: (labels[n], new[n] == labels[n]) for n in near}
        seen.append(new)
        labels = new


def test_fixpoint_as_brute_force(spark):
    rng = random.Random(5)
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    for pairs in (chain, [(f"a{rng.randrange(30):02}", f"b{rng.randrange(30):02}") for _ in range(45)]):
        got = paths.communities(spark.createDataFrame([(a, "R", b) for a, b in pairs], "src string, relation string, dst string"))
        assert {r.node: (r.community, r.settled) for r in got.collect()} == brute(pairs)


def test_whole_graph(spark):
    edges = [(r.src, r.dst) for r in registry.star_edges(spark, SF, supplied=True).collect()]
    assert {r.node: (r.community, r.settled) for r in registry.queries()["star_communities"](spark, SF).collect()} == brute(edges)
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.node: r.component for r in registry.queries()["star_components"](spark, SF).collect()} == {n: find(n) for n in root}
