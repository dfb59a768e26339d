import random
from itertools import combinations

import pyarrow as pa
from pyspark.sql import functions as F

from threadmill.operators import graph, louvain, paths, store


def frame(spark, pairs):
    return spark.createDataFrame([(a, "R", b) for a, b in pairs], "src string, relation string, dst string")


def worth(pairs, label):
    """Modularity by its definition."""
    m, degree, inside = len(pairs), {}, 0
    for a, b in pairs:
        inside += label[a] == label[b]
        for n in (a, b):
            degree[label[n]] = degree.get(label[n], 0) + 1
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


def test_planted_groups(spark):
    rng = random.Random(3)
    groups = [[f"{g}{i:02}" for i in range(12)] for g in "abcd"]
    pairs = [p for g in groups for p in combinations(g, 2) if rng.random() < 0.7]
    pairs += [(rng.choice(groups[i]), rng.choice(groups[(i + 1) % 4])) for i in range(4) for _ in range(3)]
    got = {r.node: r.community for r in louvain.louvain(frame(spark, pairs)).collect()}
    assert got == {n: g[0] for g in groups for n in g}


def test_bests_and_odd_graphs(spark):
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(16):02}", f"n{rng.randrange(16):02}") for _ in range(30)]  # loops and parallel ones too
    rows = frame(spark, pairs)
    got = {r.node: r.community for r in louvain.louvain(rows).collect()}
    again = {r.node: r.community for r in louvain.louvain(rows.repartition(3)).collect()}
    assert got == again and set(got) == {n for p in pairs for n in p}
    assert all(min(n for n in got if got[n] == c) == c for c in got.values())
    high = worth(pairs, got)
    for a, b in combinations(sorted(set(got.values())), 2):  # no two communities would be better as one
        assert worth(pairs, {n: a if c == b else c for n, c in got.items()}) <= high + 1e-4
    assert louvain.louvain(rows.where("false")).collect() == []
    assert [tuple(r) for r in louvain.louvain(frame(spark, [("x", "x")])).collect()] == [("x", "x")]


def test_many_parts_and_a_hub(spark):
    """The same groups where a task holds few edges: nodes move by halves of the parts, and a hub by itself."""
    rng = random.Random(4)
    groups = [[f"{g}{i:02}" for i in range(14)] for g in "abcde"]
    pairs = [p for g in groups for p in combinations(g, 2) if rng.random() < 0.8]
    pairs += [(rng.choice(groups[i]), rng.choice(groups[(i + 1) % 5])) for i in range(5) for _ in range(3)]
    pairs += [("a00", f"leaf{i:03}") for i in range(120)]
    one, many = ({r.node: r.community for r in louvain.louvain(frame(spark, pairs), per_task=n).collect()} for n in (1 << 20, 150))
    assert set(one) == set(many) and worth(pairs, many) > 0.97 * worth(pairs, one)
    found = louvain.louvain(frame(spark, pairs), per_task=150)
    assert abs(paths.modularity(frame(spark, pairs), found).first().modularity - worth(pairs, many)) < 1e-9


def test_stars_in_slices(spark, monkeypatch):
    """A star of 40,000 leaves and one of few: no task of the joins has much more than its share of the rows."""
    monkeypatch.setattr(store, "ROWS_PER_SLICE", 2000)
    e = spark.range(40_000).select(F.lit("hub").alias("src"), F.lit("R").alias("relation"), F.concat(F.lit("leaf"), "id").alias("dst"))
    e = e.unionByName(frame(spark, [("x", "y"), ("y", "z"), ("a", "a")]))
    both = store.settled(graph.endpoints(e).select("node", "other"))
    names = both.groupBy("other").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in store.spread_join(both, names.hint("shuffle_hash"), "other", store.heavy_keys(both, "other")).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == both.count() and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    got = graph.components(e)
    assert {r.component: r["count"] for r in got.groupBy("component").count().collect()} == {"hub": 40_001, "x": 3, "a": 1}
    labels = paths.communities(e)
    assert labels.where("community = 'hub'").count() == 40_001 and labels.where("not settled").count() == 0


def test_wishes_by_definition():
    """Each node of a part wishes for a community of the highest gain, and its slack is what the gain allows."""
    rng = random.Random(5)
    w, c = {}, [rng.randrange(6) for _ in range(20)]
    for _ in range(50):
        a, b = rng.sample(range(19), 2)  # node 19 has no edges to others
        w[a, b] = w[b, a] = w.get((a, b), 0) + rng.randrange(1, 4)
    k = [sum(x for (a, _), x in w.items() if a == i) + (i == 19) * 2 for i in range(20)]
    tot, twice = [sum(k[i] for i in range(20) if c[i] == a) for a in range(6)], sum(k)
    own = [i for i in range(20) if i % 3 == 1]
    seen = sorted({*own, *(b for a, b in w if a in own)}, key=lambda i: -i)
    need = pa.table({"node": seen, "own": [i in own for i in seen], "c": [c[i] for i in seen], "tot": [tot[c[i]] for i in seen], "k": [k[i] for i in seen], "loops": [0] * len(seen)})
    near = {i: [(b, x) for (a, b), x in w.items() if a == i] for i in own if i != 19}
    lists = pa.table({"node": list(near), "others": pa.array([[b for b, _ in x] for x in near.values()], pa.list_(pa.int64())), "ws": pa.array([[y for _, y in x] for x in near.values()], pa.list_(pa.int64()))})
    got = louvain.wishes(need, lists, twice).to_pylist()
    assert sorted(r["node"] for r in got) == own
    for r in got:
        i = r["node"]
        links = {a: sum(x for b, x in near.get(i, []) if c[b] == a) for a in {c[i], *(c[b] for b, _ in near.get(i, []))}}
        gain = {a: x - k[i] * (tot[a] - (k[i] if a == c[i] else 0)) / twice for a, x in links.items()}
        high = max(gain.values())
        assert r["inner"] == links[c[i]] and r["c"] == c[i] and r["k"] == k[i]
        assert abs(gain[r["to"]] - high) < 1e-6 and (r["to"] == c[i]) == (high <= gain[c[i]] + 1e-9)
        assert abs(r["slack"] - (high - gain[c[i]]) * twice / k[i]) < 1e-6
