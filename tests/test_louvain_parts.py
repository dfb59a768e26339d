"""Louvain's method over parts: turns move arrays between parts, hubs hear of communities as rows."""

import random
from itertools import combinations

import numpy as np
import pytest

from threadmill.operators import louvain
from threadmill.plans import registry

from .test_louvain import frame, worth
from .test_star_graph import SF


def groups_and_a_hub():
    rng = random.Random(4)
    groups = [[f"{g}{i:02}" for i in range(14)] for g in "abcde"]
    pairs = [p for g in groups for p in combinations(g, 2) if rng.random() < 0.8]
    pairs += [(rng.choice(groups[i]), rng.choice(groups[(i + 1) % 5])) for i in range(5) for _ in range(3)]
    return pairs + [("a00", f"leaf{i:03}") for i in range(120)] + [("b01", "b01"), ("c02", "c03"), ("c03", "c02"), ("c02", "c03")]


@pytest.mark.parametrize("per_part", [300, 5000])  # with the hub apart, and without
def test_turns_over_parts(spark, monkeypatch, per_part):
    """As good as in one part, whatever the order of the input; a turn stores a row for two parts, not for a node."""
    pairs, stored, real = groups_and_a_hub(), [], louvain.settled
    monkeypatch.setattr(louvain, "settled", lambda df: stored.append(real(df)) or stored[-1])
    found, names, m = louvain.divided(frame(spark, pairs), per_task=1, per_part=per_part)
    many = {r.name: r["at"] for r in found.join(names, "node").collect()}
    turns = [df.count() for df in stored if "wanting" in df.columns]
    assert len(turns) > 3 and max(turns) <= 8 * 9
    assert set(many) == {n for p in pairs for n in p} and abs(m - worth(pairs, many)) < 1e-9
    one = {r.node: r.community for r in louvain.louvain(frame(spark, pairs)).collect()}
    assert worth(pairs, many) > 0.95 * worth(pairs, one)
    rng = random.Random(1)
    again = louvain.divided(frame(spark, rng.sample(pairs, len(pairs))).repartition(5), per_task=1, per_part=per_part)
    assert {tuple(r) for r in again[0].collect()} == {tuple(r) for r in found.collect()} and again[2] == m


def test_best_by_definition():
    """Of each row the community of the highest gain, and its slack, with weights and with links that count one each."""
    rng = np.random.default_rng(3)
    for plain in (True, False):
        row, at = np.sort(rng.integers(0, 9, 60)), rng.integers(0, 5, 60)
        w = np.ones(60, "int64") if plain else rng.integers(1, 4, 60)
        k, now, tot, twice = np.bincount(row, w, 10).astype("int64") + 1, rng.integers(0, 5, 10), np.array([30.0, 8, 25, 12, 40]), 200
        best, slack = louvain._best(row, at, None if plain else w, k, now, tot, twice)
        for i in range(10):
            links = {c: int(w[(row == i) & (at == c)].sum()) for c in {int(now[i]), *at[row == i].tolist()}}
            gain = {c: x - k[i] * (tot[c] - (k[i] if c == now[i] else 0)) / twice for c, x in links.items()}
            high = max(gain.values())
            assert abs(gain[int(best[i])] - high) < 1e-6 and (best[i] == now[i]) == (high <= gain[int(now[i])] + 1e-9)
            assert abs(slack[i] - (high - gain[int(now[i])]) * twice / k[i]) < 1e-6


def test_star_modularity_is_that_of_its_communities(spark):
    """The value of star_louvain_modularity is the modularity of what star_louvain finds."""
    label = {r.node: r.community for r in registry.queries()["star_louvain"](spark, SF).collect()}
    edges = [(r.src, r.dst) for r in registry.star_edges(spark, SF, supplied=True).collect()]
    assert set(label) == {n for e in edges for n in e} and all(c <= n for n, c in label.items())
    assert abs(registry.queries()["star_louvain_modularity"](spark, SF).first().modularity - worth(edges, label)) < 1e-6
    none = spark.createDataFrame([], "node long, other long, once boolean")
    assert louvain.divided(none, named=False)[2] is None
