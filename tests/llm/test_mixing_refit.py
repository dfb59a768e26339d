from collections import defaultdict

import numpy as np
import pytest
from threadmill.llm import mixing

from .conftest import SF


def shares(rows, dim):
    mass = defaultdict(float)
    for r in rows:
        mass[r[dim]] += r.tokens * r.probability
    return {v: m / sum(mass.values()) for v, m in mass.items()}


def test_equal_targets_are_met(docs):
    out = mixing.probabilities(docs, {"lang": {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}}, keep=0.2).collect()
    assert all(abs(s - 0.25) < 1e-4 for s in shares(out, "lang").values())
    assert abs(sum(r.tokens * r.probability for r in out) / sum(r.tokens for r in out) - 0.2) < 1e-4


@pytest.mark.parametrize("few", [10**6, 0])
def test_scarce_cells_and_many_values(spark, few):
    """The scarce value is kept whole and the rest meets its targets; values past the 200th count on their own."""
    rows = [(i, "word " * (10 if i < 240 else 400), "en" if i % 3 else "de", f"s{i % 240}") for i in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mass = defaultdict(float)
    aim = {"lang": {"en": 0.5, "de": 0.5}, "topic": {"brief": 0.06, "prose": 0.94}}
    if few:
        out = mixing.probabilities(df, aim, keep=0.6, few=few, topic_of=mixing.by_form).collect()
        for r in out:
            mass[r.source] += r.tokens * r.probability
        assert len(mass) == 240 and max(mass.values()) < 2.1 * min(mass.values())
        assert max(r.probability for r in out) <= 1
        res = {(r.dimension, r.value): r for r in mixing.residuals(df, aim, keep=0.6, topic_of=mixing.by_form).collect()}
        assert len(res) == 244 and res["topic", "brief"].short and not res["topic", "prose"].short
        assert all(abs(shares(out, d)[v] - r.expected) < 1e-4 for (d, v), r in res.items())
    else:
        df = df.where("doc_id % 240 < 6")
        many, some = (mixing.probabilities(df, aim, keep=0.6, few=n, topic_of=mixing.by_form).orderBy("doc_id").collect() for n in (0, 10**6))
        assert np.allclose([r.probability for r in many], [r.probability for r in some], atol=1e-5)


def test_stated_sources_all_keep_their_share(spark):
    """300 equal sources with 300 equal targets, one of them named as a class might be."""
    name = lambda i: "(other)" if i == 7 else f"s{i}"
    df = spark.createDataFrame([(i, "some words here", "en", name(i % 300)) for i in range(3000)], "doc_id long, text string, lang string, source string")
    out = mixing.probabilities(df, {"source": {name(i): 1 / 300 for i in range(300)}}, keep=0.5).collect()
    assert all(abs(r.probability - 0.5) < 1e-6 for r in out)


def test_topics_by_hand(spark):
    """Of a language's words in 1 to 10 % of its texts, the one with the largest count times weight."""
    text = lambda i: " ".join(["Alle zusammen"] * (i % 2) + ["Grün"] * (i % 12 == 0) + ["Rot, rot"] * (i % 12 == 0) + ["gold"] * (2 if i % 25 == 0 else 0) + ["abc"])
    df = spark.createDataFrame([(i, text(i), "s", lang) for i in range(300) for lang in ("de", "xx")], "doc_id int, text string, source string, lang string")
    found = {r.lang: [(x.place, x.word) for x in r.themes] for r in mixing.themes(df).collect()}
    assert found == {lang: [(1, "grün"), (2, "gold")] for lang in ("de", "xx")}
    got = mixing.by_theme(df)(df).collect()
    assert all(r.topic == ("t2" if r.doc_id % 25 == 0 else "t1" if r.doc_id % 12 == 0 else mixing.NO_TOPIC) for r in got)


def test_refit_is_brute_force_projection():
    """Feasible targets come out exactly though cells sit at 1."""
    rng = np.random.default_rng(3)
    w = rng.integers(1, 100, 24).astype(float)
    codes = [np.arange(24) // 6, np.arange(24) // 2 % 3, np.arange(24) % 2]
    p = np.clip(rng.random(24) * 1.6, 0, 1)
    targets = [np.bincount(c, w * p) for c in codes]
    got = mixing.refit(w, codes, targets, 0.5)
    assert got.max() <= 1
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, w * got), t, atol=1e-3 * w.sum())


def test_residual_query(spark):
    """Residuals are the shares that the probabilities give; values short of tokens are the only ones far off."""
    got = {(r.dimension, r.value): r for r in mixing.op6_mixing_residuals(spark, SF).collect()}
    out = mixing.op6_mixing(spark, SF).collect()
    for d in mixing.DIMS:
        now = shares(out, d)
        assert all(abs(now[v] - r.expected) < 1e-4 for (x, v), r in got.items() if x == d)
    assert all(abs(r.residual) < 2e-3 for r in got.values() if not any(x.short and x.dimension == r.dimension for x in got.values()))
