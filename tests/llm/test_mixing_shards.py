import random
import zlib
from collections import defaultdict

import pytest

from tests import compare
from threadmill.llm import mixing, shards

from .conftest import SF


def test_mixing_as_sql(spark):
    compare.assert_same(mixing.op6_mixing(spark, SF), mixing.OP6_SQL, SF)


def test_stated_targets_and_odd_rows(docs, odd, none):
    out = mixing.probabilities(docs, {"lang": {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}}, keep=0.2).collect()
    mass = defaultdict(float)
    for r in out:
        mass[r.lang] += r.tokens * r.probability
    assert max(mass.values()) < 1.001 * min(mass.values())
    assert abs(sum(mass.values()) / sum(r.tokens for r in out) - 0.2) < 0.01
    rows = mixing.probabilities(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.probabilities(none).count() == 0
    kept = mixing.sampled(odd.withColumns({"p": mixing.F.lit("p"), "tokens": mixing.F.lit(0), "kept": mixing.F.lit(2)}))
    assert kept.columns == [*odd.columns, "p", "tokens", "kept"] and kept.count() <= odd.count()


def test_shards(spark, texts):
    rows = shards.op9_kd_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    whole_groups_evenly(rows, texts, 24)


def whole_groups_evenly(rows, texts, shards):
    """Groups of equal texts that a shard can hold are in one, and the fullest shard has at most half of the largest such
    group more than the emptiest."""
    size, weight, of = dict.fromkeys(range(shards), 0), defaultdict(int), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        weight[texts[r.doc_id]] += r.size
        of[texts[r.doc_id]].add(r.shard)
    mean = sum(size.values()) / shards
    held = {t: w for t, w in weight.items() if w <= mean}
    assert all(len(of[t]) == 1 for t in held) and max(size.values()) - min(size.values()) <= max(held.values()) / 2


@pytest.mark.parametrize("shards_", [2, 5, 16])
def test_groups_stay_whole(spark, shards_):
    """Groups of many sizes, some nearly a shard, and one larger than a shard."""
    rng = random.Random(shards_)
    texts = {}
    for g in range(120):
        text = f"{g} " + "x" * rng.choice([3, 40, 700, 2500])
        for _ in range(rng.choice([1, 1, 2, 9])):
            texts[len(texts)] = text
    for _ in range(400):
        texts[len(texts)] = "hot " * 100
    df = spark.createDataFrame([(i, t, rng.choice("ab"), rng.choice("st")) for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    whole_groups_evenly(shards.kd_shards(df, shards_).collect(), texts, shards_)


def test_large_table_in_whole_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = shards.kd_shards(docs).collect()
    whole_groups_evenly(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, 24)


def test_hot_text_is_dealt(spark, odd, none):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i} " * 9, "en", "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    size = defaultdict(int)
    for r in shards.kd_shards(df, 6).collect():
        size[r.shard] += r.size
    assert max(size.values()) < 1.15 * min(size.values())
    assert len({r.shard for r in shards.kd_shards(df, None, target_bytes=5000).collect()}) > 3
    rows = shards.kd_shards(odd, 3).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= {0, 1, 2}
    assert shards.kd_shards(none).count() == 0


def test_splits_against_sorting(docs):
    """Every node is split along the dimension that is widest by its points, at the weighted quantile of its leaves, as
    sorting all of its points finds them."""
    _, points = shards._points(docs, "doc_id", 7)
    nodes, first, targets = {0: (0, 7)}, 1, [1.0, 2.0, 1.0, 1.0, 3.0, 0.5, 0.0]
    while any(hi - lo > 1 for lo, hi in nodes.values()):
        nodes = {n: x for n, x in sorted(nodes.items()) if x[1] - x[0] > 1}
        after = shards.stored(shards._split(points, nodes, targets, first), "test")
        was = {(r.th, r.size, r.slice): r for r in points.collect()}
        now = [(was[r.th, r.size, r.slice].node, r) for r in after.collect()]
        top = lambda rs, d: [r.c[d] >> shards.LOW for r in rs]
        every = [r for _, r in now]
        bounds = [max(1, max(top(every, d)) - min(top(every, d))) for d in range(3)]
        children = {}
        for i, (n, (lo, hi)) in enumerate(nodes.items()):
            mine = [r for old, r in now if old == n]
            left, right = ([r for r in mine if r.node == first + 2 * i + side] for side in (0, 1))
            assert len(left) + len(right) == len(mine)
            d = max(range(3), key=lambda d: ((max(top(mine, d)) - min(top(mine, d))) / bounds[d], -d))
            assert not left or not right or max(r.c[d] for r in left) < min(r.c[d] for r in right)
            mid = lo + (hi - lo) // 2
            share = sum(targets[lo:mid]) / sum(targets[lo:hi])
            total = sum(r.bytes for r in mine)
            assert abs(sum(r.bytes for r in left) - total * share) <= max(r.bytes for r in mine) / 2 + 1
            children[first + 2 * i], children[first + 2 * i + 1] = (lo, mid), (mid, hi)
        points, first, nodes = after, first + 2 * len(nodes), children


def test_long_and_repeated_rows(spark):
    """A very long text, an id with two texts and repeated rows: every row has its own slot."""
    rows = [(1, "x" * 2_000_000), (2, "a"), (2, "b"), (3, "c"), (3, "c")] + [(i, f"text {i}") for i in range(10, 60)]
    df = spark.createDataFrame([(*r, "en", None, 7) for r in rows], "doc_id long, text string, lang string, source string, shard int")
    got = shards.kd_shards(df, 3).collect()
    assert len(got) == len(rows) and len({(r.shard, r.slot) for r in got}) == len(rows) and max(r["size"] for r in got) == 2_000_008
