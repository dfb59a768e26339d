"""Each stage is held against a computation of its own kind: dictionaries, all pairs, whole-text encoding."""

import re
from collections import defaultdict

import corpus_pipeline as p
from threadmill.llm import bpe, quality
from threadmill.llm.common import components, stored

from .conftest import SF
from .test_bpe import digests, expected
from .test_jaccard import brute


def test_stages(spark, docs):
    now = docs
    for name, stage in p.STAGES:
        out = stored(stage(spark, now, SF), name)
        before = {r.doc_id: r for r in now.collect()}
        if name == "bpe":
            assert digests(out) == expected(now)
            break
        assert out.columns == docs.columns
        rows = out.collect()
        got = {r.doc_id for r in rows}
        assert len(rows) == len(got) and all(r == before[r.doc_id] for r in rows)
        if name == "quality":
            score = {r.doc_id: r.score for r in quality.quality_scores(now, quality.train(now, spark.read.parquet(f"{SF}/labels.parquet")), ["doc_id"]).collect()}
            assert got == {i for i in before if score[i] >= 0.7} and len(got) > 0.75 * len(before)
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()} & set(before)
            assert len(bad & got) < 0.3 * len(bad)
        if name == "exact_dedup":
            least = {}
            for i, r in sorted(before.items()):
                least.setdefault(re.sub(r"[ \t-\r]+", " ", r.text or ""), i)
            assert got == set(least.values()) and len(got) < len(before)
        if name == "near_dedup":
            assert got == {c for _, c, _, _ in brute({i: r.text or "" for i, r in before.items()}).values()} and len(got) < len(before)
        if name == "mixing":
            mass = defaultdict(float)
            for r in rows:
                mass[r.lang] += len(r.text.split())
            assert 0.5 < sum(mass.values()) / sum(len((r.text or "").split()) for r in before.values()) < 0.7
        now = out


def test_odd_rows(spark, odd, none):
    """Nulls, repeats, one id with several texts, and columns named as the stages name theirs."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    more = spark.createDataFrame([(20, text), (21, text + " more"), (21, "quite another text"), (22, text), (22, text)], "doc_id long, text string")
    own = {"score": 1, "text_for_score": 2, "row": 3, "key": 4, "id": 5, "p": 6, "kept": 7, "topic": "x", "tokens": 8, "themes": 9, "words": 10}
    df = odd.drop("row").unionByName(more, allowMissingColumns=True).withColumns({k: quality.F.lit(v) for k, v in own.items()})
    for name, stage in p.STAGES[:-1]:
        out = stored(stage(spark, df, SF), name)
        assert out.columns == df.columns and stage(spark, df.where("false"), SF).isEmpty()
        ids = sorted(r.doc_id for r in out.where("doc_id >= 20").collect())
        if name == "exact_dedup":
            assert ids == [20, 21, 21]
        if name == "near_dedup":
            assert sorted(r.text for r in out.where("doc_id >= 20").collect()) == sorted([text, "quite another text"])
    assert p.STAGES[-1][1](spark, df, SF).count() == df.count()
    assert p.bpe_stage(spark, none, SF).isEmpty()


def test_run_and_components(spark):
    assert p.run(spark, SF).count() > 100
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 90) if i % 10 != 9] + [(200, 100), (5, 5), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components(e).collect()} == {(i, i - i % 10) for i in range(90) if i % 10} | {(200, 100)} | {(90 - 1, 80)}
    assert bpe.ranks_path()
