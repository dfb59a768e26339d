import math
import zlib
from collections import Counter

import numpy as np
from threadmill.llm import lattice

from .conftest import SF


def tokens(text):
    return (text or "").encode().translate(lattice.LOWER).split()


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            yield from ([word[:k], *rest] for rest in segmentations(word[k:], pieces))


def enumerated(word, v, logp):
    """The log probability of a word and the expected counts of its pieces, from every segmentation."""
    spelled = {c: [int(v.as_byte[b]) for b in c.encode()] for c in word if c not in v.pieces}
    known = {**v.pieces, **spelled}
    ids = [[i for p in s for i in (spelled[p] if p in spelled else [known[p]])] for s in segmentations(lattice.WORD_START + word, known)]
    p = np.array([logp[x].sum() for x in ids])
    counts = np.zeros(len(logp))
    for x, share in zip(ids, np.exp(p - np.logaddexp.reduce(p))):
        np.add.at(counts, x, share)
    return np.logaddexp.reduce(p), counts


def test_lattice_against_enumeration():
    v = lattice.vocabulary(lattice.model_path())
    model = lattice.Lattice(v)
    words = ["the", "thention", "schön", "a", "and", "inghea", "中文字", "xq", "\U0001f600x"]
    weight = np.arange(1.0, len(words) + 1)
    counts = np.zeros(len(v.start))
    for w, m, got in zip(words, weight, model.log_likelihoods(words)):
        p, own = enumerated(w, v, v.start)
        assert math.isclose(got, p, rel_tol=1e-9)
        counts += m * own
    assert np.allclose(model.expected(words, weight), counts)
    assert math.isclose(np.logaddexp.reduce(v.start), 0, abs_tol=1e-9)


def test_long_words():
    """Words whose probability is far below the least float."""
    v = lattice.vocabulary(lattice.model_path())
    model = lattice.Lattice(v)
    word = "qxzj" * 500
    assert model.log_likelihoods([word])[0] < -3000
    assert math.isclose(model.expected([word], np.ones(1)) @ np.bincount(list(v.pieces.values()), [len(p) for p in v.pieces], len(v.start)), len(word) + 1, rel_tol=1e-6)


def test_whole_texts_by_hand(spark):
    """Scores of whole texts from enumerated words, with weights fitted by enumerated expectations."""
    docs = {i: t for i, t in enumerate(["the cat and THE hat", "a cat", None, "hat hat xq\u4e2d", "the end", "cat of a", "unseen word here"])}
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, row int")
    v = lattice.vocabulary(lattice.model_path())
    c = Counter(t.decode() for i, x in docs.items() if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    ends = sum(zlib.crc32(str(i).encode()) % 10 > 0 for i in docs)
    logp = v.start
    for _ in range(2):
        x = np.full(len(logp), 0.01) + sum(n * enumerated(w, v, logp)[1] for w, n in c.items())
        x[-1] += ends
        logp = np.log(x / x.sum())
    total, once = c.total() + ends, sum(n == 1 for n in c.values())
    known = 1 - once / total
    mixed = lambda p, n: math.log10((1 - known) * math.exp(p) + known * n / total)
    for r in lattice.lm_scores(df, lattice.model_path(), rounds=2).collect():
        words = [t.decode() for t in tokens(docs[r.doc_id])]
        p = [enumerated(w, v, logp)[0] for w in words]
        assert math.isclose(r.score, (sum(p) + logp[-1]) / math.log(10), rel_tol=1e-9)
        assert math.isclose(r.mixed_score, sum(mixed(x, c[w]) for x, w in zip(p, words)) + mixed(logp[-1], ends), rel_tol=1e-9)


def check(rows, docs):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(t for i, x in docs.items() if not held[i] for t in tokens(x))
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    for r in rows:
        ts = tokens(docs[r.doc_id])
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[t] for t in ts), ends])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts) + 1, sum(c[t] > 0 for t in ts) + (ends > 0), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9), (r, base)


def test_table(spark, texts):
    """Also: training helps on held-out texts, and the mixture is better than the lattice alone there."""
    rows = lattice.op8_lattice_lm(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    untrained = {r.doc_id: r.score for r in lattice.lm_scores(spark.read.parquet(f"{SF}/documents.parquet"), lattice.model_path(), rounds=0).collect()}
    assert sum(r.score for r in held) > 0.7 * sum(untrained[r.doc_id] for r in held)
    assert sum(r.mixed_score for r in held) > 0.9 * sum(r.score for r in held)
    assert all(r.score < 0 and r.mixed_score < 0 for r in rows)


def test_all_tokens_by_the_join(spark, texts, monkeypatch):
    want = {r.doc_id: r.score for r in lattice.op8_lattice_lm(spark, SF).collect()}
    monkeypatch.setattr(lattice, "HEAD_SHARE", 2.0)
    rows = lattice.op8_lattice_lm(spark, SF).collect()
    check(rows, texts)
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-6) for r in rows)


def test_odd_rows(odd, none):
    rows = lattice.lm_scores(odd, lattice.model_path()).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert next(r for r in rows if r.doc_id == 2).n_tokens == 1
    assert lattice.lm_scores(none, lattice.model_path()).count() == 0


def test_small_batches_are_put_together(spark, monkeypatch):
    """Batches as small as texts need reach the lattice as large ones, bounded in rows and bytes; nothing is lost or moved."""
    batch = lambda lo, hi, size=5: lattice.pa.RecordBatch.from_arrays([lattice.pa.array([b"x" * size] * (hi - lo)), lattice.pa.array(range(lo, hi))], ["token", "c"])
    got = list(lattice._together(iter([batch(k, k + 1000) for k in range(0, 45_000, 1000)])))
    assert [b.num_rows for b in got] == [20_000, 20_000, 5_000] and [x for b in got for x in b.column("c").to_pylist()] == list(range(45_000))
    assert len(list(lattice._together(iter([batch(k, k + 1, 5 << 20) for k in range(3)])))) == 3
    assert list(lattice._together(iter([]))) == [] and list(lattice._together(iter([batch(0, 0)]))) == []
    sizes = []
    real = lattice._together
    rows = spark.range(9_000).selectExpr("cast(concat('w', id) as binary) AS token", "id + 1 AS c").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        seen = rows.mapInArrow(lambda it: (lattice.pa.RecordBatch.from_arrays([lattice.pa.array([b.num_rows])], ["n"]) for b in real(it)), "n long")
        sizes = [r.n for r in seen.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sizes == [9_000]
