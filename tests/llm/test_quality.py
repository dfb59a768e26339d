import itertools
import zlib

import numpy as np
from threadmill.llm import quality

from .conftest import SF


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    own = np.array([0, 1, 5, 8])
    emit, move = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, _, _ = quality.marginals(emit, move, own)
    for lo, hi in zip(own[:-1], own[1:]):
        p = np.zeros((hi - lo, 2))
        for y in itertools.product((0, 1), repeat=hi - lo):
            s = np.exp(sum(emit[lo + t, y[t]] for t in range(hi - lo)) + sum(move[y[t - 1], y[t]] for t in range(1, hi - lo)))
            for t, v in enumerate(y):
                p[t, v] += s
        assert np.allclose(np.exp(got[lo:hi]), p / p.sum(1, keepdims=True))


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.op4_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc
    assert np.mean([s >= 0.7 for s in good]) > 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (8, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.quality_scores(odd, model, odd.columns).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(none, model, ["doc_id"]).count() == 0
    assert quality.train(none, labels) is None
    assert all(r.score == 1 for r in quality.quality_scores(odd, None, ["doc_id"]).collect())


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    own = np.array([0, 1, 6, 8, 12])
    x, y = rng.normal(size=(12, 3)), rng.integers(0, 2, 12)
    w, move = rng.normal(size=3), rng.normal(size=(2, 2))
    _, gw, gm = quality.loss(x, own, y, w, move, 0.01)
    for p, g in ((w, gw), (move, gm)):
        for k in np.ndindex(p.shape):
            was, side = p[k], []
            for e in (1e-5, -1e-5):
                p[k] = was + e
                side.append(quality.loss(x, own, y, w, move, 0.01)[0])
            p[k] = was
            assert np.isclose((side[0] - side[1]) / 2e-5, g[k], atol=1e-7)


def test_scores_by_enumeration(spark):
    """Whole texts: features of each line, all labellings, and the mean by length, by hand."""
    rng = np.random.default_rng(6)
    model = {"mean": rng.normal(size=45), "dev": rng.random(45) + 0.5, "w": rng.normal(size=46) / 5, "move": rng.normal(size=(2, 2))}
    texts = ["", "One line only.", "a\n\nBB 12!\nlong words ################ ending", "x | y\nsame same same\n"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, score int")
    got = {r.row.doc_id: r.score for r in quality.scored(df, model, df.columns).collect()}
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        x, _, own = quality.line_features(data, np.array([0, len(data)]))
        lines = t.split("\n")
        assert len(x) == len(lines)
        e = np.column_stack([(x[:, :-1] - model["mean"]) / model["dev"], np.ones(len(x))]) @ model["w"]
        every = list(itertools.product((0, 1), repeat=len(lines)))
        s = np.exp([sum(e[k] * y[k] for k in range(len(y))) + sum(model["move"][a, b] for a, b in zip(y, y[1:])) for y in every])
        good = np.array([sum(p for p, y in zip(s, every) if y[k]) / s.sum() for k in range(len(lines))])
        size = np.array([len(v.encode()) + 1.0 for v in lines])
        assert np.isclose(got[i], (good * size).sum() / size.sum()), t


def test_line_features_by_hand():
    data = np.frombuffer(b"Ab 1.\n|| zz zz", np.uint8)
    x, size, own = quality.line_features(data, np.array([0, len(data)]))
    assert own.tolist() == [0, 2] and size.tolist() == [6, 9] and x.shape == (2, 46)
    assert np.allclose(x[0, :6], np.array([1, 1, 1, 1, 0, 0]) / 5) and np.allclose(x[1, 1], 4 / 8) and np.allclose(x[1, 4], 2 / 8)
    assert np.allclose(x[0, 8], 0) and np.allclose(x[1, 8], 1 / 3)  # words seen just before
    assert (x[0, 15:30] == 0).all() and np.allclose(x[0, 30:45], x[1, :15]) and np.allclose(x[1, 15:30], x[0, :15])


def test_repeated_and_long_labelled_rows(spark):
    """Rows that repeat a labelled id count once; texts over the bound take no part in the fit but get a score."""
    docs = spark.createDataFrame([(i, f"Good line {i}.\nAnother one.") for i in range(20)] + [(i, "### $$$ !!!\n%%%") for i in range(20, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(41)], "doc_id long, quality int")
    one = quality.train(docs, labels)
    again = quality.train(docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(40, "z" * 30_000)], docs.schema)), labels)
    assert all(np.allclose(one[k], again[k]) for k in one)
    assert quality.scored(spark.createDataFrame([(1, "a b\n" * 20_000)], "doc_id int, text string"), one, ["doc_id"]).count() == 1
