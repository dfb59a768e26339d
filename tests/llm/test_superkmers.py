import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.compare import assert_same
from threadmill.llm import queries, superkmers

from .conftest import SF


def brute(docs, window):
    """(id, text) -> words and what stays of them, by a dictionary of all windows."""
    rows = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in docs]
    first = {}
    for i, ws in sorted(rows):
        for k in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[k : k + window]), (i, k))
    out = {}
    for i, ws in rows:
        gone = {j for k in range(len(ws) - window + 1) if first[tuple(ws[k : k + window])] < (i, k) for j in range(k, k + window)}
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.text) for r in df.collect()}


def test_table_against_sql(spark):
    assert_same(superkmers.op11_superkmer_dedup(spark, SF), queries.oracle_sql()["op11_superkmer_dedup"], SF)


@pytest.mark.parametrize("per_slice", [512, 2])
def test_random_words(spark, monkeypatch, per_slice):
    """Few words, so that windows repeat in one text and over many; runs of one word; slices of hot minimisers."""
    monkeypatch.setattr(superkmers, "PER_SLICE", per_slice)
    rng = random.Random(3)
    rows = []
    for i in range(150):
        words = [rng.choice(["a", "b", "ü", "\U0001f600", f"u{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            words += ["la"] * rng.randint(5, 200)
        if i % 4 == 0:
            words[9:9] = [f"p{k}" for k in range(30)]
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t ", "\x0b"]) for w in words)))
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, k int, mini int, later string")
    for window, size in ((5, 2), (20, 5), (4, 4), (1, 1)):
        assert got(superkmers.dedup_windows(df, window=window, size=size)) == brute(rows, window)


def test_small_blocks_in_a_bucket(spark, monkeypatch, docs, texts):
    monkeypatch.setattr(superkmers, "WORDS_AT_ONCE", 50)
    assert got(superkmers.dedup_windows(docs)) == brute(list(texts.items()), 20)


def test_odd_rows(spark, odd, none):
    rows = superkmers.dedup_windows(odd, window=3, size=2)
    out = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == odd.count() and superkmers.dedup_windows(none).count() == 0
    assert (out[3].n_removed, out[4].n_removed, out[5].n_removed, out[4].text) == (0, 7, 7, "") and out[2].n_words == 0 == out[9].n_words
    assert out[None].n_removed == 0 and out[None].text == "no id here" and out[7].text == "x" * 5000
    ids = odd.selectExpr("cast(doc_id as string) doc_id", "text")
    named = {(r.doc_id, r.n_words, r.n_removed, r.text) for r in superkmers.dedup_windows(ids, window=3, size=2).collect()}
    assert named == {(r.doc_id and str(r.doc_id), r.n_words, r.n_removed, r.text) for r in rows.collect()}


def test_shared_ids_and_a_long_text(spark):
    """An id with two texts, of which one counts as earlier; a very long text and its copy; repeated rows."""
    long = " ".join(f"w{k % 30_011}" for k in range(200_000))
    same = " ".join(f"s{k}" for k in range(25))
    rows = [(1, same), (1, same + " end"), (2, long), (3, long), (3, long), (None, same), (None, None)]
    out = defaultdict(list)
    for r in superkmers.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[r.doc_id].append((r.n_words, r.n_removed))
    assert sorted(out[1]) in ([(25, 0), (26, 25)], [(25, 25), (26, 0)]) and out[3] == [(200_000, 200_000)] * 2
    assert sorted(out[None]) == [(0, 0), (25, 0)] and out[2] == [(200_000, brute([(2, long)], 20)[2][1])]


def test_windows_of_a_super_kmer_share_its_minimiser():
    """Each window is in one super-k-mer, and equal windows have equal minimisers wherever they stand."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    row, start, n, mini, _, _ = superkmers.super_kmers(np.frombuffer(b"".join(raw), np.uint8), at, 6, 3)
    seen, name = set(), {}
    for r, s, k, m in zip(row, start, n, mini):
        for i in range(s, s + k):
            assert (r, i) not in seen
            seen.add((r, i))
            assert name.setdefault(tuple(texts[r].split()[i : i + 6]), m) == m
    assert seen == {(r, i) for r, t in enumerate(texts) for i in range(len(t.split()) - 5)}
