import hashlib
import re

from tests import compare
from pyspark.sql import functions as F
from threadmill.llm import exact_dedup, fingerprint

from .conftest import SF


def test_dedup_as_sql(spark):
    compare.assert_same(exact_dedup.op10_exact_dedup(spark, SF), exact_dedup.OP10_SQL, SF)


def test_dedup_with_colliding_hashes(odd, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r.doc_id, norm(r.text)) for r in odd.collect()]
    for hashed in (exact_dedup.content_hash, lambda c: F.unhex(F.substring(F.md5(c), 1, 1)), lambda c: F.unhex(F.lit("00"))):
        got = exact_dedup.exact_dedup(odd, hashed=hashed).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(t for i, t in rows if i == r.doc_id)
            ids = [i for i, t in rows if t == text]
            keep = min((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_fingerprints_of_edited_texts(docs, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, rows_per_range=64).collect()}
    assert len(rows) == len(texts)
    for k, i in enumerate(order):
        a, b = texts[i], texts[order[(k + 1) % len(order)]]
        h = len(a) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest(), i
        assert rows[i].n_chars == len(a) and 0 <= rows[i].near_next <= 1 and 0 <= rows[i].near_edited <= 1
    by_print, by_text = {}, {}
    for i, t in texts.items():
        assert by_print.setdefault(rows[i].fingerprint, sorted(t.split("\n"))) == sorted(t.split("\n"))
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_fingerprint_is_homomorphic(spark):
    t = spark.createDataFrame([(1, "a b.\nc d."), (2, "c d.\na b."), (3, "a b."), (4, "c d."), (5, "a b.\na b.")], "k long, text string")
    lanes = {r.k: r.lanes for r in fingerprint.fingerprints(t, ["k"]).collect()}
    assert lanes[1] == lanes[2] != lanes[5]
    d = spark.createDataFrame([(lanes[3], lanes[4], lanes[1])], "a array<long>, b array<long>, c array<long>")
    r = d.select(fingerprint.insert(F.col("a"), F.col("b")).alias("x"), fingerprint.delete(F.col("c"), F.col("b")).alias("y")).first()
    assert r.x == lanes[1] and r.y == lanes[3]


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprint.edited_fingerprints(odd, rows_per_range=2).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert fingerprint.edited_fingerprints(none).count() == 0


def lanes_of(text):
    """Lanes by hand: Spark's xxhash64 of a number and a string is the string's hash with the number's as seed."""
    import numpy as np
    import xxhash

    h = lambda k, x: xxhash.xxh64_intdigest(x.encode(), seed=xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed=42))
    out = np.zeros(68, object)
    for p in text.split("\n"):
        a, b = h(7, p), h(11, p)
        out[:4] += [a & 0xFFFFFFFF, a >> 32, b & 0xFFFFFFFF, b >> 32]
        for s in re.split(r"(?<=[.!?|;])\s+", p, flags=re.ASCII):
            x = h(13, s)
            out[4:] += [len(s) * (1 - 2 * (x >> i & 1)) for i in range(64)]
    return [int(v) % (1 << 32) for v in out]


def likeness_of(a, b):
    x, y = ([v - (1 << 32) if v >= 1 << 31 else v for v in lanes[4:]] for lanes in (a, b))
    norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    return 1.0 if a == b else 0.0 if not norm else min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / norm))


def test_fingerprints_by_hand(docs, texts):
    rows = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    hexed = lambda lanes: "".join(f"{v:08x}" for v in lanes)
    for k, i in list(enumerate(order))[::17]:
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        h = len(a) // 2
        own, other, after = lanes_of(a), lanes_of(a[: len(a) - h] + b[:h]), lanes_of(b)
        r = rows[i]
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(own), hexed(other))
        assert abs(r.near_edited - likeness_of(own, other)) < 1e-9 and abs(r.near_next - likeness_of(own, after)) < 1e-9


def test_long_texts_and_shared_ids(spark):
    long = "\n".join(f"line {k} of a very long text. It goes on." for k in range(20_000))
    rows = [(1, long), (2, long + " "), (3, "a"), (3, "b"), (3, "a"), (None, "c")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, lanes string")
    out = fingerprint.edited_fingerprints(df, rows_per_range=2).collect()
    assert len(out) == len(rows) and sorted(r.n_chars for r in out)[-1] == len(long) + 1
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (3, 3, 2, True), (3, 3, 2, True)]
