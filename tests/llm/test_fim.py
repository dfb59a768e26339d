import hashlib
import re

from threadmill.llm import fim, queries
from tests.compare import assert_same

from .conftest import SF


def brute(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_table_against_sql(spark):
    assert_same(fim.op12_fill_in_middle(spark, SF), queries.oracle_sql()["op12_fill_in_middle"], SF)


def test_table_and_odd_rows(spark, docs, odd, none):
    """Against regular expressions: whole texts, nulls, marks inside, wide code points, texts of several pieces, and
    extra columns with clashing names."""
    wide = "\U0001f600é\r\nab<c>\x00 "
    long = ["abc, d" * 50_000, "x" * 200_000, "y" * 70_000 + "é " * 70_000, wide * 30_000]
    more = [(k, t) for k, t in enumerate([wide * 3, "a<P>b", "<M>", "<", "<<S", "P>", "ß", *long], 100)] * 2
    extra = spark.createDataFrame([(*r, "c", "h") for r in more], "doc_id long, text string, cut string, h1 string")
    for df in (docs, odd, extra):
        out = fim.fill_in_middle(df).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
        want = [(r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
        assert df is not docs or {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(none).count() == 0


def test_pieces_do_not_part_units(monkeypatch):
    splitter = fim.Split(fim.Regex(fim.UNIT), behavior="isolated")
    for text in ("abc, de  f", "aaaa", ". . ", "ab\U0001f600cd" * 9):
        whole = [fim.cuts(splitter, text, a, b) for a in range(12) for b in range(12)]
        monkeypatch.setattr(fim, "PIECE", 3)
        assert "".join(p for _, p in fim.pieces(text, 3)) == text
        assert whole == [fim.cuts(splitter, text, a, b) for a in range(12) for b in range(12)]
        monkeypatch.undo()
