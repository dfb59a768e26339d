import hashlib
import random
from collections import defaultdict

from threadmill.llm import lines

from .conftest import SF


def brute(docs: list[tuple[int, str]], min_words=50):
    """Deleted lines by comparing every run of lines of every length with those before it."""
    kept = [(i, [(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()]) for i, t in sorted(docs)]
    seen = defaultdict(set)
    count = defaultdict(int)
    for _, ls in kept:
        for _, x, _ in ls:
            count[x] += 1
    gone = {i: set() for i, _ in docs}
    for i, ls in kept:
        for a in range(len(ls)):
            words = 0
            for b in range(a, len(ls)):
                if count[ls[b][1]] < 2:
                    break
                words += ls[b][2]
                if words >= min_words:
                    key = tuple(x for _, x, _ in ls[a : b + 1])
                    if any(p < (i, a) for p in seen[key]):
                        gone[i] |= {k for k, _, _ in ls[a : b + 1]}
                    seen[key].add((i, a))
    return {i: sorted(v) for i, v in gone.items()}


def got(df):
    return {r.doc_id: [int(x) for x in r.dropped.split(",") if x] for r in df.collect()}


def test_table_against_brute_force(docs, texts):
    want = brute(list(texts.items()))
    assert got(lines.dedup_lines(docs)) == want and sum(map(len, want.values())) > 20


def test_random_lines(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice(["a", "b c", "d e f", "", "g " * 9, f"u{rng.random()}"]) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows.append((50, rows[3][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for m in (1, 4, 12):
        assert got(lines.dedup_lines(df, min_words=m)) == brute(rows, m)


def test_rest_of_the_text(spark, odd, none):
    out = {r.doc_id: r for r in lines.dedup_lines(odd, min_words=2).collect()}
    assert lines.dedup_lines(odd).count() == odd.count() and lines.dedup_lines(none).count() == 0
    assert out[3].n_dropped == 0 and out[4].text == "" and out[4].n_dropped == 1 and out[9].text == " \n \n "
    r = lines.op2_line_dedup(spark, SF).first()
    assert len(r.text_sha256) == 64 == len(hashlib.sha256(b"").hexdigest())


def test_suffix_array_against_sorting(spark):
    """Order, neighbours and common prefixes of all suffixes with a window, by sorting them as lists."""
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c c", f"u{rng.random()}"]) for _ in range(rng.randint(1, 30)))) for i in range(30)]
    line = lines.line_table(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4)
    longest = max(max(r.lens) for r in line.collect() if r.lens)
    levels = lines.suffix_ranks(line, longest)
    depth = 1 << (len(levels) - 1)
    at = {r.p: r for r in line.collect()}
    suffix = {p: [at[x].r for x in range(p, min(r.e, p + depth))] for p, r in at.items()}
    want = sorted((p for p, r in at.items() if r.lens), key=lambda p: (suffix[p], p))
    sa = sorted(lines.suffix_array(levels, line).collect(), key=lambda r: r.s)
    assert [r.p for r in sa] == want and [r.before for r in sa] == [None, *want[:-1]] and len(want) > 50
    for r in sa[1:]:
        x, y = suffix[r.before], suffix[r.p]
        same = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert r.lcp == (depth if x == y else same)
    found = defaultdict(set)
    for r in lines.lcp_intervals(lines.stored(lines.suffix_array(levels, line), "sa"), longest).collect():
        found[r.interval, r.len].add(r.p)
    groups = defaultdict(set)
    for p in want:
        for n in at[p].lens:
            groups[tuple(suffix[p][:n])].add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_runs_long_texts_and_shared_ids(spark):
    """A long text of many lines and its copy; an id with two texts; columns named as the operator's own."""
    text = "\n".join(f"line {k} has these six words" for k in range(3000))
    rows = [(1, text), (2, "other\n" + text + "\nend of it"), (3, "w " * 60), (3, "x\n" + "w " * 60), (4, "w " * 60)]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "doc_id long, text string, p int, word int, bits int")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.n_runs, r.text) for r in lines.dedup_lines(df).collect())
    assert got[:2] == [(1, 3000, 0, 0, text), (2, 3002, 3000, 1, "other\nend of it")]
    assert sorted(r[1:4] for r in got[2:4]) in ([(1, 0, 0), (2, 1, 1)], [(1, 1, 1), (2, 0, 0)]) and got[4][1:4] == (1, 1, 1)
