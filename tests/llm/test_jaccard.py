from collections import Counter, defaultdict

from pyspark.sql import functions as F
from threadmill.llm import jaccard


def shingles(text, n=5):
    w = text.encode().split()
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts: dict[int, str]):
    """By an inverted index: text_id, class_id, n_copies, n_links of every row."""
    same = defaultdict(list)
    for i, t in texts.items():
        same[t].append(i)
    sets = {min(v): shingles(t) for t, v in same.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = Counter((a, b) for v in where.values() if len(v) > 1 for k, a in enumerate(v) for b in v[k + 1 :])
    links, up = Counter(), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (min(v), root(min(v)), len(v), links[min(v)]) for t, v in same.items() for i in v}


def got(df):
    return {r.doc_id: (r.text_id, r.class_id, r.n_copies, r.n_links) for r in df.collect()}


def test_against_brute_force(docs, texts):
    assert got(jaccard.jaccard_classes(docs)) == brute(texts)


def test_large_component_in_blocks(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"e{rng.random()}" for w in base)) for i in range(60)] + [(99, "alone " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(dict(rows))
    assert got(jaccard.jaccard_classes(df, block=8)) == want
    assert sum(v[3] for v in want.values()) > 100


def test_odd_rows(odd, none):
    rows = jaccard.jaccard_classes(odd).collect()
    assert len(rows) == odd.count() - 1  # the null id
    by = {r.doc_id: r for r in rows}
    assert by[4].text_id == 3 and by[5].class_id == 3 and by[3].n_copies == 3 and by[3].n_links == 1
    assert by[1].text_id == by[2].text_id == 1 and by[1].n_links == 0 and by[6].n_links == 0
    assert jaccard.jaccard_classes(none).count() == 0


def test_prefix_reaches_recall():
    k = jaccard.prefix_length(0.8, 20, 6, 0.9999)
    assert 1 - (1 - 0.8**k) ** 20 >= 0.9999 and 1 - (1 - 0.8 ** (k + 1)) ** 20 < 0.9999


def test_texts_that_share_an_id(spark):
    """An id of several texts: each text keeps its own links."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " else"), (4, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_links, r.class_id, r.n_copies) for r in jaccard.jaccard_classes(df).collect())
    assert out == [(1, 1, 1, 1), (1, 1, 1, 2), (2, 1, 1, 1), (3, 1, 1, 1), (4, 1, 1, 2)]
    near = spark.createDataFrame([(1, a), (1, a + " more"), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.stays) for r in jaccard.jaccard_classes(near).collect()) == [(1, False), (1, True), (2, True), (3, False)]


def test_prefix_by_set_size():
    """The least similarity by trying all sizes, and prefixes that reach the recall for it."""
    for m in range(1, 30):
        every = [i / (m + b - i) for i in range(m + 1) for b in range(i, 60) if i / (m + b - i) >= 0.8 - 1e-12]
        assert abs(jaccard.least_similarity(m) - min(every)) < 1e-12
    lengths = jaccard.prefix_lengths()
    assert lengths[1] == jaccard.DEPTH and lengths[-1] == jaccard.prefix_length() == lengths.min()


def test_forest_edges_against_enumeration(spark):
    """Nodes that span ranges, tied labels and mixed depths: the same components as by comparing all prefixes."""
    import random

    from threadmill.llm.common import components

    rng, bits = random.Random(5), (2, 2, 2)
    leaves = [(tree << 6 | rng.choice([5, 17, 22, 23, 40, rng.randrange(64)]), n, rng.choice([2, 3])) for n in range(300) for tree in range(2)]
    df = spark.createDataFrame(leaves, "label long, num long, depth int").withColumn("depth", F.col("depth").cast("byte"))
    up = {n: n for _, n, _ in leaves}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for d in (2, 3):
        nodes = defaultdict(list)
        for label, n, own in leaves:
            nodes[label >> 2 * (3 - d)].append((n, own))
        for node in nodes.values():
            asked = [n for n, own in node if own <= d]
            for n in asked:
                x, y = sorted((root(n), root(asked[0])))
                up[y] = x
    got = {r.node: r.root for r in components(jaccard.forest_edges(df, 2, bits)).collect()}
    want = {n: root(n) for n in up}
    # heads that ask for longer prefixes than the node's may join: classes only grow
    for n, r in want.items():
        assert got.get(n, n) == got.get(r, r)
