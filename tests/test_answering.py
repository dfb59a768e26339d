"""Stages from triples and questions to context, each against a plain loop of the same meaning."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from threadmill.functions import similarity, text
from threadmill.operators import candidates, context, corpus, evaluate, facts, graph, linking, resolve, store


def brute_links(q, nodes, blocked, vocabulary, loose=85):
    for human, official in vocabulary:
        if human in q and official not in q:
            q += " " + official
    bare, seeds = re.sub(r"\s", "", q), []
    for m in re.finditer(r"(?i)[A-H]\s*-\s*\d{1,2}(?:-\d)?", q):
        code = re.sub(r"\s", "", m[0]).upper()
        if code in nodes and code not in seeds:
            seeds.append(code)
    free = [n for n in nodes if n not in blocked]
    hit = lambda n: len(nodes[n]) >= 2 and nodes[n] in q or len(n) >= 3 and n in q or len(n) >= 6 and re.sub(r"\s", "", n) in bare
    seeds += sorted((n for n in free if n not in seeds and hit(n)), key=lambda n: (len(n), n), reverse=True)
    chars = lambda n: set(re.sub(r"\s", "", n))
    extra = [n for n in free if n not in seeds and len(re.sub(r"\s", "", n)) >= 8 and sum(c in bare for c in chars(n)) / len(chars(n)) >= 0.75]
    seeds += sorted(extra, key=lambda n: (len(n), n), reverse=True)[:2]
    if not seeds:
        best = max(nodes, key=lambda n: similarity.best_window(n, q))
        if similarity.best_window(best, q) >= loose:
            seeds.append(best)
    if not seeds:
        last = [n for n in free if len(chars(n)) >= 4 and all(c in bare for c in chars(n))]
        seeds += sorted(last, key=lambda n: (len(chars(n)), n), reverse=True)[:2]
    return seeds[:5]


def test_links_as_the_stages_say(spark):
    nodes = {"E-7": "특정활동", "F-6": "결혼이민", "외국인등록": "", "외국인등록사항변경 신고의무": "", "체류자격외활동": "", "혼인귀화": "", "체류기간연장": "", "영주 기본소양 요건": "", "지방출입국·외국인관서의 장": "", "work permit office": "", "abcd": ""}
    asked = ["e - 7 비자로 영주권", "외국인등록 사항이 바뀌면 신고할 때 변경 의무", "알바 하려면", "결혼비자를 받으려면", "한국인과 혼인해서 귀화하려면", "완전히 다른 이야기", "the work permlt office", "zzdczbza", "E-7, F-6 e-7", "", "지방출입국·외국인관서의 장은"]
    rng = random.Random(8)
    asked += ["".join(rng.choice("외국인등록사항변경 신고의무체류자격외활동 F-67abcdw") for _ in range(rng.randint(1, 25))) for _ in range(40)]
    vocabulary = [("알바", "체류자격외활동"), ("결혼비자", "F-6")]
    blocked = {"지방출입국·외국인관서의 장"}
    got = linking.link_entities(
        spark.createDataFrame(list(enumerate(asked)), "qid int, question string"), spark.createDataFrame([(n, v, k) for k, (n, v) in enumerate(nodes.items())], "node string, label string, ord int"),
        spark.createDataFrame([(b,) for b in blocked], "node string"), vocabulary)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.qid, r.place)):
        found.setdefault(r.qid, []).append(r.node)
    assert [found.get(k, []) for k in range(len(asked))] == [brute_links(q, nodes, blocked, vocabulary) for q in asked]
    assert found[0][0] == "E-7" and "체류자격외활동" in found[2] and "F-6" in found[3]


@pytest.mark.parametrize("seed, slice_rows", [(2, 100_000), (5, 4)])
def test_accepted_as_the_greedy_walk(spark, monkeypatch, seed, slice_rows):
    """W2 on random graphs with hubs and parallel edges, several seeds; the second time nodes are joined in slices."""
    monkeypatch.setattr(store, "ROWS_PER_SLICE", slice_rows)
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(14)}", rng.choice("RS"), f"n{rng.randrange(14)}") for _ in range(60)})
    closed = {"n3", "n8"}
    starts = {1: ["n0", "n5"], 2: ["n3"], 3: ["n12", "n1", "n7"]}
    base = {(q, e): round(rng.random() * 4, 1) for q in starts for e in edges}

    def greedy(q, hops, cap):
        visited, seen, out, queue = set(starts[q]), set(), [], [(s, 0) for s in starts[q]]
        while queue:
            node, hop = queue.pop(0)
            if hop >= hops:
                continue
            near = sorted((-base[q, e], way, e) for way in (0, 1) for e in edges if e[2 * way] == node and (way == 0 or e[0] != e[2]))
            here = 0
            for minus, _, e in near:
                other = e[2] if e[0] == node else e[0]
                if other not in visited and other not in closed:
                    visited.add(other)
                    queue.append((other, hop + 1))
                if e not in seen and here < cap:
                    seen.add(e)
                    here += 1
                    out.append((*e, hop + 1, round(3 / (hop + 1) - minus, 6)))
        return out

    e = spark.createDataFrame(edges, "src string, relation string, dst string")
    seeds = spark.createDataFrame([(q, s, k) for q, ss in starts.items() for k, s in enumerate(ss)], "qid int, node string, place int")
    shut = spark.createDataFrame([(c,) for c in closed], "node string")
    weights = spark.createDataFrame([(q, *x, b) for (q, x), b in base.items()], "qid int, src string, relation string, dst string, base double")
    for hops in (1, 2, 3):
        walked = graph.walk(e, seeds.select("qid", "node"), shut, hops).join(weights, ["qid", *graph.FACT]).select("qid", *graph.FACT, "base")
        got = {}
        for r in sorted(graph.accepted(walked, seeds, shut, hops, 2).collect(), key=lambda r: r.ord):
            got.setdefault(r.qid, []).append((r.src, r.relation, r.dst, r.hop, round(r.score, 6)))
        assert all(got.get(q, []) == greedy(q, hops, 2) for q in starts)


def test_a_seed_of_very_many_facts(spark):
    """200,000 facts at one seed, each other end with a further one: five of the seed's, then
    what each leaf accepts at its end, within the budget."""
    n = 200_000
    ids = spark.range(n)
    leaf = F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 6, "0"))
    edges = ids.select(F.lit("hot").alias("src"), F.lit("R").alias("relation"), leaf.alias("dst")).unionByName(ids.select(leaf.alias("src"), F.lit("S").alias("relation"), F.concat(F.lit("y"), F.col("id") % 7).alias("dst")))
    seeds = spark.createDataFrame([(1, "hot", 0), (2, "x000003", 0), (3, None, 0), (4, "none", 0), (1, "hot", 1)], "qid int, node string, place int")
    shut = graph.hubs(edges, F.lit(False), 12)
    edges = store.settled(edges)
    walked = graph.walk(edges, seeds, shut, 2)
    weighed = walked.withColumn("base", F.when(F.col("relation") == "S", F.substring("src", 2, 6).cast("double") / n).otherwise(0.0))
    found = graph.accepted(weighed, seeds, shut, 2)
    kept = graph.within_budget(found, {"S": 3}, 9, 18, ["ord"]).collect()
    got = {q: [(r.src, r.relation, r.dst, r.hop) for r in sorted(kept, key=lambda r: r.place) if r.qid == q] for q in (1, 2, 3, 4)}
    assert got[1] == [("hot", "R", f"x{i:06}", 1) for i in range(5)] + [(f"x{i:06}", "S", f"y{i % 7}", 2) for i in (n - 1, n - 2, n - 3)] + [("hot", "R", f"x{i:06}", 2) for i in range(5, 9)]
    assert got[2] == [("x000003", "S", "y3", 1), ("hot", "R", "x000003", 1)] and got[3] == got[4] == []


def test_hub_exemption(spark):
    e = spark.createDataFrame([("F-5", "R", f"x{i}") for i in range(23)] + [("office", "R", f"x{i}") for i in range(12)] + [("blocked", "R", "x0")], "src string, relation string, dst string")
    assert {r.node for r in graph.hubs(e, F.col("node") == "blocked", passable=F.col("node").rlike(r"^[A-H]-\d+$")).collect()} == {"office", "blocked"}


def test_dictionary(spark):
    names = spark.createDataFrame([("E-9", "비전문취업"), ("F-5", "영주")], "code string, label string")
    aliases = spark.createDataFrame([("한국어 시험", "사회통합프로그램")], "alias string, official string")
    rows = ["비전문취업(E-9)", "비전문취업", " 「한국어  시험」 ", "출입국ㆍ외국인청", "E-9", "그 외"]
    got = resolve.dictionary(spark.createDataFrame([(k, x, "x1") for k, x in enumerate(rows)], "ord int, h string, t string"), names, aliases)
    assert [r.h for r in sorted(got.collect(), key=lambda r: r.ord)] == ["E-9", "E-9", "사회통합프로그램", "출입국·외국인청", "E-9", "그 외"]
    assert [r.renamed_h for r in sorted(got.collect(), key=lambda r: r.ord)] == [True, True, True, False, False, False]


def made_names(rng):
    stem = ["영주 기본소양 요건", "사회통합프로그램 이수", "체류기간 연장 허가", "근무처 변경 신고", "abcdefgh ijkl", "mnop qrst uvwx yz"]
    out = set()
    while len(out) < 70:
        x = list(rng.choice(stem) + rng.choice(["", "", " 3년", " 5년", " 신고", "s"]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], [x[k], "x"], ["q"]])
        if len("".join(x).strip()) >= 2:
            out.add("".join(x).strip())
    return sorted(out)


def test_leaders_of_triples(spark):
    """The order of names and the greedy loop over all earlier leaders."""
    rng = random.Random(4)
    names = made_names(rng)
    rows = [(k, rng.choice(names), "R", rng.choice(names), rng.choice(["rule", "llm", "llm"]), "d") for k in range(160)]
    freq, rule, seen = Counter(), set(), {}
    for _, h, _, t, o, _ in rows:
        for x in (h, t):
            freq[x] += 1
            seen.setdefault(x, len(seen))
            if o == "rule":
                rule.add(x)
    digits = lambda x: set(re.findall(r"\d+", x))
    canon, heads = {}, []
    for n in sorted(freq, key=lambda n: (n not in rule, -freq[n], len(n), seen[n])):
        hit = next((c for c in heads if digits(n) == digits(c) and (similarity.indel(n, c) >= 92 or len(c) >= 6 and c in n)), None)
        canon[n] = hit or n
        if not hit:
            heads.append(n)
    out, merged = resolve.merged(spark.createDataFrame(rows, "ord int, h string, r string, t string, origin string, src string"))
    assert {r.name: r.leader for r in merged.collect()} == {n: c for n, c in canon.items() if n != c} and len(heads) < len(freq)
    assert Counter((r.h, r.t) for r in out.collect()) == Counter((canon[h], canon[t]) for _, h, _, t, _, _ in rows if canon[h] != canon[t])


def test_review_pairs(spark):
    names = made_names(random.Random(6))
    got = {(r.a, r.b): r.score for r in resolve.review_pairs(spark.createDataFrame(list(enumerate(names)), "rank int, name string")).collect()}
    ordered = sorted((n for n in names if len(n) >= 5), key=lambda n: (len(n), names.index(n)))
    digits = lambda x: set(re.findall(r"\d+", x))
    want = {(a, b): int(similarity.token_sets(a, b)) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if digits(a) == digits(b) and similarity.token_sets(a, b) >= 70}
    assert got == want and len(want) > 20


def test_fuzzy_scores(spark):
    expected = [(1, "5년 이상 거주", "REQUIRES", "소득 요건"), (1, "a long name here", "X", "b"), (1, "3년", "REQUIRES", "c"), (2, "zz", "X", "yy")]
    evidence = [(1, "5년 이상 거주할 것", "REQUIRES", "소득 요건"), (1, "long name here", "X", "b"), (1, "5년", "REQUIRES", "c"), (1, "k", "X", "l"), (3, "a", "X", "b")]
    df = lambda x: spark.createDataFrame(x, "qid int, src string, relation string, dst string")
    got = {r.qid: r for r in evaluate.fuzzy_path_scores(spark.createDataFrame([(1,), (2,), (3,)], "qid int"), df(expected), df(evidence)).collect()}
    for q in (1, 2):
        mine = [x[1:] for x in expected if x[0] == q]
        rows = [x[1:] for x in evidence if x[0] == q]
        hits = sum(any(r == y[1] and similarity.same_node(h, y[0]) and similarity.same_node(t, y[2]) for y in rows) for h, r, t in mine)
        assert got[q].recall == pytest.approx(hits / len(mine)) and got[q].precision == pytest.approx(hits / len(rows) if rows else 0) and got[q].n_missing == len(mine) - hits
    assert got[1].recall == pytest.approx(2 / 3) and got[3].recall is None and got[3].f1 is None and got[3].precision is None
    assert {r.src for r in evaluate.missing_facts(df(expected), df(evidence)).collect()} == {"3년", "zz"}
    layered = evaluate.layers(spark.createDataFrame([(1,), (2,)], "qid int"), df(expected), df(evidence), df(evidence[:4] + [(0, "3년", "REQUIRES", "c")]).drop("qid"))
    assert {r.qid: r.layer for r in layered.collect()} == {1: "traversal", 2: "index"}
    assert [(r.layer, r.n, r.ids) for r in sorted(evaluate.failures_by_layer(layered).collect(), key=lambda r: r.place)] == [("index", 1, [2]), ("traversal", 1, [1]), ("generation", 0, [])]


def test_batches_of_similarities():
    """A word for each pair or window, against one pair at a time; long strings, empty ones, all lengths about 64."""
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abc de1가\U0001f600") for _ in range(n))
    pairs = [(make(rng.choice([0, 1, 2, 5, 9, 30])), make(rng.choice([0, 1, 3, 8, 40, 200]))) for _ in range(300)]
    pairs += [(make(n), make(m)) for n in (63, 64, 65, 90) for m in (63, 64, 65, 150)] + [("", ""), ("a b c", "c a")]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    for fast, slow in ((similarity.ratios, similarity.indel), (similarity.partial_ratios, similarity.best_window), (similarity.token_set_ratios, similarity.token_sets)):
        assert fast(a, b) == pytest.approx([slow(x, y) for x, y in pairs])
    assert similarity.node_matches(a + a, b + a).tolist() == [similarity.same_node(x, y) for x, y in zip(a + a, b + a)]


def test_nodes_that_match_without_all_pairs(spark):
    """of random names with few edits, words in other orders, and short or repeating ones, all that match."""
    rng = random.Random(12)
    names = made_names(rng) + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    names += [" ".join(rng.sample(["stay", "permit", "of", "the", "office", "3", "a"], rng.randint(1, 5))) for _ in range(40)]
    left, right = sorted(set(names[::2])), sorted(set(names[1::2]))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "node string")
    got = {(r.node, r.other) for r in evaluate.alike_nodes(frame(left), frame(right)).collect()}
    want = {(x, y) for x in left for y in right if similarity.same_node(x, y)}
    assert got == want and len(want) > 100
    for least in (60.0, 85.0, 100.0):
        sides = [spark.createDataFrame([(x, x) for x in xs], "id string, name string") for xs in (left, right)]
        pairs = {(r.left_name, r.right_name): r.bound for r in candidates.like_windows(*sides, least).collect()}
        score = {(x, y): similarity.best_window(x, y) for x in left for y in right}
        assert all(pairs.get(p, 0) >= s - 1e-6 for p, s in score.items() if s >= least)


def test_ids_of_a_large_layer(spark):
    layered = spark.createDataFrame([(i, "index" if i % 3 else "traversal") for i in range(30)], "qid int, layer string")
    rows = [(r.layer, r.part, r.n, r.ids) for r in sorted(evaluate.failures_by_layer(layered, per_row=8).collect(), key=lambda r: (r.place, r.part))]
    index = [i for i in range(30) if i % 3]
    assert rows == [("index", k, 20, index[8 * k : 8 * k + 8]) for k in range(3)] + [("traversal", k, 10, list(range(0, 30, 3))[8 * k : 8 * k + 8]) for k in range(2)] + [("generation", 0, 0, [])]


def test_documents_quotes_and_context(spark):
    docs = spark.createDataFrame([(0, "Guide", "x" * 150 + " F-5 and work permit rules " + "y" * 300), (1, "Guide/Part", "the work permit again"), (2, "Law 10", "no terms"), (3, "", "empty title")], "ord int, title string, body string")
    titles = spark.createDataFrame([("Guide",), ("Guide/Part/Sub",), ("Law",), ("Other",), ("Guide/P",)], "title string")
    assert {r.title: r.ord for r in context.found_documents(titles, docs).collect()} == {"Guide": 0, "Guide/Part/Sub": 0, "Law": 2, "Guide/P": 0}
    rows = [(1, 1, "F-5", "REQUIRES", "work permit", ["Law", "Guide/Part", "Guide"], 1), (1, 2, "work permit", "X", "F-5", ["Guide"], 2), (1, 3, "Community #0", "SUMMARY", "all of it", [], 0), (2, 1, "q", "SUMMARY", "w", [], 0)]
    evidence = spark.createDataFrame(rows, "qid int, place int, src string, relation string, dst string, sources array<string>, hop int")
    labels = spark.createDataFrame([("F-5", "settled")], "node string, label string")
    quoted = context.quotes(evidence, docs, labels)
    got = [(r.qid, r.place, r.term, r.title) for r in sorted(quoted.collect(), key=lambda r: r.place)]
    assert got == [(1, 1, "work permit", "Guide/Part"), (1, 2, "F-5", "Guide")]
    out = {r.qid: r.context for r in context.contexts(evidence, labels, quoted, spark.createDataFrame([(1, "Before."), (2, "Only this.")], "qid int, context string")).collect()}
    assert out[2] == "Only this."
    lines = out[1].split("\n")
    assert lines[:4] == ["Before.", "Facts:", "(F-5(settled)) -[REQUIRES]-> (work permit)   [1 hops, source: Law; Guide/Part; Guide]", "(work permit) -[X]-> (F-5(settled))   [2 hops, source: Guide]"]
    assert lines[5] == "Quotes:" and lines[6] == "- the work permit again   (source: Guide/Part)" and len(lines) == 8
    answers = spark.createDataFrame([(1, "It is settled by law"), (2, "w and q")], "qid int, answer string")
    assert {(r.qid, r.node) for r in context.mentioned(evidence, labels, answers).collect()} == {(1, "F-5"), (2, "q"), (2, "w")}


def test_communities_and_summaries(spark):
    member = spark.createDataFrame([(f"n{i}", "a" if i < 5 else "b" if i < 8 else "c") for i in range(10)], "node string, community string")
    degree = spark.createDataFrame([(f"n{i}", i % 4) for i in range(10)], "node string, degree int")
    listed = context.community_list(member, degree, most=2)
    assert [(r.id, r["size"], r.members) for r in sorted(listed.collect(), key=lambda r: r.id)] == [(0, 5, ["n3", "n2"]), (1, 3, ["n7", "n6"])]
    inner = spark.createDataFrame([("a", 1, "n0", "R", "n1"), ("a", 2, "n1", "R", "n2")], "community string, place int, src string, relation string, dst string")
    assert {r.id: r.input for r in context.summary_inputs(listed, inner).collect()} == {0: "(n0) -[R]-> (n1)\n(n1) -[R]-> (n2)", 1: "n7\nn6"}
    titles = spark.createDataFrame([("제목:  취업 \n요약: x", 1), ("none", 2)], "reply string, n int").select("n", context.community_title(F.col("reply"), F.col("n")).alias("t"))
    assert {r.n: r.t for r in titles.collect()} == {1: "취업", 2: "Community 2"}
    groups = spark.createDataFrame([(0, 5, "work", "a\nb"), (1, 3, "small", "c"), (2, 4, "stay", "d")], "id int, size int, title string, summary string")
    rows = context.global_evidence(spark.createDataFrame([(7,)], "qid int"), groups)
    assert context.global_prompts(rows).first().parts == "Community #0 work\na b\n\nCommunity #2 stay\nd"
    more = context.with_summaries(spark.createDataFrame([(7, "x", "R", "y", 1, 1, ["s"])], "qid int, src string, relation string, dst string, hop int, place int, sources array<string>"), rows)
    assert more.count() == 3 and more.where("relation <> 'SUMMARY'").count() == 1


def test_corpus_stages(spark):
    pages = spark.createDataFrame([("A", "x" * 500), ("B", "short"), ("Drop", "y" * 900), ("Off", "z" * 900), ("C", None)], "title string, body string")
    kept, skipped = corpus.screened(pages, ["Drop"], wanted="A|B|C|Drop")
    assert [r.title for r in kept.collect()] == ["A"]
    assert {r.title: r.reason for r in skipped.collect()} == {"B": "5 characters", "Drop": "on the drop list", "Off": "title off topic", "C": "0 characters"}
    both = spark.createDataFrame([("A visa", "visa " * 100), ("A visa", "other " * 100), ("B", "visa " * 100), ("A visa", None), (None, "visa " * 100)], "title string, body string")
    kept, skipped = corpus.screened(both, [], wanted="^A", anchor="visa")
    assert [r.body[:4] for r in kept.collect()] == ["visa"] and sorted(r.reason for r in skipped.collect()) == ["0 characters", "no anchor in the body", "title off topic", "title off topic"]
    m = corpus.manifest(spark.createDataFrame([("T", "see (F-5) and E-7, (F-5)")], "title string, body string"), F.lit("Law"), F.lit("u")).first()
    assert (m.title, m.type, m.chars, m.source, m.categories) == ("T", "Law", 24, "u", ["E-7", "F-5"])
    docs = [("출입국관리법 제10조의2 영주자격(요건)", "체류자격 변경 (F-5)"), ("별표 체류자격/근무처", "영주자격 신청"), ("국적법 귀화", "아무것도 (E-7) (F-5)"), ("셋", "none")]
    rows = {r.title: (r.by_title, r.by_code, r.n_codes) for r in corpus.overlaps(spark.createDataFrame(docs, "title string, body string"), ("출입국관리법", "국적법")).collect()}
    assert [rows[t] for t, _ in docs] == [(True, False, 1), (True, False, 0), (False, True, 2), (False, False, 0)]


def test_text_pieces(spark):
    row = spark.createDataFrame([("<p>a</p><script>x</style>y</script>&amp;nbsp;b", "A body printContents x>here<end>more", "e - 7, (F5) E-7 a-1-2", "a\x01b\tc")], "html string, page string, said string, raw string")
    r = row.select(text.clean_html(F.col("html")).alias("h"), text.between(F.col("page"), "printContents", ">", ("<stop>", "<end>")).alias("p"), text.between(F.col("page"), "missing", ">", ("<end>",)).alias("q"), text.spoken_codes(F.col("said")).alias("c"), text.printable(F.col("raw")).alias("r"), text.tokens_with_grams(F.lit("AB c")).alias("t")).first()
    assert r.h == "a\n b" and r.p == "here" and r.q is None and r.c == ["E-7", "A-1-2", "F-5"] and r.r == "ab\tc" and r.t == ["AB", "c", "AB", "c"]


def test_order_of_parts(spark):
    rules = spark.createDataFrame([((1, 5, 0), "a", "R", "b", "rule", "d")], "ord struct<rule: int, doc_ord: long, pos: long>, h string, r string, t string, origin string, src string")
    model = spark.createDataFrame([(3, "a", "R", "b", "llm", "e"), (2, "x", "R", "y", "llm", "d")], "ord long, h string, r string, t string, origin string, src string")
    both = resolve.in_order(rules, model)
    assert [r.src for r in sorted(both.collect(), key=lambda r: r.ord)] == ["d", "d", "e"]
    got = {(r.h, r.t): (r.origin, r.sources) for r in facts.aggregate_facts(both).collect()}
    assert got["a", "b"] == ("rule", "d; e") and got["x", "y"] == ("llm", "d")
    nodes, edges = resolve.graph_of(facts.aggregate_facts(both), spark.createDataFrame([("a", "name")], "code string, label string"))
    assert {(r.id, r.type, r.label) for r in nodes.collect()} == {("a", "Visa", "name"), ("b", "", ""), ("x", "", ""), ("y", "", "")} and edges.count() == 2
    assert {r.grounded: r.n for r in resolve.grounding_counts(spark.createDataFrame([("rule",), ("llm-inferred",)], "origin string")).collect()} == {True: 1, False: 1}


def test_candidate_joins(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(25)})
    t, n = spark.createDataFrame(list(enumerate(texts)), "id int, x string"), spark.createDataFrame([(v,) for v in names], "name string")
    got = {(r.id, r.name) for r in candidates.containing(t, ["id"], "x", n, "name", 2).collect()}
    want = {(k, v) for k, x in enumerate(texts) for v in names if v in x}
    assert got == want
    for size in (1, 20):  # many sets of names
        monkeypatch.setattr(candidates, "SET_CHARS", size)
        more = t.unionByName(spark.createDataFrame([(99, None), (98, "")], "id int, x string"))
        assert {(r.id, r.name) for r in candidates.containing(more, ["id"], "x", n, "name", 2).collect()} == want
    assert candidates.containing(t, ["id"], "x", n.where("false"), "name").columns == ["id", "name"]
    odd = evaluate.upper_median(spark.createDataFrame([(v,) for v in [5, 1, 9, 9, 2, 2]], "v int"), "v").first().median
    assert odd == sorted([5, 1, 9, 9, 2, 2])[3]


def test_prompts_are_texts_a_few_at_a_time():
    """A batch of many prompts is asked in slices, whose replies leave before the next is read; columns beside the prompt
    stay as they are."""
    import pyarrow as pa

    from threadmill.operators import answers

    asked = []

    def model(prompts):
        asked.extend(prompts)
        if prompts[0] == "p3":
            raise ValueError("no")
        return [p.upper() for p in prompts]

    n = 5000
    batch = pa.RecordBatch.from_arrays([pa.array([[k] for k in range(n)]), pa.array([None if k == 1 else f"p{k}" for k in range(n)]), pa.nulls(n, pa.string())], ["k", "reply", "why"])
    got = answers._asked(iter([batch]), (1, 2), model, False, 1, 1)
    first = next(got)
    assert first.num_rows == answers.ROWS_AT_ONCE >= len(asked)
    rows = [r for b in (first, *got) for r in b.to_pylist()]
    assert rows == [{"k": [k], "reply": None if k in (1, 3) else f"P{k}", "why": "ValueError: no" if k == 3 else None} for k in range(n)]


def test_texts_are_searched_a_few_at_a_time():
    import pyarrow as pa

    from threadmill.operators import candidates

    class Names:
        value = ["ab", "b1"]

    texts = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([f"ab{k}" for k in range(3000)])], ["k", "text"])
    got = list(candidates._named(iter([texts]), "few", Names))
    assert len(got) == -(-3000 // candidates.TEXTS_AT_ONCE)
    assert sorted((r["k"], r["name"]) for b in got for r in b.to_pylist()) == sorted([(k, "ab") for k in range(3000)] + [(k, "b1") for k in range(3000) if str(k)[0] == "1"])
