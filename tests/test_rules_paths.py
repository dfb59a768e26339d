import itertools
import random

import pytest
from pyspark.sql import functions as F
from threadmill.functions import text
from threadmill.operators import answers, graph, paths, rules

DOCS = [
    (0, "별표 1의2 장기체류자격", "1. 주재 (D-7) 가\n2. 기업투자 (D-8) 나\n3. 교수 (E-1) 다\n4. 특정활동 (E-7) 라\n5. 거주 (F-2) 마", []),
    (1, "별표 1의3 영주자격", "머리 1. 10. 주재(D-7)부터 20. 특정활동(E-7)까지의 체류자격으로 5년 이상 체류하고 있는 사람 2. 국민 또는 영주자격(F-5)을 가진 사람", []),
    (2, "외국인등록", "입국한 날부터 90일을 초과하여 체류하면 등록\n외국인등록 면제 대상은 면제됩니다\n- 외교 (A-1, A-2, A-3)\n- 협정 (A-3)\n끝 (B-1)\n관할 출입국관리사무소에 신청", ["안내", "D-2", "E-6-2", "기타"]),
    (3, "각종신고의무", "외국인등록 후 15일 이내에 외국인등록사항변경신고를 하여야 합니다\n보존 3년 이상 신고", ["법령", "D-2"]),
    (4, "사회통합", "사회통합프로그램을 이수하면 영주 기본소양 요건 충족 인정", []),
    (5, "서식 제3조", "일반귀화 신청 [ ] 성년이며 영주자격(F-5)을 가진 사람\n국내 3년 이상 체류 및 외국인등록", []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(DOCS, "doc_ord long, title string, body string, tags array<string>")
    return {(r.h, r.r, r.t, r.src) for r in rules.rule_triples(docs).collect()}


def test_names_tags_and_offices(found):
    assert {x[:3] for x in found if x[1] == "NAMED"} == {("D-7", "NAMED", "주재"), ("D-8", "NAMED", "기업투자"), ("E-1", "NAMED", "교수"), ("E-7", "NAMED", "특정활동"), ("F-2", "NAMED", "거주")}
    assert {x[:3] for x in found if x[1] == "ALLOWS"} == {("D-2", "ALLOWS", "외국인등록"), ("E-6-2", "ALLOWS", "외국인등록")}
    assert {x[:3] for x in found if x[1] == "HANDLED_BY"} == {("외국인등록", "HANDLED_BY", "출입국·외국인청")}


def test_bridges(found):
    assert ("영주 기본소양 요건", "SATISFIED_BY", "사회통합프로그램", "사회통합") in found and ("F-5", "REQUIRES", "영주 기본소양 요건", "사회통합") in found
    assert ("일반귀화", "REQUIRES", "영주자격(F-5)", "서식 제3조") in found and ("영주자격(F-5)", "SATISFIED_BY", "F-5", "서식 제3조") in found


def test_periods_find_their_subject(found):
    got = {x for x in found if x[1] == "REQUIRES" and x[3] in ("외국인등록", "각종신고의무", "서식 제3조") and x[0] != "일반귀화"}
    assert got == {
        ("외국인등록", "REQUIRES", "90일을 초과", "외국인등록"),
        ("외국인등록사항변경신고", "REQUIRES", "15일 이내", "각종신고의무"),
        ("외국인등록", "REQUIRES", "3년 이상", "서식 제3조"),
    }


def test_exemption_blocks(found):
    assert {x[:3] for x in found if x[1] == "EXEMPT_FROM"} == {(c, "EXEMPT_FROM", "외국인등록") for c in ("A-1", "A-2", "A-3")}


def test_ranges_of_codes_convert(found):
    assert {x[0] for x in found if x[1] == "CONVERTS_TO"} == {"D-7", "D-8", "E-1", "E-7"}
    assert {x[0] for x in found if x[1:3] == ("REQUIRES", "5년 이상 체류")} == {"D-7", "D-8", "E-1", "E-7"}


def test_shortest_ways_as_by_enumeration():
    rng = random.Random(3)
    for _ in range(60):
        facts = [(rng.choice("abcdef"), rng.choice("RS"), rng.choice("abcdef")) for _ in range(7)]
        near = {(x, y): min(f for f in facts if {f[0], f[2]} == {x, y}) for f in facts for x, y in ((f[0], f[2]), (f[2], f[0]))}
        ways = [w for n in range(2, 7) for w in itertools.permutations("abcdef", n) if w[0] == "a" and all(s in near for s in itertools.pairwise(w))]
        want = set()
        for goal in "bcdef":
            if own := [w for w in ways if w[-1] == goal]:
                want |= {near[s] for s in itertools.pairwise(min(own, key=lambda w: (len(w), w)))}
        assert paths.shortest(facts, "a", set("bcdef")) == want


def test_key_paths(spark):
    ev = spark.createDataFrame([(1, "b", "R", "a"), (1, "b", "R", "c"), (1, "c", "R", "d"), (2, "a", "R", "b")], "qid int, src string, relation string, dst string")
    ends = lambda rows: spark.createDataFrame(rows, "qid int, node string")
    got = paths.key_paths(ev, ends([(1, "a"), (2, "a")]), ends([(1, "c"), (1, "z")]))
    assert {tuple(r) for r in got.collect()} == {(1, "b", "R", "a"), (1, "b", "R", "c")}


def test_communities_and_modularity(spark):
    cliques = [(a, "R", b) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("d", "R", "w")]
    edges = spark.createDataFrame(cliques, "src string, relation string, dst string")
    m = paths.communities(edges)
    assert {(r.node, r.community) for r in m.collect()} == {(n, g[0]) for g in ("abcd", "wxyz") for n in g}
    assert paths.modularity(edges, m).first()[0] == pytest.approx(12 / 13 - 2 * 13 * 13 / (4 * 13 * 13))
    assert paths.community_facts(edges, m, 2).count() == 4
    lines = paths.schema_drawing(graph.relation_counts(edges, ["R", "S"]), [("A", "R", "B"), ("B", "S", "C")], ["S"])
    assert {r.line for r in lines.collect()} == {"A -->|R 13| B", "B ==>|S 0| C"}


def test_answers(spark):
    rows = spark.createDataFrame([(1, "how long", "stay 3 years"), (2, "who", "")], "qid int, question string, context string")

    def model(prompts):
        assert all("who" not in p for p in prompts)
        return ["3 years" if p.startswith("Not in") else "5 years" for p in prompts]

    got = {r.qid: r for r in answers.verified(answers.synthesised(rows, model), model).collect()}
    assert got[1].answer == "3 years" and got[1].unsupported == [] and got[2].answer == answers.REFUSAL
    assert {r.route for r in answers.routed(rows, lambda ps: ["a PATH"] * len(ps)).collect()} == {"path"}
    judged = answers.judged(rows.withColumn("expected", F.lit("x")).withColumn("answer", F.lit("y")), lambda ps: ["O" if "how" in p else "X" for p in ps])
    assert {(r.qid, r.ok) for r in judged.collect()} == {(1, True), (2, False)}
    odd = spark.createDataFrame([(k,) for k in ("o\n", "\n\u3000O", " Okay", "x O", "", None)], "answer string").withColumns({"question": F.lit(""), "expected": F.lit("")})
    echo = answers.judged(odd, lambda ps: [p[2:] for p in ps])
    assert sorted((r.answer or "", r.ok) for r in echo.collect()) == sorted([("o\n", True), ("\n\u3000O", True), (" Okay", True), ("x O", False), ("", False), ("", False)])
    docs = spark.createDataFrame([(7, ["stay"], "stay long"), (8, ["go"], "go now"), (9, ["eat"], "eat well")], "doc int, terms array<string>, text string")
    basic = answers.basic_answers(docs, rows.withColumn("terms", F.array(F.when(F.col("qid") == 1, "stay").otherwise("none"))), lambda ps: [p[:9] for p in ps])
    assert {r.qid: (r.docs, r.answer) for r in basic.collect()} == {1: ([7], "stay long"), 2: (None, answers.REFUSAL)}
    facts = spark.createDataFrame([(1, 1, "a", "R", "b", ["y", "x"]), (1, 2, "b", "R", "c", ["x"])], "qid int, place int, src string, relation string, dst string, sources array<string>")
    out = {r.qid: r for r in answers.assembled(rows.select("qid"), facts, facts.where("place = 2")).collect()}
    assert out[1].path == ["b R c"] and out[1].sources == ["x", "y"] and out[2].path == []


def test_calls_in_a_pool(spark):
    """Order is kept, failing prompts are tried again and become rows, and a context of blanks isn't sent."""
    rows = spark.createDataFrame([(k, f"q{k}", " \n\u3000" if k == 3 else f"c{k}") for k in range(20)] + [(20, None, None)], "qid int, question string, context string")

    def model(prompts):
        assert len(prompts) == 1 and "q3" not in prompts[0]
        n = int(prompts[0].split("q")[1].split("\n")[0])
        if n % 5 == 0 and answers.ASK_REPLY in prompts[0]:
            raise ValueError(f"no {n}")
        return f'{{"verdict": "v{n}", "steps": ["a", "b"]}}' if n % 2 else f"plain {n}"

    def one(prompts):
        return [model(prompts)]

    told = F.when(F.col("qid") != 3, F.concat(F.col("question"), F.lit(answers.ASK_REPLY)))
    got = {r.qid: (r.said, r.why) for r in answers.replied(rows.where("qid < 20"), told, one, "said", failed="why").collect()}
    assert got[5] == (None, "ValueError: no 5") and got[4] == ("plain 4", None) and got[3] == (None, None) and len(got) == 20
    out = {r.qid: r for r in answers.synthesised(rows, one, structured=True).collect()}
    assert out[7].answer == "v7\n\n1. a\n2. b" and out[7].reply.verdict == "v7" and out[7].reply.steps == ["a", "b"]
    assert out[4].answer == "plain 4" and out[4].reply is None and out[10].answer == "plain 10" and out[3].answer == answers.REFUSAL == out[20].answer
    with pytest.raises(Exception, match="no 5"):
        answers.replied(rows.where("qid = 5"), told, one, "said").collect()


def test_default_names_and_numbers(spark):
    items = spark.createDataFrame([(0, "t", 0, "E-7", "work"), (0, "t", 1, "E-7", "later"), (1, "t", 0, "D-2", "")], "doc_ord int, title string, pos int, code string, label string")
    assert {(r.code, r.label) for r in rules.known_names(items).collect()} == {("E-7", "work"), (rules.SETTLED_CODE, rules.SETTLED)}
    row = spark.createDataFrame([("stay 5   year, \uff13\u3000month, 2day", "for 2 day")], "a string, c string")
    assert row.select(text.unsupported_numbers(F.col("a"), F.col("c")).alias("n")).first().n == ["5   year", "\uff13\u3000month"]


def test_lines_are_searched_once(spark):
    """The places that are found in lines are kept, so later steps don't search the lines again."""
    docs = spark.createDataFrame([(1, "체류지변경신고", "변경한 날부터 14일 이내에 신고하여야 한다", [])], "doc_ord long, title string, body string, tags array<string>")
    found = rules.periods(docs)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.h for r in found.collect()] == ["체류지변경신고"]
