"""Triples from documents by rules. A rule is a plan from documents (doc_ord, title, body) to triples (ord, h, r, t,
origin, src); ord sorts by rule, document and place, so that facts know their first source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import candidates, facts
from .store import settled, ship

# Patterns and words of the corpus.
CODE = r"[A-H]-[0-9]{1,2}"
ITEM = r"(?U)\d+(?:의\d+)?\.\s*([가-힣·ㆍ\s]{2,12}?)\s*\(([A-H]-\d{1,2})\)"
BRIDGE = r"(?U)사회통합\s*프로그램을?\s*이수하면\s*([가-힣\s]{2,20}?요건)\s*충족"
NATURALISED = r"(?U)(일반귀화|간이귀화|혼인귀화)[^\[]{0,60}\[\s*\]\s*[^\[]{0,40}?영주자격\(([A-H]-\d{1,2})\)"
TAG_CODE = r"^[A-H]-[0-9]{1,2}(-[0-9])?$"
PERIOD = r"(?:(?:전|이후)\s*)?\d+\s*(?:일|개월|년)\s*[을를]?\s*(?:이내|이상|초과|미만|전부터|부터|까지)"
PROCEDURE = r"[가-힣·]{2,14}(?:신고|허가|신청|등록|연장|변경|이수|평가|귀화)"
ACT = "신청|신고|등록|체류|거주|이수|허가|받아야|하여야"
NO_REQUIREMENT = "보존|수수료|과태료|벌금|징역|유효기간|발급일|촬영|사진"
DUTY = r"^[을를]?\s*(?:하여야|해야|하여|합니다|하면)"
EXEMPT = r"(?U)([가-힣]{2,12})\s*(?:예외|면제)[^\n]{0,30}면제됩니다"
OFFICE_SAID = r"(?U)관할\s*출입국(?:관리사무소|·외국인관서|ㆍ외국인관서)"
OFFICE = "출입국·외국인청"
RANGE = r"(?U)\(([A-H]-\d{1,2})\)\s*부터.*?\(([A-H]-\d{1,2})\)\s*까지"
ITEM_SPLIT = r"(?U)(?=\s\d{1,2}\.\s(?![가-힣]{2,10}\s*\([A-H]-))"
CONDITION = r"(?U)(\d+년 이상[^,.]*?)(?=하고 있|한 사람|인 사람|$)"
ANNEX, STATUS, LONG, SETTLED, ARTICLE = "별표", "체류자격", "장기체류자격", "영주자격", r"제[0-9]+조"
GUIDE, SETTLEMENT, SETTLED_CODE, PROGRAMME = "안내", "영주", "F-5", "사회통합프로그램"
NEAR, REACH, PER_SUBJECT, MOST_CODES = 60, 80, 3, 14


def groups(text: Column, pattern: str, *numbers: int) -> Column:
    """Array of (pos, a, b): the groups of each match, trimmed, with its number."""
    first, *more = (F.regexp_extract_all(text, F.lit(pattern), F.lit(n)) for n in numbers)
    return F.transform(first, lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("a"), *(F.trim(F.get(m, i)).alias("b") for m in more)))


def triples(rows: DataFrame, rule: int, h: Column, r: str, t: Column) -> DataFrame:
    order = F.struct(F.lit(rule).alias("rule"), "doc_ord", F.col("pos").cast("long").alias("pos"))
    return rows.select(order.alias("ord"), h.alias("h"), F.lit(r).alias("r"), t.alias("t"), F.lit("rule").alias("origin"), F.col("title").alias("src"))


def named_items(docs: DataFrame) -> DataFrame:
    """(doc_ord, title, pos, code, label) of the numbered items in annexes of statuses."""
    annexes = docs.where(F.contains("title", F.lit(ANNEX)) & F.contains("title", F.lit(STATUS)))
    return annexes.select("doc_ord", "title", F.explode(groups(F.col("body"), ITEM, 1, 2)).alias("x")).select("doc_ord", "title", "x.pos", F.col("x.b").alias("code"), F.col("x.a").alias("label"))


def code_names(items: DataFrame) -> DataFrame:
    """Triples NAMED, the first label of each code."""
    first = items.where("label <> ''").groupBy("code").agg(F.min(F.struct("doc_ord", "pos", "label", "title")).alias("x")).select("code", "x.*")
    return triples(first, 1, F.col("code"), "NAMED", F.col("label"))


def known_names(items: DataFrame, defaults: list[tuple[str, str]] = ((SETTLED_CODE, SETTLED),)) -> DataFrame:
    """(code, label): the first label of each code, and defaults for codes that no item names: the settled status has
    an annex of its own and stands in no list."""
    first = items.where("label <> ''").groupBy("code").agg(F.min_by("label", F.struct("doc_ord", "pos")).alias("label"))
    more = items.sparkSession.createDataFrame(list(defaults), "code string, label string")
    return first.unionByName(more.join(first.select("code"), "code", "left_anti"))


def code_order(items: DataFrame) -> DataFrame:
    """(code, pos): the codes of the annex of long stays as they come, which is what a range of codes means."""
    first = items.where(F.contains("title", F.lit(LONG))).groupBy("code").agg(F.min(F.struct("doc_ord", "pos")).alias("at"))
    return first.select("code", (F.row_number().over(Window.orderBy("at")) - 1).alias("pos"))  # a row per code


def bridges(docs: DataFrame) -> DataFrame:
    """R2: a requirement met by the programme; the settled status requires the one that is named after it."""
    rows = docs.select("doc_ord", "title", F.explode(groups(F.col("body"), BRIDGE, 1)).alias("x")).select("doc_ord", "title", "x.pos", facts.normalised(F.col("x.a")).alias("name"))
    met = triples(rows, 2, F.col("name"), "SATISFIED_BY", F.lit(PROGRAMME))
    return met.unionByName(triples(rows.where(F.startswith("name", F.lit(SETTLEMENT))), 3, F.lit(SETTLED_CODE), "REQUIRES", F.col("name")))


def naturalisation(docs: DataFrame) -> DataFrame:
    """Kinds of naturalisation that require a settled status, which a code satisfies."""
    rows = docs.select("doc_ord", "title", F.explode(groups(F.col("body"), NATURALISED, 1, 2)).alias("x")).select("doc_ord", "title", "x.*")
    status = F.concat(F.lit(f"{SETTLED}("), F.col("b"), F.lit(")"))
    return triples(rows, 4, F.col("a"), "REQUIRES", status).unionByName(triples(rows, 5, status, "SATISFIED_BY", F.col("b")))


def tagged(docs: DataFrame) -> DataFrame:
    """Codes among the tags of a guide (documents with tags) allow its procedure, unless nearly all of them do."""
    own = F.filter("tags", lambda x: F.rlike(x, F.lit(TAG_CODE)))
    rows = docs.where(F.get("tags", F.lit(0)) == GUIDE).withColumn("codes", own).where(F.size("codes").between(1, MOST_CODES))
    return triples(rows.select("doc_ord", "title", F.posexplode("codes").alias("pos", "code")), 6, F.col("code"), "ALLOWS", F.col("title"))


def spotted(lines: DataFrame) -> DataFrame:
    """(doc_ord, title, n, kind, start, stop, said, near, behind): where periods and procedures stand in lines, with the
    words around each and right behind it. Spark's own functions tell the text of every match and the place of the
    first only. A line may be very long: what leaves a task is what stands near a match, not the line."""
    kinds = {"period": re.compile(PERIOD), "procedure": re.compile(PROCEDURE)}

    def spot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every = ((row, kind, m) for row in b.itertuples(index=False, name=None) for kind, p in kinds.items() for m in p.finditer(row[3]))
            hits = [(*row[:3], kind, m.start(), m.end(), m[0], row[3][max(0, m.start() - NEAR) : m.end() + NEAR], row[3][m.end() : m.end() + 8]) for row, kind, m in every]
            yield pd.DataFrame(hits, columns=["doc_ord", "title", "n", "kind", "start", "stop", "said", "near", "behind"])

    ship(lines.sparkSession)
    return lines.select("doc_ord", "title", "n", "line").mapInPandas(spot, "doc_ord long, title string, n int, kind string, start int, stop int, said string, near string, behind string")


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_ord", "title", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))


def periods(docs: DataFrame) -> DataFrame:
    """The periods that a procedure requires, PER_SUBJECT at most, its own document's first.

    The subject is the next procedure within REACH if a duty follows it, else the last one before, else the document's
    title if it names a procedure, else the longest such title in the line. A period meets procedures by blocks of
    REACH characters, so that long lines form no pairs far apart; titles are found by an automaton that reads a line once."""
    acts = lines_of(docs).where(F.rlike("line", F.lit(ACT)))
    hits = settled(spotted(acts))  # read thrice, and lines are searched once
    key = ["doc_ord", "n", "start"]
    asked = hits.where((F.col("kind") == "period") & ~F.rlike("near", F.lit(NO_REQUIREMENT)) & F.rlike("near", F.lit(ACT)))
    block = lambda c: F.floor(F.col(c) / REACH)
    names = hits.where((F.col("kind") == "procedure") & (F.char_length("said") >= 4))
    names = names.select("doc_ord", "n", F.col("start").alias("at"), F.col("said").alias("name"), F.rlike("behind", F.lit(DUTY)).alias("duty"), block("start").alias("block"))
    spread = asked.select(*key, "stop", F.explode(F.sequence(block("start") - 1, block("stop") + 1)).alias("block"))
    met = spread.join(names, ["doc_ord", "n", "block"])
    ahead = F.col("duty") & (F.col("at") - F.col("stop")).between(1, REACH)
    before = (F.col("start") - F.col("at")).between(1, REACH)
    met = met.groupBy(*key).agg(F.min_by("name", F.when(ahead, F.col("at"))).alias("after"), F.max_by("name", F.when(before, F.col("at"))).alias("before"))
    statute = F.rlike("title", F.lit(ARTICLE)) | F.contains("title", F.lit(ANNEX))
    subjects = settled(asked.join(met, key, "left").withColumn("subject", F.coalesce("after", "before", F.when(~statute, F.col("title")))))

    open_lines = acts.join(subjects.where("subject is null").select("doc_ord", "n").distinct(), ["doc_ord", "n"])
    heads = docs.where(~statute).select(F.col("title").alias("other"))
    longest = candidates.containing(open_lines.select("doc_ord", "n", "line"), ["doc_ord", "n"], "line", heads, "other", 4)
    longest = longest.groupBy("doc_ord", "n").agg(F.max_by("other", F.struct(F.char_length("other"), "other")).alias("other"))
    found = subjects.join(longest, ["doc_ord", "n"], "left").withColumn("subject", F.coalesce("subject", "other")).where("subject is not null")
    kept = facts.capped(found.withColumn("own", F.col("subject") == F.col("title")), ["subject"], [F.desc("own"), *key], PER_SUBJECT)
    return triples(kept.withColumn("pos", F.col("n").cast("long") * (1 << 31) + F.col("start")), 7, F.col("subject"), "REQUIRES", facts.normalised(F.col("said")))


def exemptions(docs: DataFrame) -> DataFrame:
    """The codes in the bullets right after a heading that exempts from a procedure."""
    lines = lines_of(docs)
    starts = facts.blocks(lines, "doc_ord", F.rlike("line", F.lit(EXEMPT)), F.startswith("line", F.lit("-")))
    heads = lines.join(starts, ["doc_ord", "n"]).select("doc_ord", "title", F.regexp_extract("line", EXEMPT, 1).alias("from"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + F.col("length"))).alias("n"))
    listed = heads.join(lines.select("doc_ord", "n", "line"), ["doc_ord", "n"])
    own = F.array_distinct(F.regexp_extract_all("line", F.lit(f"({CODE})"), F.lit(1)))
    rows = listed.select("doc_ord", "title", "from", "n", F.posexplode(own).alias("k", "code")).withColumn("pos", F.col("n").cast("long") * 1000 + F.col("k"))
    return triples(rows, 8, F.col("code"), "EXEMPT_FROM", F.col("from"))


def offices(docs: DataFrame) -> DataFrame:
    """Guides that send to the office."""
    head = F.substr("title", F.lit(1), F.lit(12))
    statute = F.contains("title", F.lit(ANNEX)) | (F.contains(head, F.lit("제")) & F.contains(head, F.lit("조")))
    rows = docs.where(~statute & F.rlike("body", F.lit(OFFICE_SAID)) & F.rlike("body", F.lit("신청|받아야"))).withColumn("pos", F.lit(0))
    return triples(rows, 9, F.trim(F.split("title", "/")[0]), "HANDLED_BY", F.lit(OFFICE))


def conversions(docs: DataFrame, order: DataFrame) -> DataFrame:
    """In each item of the settled status's annex, every code, ranges filled in by order (code, pos), converts
    to it and requires the item's conditions."""
    annexes = docs.where(F.contains("title", F.lit(SETTLED)) & F.contains("title", F.lit(ANNEX)))
    items = annexes.select("doc_ord", "title", F.posexplode(F.split("body", ITEM_SPLIT)).alias("pos", "item"))
    said = items.select("doc_ord", "pos", F.explode(F.regexp_extract_all("item", F.lit(rf"\(({CODE}(?:-[0-9]{{1,2}})?)\)"), F.lit(1))).alias("code"))
    ranges = items.select(F.struct("doc_ord", "pos").alias("id"), F.explode(groups(F.col("item"), RANGE, 1, 2)).alias("x")).select("id", "x.a", "x.b")
    filled = facts.expand_ranges(ranges, order).select("id.doc_ord", "id.pos", "code")
    codes = said.unionByName(filled).where(F.col("code") != SETTLED_CODE).distinct()
    conditions = F.filter(F.transform(F.regexp_extract_all("item", F.lit(CONDITION), F.lit(1)), facts.normalised), lambda x: F.char_length(x).between(4, 40))
    rows = items.select("doc_ord", "title", "pos", conditions.alias("conditions")).join(codes, ["doc_ord", "pos"])
    needs = rows.withColumn("need", F.explode("conditions"))
    return triples(rows, 10, F.col("code"), "CONVERTS_TO", F.lit(SETTLED_CODE)).unionByName(triples(needs, 11, F.col("code"), "REQUIRES", F.col("need")))


def rule_triples(docs: DataFrame) -> DataFrame:
    """All rules over documents (doc_ord, title, body, tags)."""
    items = named_items(docs)
    out = code_names(items)
    for more in (bridges(docs), naturalisation(docs), tagged(docs), periods(docs), exemptions(docs), offices(docs), conversions(docs, code_order(items))):
        out = out.unionByName(more)
    return out
