"""Triples into one vocabulary of names: dictionary, leaders of like names, pairs for review, and the graph they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity, text as T
from . import candidates, facts
from .store import settled, small

CODE = r"[A-H]-\d{1,2}(?:-\d)?"


def in_order(*parts: DataFrame) -> DataFrame:
    """Triples (ord, h, r, t, origin, src) of several origins as one table. Those of the first come first: ord becomes
    (part, rule, doc_ord, pos), of rules' own order or of a number."""
    every = None
    for k, p in enumerate(parts):
        ord_ = [F.col(f"ord.{c}") for c in ("rule", "doc_ord", "pos")] if dict(p.dtypes)["ord"].startswith("struct") else [F.lit(0), F.col("ord"), F.lit(0)]
        rule, doc, pos = (c.cast(t).alias(n) for c, t, n in zip(ord_, ("int", "long", "long"), ("rule", "doc_ord", "pos")))
        own = p.select(F.struct(F.lit(k).alias("part"), rule, doc, pos).alias("ord"), "h", "r", "t", "origin", "src")
        every = own if every is None else every.unionByName(own)
    return every


def dictionary(triples: DataFrame, names: DataFrame, aliases: DataFrame, code: str = CODE) -> DataFrame:
    """Triples with both ends in the words of the dictionary, and renamed_h, renamed_t.

    An end is cleaned, then its alias (alias, official), else the code in parentheses in it or that it is, else the
    code of which it is the name (names: code, label; the last code of a name), else itself. Both tables are joined, by
    broadcast where they are small."""
    official = small(settled(aliases.groupBy("alias").agg(F.max("official").alias("official"))))
    of_name = small(settled(names.where("label <> ''").groupBy("label").agg(F.max("code").alias("code_of_name"))))
    out = triples
    for end in ("h", "t"):
        x = facts.normalised(F.col(end))
        out = out.withColumn("clean", x).join(official.withColumnRenamed("alias", "clean"), "clean", "left").join(of_name.withColumnRenamed("label", "clean"), "clean", "left")
        inside = F.regexp_extract("clean", rf"\(({code})\)", 1)
        found = F.when(inside != "", inside).when(F.col("clean").rlike(rf"^(?:{code})$"), F.col("clean"))
        new = F.coalesce("official", found, "code_of_name", "clean")
        out = out.withColumn(f"renamed_{end}", new != F.col("clean")).withColumn(end, new).drop("clean", "official", "code_of_name")
    return out


def name_order(triples: DataFrame) -> DataFrame:
    """(name, n, from_rule, rank) of the ends of triples (ord, h, t, origin): names of rules first, then the
    frequent, then the short, then the first seen. Ranks are dense from 0, counted by ranges."""
    ends = triples.select("ord", "origin", F.posexplode(F.array("h", "t")).alias("side", "name"))
    names = ends.groupBy("name").agg(F.count("*").alias("n"), F.max(F.col("origin") == "rule").alias("from_rule"), F.min(F.struct("ord", "side")).alias("seen"))
    order = [F.desc("from_rule"), F.desc("n"), F.char_length("name"), F.col("seen")]
    parts = settled(names.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = parts.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("rn", within).join(F.broadcast(offset), "part").select("name", "n", "from_rule", (F.col("offset") + F.col("rn") - 1).alias("rank"))


def _two_grams(name: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.char_length(name) - 1, F.lit(1)))
    return candidates.numbered_items(F.transform(places, lambda i: F.substr(name, i, F.lit(2))))


def like_names(ranked: DataFrame, ratio: float = 92.0, inside: int = 6) -> DataFrame:
    """(early, late) ranks of names with the same digits of which the later is alike (ratio or more) or contains the
    earlier (of `inside` characters or more).

    Alike names meet by rare 2-grams: every insertion or deletion costs two of them, and the ratio bounds how many there
    are. Contained names are found by an automaton."""
    names = settled(ranked.select("rank", "name", T.digit_key(F.col("name")).alias("digits")))
    miss = 1 - ratio / 100  # of both lengths together; the other is at most this much longer
    edits = F.floor(F.char_length("name") * (1 + (1 + miss) / (1 - miss)) * miss)
    sets = names.select("rank", "digits", _two_grams(F.col("name")).alias("items"), edits.alias("edits"))
    pairs = candidates.overlapping(sets, "digits", "items", F.greatest(F.size("items") - 2 * F.col("edits"), F.lit(1)))
    side = lambda c: names.select(F.col("rank").alias(c), F.col("name").alias(f"{c}_name"))
    alike = pairs.join(side("early"), "early").join(side("late"), "late").where(similarity.udfs()["ratio"]("early_name", "late_name") >= ratio).select("early", "late")
    whole = names.select(F.col("rank").alias("late"), "name", F.col("digits").alias("late_digits"))
    part = names.select(F.col("rank").alias("early"), F.col("name").alias("early_name"), "digits")
    held = candidates.containing(whole, ["late", "late_digits"], "name", part, "early_name", inside).join(part, "early_name")
    held = held.where("early < late and digits = late_digits").select("early", "late")
    return alike.unionByName(held).distinct()


def merged(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples with every name replaced by its leader's, and (name, leader, n) of the names so merged."""
    ranked = settled(name_order(triples))
    leads = settled(facts.leaders(ranked.select("rank"), like_names(ranked)))
    named = leads.join(ranked.select("rank", "name", "n"), "rank").join(ranked.select(F.col("rank").alias("leader"), F.col("name").alias("leader_name")), "leader")
    canon = settled(named.where("rank <> leader").select("name", F.col("leader_name").alias("leader"), "n"))
    out = triples
    for end in ("h", "t"):
        out = out.join(small(canon.select(F.col("name").alias(end), "leader")), end, "left").withColumn(end, F.coalesce("leader", end)).drop("leader")
    return out.where("h <> t"), canon


def review_pairs(names: DataFrame, least: float = 70.0, shortest: int = 5) -> DataFrame:
    """(a, b, score) of names (name, rank) with the same digits whose token-set ratio is `least` or more, the
    shorter, of `shortest` characters or more, first. For a person to judge; nothing is merged.

    Of one of two such names, the other has at least the share ratio / (2 - ratio) of the characters, whichever way the
    ratio comes about: the rarest of its characters, so many that one must be common, meet all of the other's."""
    n = names.where(F.char_length("name") >= shortest).select("rank", "name", F.char_length("name").alias("size"), T.digit_key(F.col("name")).alias("digits"))
    n = settled(n.withColumn("words", F.array_distinct(F.filter(F.split("name", r"(?U)\s+"), lambda w: w != ""))))
    ratio, joined = least / 100, F.array_join("words", " ")
    sets = n.select("rank", "digits", candidates.numbered_items(F.filter(F.split(F.array_join("words", ""), ""), lambda c: c != "")).alias("items"), (F.ceil(F.char_length(joined) * ratio / (2 - ratio) - 1e-9) - F.size("words") + 1).alias("need"))
    keys = candidates.rarest(sets, ["rank", "digits"], "items", F.least(F.greatest(F.size("items") - F.col("need") + 1, F.lit(1)), F.size("items")))
    other = sets.select(F.col("rank").alias("other"), "digits", F.explode("items").alias("item"))
    pairs = keys.join(other, ["digits", "item"]).where("rank <> other").select(F.least("rank", "other").alias("early"), F.greatest("rank", "other").alias("late")).distinct()
    side = lambda c: n.select(F.col("rank").alias(c), F.struct("size", "rank", "name").alias(f"{c}_side"))
    pairs = pairs.join(side("early"), "early").join(side("late"), "late").select(F.least("early_side", "late_side")["name"].alias("a"), F.greatest("early_side", "late_side")["name"].alias("b"))
    return pairs.withColumn("score", similarity.udfs()["token_set_ratio"]("a", "b")).where(F.col("score") >= least).select("a", "b", F.floor("score").cast("int").alias("score"))


def grounding_counts(marked: DataFrame) -> DataFrame:
    """(grounded, n) of triples that facts.grounded marked."""
    return marked.groupBy((~F.endswith("origin", F.lit("-inferred"))).alias("grounded")).agg(F.count("*").alias("n"))


def graph_of(found: DataFrame, names: DataFrame, code: str = CODE) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (src, relation, dst, origin, sources, n_sources) of facts. A node is a Visa if
    it is a code or has a name; NAMED facts are names, not edges."""
    edges = found.where("r <> 'NAMED'").select(F.col("h").alias("src"), F.col("r").alias("relation"), F.col("t").alias("dst"), "origin", "sources", "n_sources")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = names.groupBy("code").agg(F.min("label").alias("label"))
    nodes = ids.join(known.withColumnRenamed("code", "id"), "id", "left")
    kind = F.when(F.col("id").rlike(rf"^(?:{code})$") | F.col("label").isNotNull(), "Visa").otherwise("")
    return nodes.select("id", kind.alias("type"), F.coalesce("label", F.lit("")).alias("label")), edges
