"""Property graphs as edge tables (src, relation, dst): neighbours, degrees, bounded walks, evidence, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import heavy_keys, settled, small, spread_join

FACT = ["src", "relation", "dst"]


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, src, relation, dst, other): each edge seen from both ends, in its own direction."""
    out = edges.select(F.col("src").alias("node"), *FACT, F.col("dst").alias("other"))
    return out.unionByName(edges.where("src <> dst").select(F.col("dst").alias("node"), *FACT, F.col("src").alias("other")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at a node, parallel ones counted; a column `copies` tells how many rows an edge stands for."""
    n = F.sum("copies") if "copies" in edges.columns else F.count("*")
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), *(["copies"] if "copies" in edges.columns else [])).groupBy("node").agg(n.alias("degree"))


def hubs(edges: DataFrame, blocked: Column, least: int = 12, passable: Column | None = None) -> DataFrame:
    """Nodes that a walk may reach but not pass: blocked ones and those of a high degree that aren't passable, as codes
    are. Seeds need no exemption: a walk expands them before it meets them."""
    busy = F.col("degree") >= least
    return degrees(edges).where(blocked | (busy if passable is None else busy & ~passable)).select("node")


def walk(edges: DataFrame, seeds: DataFrame, closed: DataFrame, hops: int) -> DataFrame:
    """(qid, src, relation, dst, hop): facts within hops of a question's seeds (qid, node), with their least hop.

    Breadth first, both ways. A node is expanded once, at its first discovery; closed nodes are reached, never passed.
    Each round is a join of the frontier, so that a few questions or many share one plan. Nodes with very many facts are
    joined in slices. edges should be settled or a stored table: they are read in every round, and travel as narrow rows."""
    near = edges.select(F.col("src").alias("node"), "relation", F.col("dst").alias("other"), F.lit(True).alias("out"))
    near = near.unionByName(edges.where("src <> dst").select(F.col("dst").alias("node"), "relation", F.col("src").alias("other"), F.lit(False).alias("out")))
    src, dst = F.when(F.col("out"), F.col("node")).otherwise(F.col("other")), F.when(F.col("out"), F.col("other")).otherwise(F.col("node"))
    heavy = heavy_keys(near, "node")
    frontier = seen = seeds.select("qid", "node").distinct()
    found = None
    for hop in range(1, hops + 1):
        step = spread_join(near, frontier, "node", heavy).select("qid", src.alias("src"), "relation", dst.alias("dst"), "other")
        if hop < hops:
            step = settled(step)  # feeds the facts of this hop and the frontier of the next
        now = step.select("qid", *FACT).withColumn("hop", F.lit(hop))
        found = now if found is None else found.unionByName(now)
        if hop < hops:
            frontier = settled(step.select("qid", F.col("other").alias("node")).distinct().join(closed, "node", "left_anti").join(seen, ["qid", "node"], "left_anti"))
            seen = seen.unionByName(frontier)
    return found.groupBy("qid", *FACT).agg(F.min("hop").alias("hop"))


def question_words(question: Column) -> Column:
    """The words of a question, parted at white space and marks, of two characters or more."""
    return F.filter(F.split(question, r"(?U)[\s,.?!·]+"), lambda w: F.char_length(w) >= 2)


def in_question(words: Column, *names: Column) -> Column:
    """Whether one of the words is part of a name (null or empty names have none)."""
    return F.exists(words, lambda w: F.greatest(*(F.coalesce(F.contains(n, w), F.lit(False)) for n in names), F.lit(False)))


def accepted(walked: DataFrame, seeds: DataFrame, closed: DataFrame, hops: int, per_node: int = 5) -> DataFrame:
    """(qid, src, relation, dst, hop, score, ord): W2, the facts that a walk accepts, at most per_node new ones at every
    node it expands, best first.

    walked: (qid, src, relation, dst, base) all facts at nodes that the walk of a question expands, each once, with their
    relevance but for 3 / hop. seeds: (qid, node, place), a repeated node counts once. closed: nodes that are reached,
    not passed. See _greedy for the order."""
    facts = settled(walked.select("qid", *FACT, "base"))
    near = _both_ways(facts)
    heavy = heavy_keys(near, ["qid", "node"])
    return _greedy(lambda frontier: spread_join(near, frontier, ["qid", "node"], heavy), heavy, ["qid", "other"], seeds.select("qid", "node", "place"), closed, hops, per_node)


def accepted_walk(edges: DataFrame, seeds: DataFrame, closed: DataFrame | None, hops: int, base: Column, per_node: int = 5) -> DataFrame:
    """accepted() of all the facts that walk() finds, without a walk beforehand: nodes meet their edges once a hop.

    seeds: (qid, node, place) and what base needs to know of a question, which is the same in all of its rows. base: the
    relevance but for 3 / hop, an expression over src, relation, dst, qid and those columns. edges: each once, settled or
    a stored table, as they are read in every hop. closed may be None for one hop, where nothing is passed."""
    near = _both_ways(edges.select(*FACT))
    heavy = heavy_keys(near, "node")
    step = lambda frontier: spread_join(near, frontier, "node", heavy).withColumns(_fact()).withColumn("base", base)
    return _greedy(step, heavy, ["other"], seeds, closed, hops, per_node)


def _both_ways(facts: DataFrame) -> DataFrame:
    """facts seen from both ends: node, relation, other, way (0: outgoing) and the further columns in place of src and dst."""
    more = [c for c in facts.columns if c not in ("src", "dst")]
    side = lambda df, way, node, other: df.select(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(way).alias("way"), *more)
    return side(facts, 0, "src", "dst").unionByName(side(facts.where("src <> dst"), 1, "dst", "src"))


def _fact() -> dict[str, Column]:
    """src and dst of a fact seen from node."""
    out = F.col("way") == 0
    return {"src": F.when(out, F.col("node")).otherwise(F.col("other")), "dst": F.when(out, F.col("other")).otherwise(F.col("node"))}


def _greedy(step: Callable[[DataFrame], DataFrame], heavy: DataFrame | None, hot: list[str], seeds: DataFrame, closed: DataFrame | None, hops: int, per_node: int) -> DataFrame:
    """What accepted() gives. step: the frontier (qid, node, at, ...) with a row for each fact at its nodes (other,
    relation, way, base). heavy: the slices of keys of many facts, which `hot` names, seen from the other end.

    Nodes are expanded in the order in which they are found, a node's facts in the order of score, outgoing ones first and
    by name on ties; a fact left over at one end may be accepted at its other. ord orders the facts of a question: the hop
    and then the way to the fact, whose steps sort as the walk takes them, so no question is numbered as a whole.

    Each hop's facts meet the expanded nodes at their other ends once: that tells which are taken there, which are tied
    to a node of the same hop, and which ends are new. A node takes per_node facts at most, so a row has all that it took.
    A node's best facts are windows over (qid, node) with a limit that tasks apply
    before they shuffle. Only a fact between two nodes of one hop ties their choices together: the earlier node has the
    first say. Such choices are made anew until none changes, which a node's earlier neighbours bound; so a question, or
    a seed of any degree, is never one task's group."""
    more = [c for c in seeds.columns if c not in ("qid", "node", "place")]
    known = [F.first(c).alias(c) for c in more]
    key = F.struct((-F.col("base")).alias("minus"), "way", *FACT)
    first = F.struct(F.col("place").cast("double").alias("minus"), F.lit(0).alias("way"), F.col("node").alias("src"), F.lit("").alias("relation"), F.lit("").alias("dst"))
    frontier = settled(seeds.groupBy("qid", "node").agg(F.min(F.array(first)).alias("at"), *known))
    if heavy is not None:
        heavy = heavy.select(*(F.col("node").alias("other") if c == "other" else c for c in hot), "slices")
    if hops > 1:
        shut = settled(closed.select(F.col("node").alias("other")).distinct())
    fact, took = ["qid", *FACT], "array<struct<src: string, relation: string, dst: string>>"
    expanded = taken = None

    def best(rows: DataFrame) -> DataFrame:
        """The first per_node rows of each node."""
        ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "node").orderBy(F.desc("base"), "way", *FACT)))
        return ranked.where(F.col("rn") <= per_node).drop("rn")

    for hop in range(1, hops + 1):
        ends = frontier.select("qid", F.col("node").alias("other"), F.col("at").alias("other_at"), F.lit(None).cast(took).alias("took"))
        if expanded is not None:
            ends = ends.unionByName(expanded)
        carried = ["at", *more] if hop < hops else []  # the last hop's rows are most, and its way is added to the best
        here = step(frontier).select("qid", "node", *carried, "other", "relation", "way", "base")
        met = _met(here, ends.withColumn("seen", F.lit(True)), heavy, hot).withColumns(_fact())
        met = met.where(~F.coalesce(F.array_contains("took", F.struct(*FACT)), F.lit(False)))
        tied = F.col("other_at").isNotNull() & (F.col("other") != F.col("node"))
        rows = settled(met.select("qid", "node", *carried, "other", "relation", "way", "base", "other_at", F.coalesce("seen", F.lit(False)).alias("seen"), tied.alias("tied"))).withColumns(_fact())
        bound = rows.where("tied")
        if bound.isEmpty():
            mine = best(rows)
        else:
            if hop == hops:
                bound = spread_join(bound, frontier.select("qid", "node", "at"), ["qid", "node"], heavy_keys(bound, ["qid", "node"]))
            bound = settled(bound.withColumn("late", F.col("other_at") < F.col("at")).select(*rows.columns, "late"))
            sure = settled(best(rows.where("not tied").withColumn("late", F.lit(False)).unionByName(bound.where("not late"))))
            unsure, gone = bound.where("late"), settled(sure.where("tied").select(*fact))
            while True:
                mine = settled(best(sure.unionByName(unsure.join(gone, fact, "left_anti").select(*sure.columns))))
                said = settled(mine.where("tied and not late").select(*fact))
                if said.join(gone, fact, "left_anti").isEmpty() and gone.join(said, fact, "left_anti").isEmpty():
                    break
                gone = said
        if hop == hops:
            mine = mine.join(frontier.select("qid", "node", "at"), ["qid", "node"])  # parted as the windows are
        way = F.concat("at", F.array(key))
        now = mine.select("node", *fact, F.lit(hop).alias("hop"), (3.0 / F.lit(hop) + F.col("base")).alias("score"), F.struct(F.lit(hop).alias("hop"), way.alias("way")).alias("ord"))
        if hop < hops:
            now = settled(now)
            own = now.groupBy("qid", F.col("node").alias("other")).agg(F.collect_list(F.struct(*FACT)).cast(took).alias("took"))
            done = frontier.select("qid", F.col("node").alias("other")).join(own, ["qid", "other"], "left").select("qid", "other", F.lit(None).cast(dict(frontier.dtypes)["at"]).alias("other_at"), "took")
            expanded = settled(done if expanded is None else expanded.unionByName(done))
            new = rows.where("not seen").join(small(shut), "other", "left_anti")
            frontier = settled(new.groupBy("qid", "other").agg(F.min(way).alias("at"), *known).withColumnRenamed("other", "node"))
        taken = now if taken is None else taken.unionByName(now)
    return taken.drop("node")


def _met(here: DataFrame, ends: DataFrame, heavy: DataFrame | None, hot: list[str]) -> DataFrame:
    """here with the row of its other end in ends, or none. Rows at ends of very many facts are dealt into slices."""
    if heavy is None:
        return here.join(ends, ["qid", "other"], "left")
    dealt = F.pmod(F.xxhash64("qid", "node", "relation", "way"), F.coalesce("slices", F.lit(1))).cast("int")
    rows = here.join(heavy, hot, "left").withColumn("slice", dealt).drop("slices")
    copies = ends.join(heavy, hot, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return rows.join(copies, ["qid", "other", "slice"], "left").drop("slice")


def relevance(hop: Column, relation: Column, at_seed: Column, in_question: Column, spine: list[str]) -> Column:
    return 3.0 / hop + F.when(relation.isin(spine), 2.0).otherwise(0.0) + F.when(at_seed, 1.0).otherwise(0.0) + F.when(in_question, 1.5).otherwise(0.0)


def within_budget(scored: DataFrame, budget: dict[str, int], default: int, cap: Column | int, ties: list[str] = FACT) -> DataFrame:
    """The best facts of each question: so many per relation, then so many in all. Skipping a fact over its relation's
    budget changes nothing for others, so two ranks are the greedy choice exactly. The largest budget is a limit that
    tasks apply before they shuffle."""
    order = [F.desc("score"), *ties]
    most = F.lit(default)
    for r, n in budget.items():
        most = F.when(F.col("relation") == r, n).otherwise(most)
    top = scored.withColumn("in_relation", F.row_number().over(Window.partitionBy("qid", "relation").orderBy(*order))).where((F.col("in_relation") <= max([default, *budget.values()])) & (F.col("in_relation") <= most))
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return top.where(F.col("place") <= cap).drop("in_relation")


def relation_counts(edges: DataFrame, declared: list[str]) -> DataFrame:
    """(relation, n): declared relations without edges count 0."""
    names = edges.sparkSession.createDataFrame([(r,) for r in declared], "relation string")
    return names.join(edges.groupBy("relation").agg(F.count("*").alias("n")), "relation", "left").select("relation", F.coalesce("n", F.lit(0)).alias("n"))


def node_types(edges: DataFrame, rules: list[tuple[str, str, str]], default: str = "Other", stored: DataFrame | None = None, known: list[str] = (), codes: dict[str, str] | None = None, sized: bool = False) -> DataFrame:
    """(node, type, degree if sized): the type that is stored for a node (node, type), if it is a known one; else the type of the first
    pattern of codes that is all of the node; else by the relations at it, the first rule (type, 'out' or 'in', relation)
    that holds. A node without edges has a row if it is stored; of several stored types the least known one counts."""
    end = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("way")))).alias("end")
    ends = edges.select("relation", end).select("end.*", "relation")
    # a flag for each rule and a count, which tasks add up before they shuffle
    holds = [F.coalesce(F.bool_or((F.col("way") == way) & (F.col("relation") == r)), F.lit(False)).alias(f"rule{k}") for k, (_, way, r) in enumerate(rules)]
    sets = ends.groupBy("node").agg(F.count("*").alias("degree"), *holds)
    kind = F.lit(default)
    for k, (t, *_) in reversed(list(enumerate(rules))):
        kind = F.when(F.col(f"rule{k}"), t).otherwise(kind)
    for pattern, t in reversed((codes or {}).items()):
        kind = F.when(F.rlike("node", F.lit(f"^(?:{pattern})\\z")), t).otherwise(kind)
    if stored is not None:
        own = stored.groupBy("node").agg(F.min(F.when(F.col("type").isin(list(known)), F.col("type"))).alias("own"))
        sets = sets.join(own, "node", "full")
        kind = F.coalesce("own", kind)
    return sets.select("node", kind.alias("type"), *(["degree"] if sized else []))


def drawn(edges: DataFrame, spine: list[str], wide: float = 2.5) -> DataFrame:
    """(src, relation, dst, width) of edges in a drawing, those of the spine's relations wider than 1."""
    return edges.select(*FACT, F.when(F.col("relation").isin(spine), wide).otherwise(1.0).alias("width"))


def numbered(names: DataFrame, name: str, more: list[str] | None = None) -> DataFrame:
    """(name, id): distinct names with their place in order, from 0, counted by ranges. With `more`, names are distinct
    already and have these columns too."""
    once = names.select(name).distinct() if more is None else names.select(name, *more)
    parts = settled(once.repartitionByRange(name).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    return parts.withColumn("place", place).join(F.broadcast(offset), "part").select(name, *(more or []), (F.col("offset") + F.col("place")).alias("id"))


def coded(edges: DataFrame, ordered: bool = False, code: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Names as longs: nodes (name, node, with id, the name's place in order, if `ordered`) and pairs (node, other), a row
    for each edge without null ends. The code is a hash, so that no edge is joined for it; where two names share one, which
    is looked for, their places are the code instead."""
    ends = edges.where("src is not null and dst is not null")
    names = ends.select(F.explode(F.array("src", "dst")).alias("name"))
    nodes = settled(numbered(names, "name") if ordered else names.distinct()).withColumn("node", code(F.col("name")))
    if nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return nodes, ends.select(code(F.col("src")).alias("node"), code(F.col("dst")).alias("other"))
    places = nodes.drop("node") if ordered else settled(numbered(nodes, "name"))
    nodes, rows = places.withColumn("node", F.col("id")), settled(ends.select("src", "dst"))
    pairs = settled(spread_join(rows, places.select(F.col("name").alias("src"), F.col("id").alias("node")), "src", heavy_keys(rows, "src")))
    pairs = spread_join(pairs, places.select(F.col("name").alias("dst"), F.col("id").alias("other")), "dst", heavy_keys(pairs, "dst"))
    return nodes if ordered else nodes.drop("id"), pairs.select("node", "other")


def _roots(up: DataFrame, most_rounds: int) -> DataFrame:
    """(node, root) of pointers (node, root) that lead to smaller nodes or to the node itself: each followed to its end,
    twice as far in every round."""
    for _ in range(most_rounds):
        beyond = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        new = settled(spread_join(up, beyond, "root", heavy_keys(up, "root")).select("node", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")))
        up = new.select("node", "root")
        if new.where("moved").isEmpty():
            return up
    raise RuntimeError(f"pointers not followed in {most_rounds} rounds")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that edges lead to. Each node points to its smallest neighbour if that is
    smaller; the trees of these pointers become the nodes of the next round, of which there are half as many at most, and
    edges between them are kept once. Edges meet their ends' trees in slices where these are many, and names only at the
    end. Every round is stored in the shared folder."""
    nodes, pairs = coded(edges)
    once = lambda a, b: (F.least(a, b).alias("node"), F.greatest(a, b).alias("other"))
    found, pairs = None, settled(pairs.where("node <> other").select(*once("node", "other")))  # repeated ones go with the first round
    for _ in range(most_rounds):
        if pairs.isEmpty():
            break
        # of a pair (smaller, greater) either end is a node, and only the greater may point to the other
        up = pairs.select(F.explode(F.array(F.struct("node", F.col("node").alias("root")), F.struct(F.col("other").alias("node"), F.col("node").alias("root")))).alias("x")).groupBy("x.node").agg(F.min("x.root").alias("root"))
        up = _roots(settled(up), most_rounds)
        for end, heavy in [(end, heavy_keys(pairs, end)) for end in ("node", "other")]:
            at = up.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            pairs = spread_join(pairs, at, end, heavy).drop(end).withColumnRenamed(f"{end}_root", end)
        pairs = settled(pairs.where("node <> other").select(*once("node", "other")).distinct())
        if found is None:
            found = up
        else:
            later = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            found = settled(spread_join(found, later, "root", heavy_keys(found, "root"), "left").select("node", F.coalesce("beyond", "root").alias("root")))
    else:
        raise RuntimeError(f"edges left after {most_rounds} rounds")
    if found is None:  # loops alone
        return nodes.select(F.col("name").alias("node"), F.col("name").alias("component"))
    named = settled(nodes.join(found, "node", "left").select("name", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("name").alias("component"))
    return spread_join(named, least, "root", heavy_keys(named, "root")).select(F.col("name").alias("node"), "component")
