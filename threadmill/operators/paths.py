"""Key paths inside a question's evidence, communities of a graph and their modularity, and the schema as a drawing."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import parts
from .graph import FACT, coded, degrees, numbered
from .store import heavy_keys, settled, ship, spread_join


def shortest(facts: list[tuple[str, str, str]], start: str, goals: set[str]) -> set[tuple[str, str, str]]:
    """The facts on a shortest way, in either direction, from start to each goal; of ways of one length the one whose
    nodes sort first, and of facts between two nodes the one that sorts first."""
    near: dict[str, dict[str, tuple]] = {}
    for f in sorted(facts, reverse=True):
        near.setdefault(f[0], {})[f[2]] = near.setdefault(f[2], {})[f[0]] = f
    came, queue = {start: None}, deque([start])
    while queue:
        node = queue.popleft()
        for other in sorted(near.get(node, ())):
            if other not in came:
                came[other] = (node, near[node][other])
                queue.append(other)
    out = set()
    for node in goals & came.keys():
        while came[node]:
            node, fact = came[node]
            out.add(fact)
    return out


def key_paths(evidence: DataFrame, seeds: DataFrame, goals: DataFrame) -> DataFrame:
    """(qid, src, relation, dst): the facts of evidence (qid, src, relation, dst) on shortest ways from a question's
    seeds to its goals (qid, node), in their own direction.

    evidence has had its cap, and seeds theirs, so that what is known of one question is a short list."""
    ship(evidence.sparkSession)
    lists = evidence.groupBy("qid").agg(F.collect_list(F.struct(*FACT)).alias("facts"))
    ends = [df.groupBy("qid").agg(F.collect_set("node").alias(n)) for df, n in ((seeds, "seeds"), (goals, "goals"))]
    rows = lists.join(ends[0], "qid").join(ends[1], "qid")
    kind = dict(rows.dtypes)["qid"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, facts, starts, wanted in b[["qid", "facts", "seeds", "goals"]].itertuples(index=False, name=None):
                known = [(f["src"], f["relation"], f["dst"]) for f in facts]
                out += [(qid, *f) for f in sorted(set().union(*(shortest(known, s, set(wanted) - {s}) for s in starts)))]
            yield pd.DataFrame(out, columns=["qid", *FACT])

    return rows.mapInPandas(find, f"qid {kind}, src string, relation string, dst string")


TOLD = "part int, slot int, x binary, same binary, changed long, mark long, mark2 long"


def _most_heard(lists: parts.Lists, said: np.ndarray) -> np.ndarray:
    """Of each node of a part the label that most of its neighbours have, the smaller on ties."""
    names = None
    if said.itemsize > 4:
        names, said = np.unique(said, return_inverse=True)
    new = np.empty(len(lists.own), said.dtype)
    for i, j in lists.chunks():
        key = (np.repeat(np.arange(j - i), lists.counts[i:j]) << 32) | said[lists.near[lists.ends[i] : lists.ends[j]]]
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        row, label = key[starts] >> 32, key[starts] & 0xFFFFFFFF
        rank = (np.diff(np.r_[starts, len(key)]) << 32) | (0xFFFFFFFF - label)
        best = np.maximum.reduceat(rank, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
        new[i:j] = 0xFFFFFFFF - (best & 0xFFFFFFFF)
    return new if names is None else names[new]


def _mark(own: np.ndarray, labels: np.ndarray, odd: int) -> int:
    x = own.view("uint64") * np.uint64(odd) + labels.astype("uint64") * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return int(np.bitwise_xor.reduce(x ^ (x >> np.uint64(32))).view("int64"))


def _begin(rows: pa.Table, lists: parts.Lists, keys: list[int]) -> list[dict]:
    x = parts.narrow(rows.column("id").to_numpy()[np.argsort(rows.column("node").to_numpy())])
    out = lists.tell(keys, x=x)
    out[-1]["same"] = parts.packed(np.zeros(0, "bool"))
    return out


def _said(rows: pa.Table, column: str = "x") -> dict[int, bytes]:
    return dict(zip(rows.column("slot").to_pylist(), rows.column(column).to_pylist()))


def _unpack(rows: pa.Table, lists: parts.Lists) -> pa.Table:
    """A part's labels and what stayed the same, of one row or two -> (node, id, settled)."""
    x, same = (next((parts.unpacked(b) for b in rows.column(c).to_pylist() if b is not None), None) for c in ("x", "same"))
    return pa.table({"node": lists.own, "id": x.astype("int64"), "settled": same if same is not None and len(same) else np.zeros(len(lists.own), "bool")})


class Passed(NamedTuple):
    """nodes (name, node, id), parts of the graph and rows of hubs (node, other, w), if any, and what parts were told at
    first (ids), by the labels and one round later."""

    nodes: DataFrame
    parts: parts.Parts
    full: DataFrame | None
    first: DataFrame
    labels: DataFrame
    later: DataFrame


def both_ways(pairs: DataFrame, out_only: bool = False) -> DataFrame:
    """(node, other, w) of pairs (node, other), each in both directions and counting one, or once where a flag `once` says
    so. out_only: only in its own direction."""
    one = F.when(F.col("once"), F.lit(parts.ONCE)).otherwise(1) if "once" in pairs.columns else F.lit(1).cast("long")
    back = F.lit(0).cast("long") if out_only else one
    ends = F.array(F.struct("node", "other", one.alias("w")), F.struct(F.col("other").alias("node"), F.col("node").alias("other"), back.alias("w")))
    return pairs.where("node is not null and other is not null").select(F.explode(ends).alias("x")).select("x.*")


def passed(edges: DataFrame, rounds: int | None = None, most_rounds: int = 100, name: Callable[[Column], Column] | None = None, out_only: bool = False, per_part: int | None = None) -> Passed:
    """Label passing as in communities. Where nodes have numbers already, edges are (node, other), longs, perhaps with a
    flag `once` for rows that count once between the same nodes, however many there are, and name tells a number's name.
    out_only: weights are those of edges in their own direction.

    Nodes are longs and labels places in the order of names. A graph is dealt into parts, whose lists of neighbours stay
    where they are; in a round, a node's label goes once to each part that has a neighbour of it. Hubs hear labels as rows."""
    if name is None:
        nodes, pairs = coded(edges, ordered=True)
        graph, full = parts.deal(both_ways(pairs, out_only), per_part)
    else:
        graph, full = parts.deal(both_ways(edges, out_only), per_part)
        nodes = settled(numbered(parts.nodes(graph).withColumn("name", name(F.col("node"))), "name", ["node"]))
    if full is not None:
        full = settled(full)
        busy = full.select("node", "other")
        busy = settled(busy.unionByName(busy.select("node", F.col("node").alias("other"))).distinct())
    keys = graph.keys
    told = first = settled(parts.turn(graph, parts.by_node(graph, nodes.select("node", "id")), lambda rows, lists: _begin(rows, lists, keys), TOLD))
    seen = set()
    for k in range(most_rounds + 1):
        heard = {}
        if full is not None:
            met = busy.join(unpacked(graph, told).select(F.col("node").alias("other"), F.col("id").alias("label")), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
            heard = {r.node: r.label for r in met.groupBy("node").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")).collect()}  # hubs alone

        def step(rows: pa.Table, lists: parts.Lists, heard: dict[int, int] = heard) -> list[dict]:
            said = lists.hear(_said(rows))
            was, new = said[lists.mine], _most_heard(lists, said)
            for node in set(heard) & set(lists.own[np.isin(lists.own, list(heard))].tolist()):
                new[np.searchsorted(lists.own, node)] = heard[node]
            out = lists.tell(keys, x=new)
            same = new == was
            out[-1] |= {"same": parts.packed(same), "changed": int((~same).sum()), "mark": _mark(lists.own, new, 0x165667B19E3779F9), "mark2": _mark(lists.own, new, 0x27D4EB2F165667C5)}
            return out

        new = settled(parts.turn(graph, told, step, TOLD))
        changed, *mark = new.where("same is not null").agg(F.sum("changed"), F.bit_xor("mark"), F.bit_xor("mark2")).first()
        if not changed or tuple(mark) in seen or k == rounds:
            return Passed(nodes, graph, full, first, told, new)
        seen.add(tuple(mark))
        told = new
    raise RuntimeError(f"{changed} nodes not settled after {most_rounds} rounds")


def unpacked(graph: parts.Parts, told: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """(node, id, settled): labels as rows, and whether they are the same later."""
    own = told.where("same is not null").select("part", "x", F.lit(None).cast("binary").alias("same"))
    if later is not None:
        own = own.unionByName(later.where("same is not null").select("part", F.lit(None).cast("binary").alias("x"), "same"))
    return parts.turn(graph, own, _unpack, "node long, id long, settled boolean")


def communities(edges: DataFrame, rounds: int | None = None, most_rounds: int = 100, name: Callable[[Column], Column] | None = None, per_part: int | None = None) -> DataFrame:
    """(node, community, settled) by label passing, both ways: a node takes the label that most of its neighbours and
    itself have, the smaller on ties, until no label changes, or until the labels are those of an earlier round: then
    they go round for ever, and of those in turn the last are given. settled is false for a node that would still change.
    With `rounds`, the labels after so many. Raises an error if labels still change after most_rounds. See passed."""
    p = passed(edges, rounds, most_rounds, name, per_part=per_part)
    found = settled(unpacked(p.parts, p.labels, p.later).join(p.nodes.select("node", "name"), "node").select("name", "id", "settled"))
    p.parts.held.unpersist()
    named = spread_join(found, p.nodes.select("id", F.col("name").alias("community")), "id", heavy_keys(found, "id"))
    return named.select(F.col("name").alias("node"), "community", "settled")


def worth(graph: parts.Parts, told: DataFrame) -> DataFrame:
    """One row, modularity, of the labels that parts were told of: summed up in each part by label before sums meet."""

    def sums(rows: pa.Table, lists: parts.Lists) -> pa.Table:
        said = lists.hear(_said(rows))
        row, w = np.repeat(np.arange(len(lists.own)), lists.counts), lists.w.astype("int64")
        at, to, mine = said[lists.mine][row], said[lists.near], lists.mine.start + row
        inside = np.where(at == to, w, 0)
        if len(lists.busy):  # a hub's edges to others are in their lists only
            busy = np.zeros(lists.bounds[-1], "bool")
            busy[lists.busy] = True
            twice = busy[lists.near] & ~busy[mine]
            at, inside, w = np.concatenate([at, to[twice]]), np.concatenate([inside, inside[twice]]), np.concatenate([w, w[twice]])
        label, group = np.unique(at, return_inverse=True)
        return pa.table({"label": label.astype("int64"), "d": np.bincount(group, w, len(label)).astype("int64"), "inside": np.bincount(group, inside, len(label)).astype("int64")})

    found = parts.turn(graph, told.select("part", "slot", "x"), sums, "label long, d long, inside long").groupBy("label").agg(F.sum("d").alias("d"), F.sum("inside").alias("inside"))
    # d counts an edge at both ends
    found = found.agg(F.sum("d").alias("d"), F.sum("inside").alias("inside"), F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return found.select((F.col("inside") / F.col("d") - F.col("squares") / F.col("d") / F.col("d")).alias("modularity"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row, modularity: the share of edges inside communities less what degrees alone would give."""
    edges, membership = settled(edges.select(*FACT)), settled(membership.select("node", "community"))
    a, b = (membership.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    inside = edges.join(a, "src").join(b, "dst").agg(F.count("*").alias("m"), F.count_if(F.col("c_src") == F.col("c_dst")).alias("inside"))
    sizes = degrees(edges).join(membership, "node").groupBy("community").agg(F.sum("degree").alias("d")).agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return inside.crossJoin(sizes).select((F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))  # two rows of one


def community_facts(edges: DataFrame, membership: DataFrame, most: int = 60) -> DataFrame:
    """(community, place, src, relation, dst): the first facts inside each community, for its summary."""
    membership = settled(membership.select("node", "community"))
    a, b = (membership.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    inside = edges.join(a, "src").join(b, "dst").where("c_src = c_dst").select(F.col("c_src").alias("community"), *FACT)
    return inside.withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy(*FACT))).where(F.col("place") <= most)


def first_facts(p: Passed, relation: Callable[[Column, Column], Column], most: int = 60) -> DataFrame:
    """What community_facts tells, of label passing with out_only, where relation tells an edge's from the names of its
    ends. Parts give the facts of each community's first subjects, as many as have `most` together, and these meet."""

    def firsts(rows: pa.Table, lists: parts.Lists) -> pa.Table:
        said, ids = lists.hear(_said(rows.filter(rows.column("labels").is_valid()), "labels")), lists.hear(_said(rows.filter(rows.column("ids").is_valid()), "ids"))
        row = np.repeat(np.arange(len(lists.own)), lists.counts)
        label, mine = said[lists.mine], ids[lists.mine]
        at = np.flatnonzero((lists.w > 0) & (label[row] == said[lists.near]))
        n = np.bincount(row[at], lists.w[at], len(lists.own)).astype("int64")
        order = np.flatnonzero(n)
        order = order[np.lexsort((mine[order], label[order]))]
        before = np.cumsum(n[order]) - n[order]  # facts of earlier subjects, of a community less those of communities before
        new = np.r_[True, label[order][1:] != label[order][:-1]] if len(order) else np.empty(0, "bool")
        kept = np.zeros(len(lists.own), "bool")
        kept[order[before - (before[new][np.cumsum(new) - 1] if len(order) else 0) < most]] = True
        at = at[kept[row[at]]]
        return pa.table({"label": label[row[at]].astype("int64"), "src_id": mine[row[at]].astype("int64"), "dst_id": ids[lists.near[at]].astype("int64"), "copies": lists.w[at].astype("int64")})

    none = F.lit(None).cast("binary")
    told = p.labels.select("part", "slot", F.col("x").alias("labels"), none.alias("ids")).unionByName(p.first.select("part", "slot", none.alias("labels"), F.col("x").alias("ids")))
    found = parts.turn(p.parts, told, firsts, "label long, src_id long, dst_id long, copies long")
    if p.full is not None:
        ends = unpacked(p.parts, p.labels).select("node", F.col("id").alias("label")).join(p.nodes.select("node", "id"), "node")
        w = F.sum("w")
        facts = p.full.where("w > 0 and not (node = other)").groupBy("node", "other").agg((w % parts.ONCE + F.when(w >= parts.ONCE, 1).otherwise(0)).alias("copies"))
        facts = facts.where(~F.col("other").isin(p.parts.hubs))  # those between hubs are in lists
        facts = facts.join(ends.select("node", "label", F.col("id").alias("src_id")), "node").join(ends.select(F.col("node").alias("other"), F.col("label").alias("to"), F.col("id").alias("dst_id")), "other")
        found = found.unionByName(facts.where("label = to").select("label", "src_id", "dst_id", "copies"))
    earlier = Window.partitionBy("label").orderBy("src_id").rangeBetween(Window.unboundedPreceding, -1)
    found = settled(settled(found).withColumn("before", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).where(F.col("before") < most))
    for end, at in (("src", "src_id"), ("dst", "dst_id"), ("community", "label")):
        found = found.join(p.nodes.select(F.col("id").alias(at), F.col("name").alias(end)), at)
    facts = found.select("community", "src", relation(F.col("src"), F.col("dst")).alias("relation"), "dst", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy(*FACT))).where(F.col("place") <= most)


def schema_drawing(counts: DataFrame, signatures: list[tuple[str, str, str]], spine: list[str]) -> DataFrame:
    """(relation, line): a Mermaid line for each relation of the schema (from, relation, to) with its count
    (relation, n), thick for the spine."""
    names = counts.sparkSession.createDataFrame(signatures, "a string, relation string, b string")
    arrow = F.when(F.col("relation").isin(spine), "==>").otherwise("-->")
    line = F.concat("a", F.lit(" "), arrow, F.lit("|"), "relation", F.lit(" "), F.coalesce("n", F.lit(0)).cast("string"), F.lit("| "), "b")
    return names.join(counts, "relation", "left").select("relation", line.alias("line"))
