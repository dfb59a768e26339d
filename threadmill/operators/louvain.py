"""Communities by Louvain's method: nodes move to the neighbouring community of the highest gain in modularity, which
partitions with all their edges at hand find; then communities become the nodes of the next level."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import parts, paths
from .graph import coded
from .store import heavy_keys, settled, ship, spread_join

#: Rows of neighbours up to which a graph is moved one by one in a task.
EDGES_PER_TASK = 1 << 20
#: The chance that a wish has at most, that of the first turn, and gains that count as none.
MOST, FIRST, LEAST = 0.5, 0.5, 1e-9
#: Multiplies a number to an order like a random one, without two alike.
MIX = np.uint64(0x9E3779B97F4A7C15)


def moved(rows: pd.DataFrame, twice: int, least_gain: float) -> pd.DataFrame:
    """One part's rows -> (node, to, inner): the community of each of its nodes after moves one by one, and the weight of
    its edges to the community it had before.

    rows: a row for each node (other null; its k, community c and that one's tot), and one for each edge of them (node,
    other, w, and c and tot of other). Communities of other parts' nodes stand still meanwhile. Nodes go in order, round
    after round, until a round gains less than least_gain in modularity."""
    own = rows[rows["other"].isna()].sort_values("node")
    ids, k, c = own["node"].tolist(), own["k"].astype("int64").tolist(), own["c"].tolist()
    place = {n: i for i, n in enumerate(ids)}
    tot = dict(zip(rows["c"].tolist(), rows["tot"].tolist()))
    inside: list[list] = [[] for _ in ids]
    beyond: list[dict] = [{} for _ in ids]
    inner = [0] * len(ids)
    edges = rows[rows["other"].notna()].sort_values(["node", "other"])
    for node, other, w, at in zip(edges["node"].tolist(), edges["other"].astype("int64").tolist(), edges["w"].astype("int64").tolist(), edges["c"].tolist()):
        i = place[node]
        if at == c[i]:
            inner[i] += w
        j = place.get(other)
        if j is None:
            beyond[i][at] = beyond[i].get(at, 0) + w
        else:
            inside[i].append((j, w))
    while True:
        won = 0.0
        for i in range(len(ids)):
            links = dict(beyond[i])
            for j, w in inside[i]:
                links[c[j]] = links.get(c[j], 0) + w
            now = c[i]
            best, high = now, links.get(now, 0) - k[i] * (tot[now] - k[i]) / twice
            low = high
            for at, w in links.items():
                gain = w - k[i] * (tot[at] - (k[i] if at == now else 0)) / twice
                if gain > high + LEAST or (at < best and best != now and abs(gain - high) <= LEAST):
                    best, high = at, gain
            if best != now:
                tot[now] -= k[i]
                tot[best] += k[i]
                c[i] = best
                won += 2 * (high - low) / twice
        if won < least_gain:
            return pd.DataFrame({"node": ids, "to": c, "inner": inner})


def wishes(need: pa.Table, lists: pa.Table, twice: int) -> pa.Table:
    """Not used by louvain any more, which has _wish. One part's rows -> (node, to, inner, slack, k, loops, c) of its own nodes: the neighbouring community of the highest
    gain in modularity (the smallest of equal ones; its own if none gains), the weight of a node's edges to its own, and
    by how much more the totals of the two could change before the move gains nothing.

    need: (node, own, c, tot, k, loops) of the part's nodes and their neighbours. lists: (node, others, ws)."""
    of = {n: need.column(n).to_numpy() for n in ("node", "own", "c", "k", "loops", "tot")}
    order = np.argsort(of["node"])
    of = {n: x[order] for n, x in of.items()}
    ids, k = of["node"], of["k"].astype(float)
    labels, at = np.unique(of["c"].astype("uint64") * MIX, return_inverse=True)
    tot = np.zeros(len(labels))
    tot[at] = of["tot"]
    others = lists.column("others").combine_chunks()
    row = np.repeat(np.searchsorted(ids, lists.column("node").to_numpy()), pc.list_value_length(others).to_numpy())
    key = row * len(labels) + at[np.searchsorted(ids, others.flatten().to_numpy())]
    order = np.argsort(key)
    key = key[order]
    low, high, best, inner = -k * (tot[at] - k) / twice, np.full(len(ids), -np.inf), at.copy(), np.zeros(len(ids), "int64")
    if len(key):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        w = np.add.reduceat(lists.column("ws").combine_chunks().flatten().to_numpy()[order], starts)
        r, to = np.divmod(key[starts], len(labels))
        stays = to == at[r]
        inner[r[stays]] = w[stays]
        low += inner
        gain = np.where(stays, low[r], w - k[r] * tot[to] / twice)
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        high[r[starts]] = np.maximum.reduceat(gain, starts)
        best[r[starts]] = np.minimum.reduceat(np.where(gain >= high[r] - LEAST, to, len(labels)), starts)
    moves = high > low + LEAST
    named = np.zeros(len(labels), "int64")
    named[at] = of["c"]
    best[~moves] = at[~moves]
    slack = np.where(moves, high - low, 0) * twice / np.maximum(k, 1)
    own = of["own"]
    out = {"node": ids, "to": named[best], "inner": inner, "slack": slack, "k": of["k"], "loops": of["loops"], "c": of["c"]}
    return pa.table({n: x[own] for n, x in out.items()})


STATE = "part int, slot int, c binary, tot binary, joins binary, inner double, wanting long, squares double"
TOLD = "part int, slot int, c binary, tot binary, joins binary"
ASKED = "part int, slot int, c binary, k binary, joins binary, inner double, wanting long"


def _best(row: np.ndarray, at: np.ndarray, w: np.ndarray | None, k: np.ndarray, now: np.ndarray, tot: np.ndarray, twice: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows' links to communities (row, at, w or 1 each; not of a node to itself) -> for each row the place of the
    community of the highest gain in modularity (the first of equal ones; its own if none gains), and by how much more totals could change before the move gains nothing. k, now: of rows; tot: of communities."""
    key = (row << 32) | at
    if w is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, w = key[order], w[order]
    best, low, high = now.copy(), -k * (tot[now] - k) / twice, np.full(len(k), -np.inf)
    if len(key):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        w = np.diff(np.r_[starts, len(key)]) if w is None else np.add.reduceat(w, starts)
        r, to = key[starts] >> 32, key[starts] & 0xFFFFFFFF
        stays = to == now[r]
        low[r[stays]] += w[stays]
        gain = np.where(stays, low[r], w - k[r] * tot[to] / twice)
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        high[r[starts]] = np.maximum.reduceat(gain, starts)
        best[r[starts]] = np.minimum.reduceat(np.where(gain >= high[r] - LEAST, to, len(tot)), starts)
    moves = high > low + LEAST
    best[~moves] = now[~moves]
    return best, np.where(moves, high - low, 0) * twice / np.maximum(k, 1)


def _weights(lists: parts.Lists, hubs: dict[int, int]) -> np.ndarray:
    """The weight of each node's edges, loops twice; hubs' are known."""
    k = np.add.reduceat(lists.w.astype("int64"), lists.ends[:-1])
    for i in np.flatnonzero(np.isin(lists.own, list(hubs))).tolist() if hubs else []:
        k[i] = hubs[int(lists.own[i])]
    return k


def _start(rows: pa.Table, lists: parts.Lists, keys: list[int], offsets: list[int], hubs: dict[int, int]) -> list[dict]:
    """Each node is a community of its own."""
    k, p = _weights(lists, hubs), lists.p
    c, none, squares = np.arange(len(k)) + offsets[p], np.zeros(len(k), "int64"), float((k.astype(float) ** 2).sum())
    return [{"part": keys[p], "slot": -1, "c": parts.packed(c), "squares": squares}, {"part": keys[p], "slot": p, "tot": parts.packed(k), "joins": parts.packed(none)}]


def _tell(rows: pa.Table, lists: parts.Lists, keys: list[int]) -> list[dict]:
    """What owners say of the communities of a part's nodes, to all parts that need these nodes."""
    first, *said = sorted(rows.select(["slot", "c", "tot", "joins"]).to_pylist(), key=lambda r: r["slot"])
    c = parts.unpacked(first["c"])
    _, at = parts.ranked(c)  # owners have communities in order
    tot, joins = (np.concatenate([parts.unpacked(r[x]) for r in said]) for x in ("tot", "joins"))
    return lists.tell(keys, c=parts.narrow(c), tot=parts.narrow(tot[at]), joins=parts.narrow(joins[at]))


def _wish(rows: pa.Table, lists: parts.Lists, keys: list[int], offsets: list[int], hubs: dict[int, int], heard: dict[int, tuple], twice: int, turn: int) -> list[dict]:
    """A part's nodes wish for the neighbouring community of the highest gain, and get it with a chance of MOST at most and
    of their slack over the weight of those who wished for it a turn before. What owners of communities are told of that."""
    told = {x: dict(zip(rows.column("slot").to_pylist(), rows.column(x).to_pylist())) for x in ("c", "tot", "joins")}
    c, tot, joins = (lists.hear(told[x]).astype("int64") for x in ("c", "tot", "joins"))
    _, at = parts.ranked(c.astype("uint64") * MIX)  # equal gains are told apart by an order like a random one
    size = int(at.max()) + 1
    named, totals, asked = np.zeros(size, "int64"), np.zeros(size), np.zeros(size)
    named[at], totals[at], asked[at] = c, tot, joins
    k, now, own = _weights(lists, hubs), at[lists.mine], np.arange(lists.mine.start, lists.mine.stop)
    plain, best, slack, inner = bool(lists.w.max() <= 1), now.copy(), np.zeros(len(k)), 0
    for i, j in lists.chunks():
        row, near, w = np.repeat(np.arange(j - i), lists.counts[i:j]), lists.near[lists.ends[i] : lists.ends[j]], lists.w[lists.ends[i] : lists.ends[j]].astype("int64")
        inner += int(w[at[near] == now[i:j][row]].sum())
        far = near != own[i:j][row]
        best[i:j], slack[i:j] = _best(row[far], at[near[far]], None if plain else w[far], k[i:j], now[i:j], totals, twice)
    was, to, chance = c[lists.mine], named[best], np.minimum(MOST, slack / np.maximum(asked[best], 1))
    for node in set(heard) & set(lists.own[np.isin(lists.own, list(heard))].tolist()):
        i = np.searchsorted(lists.own, node)
        to[i], chance[i], more = heard[node]
        inner += more
    if turn == 0:
        chance = np.full(len(k), FIRST)
    x = (lists.own.astype("uint64") + np.uint64((turn + 1) * 0x165667B19E3779F9 % 2**64)) * MIX
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    wants = to != was
    new = np.where(wants & ((x >> np.uint64(33)).astype(float) / 2**31 < chance), to, was)
    labels, place = parts.ranked(np.concatenate([new, to]))
    weight, joining = (np.bincount(p, x, len(labels)).astype("int64") for p, x in ((place[: len(k)], k), (place[len(k) :], np.where(wants, k, 0))))
    ends, out = np.searchsorted(labels, offsets), []
    for s in range(lists.n):
        if ends[s + 1] > ends[s]:
            of = slice(ends[s], ends[s + 1])
            out.append({"part": keys[s], "slot": lists.p, "c": parts.packed(labels[of]), "k": parts.packed(weight[of]), "joins": parts.packed(joining[of])})
    return [*out, {"part": keys[lists.p], "slot": -1, "c": parts.packed(new), "inner": float(inner), "wanting": int(wants.sum())}]


def _own(rows: pa.Table, keys: list[int], offsets: list[int]) -> pa.Table:
    """A part adds up what it is told of communities named by its nodes, and says so to all that have nodes of them."""
    said = rows.to_pylist()
    p = keys.index(said[0]["part"])
    tot, joins, out = np.zeros(offsets[p + 1] - offsets[p], "int64"), np.zeros(offsets[p + 1] - offsets[p], "int64"), []
    for r in said:
        if r["slot"] >= 0:
            r["at"], r["k"] = parts.unpacked(r["c"]) - offsets[p], parts.unpacked(r["k"])
            tot[r["at"]] += r["k"]
            joins[r["at"]] += parts.unpacked(r["joins"])
    for r in said:
        if r["slot"] < 0:
            out.append({"part": r["part"], "slot": -1, "c": r["c"], "inner": r["inner"], "wanting": r["wanting"], "squares": float((tot.astype(float) ** 2).sum())})
        else:
            at = r["at"][r["k"] > 0]
            out.append({"part": keys[r["slot"]], "slot": p, "tot": parts.packed(tot[at]), "joins": parts.packed(joins[at])})
    return parts.table(out, STATE)


def _members(rows: pa.Table, lists: parts.Lists) -> pa.Table:
    return pa.table({"node": lists.own, "c": parts.unpacked(rows.column("c")[0].as_py()).astype("int64")})


def _links(rows: pa.Table, lists: parts.Lists) -> pa.Table:
    """A part's lists as rows (node, other, w), those of a node to itself too; of communities if it was told of these."""
    at = lists.at_hubs()
    row = np.repeat(np.arange(len(lists.own)), lists.counts)
    c = lists.hear(dict(zip(rows.column("slot").to_pylist(), rows.column("c").to_pylist()))).astype("int64")
    named, c = parts.ranked(c)
    a, b, w = c[lists.mine][row], c[lists.near], lists.w.astype("int64")
    a, b, w = np.concatenate([a, b[at]]), np.concatenate([b, a[at]]), np.concatenate([w, w[at]])
    key = (a << 32) | b
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return pa.table({"node": named[key[starts] >> 32], "other": named[key[starts] & 0xFFFFFFFF], "w": np.add.reduceat(w[order], starts)})


def _hubs_wishes(full: DataFrame, told: DataFrame, graph: parts.Parts, hubs: dict[int, int], twice: int) -> dict[int, tuple[int, float, int]]:
    """Of hubs, what they wish for, their chance, and the weight of their links to others than hubs in their own community.
    Their edges are added up by community in every task before they meet."""
    at = parts.turn(graph, told, lambda rows, lists: pa.table({"node": lists.own, **{x: parts.unpacked(rows.filter(pc.equal(rows.column("slot"), lists.p)).column(x)[0].as_py()).astype("int64") for x in ("c", "tot", "joins")}}), "node long, c long, tot long, joins long")
    at = settled(at)
    own = at.where(F.col("node").isin(list(hubs))).collect()
    now = F.create_map(*(F.lit(x) for r in own for x in (r.node, r.c)))[F.col("node")]
    k = F.create_map(*(F.lit(x) for h, w in hubs.items() for x in (h, w)))[F.col("node")]
    links = full.where("node <> other").join(at.withColumnRenamed("node", "other"), "other").groupBy("node", "c").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("other").isin(list(hubs)), 0).otherwise(F.col("w"))).alias("inner"), F.first("tot").alias("tot"), F.first("joins").alias("joins"))
    gain = F.col("w") - k * (F.col("tot") - F.when(F.col("c") == now, k).otherwise(0)).cast("double") / twice
    links = links.withColumn("gain", gain).groupBy("node").agg(F.max_by(F.struct("c", "gain", "joins"), F.struct("gain", F.xxhash64("c"), "c")).alias("best"), F.max(F.when(F.col("c") == now, F.col("gain"))).alias("low"), F.max(F.when(F.col("c") == now, F.col("inner"))).alias("inner"))
    found, tots = {r.node: r for r in links.collect()}, {r.node: (r.c, r.tot) for r in own}  # a row for each hub
    out = {}
    for h, r in found.items():
        c, tot = tots[h]
        low = -hubs[h] * (tot - hubs[h]) / twice if r.low is None else r.low
        moves = r.best.gain > low + LEAST
        out[h] = (r.best.c if moves else c, min(MOST, (r.best.gain - low) * twice / hubs[h] / max(r.best.joins, 1)), r.inner or 0)
    return out


def _turns(graph: parts.Parts, full: DataFrame | None, hubs: dict[int, int], twice: int, most_turns: int, least_gain: float, patience: int = 2) -> tuple[DataFrame, float]:
    """The best division that moves of single nodes lead to, as parts were told of it, and its modularity. Ends when no node
    wants to move, or when `patience` turns in a row bring less than least_gain each.

    All nodes wish at once, and each gets its wish with a chance, so that communities aren't overrun. A community is named
    by the number of a node, whose part owns it: it adds up the community's weight and says it to parts that have nodes of it."""
    n, keys, offsets = graph.n, graph.keys, parts.offsets(graph)
    state = settled(parts.turn(graph, parts.each(graph), lambda rows, lists: _start(rows, lists, keys, offsets, hubs), STATE))
    squares, best, high, idle = state.agg(F.sum("squares")).first()[0], state, float("-inf"), 0
    for turn in range(most_turns):
        told = parts.turn(graph, state, lambda rows, lists: _tell(rows, lists, keys), TOLD)
        heard = {} if full is None else _hubs_wishes(full, told, graph, hubs, twice)
        asked = parts.turn(graph, told, lambda rows, lists, heard=heard, turn=turn: _wish(rows, lists, keys, offsets, hubs, heard, twice, turn), ASKED)
        new = settled(asked.repartition(n, "part").groupBy("part").applyInArrow(lambda rows: _own(rows, keys, offsets), STATE))
        inner, wanting, later = new.agg(F.sum("inner"), F.sum("wanting"), F.sum("squares")).first()
        now = inner / twice - squares / twice / twice
        idle = 0 if now > high + least_gain else idle + 1
        if now > high:
            best, high = state, now
        if not wanting or idle == patience:
            break
        state, squares = new, later
    return best, high


def _one_by_one(near: DataFrame, nodes: DataFrame, twice: int, least_gain: float) -> tuple[DataFrame, float]:
    """Of a graph of one part, the division that moves one by one lead to in a task, and its modularity."""
    lab = nodes.join(nodes.groupBy("c").agg(F.sum("k").alias("tot")), "c")
    far, null = near.join(lab.select(F.col("node").alias("other"), "c", "tot"), "other"), F.lit(None).cast("long")
    rows = far.select("node", "other", "w", "c", "tot", null.alias("k")).unionByName(lab.select("node", null.alias("other"), null.alias("w"), "c", "tot", "k"))
    step = rows.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda pdf: moved(pdf, twice, least_gain / 10), "node long, to long, inner long")
    level = settled(step.select("node", F.col("to").alias("c")).join(nodes.drop("c"), "node").select("node", "k", "loops", "c"))
    at = level.select(F.col("node").alias("other"), F.col("c").alias("to"))
    inner = near.join(level.select("node", "c"), "node").join(at, "other").where("c = to").agg(F.sum("w")).first()[0] or 0
    loops, squares = level.groupBy("c").agg(F.sum("loops").alias("loops"), F.sum("k").cast("double").alias("tot")).agg(F.sum("loops"), F.sum(F.col("tot") * F.col("tot"))).first()
    return level, (inner + loops) / twice - squares / twice / twice


def _later(found: DataFrame, level: DataFrame) -> DataFrame:
    """found (node, at) after a level (node, c) of its communities."""
    met = spread_join(found, level.withColumnRenamed("node", "at"), "at", heavy_keys(found, "at"))
    return settled(met.select("node", F.col("c").alias("at")))


def divided(edges: DataFrame, most_turns: int = 60, least_gain: float = 1e-4, per_task: int = EDGES_PER_TASK, named: bool = True, per_part: int | None = None) -> tuple[DataFrame, DataFrame | None, float | None]:
    """Louvain's method as louvain has it -> (node, at), numbers of nodes and of their communities; the nodes (name, node),
    or None if edges have numbers already (not named: node, other and perhaps `once`, as paths.passed); modularity, None without edges."""
    ship(edges.sparkSession)
    names, pairs = coded(edges) if named else (None, edges)
    found, last, now, flagged = None, float("-inf"), None, True
    rows = paths.both_ways(pairs)
    while True:
        graph, full = parts.deal(rows, per_part or 8 * per_task, flagged)
        keys = graph.keys
        large = graph.size > per_task or full is not None
        hubs = {}
        if full is not None:
            w = F.sum("w")
            full = settled(full.groupBy("node", "other").agg((w % parts.ONCE + F.when(w >= parts.ONCE, 1).otherwise(0) if flagged else w).alias("w")))
            hubs = {r.node: r.w for r in full.groupBy("node").agg(F.sum("w").alias("w")).collect()}
        if not large:
            break
        twice = parts.weight(graph)
        level, now = _turns(graph, full, hubs, twice, most_turns, least_gain)
        own = settled(parts.turn(graph, level.where("slot = -1"), _members, "node long, c long"))
        found = own.withColumnRenamed("c", "at") if found is None else _later(found, own)
        told = parts.turn(graph, level, lambda r, lists, keys=keys: _tell(r, lists, keys), TOLD)
        if now < last + least_gain:
            graph.held.unpersist()
            return found, names, now
        rows, last, flagged = settled(parts.turn(graph, told, _links, "node long, other long, w long")), now, False
        graph.held.unpersist()
    offsets, first = parts.offsets(graph), parts.each(graph)
    placed = settled(parts.turn(graph, first, lambda r, lists: pa.table({"node": lists.own, "c": np.arange(len(lists.own)) + offsets[lists.p]}), "node long, c long"))
    found = placed.withColumnRenamed("c", "at") if found is None else _later(found, placed)
    ids = parts.turn(graph, first, lambda r, lists: lists.tell(keys, c=np.arange(len(lists.own)) + offsets[lists.p]), "part int, slot int, c binary")
    rows = settled(parts.turn(graph, ids, _links, "node long, other long, w long"))
    graph.held.unpersist()
    near = settled(rows.where("node <> other"))
    nodes = settled(rows.groupBy("node").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("node") == F.col("other"), F.col("w")).otherwise(0)).alias("loops")).withColumn("c", F.col("node")))
    twice = nodes.agg(F.sum("k")).first()[0]
    while twice:
        level, now = _one_by_one(near, nodes, twice, least_gain)
        found = _later(found, level.select("node", "c"))
        if now < last + least_gain:
            break
        last = now
        a, b = (level.select(F.col("node").alias(n), F.col("c").alias(f"{n}_c")) for n in ("node", "other"))
        joined = settled(near.join(a, "node").join(b, "other").groupBy(F.col("node_c").alias("node"), F.col("other_c").alias("other")).agg(F.sum("w").alias("w")))
        sums = level.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k"), F.sum("loops").alias("loops"))
        inner = joined.where("node = other").select("node", F.col("w").alias("within"))
        nodes = settled(sums.join(inner, "node", "left").select("node", "k", (F.col("loops") + F.coalesce("within", F.lit(0))).alias("loops"), F.col("node").alias("c")))
        near = settled(joined.where("node <> other"))
    return found, names, now


def louvain(edges: DataFrame, most_turns: int = 60, least_gain: float = 1e-4, per_task: int = EDGES_PER_TASK, name: Callable[[Column], Column] | None = None, per_part: int | None = None) -> DataFrame:
    """(node, community) of edges (src, relation, dst), each counting once in either direction; a community is named
    by its smallest node. Facts between the same nodes add up, and a fact from a node to itself is in its community. Where
    nodes have numbers already, edges are as paths.passed has them, and name tells a number's name.

    A graph of more than per_task rows of neighbours is dealt into parts, whose lists stay where they are: in a turn, a
    node's community goes as arrays to the parts that have a neighbour of it, and a share of the wishes comes true. A smaller
    one, as the later levels of a large one are, moves its nodes one by one and settles in a turn. A level ends when no node
    wants to move, when turns bring less than least_gain in modularity, or after most_turns, with the best division seen;
    levels end when one brings less than least_gain. The result doesn't depend on how the input is partitioned."""
    found, names, _ = divided(edges, most_turns, least_gain, per_task, name is None, per_part)
    found = settled(found.join(names, "node").select("name", "at") if name is None else found.select(name(F.col("node")).alias("name"), "at"))
    first = found.groupBy("at").agg(F.min("name").alias("community"))
    return spread_join(found, first, "at", heavy_keys(found, "at")).select(F.col("name").alias("node"), "community")
