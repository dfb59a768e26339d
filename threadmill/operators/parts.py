"""Graphs dealt into parts: a part has the lists of neighbours of its nodes, and what is told of a node goes once to each
part with a neighbour of it, as packed arrays in an order that both ends know, so without its name."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import settled, ship

#: Rows of neighbours that a task holds, about, and those that it gets at least if there are fewer parts than cores. A node
#: of more than HUB rows is a hub: its neighbours are counted in rows instead.
PER_PART, LEAST_PART, HUB = 1 << 23, 1 << 17, 1 << 21
#: The weight of rows that count once between two nodes, however many there are.
ONCE = 1 << 32
#: Rows in which hubs are looked for by number of bucket.
BUCKETS = 1 << 16
HELD = "part int, slot int, own binary, counts binary, near binary, w binary, bounds binary, busy binary, route binary"


class Parts(NamedTuple):
    """n parts, the key of each (hashed to a partition of its own), their lists, the hubs' numbers, and how many rows there were."""

    n: int
    keys: list[int]
    held: DataFrame
    hubs: list[int]
    size: int


def packed(x: np.ndarray) -> bytes:
    """x by planes of bytes, compressed: numbers of few values or of a narrow range take little."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else np.empty(0, "uint8")
    return x.dtype.char.encode() + len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:1].decode()), int.from_bytes(b[1:9], "little")
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(b[9:], n * kind.itemsize, asbytes=True), "uint8")
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("int32") if not len(x) or (x.max() < 2**31 and x.min() >= -(2**31)) else x


def slots(x: np.ndarray, n: int) -> np.ndarray:
    """The part of each node, as slot tells of a column."""
    x = x.astype("int64")
    h = (x ^ (x.view("uint64") >> np.uint64(32)).astype("int64")) & 0x7FFFFFFF
    return ((h * 2654435761) >> 16) % n


def slot(c: Column, n: int) -> Column:
    h = c.bitwiseXOR(F.shiftrightunsigned(c, 32)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.pmod(F.shiftright(h * F.lit(2654435761), 16), F.lit(n)).cast("int")


def part_of(c: Column, n: int, keys: list[int]) -> Column:
    return F.get(F.array(*map(F.lit, keys)), slot(c, n))


def _keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an int that is hashed to it."""
    rows = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("key"))
    return [r.key for r in rows.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key")).orderBy("p").collect()]


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of x in order, and for each of x which of them it is."""
    order = np.argsort(x)
    x = x[order]
    new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.empty(0, "bool")
    rank = np.empty(len(x), "int64")
    rank[order] = np.cumsum(new) - 1
    return x[new], rank


def once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def lay(rows: pa.Table, n: int, keys: list[int], hubs: list[int], flagged: bool = True) -> pa.Table:
    """One part's rows (part, node, other, w) -> its lists, each node among its own neighbours with a weight of 0 more, and
    for each other part which of its nodes that one needs. flagged: of a weight, what is above ONCE counts as one however often."""
    p, hubs, size = keys.index(rows.column("part")[0].as_py()), np.array(hubs, "int64"), len(rows)
    own, row = ranked(rows.column("node").to_numpy())
    need, place = ranked(np.concatenate([rows.column("other").to_numpy(), own, hubs]))
    at = slots(need, n)
    order = np.argsort(at, kind="stable")
    moved = np.empty(len(need), "int64")
    moved[order] = np.arange(len(need))
    at, place = at[order], moved[place]
    key = np.concatenate([(row << 32) | place[:size], (np.arange(len(own)) << 32) | place[size : size + len(own)]])
    w, busy = np.concatenate([rows.column("w").to_numpy(), np.zeros(len(own), "int64")]), once(place[size + len(own) :])
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    w, key = np.add.reduceat(w[order], starts), key[starts]
    w = (w & (ONCE - 1)) + (w >= ONCE) if flagged else w
    row, near = key >> 32, key & 0xFFFFFFFF
    back = slice(None)  # neighbours that have the node in their lists too: hubs do so with hubs alone
    if len(hubs):
        back = np.isin(own, hubs)[row] | ~np.isin(near, busy)
    told = [once((at[near[back]] << 32) | row[back])]
    for i in np.flatnonzero(np.isin(own, hubs)).tolist():
        told.append((np.arange(n) << 32) | i)
    told = once(np.concatenate(told))
    ends = np.searchsorted(told, np.arange(n + 1) << 32)
    out = [{"part": keys[p], "slot": -1, "own": packed(own), "counts": packed(np.bincount(row, minlength=len(own)).astype("int32")), "near": packed(narrow(near)), "w": packed(narrow(w)), "bounds": packed(np.searchsorted(at, np.arange(n + 1))), "busy": packed(busy)}]
    out += [{"part": keys[p], "slot": s, "route": packed(narrow(told[ends[s] : ends[s + 1]] & 0xFFFFFFFF))} for s in range(n) if s != p and ends[s + 1] > ends[s]]
    return table(out, HELD)


def table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [x.strip().split() for x in schema.split(",")]
    return pa.Table.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in names], names=[c for c, _ in names])


def deal(pairs: DataFrame, per_part: int | None = None, flagged: bool = True) -> tuple[Parts, DataFrame | None]:
    """Pairs (node, other, w) of longs, each in both directions -> parts, and the rows of the hubs or None. The lists are
    kept on the executors' disks by parts, so that they don't move again; held.unpersist() ends that."""
    spark, per_part = pairs.sparkSession, per_part or PER_PART
    ship(spark)
    bucket = F.pmod(F.xxhash64("node"), F.lit(BUCKETS))
    sizes = pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    found = settled(sizes)
    size = found.agg(F.sum("n")).first()[0] or 0
    most = min(HUB, max(per_part // 4, 1))
    full = [r.bucket for r in found.where(F.col("n") > most).select("bucket").collect()]  # size / most at most
    hubs = []
    if full:
        busy = pairs.where(bucket.isin(full)).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most)
        hubs = sorted(r.node for r in busy.collect())
    n, cores = math.ceil(size / per_part), spark.sparkContext.defaultParallelism
    n = math.ceil(n / cores) * cores if n > cores else max(n, min(cores, math.ceil(size / LEAST_PART)), 1)
    keys, loose, own = _keys(spark, n), pairs, None
    if hubs:
        loose = pairs.where(~F.col("node").isin(hubs) | F.col("other").isin(hubs))
        ends = spark.range(len(hubs)).select(F.get(F.array(*map(F.lit, hubs)), F.col("id").cast("int")).alias("node"))
        loose = loose.unionByName(ends.select("node", F.col("node").alias("other"), F.lit(0).cast("long").alias("w")))
        own = pairs.where(F.col("node").isin(hubs))
    rows = loose.select(part_of(F.col("node"), n, keys).alias("part"), "node", "other", F.col("w").cast("long").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if len(b)]
        if own:  # a partition is a part, as keys are chosen
            yield from lay(pa.Table.from_batches(own), n, keys, hubs, flagged).to_batches()

    held = rows.repartition(n, "part").mapInArrow(run, HELD).repartition(n, "part").persist(StorageLevel.DISK_ONLY)
    return Parts(n, keys, held, hubs, size), own


class Lists:
    """What a task has of its part: own nodes, and for each (row) a list of places (near) among the nodes it needs."""

    def __init__(self, held: pa.Table, n: int):
        self.n, self.routes = n, {}
        for r in held.to_pylist():
            if r["slot"] < 0:
                self.own, self.counts, self.near, self.w, self.bounds = (unpacked(r[c]) for c in ("own", "counts", "near", "w", "bounds"))
                self.busy = unpacked(r["busy"])  # places of hubs
            else:
                self.routes[r["slot"]] = unpacked(r["route"])
        self.ends = np.concatenate([[0], np.cumsum(self.counts, dtype="int64")])
        self.p = int(slots(self.own[:1], n)[0])
        self.mine = slice(self.bounds[self.p], self.bounds[self.p + 1])

    def hear(self, told: dict[int, bytes]) -> np.ndarray:
        """One array of what all needed nodes were told of."""
        out = None
        for s, b in told.items():
            x = unpacked(b)
            if out is None or x.itemsize > out.itemsize:
                out = np.empty(self.bounds[-1], x.dtype) if out is None else out.astype(x.dtype)
            out[self.bounds[s] : self.bounds[s + 1]] = x
        return out

    def rows(self) -> np.ndarray:
        """The row of each entry of near."""
        return np.repeat(np.arange(len(self.own)), self.counts)

    def at_hubs(self) -> np.ndarray:
        """Which entries lead from another node to a hub; the hub has none for them."""
        busy = np.zeros(self.bounds[-1], "bool")
        busy[self.busy] = True
        return busy[self.near] & ~busy[self.mine][self.rows()]

    def chunks(self, entries: int = 1 << 21):
        """(first, last) rows of about so many entries."""
        i = 0
        while i < len(self.own):
            j = max(i + 1, int(np.searchsorted(self.ends, self.ends[i] + entries, "right")) - 1)
            yield i, j
            i = j

    def tell(self, keys: list[int], **x: np.ndarray) -> list[dict]:
        """Rows for the other parts, each with what they need of x, and one for this part with all."""
        out = [{"part": keys[s], "slot": self.p} | {c: packed(v[at]) for c, v in x.items()} for s, at in self.routes.items()]
        return out + [{"part": keys[self.p], "slot": self.p} | {c: packed(v) for c, v in x.items()}]


def turn(parts: Parts, rows: DataFrame, step: Callable[[pa.Table, Lists], list[dict]], schema: str) -> DataFrame:
    """What step makes, in each part, of its rows and lists."""
    n = parts.n

    def run(told: pa.Table, held: pa.Table) -> pa.Table:
        out = step(told, Lists(held, n)) if len(held) and len(told) else []
        return out if isinstance(out, pa.Table) else table(out, schema)

    return rows.repartition(n, "part").groupBy("part").cogroup(parts.held.groupBy("part")).applyInArrow(run, schema)


def by_node(parts: Parts, rows: DataFrame) -> DataFrame:
    """rows (node, ...) with the part of each."""
    return rows.withColumn("part", part_of(F.col("node"), parts.n, parts.keys))


def nodes(parts: Parts) -> DataFrame:
    """(node): all nodes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(own))], names=["node"])

    return parts.held.where("slot = -1").select("own").mapInArrow(run, "node long")


def each(parts: Parts) -> DataFrame:
    """(part): a row for each part."""
    return parts.held.sparkSession.createDataFrame([(k,) for k in parts.keys], "part int")


def offsets(parts: Parts) -> list[int]:
    """How many nodes the parts before each have, and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int.from_bytes(x[1:9], "little") for x in b.column(1).to_pylist()], pa.int64())], names=["part", "n"])

    sizes = {r.part: r.n for r in parts.held.where("slot = -1").select("part", "own").mapInArrow(run, "part int, n long").collect()}
    return [0, *np.cumsum([sizes.get(k, 0) for k in parts.keys]).tolist()]


def weight(parts: Parts) -> int:
    """The weight of all nodes' edges, each at both ends."""

    def run(rows: pa.Table, lists: Lists) -> pa.Table:
        w = lists.w.astype("int64")
        return pa.table({"w": [int(w.sum() + w[lists.at_hubs()].sum())]})

    return turn(parts, each(parts), run, "w long").agg(F.sum("w")).first()[0] or 0
