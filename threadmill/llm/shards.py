"""Sharding: a k-d tree over metadata, split at distributed weighted medians until leaves have the target bytes."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import small, stored, table

SHARDS = 24
#: A group of equal texts that is larger than a shard is dealt in slices of at most this share of one.
SLICE_SHARE = 0.25
#: Points of more than this share of a shard are placed before the tree, which then gives each shard what it lacks.
HEAVY = 0.25
#: Bytes are evened out until the fullest shard has at most this share of a shard more than the emptiest, or nothing
#: helps, in so many rounds at most.
EVEN, MOST_ROUNDS = 0.001, 40
#: Bits of a coordinate that come from the dimension itself and from a hash that parts ties; bits found in each pass.
TOP, LOW, DIGIT = 20, 40, 10
#: Runs by which slots are numbered inside a shard: so many at least, and rows of a run at most, about.
SLICES, ROWS_PER_RUN = 32, 200_000
DIMENSIONS = ("size", "lang", "source")


def _points(docs: DataFrame, id_col: str, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, size, text_crc32, th, slice) and weighted points (th, size, slice, bytes, c: array of coordinates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("th"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )
    rows = stored(rows, "rows")
    groups = rows.groupBy("th", "size").agg(F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    groups = stored(groups.withColumn("bytes", F.col("n") * F.col("size")), "groups")
    most = max(1.0, (groups.agg(F.sum("bytes")).first()[0] or 0) / shards)
    # fewer than shards groups are larger than a shard
    large = groups.where((F.col("bytes") > most) & (F.col("n") > 1)).select("th", "size", F.least(F.col("n"), F.ceil(F.col("bytes") / (most * SLICE_SHARE))).cast("int").alias("k"))
    rows = rows.join(F.broadcast(large), ["th", "size"], "left")
    rows = rows.select("doc_id", "size", "text_crc32", "th", "lang", "source", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("k"))).cast("int").alias("slice"))
    points = rows.groupBy("th", "size", "slice").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    top = (1 << TOP) - 1
    scaled = [F.least(F.lit(top), F.floor(F.log2(F.col("size")) * (top // 48)))] + [F.xxhash64(c).bitwiseAND(F.lit(top)) for c in ("lang", "source")]
    low = F.xxhash64("th", "size", "slice").bitwiseAND(F.lit((1 << LOW) - 1))
    points = points.select("th", "size", "slice", "bytes", F.array(*(F.shiftleft(x.cast("long"), LOW) + low for x in scaled)).alias("c"), F.lit(0).alias("node"))
    return rows, stored(points, "points")


def _halves(lo: int, hi: int) -> tuple[tuple[int, int], tuple[int, int]]:
    mid = lo + (hi - lo) // 2
    return (lo, mid), (mid, hi)


def _split(points: DataFrame, nodes: dict[int, tuple[int, int]], targets: list[float], first: int) -> DataFrame:
    """points with every node (the range of shards it is for) of more than one shard split: left gets the first half of
    its shards and their share of the bytes, by targets. The children of the i-th of them are nodes first + 2 i and
    first + 2 i + 1.

    Each node's widest dimension is found first, then the weighted quantile of all nodes at once, DIGIT bits a pass,
    until one point of each node holds it: that goes to the side that gets nearer to its share. The driver sees a row
    for each node and pass."""
    spark = points.sparkSession
    todo = sorted(n for n, (lo, hi) in nodes.items() if hi - lo > 1)
    spread = points.groupBy("node").agg(F.sum("bytes").alias("w"), *(f(F.shiftrightunsigned(F.col("c")[d], LOW)).alias(f"{n}{d}") for d in range(len(DIMENSIONS)) for n, f in (("lo", F.min), ("hi", F.max))))
    spread = {r.node: r for r in spread.collect()}
    bounds = {d: max(1, max(r[f"hi{d}"] for r in spread.values()) - min(r[f"lo{d}"] for r in spread.values())) for d in range(len(DIMENSIONS))} if spread else {}
    state = {}
    for n in todo:
        state[n] = {"d": 0, "prefix": 0, "want": 0.0}
        if r := spread.get(n):
            d = max(range(len(DIMENSIONS)), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / bounds[d], -d))
            left, whole = (sum(targets[lo:hi]) for lo, hi in (_halves(*nodes[n])[0], nodes[n]))
            state[n] |= {"d": d, "want": r.w * left / whole if whole else 0.0}
    shift, alone = TOP + LOW, not spread
    while shift > 0 and not alone:
        shift -= DIGIT
        plan = spark.createDataFrame([(n, s["d"], s["prefix"], float(s["want"])) for n, s in state.items()], "node int, d int, prefix long, want double")
        at = F.shiftrightunsigned(F.get("c", F.col("d")), shift)
        within = points.join(F.broadcast(plan), "node").where(F.shiftright(at, DIGIT) == F.col("prefix"))
        sums = within.groupBy("node", at.alias("at")).agg(F.sum("bytes").alias("w"), F.count("*").alias("n"), F.first("want").alias("want"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # 2**DIGIT rows at most
        sums = sums.withColumn("left", F.coalesce(upto, F.lit(0)))
        last = sums.where(F.col("left") <= F.col("want")).groupBy("node").agg(F.max_by(F.struct("at", "w", "n", "left"), "at").alias("x")).select("node", "x.*").collect()
        for r in last:
            state[r.node] |= {"prefix": r["at"], "want": state[r.node]["want"] - r.left, "w": r.w}
        alone = all(r.n == 1 for r in last)
    # what lies below the prefix goes left, and the point that holds the quantile if that leaves the smaller error
    cut = lambda s: (s["prefix"] + (s["want"] > s.get("w", 0) / 2)) << shift
    moves = spark.createDataFrame([(n, s["d"], cut(s), first + 2 * i) for i, (n, s) in enumerate(state.items())], "node int, d int, at long, left int")
    moved = points.join(F.broadcast(moves), "node", "left")
    return moved.select("th", "size", "slice", "bytes", "c", F.when(F.col("left").isNull(), F.col("node")).otherwise(F.col("left") + F.when(F.get("c", F.col("d")) < F.col("at"), 0).otherwise(1)).alias("node"))


def _heavy(points: DataFrame, shards: int) -> tuple[list[tuple], list[float]]:
    """(th, size, slice, shard) of the points of more than HEAVY of a shard, the largest first, each where such points have
    the fewest bytes yet; and the bytes that each shard is to get of the others, so that all have equally many as far
    as that can be."""
    total = points.agg(F.sum("bytes")).first()[0] or 0
    rows = points.where(F.col("bytes") > HEAVY * total / shards).select("th", "size", "slice", "bytes").collect()  # shards / HEAVY at most
    load, placed = [(0, k) for k in range(shards)], []
    for r in sorted(rows, key=lambda r: (-r.bytes, r.th)):
        w, k = heapq.heappop(load)
        placed.append((r.th, r["size"], r.slice, k))
        heapq.heappush(load, (w + r.bytes, k))
    light, level = total - sum(r.bytes for r in rows), 0.0
    load.sort()
    for i in range(shards):  # the level at which the emptiest i + 1 shards take all the light points
        level = (light + sum(w for w, _ in load[: i + 1])) / (i + 1)
        if i + 1 == shards or level <= load[i + 1][0]:
            break
    targets = [0.0] * shards
    for w, k in load:
        targets[k] = max(0.0, level - w)
    return placed, targets


def _evened(points: DataFrame, shards: int) -> DataFrame:
    """points (th, size, slice, bytes, shard) with some moved from full to empty shards.

    In a round the fullest shard meets the emptiest, the second fullest the second emptiest and so on; each passes on
    the point nearest to half of what it has more. The driver sees a row for each shard and round, and keeps the points
    that moved, a few for each round: in later rounds it looks through these itself, and tasks through all others."""
    spark = points.sparkSession
    key = ["th", "size", "slice"]
    load = dict.fromkeys(range(shards), 0) | {r.shard: r.w for r in points.groupBy("shard").agg(F.sum("bytes").alias("w")).collect()}
    allowed = EVEN * sum(load.values()) / shards
    moved: dict[tuple, tuple[int, int]] = {}  # (th, size, slice): bytes and the shard now
    has_moved = lambda: F.concat_ws(":", *key).isin([":".join(map(str, k)) for k in moved])
    for _ in range(MOST_ROUNDS):
        order = sorted(load, key=lambda k: (load[k], k))
        if load[order[-1]] - load[order[0]] <= allowed:
            break
        pairs = [(order[-1 - i], order[i], (load[order[-1 - i]] - load[order[i]]) / 2) for i in range(shards // 2)]
        pairs = [p for p in pairs if p[2] > allowed / 4]
        if not pairs:
            break
        lookup = F.create_map(*(F.lit(x) for a, b, half in pairs for x in (a, F.struct(F.lit(b).alias("to"), F.lit(half).alias("half")))))
        fit = points.withColumn("plan", F.element_at(lookup, F.col("shard"))).where(F.col("bytes") < 2 * F.col("plan.half"))
        if moved:
            fit = fit.where(~has_moved())
        fit = fit.select(*key, "bytes", "shard", "plan.to", "plan.half")
        found = fit.groupBy("shard", "to").agg(F.min_by(F.struct(*key, "bytes"), F.struct(F.abs(F.col("bytes") - F.col("half")), *key)).alias("x")).select("shard", "x.*").collect()
        fits = {r.shard: [(r.th, r["size"], r.slice, r.bytes)] for r in found}
        for k, (w, at) in moved.items():
            fits.setdefault(at, []).append((*k, w))
        passed = False
        for full, empty, half in pairs:
            if best := min((x for x in fits.get(full, []) if x[3] < 2 * half), key=lambda x: (abs(x[3] - half), *x[:3]), default=None):
                moved[best[:3]] = best[3], empty
                load[full] -= best[3]
                load[empty] += best[3]
                passed = True
        if not passed:
            break
    if not moved:
        return points
    where = spark.createDataFrame([(*k, at) for k, (_, at) in moved.items()], "th long, size long, slice int, now int")
    there = points.where(has_moved()).join(F.broadcast(where), key).withColumn("shard", F.col("now")).drop("now")
    return stored(points.where(~has_moved()).unionByName(there), "evened")


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: bytes of the text (null: none) plus 8. Shards have nearly equal bytes (law `bytes`). shards None: as many as
    target_bytes asks for. Equal texts share a shard, unless they are more than a shard holds: then they are dealt by id
    in slices. Groups and slices of over a quarter of a shard are placed first, the largest first; the tree deals all
    others, so that shards get equal bytes. Where its leaves differ, by the points at its cuts, some of them move. slot numbers a shard's rows from 0 without gaps.
    grown_shard is null under this law. Missing lang or source count as empty; null ids and repeated rows are rows like
    others; extra columns are ignored; an empty table gives an empty result. A text of any length is one point.

    The tree works on one narrow point per group of equal texts. Texts are read once and not moved."""
    if shards is None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    rows, points = _points(docs, id_col, shards)
    slices = max(SLICES, math.ceil(rows.count() / (shards * ROWS_PER_RUN)))
    key = ["th", "size", "slice"]
    heavy, targets = _heavy(points, shards)
    put = F.broadcast(docs.sparkSession.createDataFrame(heavy, "th long, size long, slice int, shard int"))
    points = stored(points.join(put, key, "left"), "points")
    whole, points = points.where("shard is not null").select(*key, "bytes", "shard"), points.where("shard is null").drop("shard")
    nodes, leaves, next_node = {0: (0, shards)}, [], 1
    while nodes:
        leaves += [(n, lo) for n, (lo, hi) in nodes.items() if hi - lo == 1]
        nodes = {n: x for n, x in sorted(nodes.items()) if x[1] - x[0] > 1}
        if nodes:
            points = stored(_split(points, nodes, targets, next_node), "points")
            nodes = {next_node + 2 * i + side: half for i, x in enumerate(nodes.values()) for side, half in enumerate(_halves(*x))}
            next_node += len(nodes)
    names = docs.sparkSession.createDataFrame(leaves, "node int, shard int")
    points = points.join(F.broadcast(names), "node").select(*key, "bytes", "shard").unionByName(whole)
    points = _evened(stored(points, "leaves"), shards)
    placed = rows.join(small(points.select("th", "size", "slice", "shard")), ["th", "size", "slice"])
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "th"), F.lit(slices)).cast("int").alias("run")), "placed")
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.withColumn("at", F.row_number().over(within) - 1).join(small(stored(counts, "counts")), ["shard", "run"])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over documents, with 24 shards."""
    return kd_shards(table(spark, sf_dir, "documents"))
