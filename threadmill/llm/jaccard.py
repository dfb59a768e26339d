"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import components, mix, ship, small, spans, stored, table, utf8, word_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
#: Tries in the forest, levels of each, and the chance of meeting that a pair of texts alike enough must have.
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: Bits of a label: the tree's number, then the hash of every level. Shorter hashes only add candidates.
TREE_BITS, LEVEL_BITS = 5, (14, 12, 11, 9, 6, 6)
#: Texts and bytes of shingles that meet in one task at most, twice; larger components are compared block by block.
#: Components of over WHOLE texts are cut into up to SQUARES blocks already, so that their squares spread over tasks.
BLOCK, BLOCK_BYTES, WHOLE, SQUARES = 512, 16 << 20, 192, 16
#: Texts of up to so many shingles get their own prefix length; the others can have partners at the threshold itself.
FEW = 40


def prefix_length(similarity: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix by which two texts of this similarity meet in some tree with the target recall: it starts at
    the full depth of the tries and is shortened level by level until 1 - (1 - similarity ** k) ** trees reaches it."""
    k = depth
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


def least_similarity(m: int, threshold: float = THRESHOLD) -> float:
    """The smallest Jaccard similarity of threshold or more that a set of m members can have with any set."""
    best = 1.0
    for both in range(max(1, math.ceil(threshold * m - 1e-9)), m + 1):
        other = math.floor(both / threshold - m + both + 1e-9)
        if other >= both:
            best = min(best, both / (m + other - both))
    return best


def prefix_lengths(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> np.ndarray:
    """Prefix length by number of shingles, up to FEW; the last entry is for all larger sets."""
    own = [depth] + [prefix_length(least_similarity(m, threshold), trees, depth, recall) for m in range(1, FEW + 1)]
    return np.array([*own, prefix_length(threshold, trees, depth, recall)], np.int8)


def shingle_rows(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, and the row's offsets in them. A text of fewer words is one shingle
    of all of them; a text without words has none."""
    starts, ends, first = words(data, at)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(many)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    base = np.arange(out[-1]) - np.repeat(out[:-1], many) + np.repeat(first[:-1], many)
    stop = np.repeat(first[1:], many)
    total = np.zeros(out[-1], np.uint64)
    for k, c in enumerate(np.random.default_rng(5).integers(0, 2**63, n, dtype=np.uint64) | np.uint64(1)):
        inside = base + k < stop
        total += np.where(inside, h[np.minimum(base + k, len(h) - 1)] * c, np.uint64(0))
    return mix(total), out


def set_sizes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct shingles of each row; rows of more than FEW shingles keep their count with repeats."""
    n = np.diff(at)
    few = np.flatnonzero((n > 1) & (n <= FEW))
    n[few] = [len(set(flat[at[r] : at[r + 1]].tolist())) for r in few]
    return n


def labels(sets: np.ndarray, at: np.ndarray, trees: int, level_bits: tuple[int, ...] = LEVEL_BITS) -> np.ndarray:
    """For each row its label in every tree, level after level from the high bits on, behind the tree's number; rows
    without shingles get 0. Labels sorted as numbers are the leaves of the prefix tries in order."""
    rng = np.random.default_rng(17)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, trees), np.uint64)
    for t in range(trees):
        label = np.full(len(full), t, np.uint64)
        for bits in level_bits:
            a = rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            if len(full):
                least = mix(np.minimum.reduceat(mix_fast(sets, a), at[full]))
                label = label << np.uint64(bits) | least >> np.uint64(64 - bits)
        out[full, t] = label
    return out


def meetings(batches: Iterator[pa.RecordBatch], level_bits: tuple[int, ...] = LEVEL_BITS) -> Iterator[pa.RecordBatch]:
    """Leaves (label, num, depth) of one range in order -> edges (a, b) from each text to the first text under its trie
    nodes of length depth and longer. One more row (a null) tells the range, its first and last label, and the first
    text under each node that is still open at its end."""
    low = np.append(np.cumsum(level_bits[::-1])[::-1][1:], 0)  # bits below each level
    prefix = lambda label, d: label >> int(low[d - 1])
    depth = len(level_bits)
    head, last, first = [-1] * (depth + 1), None, None
    part = -1
    for b in batches:
        if not b.num_rows:
            continue
        label, num, own = (b.column(c).to_numpy() for c in ("label", "num", "depth"))
        part = b.column("part")[0].as_py()
        first = (int(label[0]), int(num[0])) if first is None else first
        a, z = [], []
        for d in range(1, depth + 1):
            p = prefix(label, d)
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            if last is not None and prefix(last, d) == int(p[0]):
                new[0] = False
            at = np.flatnonzero(new)
            heads = np.concatenate([[head[d]], num[at]])[np.cumsum(new)]
            head[d] = int(heads[-1])
            mine = (own <= d) & (heads != num)
            a.append(num[mine])
            z.append(heads[mine])
        last = int(label[-1])
        a, z = np.concatenate(a), np.concatenate(z)
        n = len(a)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64()), *(pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], EDGE)
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([first[1]], pa.int64()), pa.array([part], pa.int32()), pa.array([first[0]], pa.int64()), pa.array([last], pa.int64()), pa.array([head[1:]], pa.list_(pa.int64()))], EDGE)


EDGE = ["a", "b", "part", "first", "last", "heads"]


def forest_edges(leaves: DataFrame, shortest: int, level_bits: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """(a, b) of leaves (label, num, depth): texts that share a trie node as long as the depth of one of them asks, each
    with the first text under that node.

    The leaves are sorted by range, ties by text, so that a label of many texts is no task of its own. A node that
    spans ranges is tied together by its ranges' first texts, one row per range."""
    order = leaves.repartitionByRange("label", "num").sortWithinPartitions("label", "num").withColumn("part", F.spark_partition_id())
    found = stored(order.mapInArrow(lambda it: meetings(it, level_bits), "a long, b long, part int, first long, last long, heads array<long>"), "met")
    before = Window.orderBy("part")  # one row per range
    ends = found.where("a is null").select("b", "first", F.lag("last").over(before).alias("last"), F.lag("heads").over(before).alias("heads"))
    low = [sum(level_bits[d:]) for d in range(shortest, len(level_bits) + 1)]
    over = [F.when(F.shiftright("first", x) == F.shiftright("last", x), F.col("heads")[d - 1]) for d, x in zip(range(shortest, len(level_bits) + 1), low)]
    tied = ends.where("last is not null").select(F.col("b").alias("a"), F.explode(F.array(*over)).alias("b")).where("b is not null")
    return found.where("a is not null").select("a", "b").unionByName(tied).distinct()


def mix_fast(h: np.ndarray, a: np.uint64) -> np.ndarray:
    h = h * a
    return h ^ (h >> np.uint64(32))


def linked_in_cell(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of threshold or more; b None: pairs within a."""
    every = sets_a + (sets_b or [])
    flat = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    more = count[col] > 1  # the others meet nothing
    row, col = row[more], col[more]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    _, col = np.unique(col, return_inverse=True)
    n = len(sets_a)
    both = np.zeros((n, len(sets_b) if sets_b is not None else n), np.float32)
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(every), min(width, int(col[-1]) + 1 - lo)), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        both += m[:n] @ (m[n:] if sets_b is not None else m).T
    size = np.array([len(s) for s in every], np.float64)
    union = size[:n, None] + (size[n:] if sets_b is not None else size)[None, :] - both
    return (both >= threshold * union - 1e-9) & (union > 0)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def verify(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell -> for each cell and text: its root among the texts linked in the cell, and its links."""

    def decide(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("num", kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in cell["shingles"]]
        side = (cell["block"] == cell["i"]).to_numpy() if cell["i"].iloc[0] != cell["j"].iloc[0] else np.ones(len(cell), bool)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        links = np.zeros(len(cell), np.int64)
        if cell["i"].iloc[0] == cell["j"].iloc[0]:
            hit = linked_in_cell(sets, None, threshold)
            np.fill_diagonal(hit, False)
            links += hit.sum(1)
            pairs = np.argwhere(np.triu(hit))
        elif len(a) and len(b):
            hit = linked_in_cell([sets[x] for x in a], [sets[x] for x in b], threshold)
            links[a] += hit.sum(1)
            links[b] += hit.sum(0)
            p = np.argwhere(hit)
            pairs = np.stack([a[p[:, 0]], b[p[:, 1]]], 1)
        else:
            pairs = np.zeros((0, 2), int)
        num = cell["num"].to_numpy()
        return pd.DataFrame({"num": num, "root": num[_roots(len(num), pairs)], "links": links, "cells": cell["cells"].to_numpy()})

    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf[["comp", "i", "j"]].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
        rest = pdf.iloc[cut[-1] :].reset_index(drop=True) if len(pdf) else pdf
        if out := [decide(pdf.iloc[x:y]) for x, y in zip(cut[:-1], cut[1:])]:
            yield pd.concat(out, ignore_index=True)
    if rest is not None and len(rest):
        yield decide(rest)


def text_key(text: Column) -> Column:
    """What tells texts apart: 128 bits of SHA-256, in hex; a null text is an empty one."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per row of docs: doc_id, text_id, class_id, n_copies, n_links, text_key, stays.

    text_id: the smallest id with the same text. n_copies: rows with that text. n_links: other texts whose sets of
    five-word shingles have a Jaccard similarity of threshold or more with this one's. class_id: the smallest id that
    links and copies lead to. text_key: a 128-bit hash of the text, by which texts are told apart: where different texts
    share an id, each has its own links and class, and two classes can bear that id. stays: the row has the text and the
    id of its class's first document, the one to keep of its near duplicates. A text of fewer words than a shingle is
    one shingle; a text without words has no links, and a null text is an empty one. Rows with a null id
    are ignored. Other columns are ignored; an empty table gives an empty result.

    Copies collapse first, and texts are numbered in the order of their ids. Each distinct text is a leaf of every trie
    of the forest, with a label of full depth. A leaf is matched by its prefix, which starts at full depth and is
    shortened until a partner meets it in some tree with the target recall. How far depends on the text: a small set
    can only have partners well above the threshold, and keeps longer prefixes. Texts under one matched node make
    candidate components with about as many edges as members. Each component's texts are compared exactly in one task,
    or in squares of blocks where it is larger (by number or bytes): pairs are counted there and never written out,
    and only a spanning forest of the links leaves a square."""
    ship(docs.sparkSession)
    lengths = prefix_lengths(threshold, trees, DEPTH, recall)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", F.unhex(text_key(F.col("text"))).alias("tk"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in spans(at):
                sets, own = shingle_rows(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], shingle)
                found = labels(sets, own, trees).view(np.int64)
                size = set_sizes(sets, own)
                found = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * trees), pa.array(found.ravel()))
                depth = pa.array(lengths[np.minimum(size, FEW + 1)], pa.int8())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("tk")[lo:hi], pa.array(size, pa.int64()), depth, found], ["doc_id", "tk", "size", "depth", "labels"])

    signed = stored(rows.mapInArrow(sign, "doc_id long, tk binary, size long, depth byte, labels array<long>"), "signed")
    texts = signed.groupBy("tk").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("depth").alias("depth"), F.first("labels").alias("labels"))
    # numbered in the order of ids, so that the smallest number of a class has its smallest id
    texts = stored(texts.repartitionByRange("text_id", "tk").sortWithinPartitions("text_id", "tk").select(F.monotonically_increasing_id().alias("num"), "*"), "texts")

    leaves = texts.where("size > 0").select(F.explode("labels").alias("label"), "num", "depth")
    found = stored(components(forest_edges(leaves, int(lengths.min()))), "found")
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    known = found.withColumnRenamed("node", "num").join(texts.select("num", "text_id", "tk", "size"), "num")
    known = stored(known, "candidates")
    blocks = known.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    spread = F.when(F.col("n") > WHOLE, F.least(F.lit(float(SQUARES)), F.col("n") * 3 / WHOLE)).otherwise(1.0)
    blocks = stored(blocks.select("root", F.ceil(F.greatest(spread, F.col("n") / block, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("nb")), "blocks")
    member = known.join(small(blocks), "root").select("num", "text_id", "tk", F.col("root").alias("comp"), "nb", F.pmod(F.xxhash64("num"), F.col("nb")).cast("int").alias("block"))
    member = stored(member, "member")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in spans(at):
                flat, own = shingle_rows(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], shingle)
                packed = pa.array([np.unique(flat[x:y]).tobytes() for x, y in zip(own[:-1], own[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("num", "comp", "nb", "block")), packed], ["num", "comp", "nb", "block", "shingles"])

    whole = rows.join(small(member.withColumnRenamed("text_id", "doc_id")), ["doc_id", "tk"])
    whole = whole.dropDuplicates(["num"]).select("num", "comp", "nb", "block", "text").mapInArrow(sets, "num long, comp long, nb int, block int, shingles binary")
    cells = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "num", "block", F.col("nb").alias("cells"), "shingles"
    )
    cells = cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    judged = stored(cells.mapInPandas(lambda it: verify(it, threshold), "num long, root long, links long, cells int"), "judged")
    wide = components(judged.where("cells > 1 and num <> root").select(F.col("num").alias("a"), F.col("root").alias("b")))
    classes = judged.groupBy("num").agg(F.sum("links").alias("n_links"), F.min(F.when(F.col("cells") == 1, F.col("root"))).alias("near"))
    classes = classes.join(wide.select(F.col("node").alias("num"), "root"), "num", "left").select("num", "n_links", F.coalesce("near", "root", "num").alias("class"))
    ids = texts.select(F.col("num").alias("class"), F.col("text_id").alias("class_id"))
    classes = stored(classes.join(ids, "class").select("num", "n_links", "class_id", (F.col("num") == F.col("class")).alias("first")), "classes")
    every = texts.select("num", "tk", "text_id", "n_copies").join(small(classes), "num", "left")
    every = stored(every.select("tk", "text_id", "n_copies", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", F.lit(True)).alias("first")), "known")
    stays = (F.col("first") & (F.col("doc_id") == F.col("class_id"))).alias("stays")
    return signed.select("doc_id", "tk").join(every, "tk").select("doc_id", "text_id", "class_id", "n_copies", "n_links", F.lower(F.hex("tk")).alias("text_key"), stays)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_classes over documents."""
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key", "stays")
