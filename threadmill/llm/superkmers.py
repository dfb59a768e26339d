"""Substring dedup by super-k-mers: consecutive windows of words that share a minimiser travel as one packed string to
the bucket of the minimiser, where windows are named exactly, sorted and counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import mix, ship, spans, stored, table, utf8, word_hashes, words

#: Words of a window, and of the minimiser that is sought in it.
WINDOW, MINIMISER = 20, 5
#: Windows of a super-k-mer at most: a mask of 64 bits says which of them repeat.
MOST_WINDOWS = 64
#: Super-k-mers of one minimiser that meet in one group, about: those of a more frequent one are dealt into slices.
PER_SLICE = 512
#: Words that are named and sorted at once in a bucket, about.
WORDS_AT_ONCE = 300_000
#: Bits of a map that tells which keys can't have a partner and so needn't move; 2 MB at most go to a task. It fills up
#: as the input grows, and then all keys move; results are the same.
MAP_BITS = 1 << 24
KEY = ["doc_id", "th"]


def bit_map(keys: DataFrame) -> DataFrame:
    """(word, bits) of a map of MAP_BITS in which the hashes of keys (one long column, k) are set."""
    bit = F.pmod(F.xxhash64("k"), F.lit(MAP_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    return stored(keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")), "bits")


def split_by_map(rows: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (with k) that may have a partner among the keys of a map, and those that have none."""
    bit = F.pmod(F.xxhash64("k"), F.lit(MAP_BITS))
    found = rows.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(bits), "word", "left")  # MAP_BITS / 64 rows at most
    hit = F.coalesce(F.getbit("bits", F.pmod(bit, F.lit(64)).cast("int")) == 1, F.lit(False))
    return found.where(hit).drop("word", "bits"), found.where(~hit).drop("word", "bits")


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join: no side has a bound, and adaptive execution splits partitions that a hot key makes large."""
    return left.join(right.hint("merge"), on, how)


def super_kmers(data: np.ndarray, at: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Of rows of text: row, first window, number of windows and minimiser of each super-k-mer, whether windows in it may
    be equal, and words() of the rows.

    A minimiser is the least hash of size words in a row within a window. Windows are numbered by their first word. Of
    two equal windows the first loses its leftmost minimiser before the second begins: then the words of the minimiser
    begin a window that isn't the last."""
    starts, ends, first = found = words(data, at)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, none, none.astype(bool), found
    hashes = word_hashes(data, starts, ends)
    short = hashes[: len(hashes) - size + 1].copy()
    for j in range(1, size):
        short = mix(short * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - size + 1 + j])
    least, reach, span = short, 1, window - size + 1
    while reach < span:
        step = min(reach, span - reach)
        least, reach = np.minimum(least[: len(least) - step], least[step:]), reach + step
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    w = np.flatnonzero(row[: len(least)] == row[window - 1 : window - 1 + len(least)])
    if not len(w):
        return none, none, none, none, none.astype(bool), found
    mini, row = least[w].view(np.int64), row[w]
    new = np.ones(len(w), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (row[1:] != row[:-1])
    run = np.flatnonzero(new)
    new[(np.arange(len(w)) - run[np.cumsum(new) - 1]) % MOST_WINDOWS == 0] = True
    run = np.flatnonzero(new)
    leaves = (short[w] == least[w]) & ~np.append(new[1:], True)
    return row[run], w[run] - first[row[run]], np.diff(np.append(run, len(w))), mini[run], np.logical_or.reduceat(leaves, run), found


def minimisers(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """(k, text) -> (k, minis): the minimisers of each text's super-k-mers, one for each, or two where its own windows may
    be equal."""
    for batch in batches:
        data, at = utf8(batch.column(1))
        for lo, hi in spans(at):
            row, _, _, mini, twice, _ = super_kmers(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], window, size)
            row, mini = np.repeat(row, 1 + twice), np.repeat(mini, 1 + twice)
            offsets = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(mini))], names=["k", "minis"])


def slices(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of data, one behind the other, and their offsets."""
    out = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.repeat(at - out[:-1], lengths) + np.arange(out[-1])], out


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, each with one space behind it, and their offsets."""
    out, to = slices(np.append(data, np.uint8(32)), starts, ends - starts + 1)
    out[to[1:] - 1] = 32
    return out, to


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)).cast(pa.string())


def packed(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, minis, slices) -> (mini, slice, hot, doc_id, th, start, text): the super-k-mers whose minimiser
    is one of minis, as their words with a space behind each. Those of a hot minimiser are dealt into its slices."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        minis, many = batch.column("minis"), batch.column("slices")
        offsets, minis, many = minis.offsets.to_numpy(), minis.values.to_numpy(), many.values.to_numpy()
        th = batch.column("th").to_numpy()
        for lo, hi in spans(at):
            row, start, n, mini, _, (starts, ends, first) = super_kmers(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], window, size)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            times = np.zeros(len(row), np.int64)
            for r in range(hi - lo):
                asked, own = minis[offsets[lo + r] : offsets[lo + r + 1]], slice(bounds[r], bounds[r + 1])
                if len(asked) and own.start < own.stop:
                    order = np.argsort(asked)
                    k = np.minimum(np.searchsorted(asked[order], mini[own]), len(asked) - 1)
                    times[own] = np.where(asked[order][k] == mini[own], many[offsets[lo + r] : offsets[lo + r + 1]][order][k], 0)
            got = times > 0
            row, start, n, mini, times = row[got], start[got], n[got], mini[got], times[got]
            text, to = spaced(data[at[lo] : at[hi]], starts, ends)
            w = first[row] + start
            text, to = slices(text, to[w], to[w + n + window - 1] - to[w])
            dealt = (mix((th[lo + row] ^ start).astype(np.uint64)) % times.astype(np.uint64)).astype(np.int32)
            for i in range(0, len(row), 10_000):
                j = min(i + 10_000, len(row))
                ids = batch.column("doc_id").take(pa.array(lo + row[i:j]))
                part = strings(text[to[i] : to[j]], to[i : j + 1] - to[i])
                yield pa.record_batch(
                    [pa.array(mini[i:j]), pa.array(dealt[i:j]), pa.array(times[i:j] > 1), ids, pa.array(th[lo + row[i:j]]), pa.array(start[i:j].astype(np.int32)), part],
                    names=["mini", "slice", "hot", "doc_id", "th", "start", "text"],
                )


def window_names(text: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed strings: string, place in it and name of each window, equal for equal windows alone, and the offsets of
    the words in the strings' bytes.

    Words get numbers, and stretches of 2, 4, 8 ... words numbers for the pairs of their halves', until two of them
    cover a window."""
    data, at = utf8(text)
    ends = np.flatnonzero(data == 32) + 1
    offsets = np.concatenate([[0], ends])
    names = strings(data, offsets).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.searchsorted(offsets, at)
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        names = pd.factorize(names[: len(names) - step] * (names.max() + 1) + names[step:])[0].astype(np.int64)
        reach += step
    per = np.diff(first) - window + 1
    string = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(string)) - np.repeat(np.cumsum(per) - per, per)
    return string, place, names[first[string] + place], offsets


def repeats(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers in the order of (mini, slice, doc_id, th, start) -> (doc_id, th, start, mask, text). mask has the
    windows from start on that came earlier in the same minimiser and slice. For hot minimisers, whose slices don't know
    each other's windows, there is also a row for each first window of a slice, with its text and no mask."""

    def found(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        string, place, name, offsets = window_names(block.column("text"), window)
        mini, dealt, hot = (block.column(c).to_numpy(zero_copy_only=False) for c in ("mini", "slice", "hot"))
        start = block.column("start").to_numpy()
        group = np.cumsum(np.append(0, (mini[1:] != mini[:-1]) | (dealt[1:] != dealt[:-1])))
        whole = group[string] * (name.max() + 1) + name
        order = np.argsort(whole, kind="stable")  # equal windows, the earliest first
        earliest = np.ones(len(order), bool)
        earliest[order[1:]] = whole[order[1:]] != whole[order[:-1]]
        mask = np.bitwise_or.reduceat(np.where(earliest, 0, 1).astype(np.uint64) << place.astype(np.uint64), np.flatnonzero(place == 0)).view(np.int64)
        later = np.flatnonzero(mask != 0)
        rows = [block.column(c).take(pa.array(later)) for c in ("doc_id", "th", "start")]
        names = ["doc_id", "th", "start", "mask", "text"]
        if len(later):
            yield pa.record_batch([*rows, pa.array(mask[later]), pa.nulls(len(later), pa.string())], names=names)
        first = np.flatnonzero(earliest & hot[string].astype(bool))
        if len(first):
            data, at = utf8(block.column("text"))
            w = np.searchsorted(offsets, at)[string[first]] + place[first]
            text, to = slices(data, offsets[w], offsets[w + window] - offsets[w])
            ids = [block.column(c).take(pa.array(string[first])) for c in ("doc_id", "th")]
            yield pa.record_batch([*ids, pa.array((start[string[first]] + place[first]).astype(np.int32)), pa.nulls(len(first), pa.int64()), strings(text, to)], names=names)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size < WORDS_AT_ONCE * 6:
            continue
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        mini, dealt = block.column("mini").to_numpy(), block.column("slice").to_numpy()
        cut = np.flatnonzero((mini != mini[-1]) | (dealt != dealt[-1]))
        if len(cut):  # the last group may go on
            yield from found(block.slice(0, int(cut[-1]) + 1))
            block = block.slice(int(cut[-1]) + 1)
        held, size = [block], block.column("text").nbytes
    if held and (block := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield from found(block.to_batches()[0])


def _rest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, later) -> (doc_id, n_words, n_removed, text): words that no later window covers, with one space
    between them. later has the first windows and the masks of what repeats, or is null."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        later = batch.column("later")
        offsets = later.offsets.to_numpy() - later.offsets[0].as_py()
        pairs = later.flatten()
        start, mask = (pairs.field(k).to_numpy() for k in range(2))
        for lo, hi in spans(at):
            starts, ends, first = words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            own = slice(offsets[lo], offsets[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            which, bit = np.nonzero(np.unpackbits(mask[own].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            w = first[row[which]] + start[own][which] + bit
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, w, 1)
            np.add.at(change, w + window, -1)
            kept = np.cumsum(change[:-1]) == 0
            text, to = spaced(data[at[lo] : at[hi]], starts[kept], ends[kept])
            bounds = np.concatenate([[0], np.cumsum(kept)])[first]
            n, left = np.diff(first), np.diff(bounds)
            some = left > 0  # the last word's space goes
            text, to = slices(text, to[bounds[:-1]], to[bounds[1:]] - to[bounds[:-1]] - some)
            yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(n - left), strings(text, to)], names=["doc_id", "n_words", "n_removed", "text"])


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int, size: int) -> DataFrame:
    """(doc_id, th, start, mask): windows of each document, by their first word, that also start earlier. Documents are
    told apart by id and a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("th"), text.alias("text")).where("doc_id is not null").withColumn("k", F.xxhash64(*KEY))
    kind = docs.schema[id_col].dataType.simpleString()
    once = stored(rows.select("k", "text").mapInArrow(lambda it: minimisers(it, window, size), "k long, minis array<long>"), "minis")  # a repeated row's count twice, which only sends more
    marks = once.select("k", F.explode("minis").alias("mini"))
    often = stored(marks.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # a window that repeats has a minimiser that repeats: all others stay where they are
    shared, _ = split_by_map(marks.select("mini", F.col("k").alias("doc"), F.col("mini").alias("k")), bit_map(often.select(F.col("mini").alias("k"))))
    shared = merged(shared.select("mini", F.col("doc").alias("k")), often, ["mini"])
    asked = shared.groupBy("k").agg(F.collect_set(F.struct("mini", F.ceil(F.col("n") / PER_SLICE).cast("long").alias("slices"))).alias("asked"))
    asked = stored(asked.select("k", F.col("asked.mini").alias("minis"), F.col("asked.slices").alias("slices")), "asked")
    some, _ = split_by_map(rows, bit_map(asked.select("k")))
    some = merged(some, asked, ["k"]).dropDuplicates(["k", *KEY]).select(*KEY, "text", "minis", "slices")
    travelling = some.mapInArrow(lambda it: packed(it, window, size), f"mini long, slice int, hot boolean, doc_id {kind}, th long, start int, text string")
    order = ["mini", "slice", *KEY, "start"]
    bucket = travelling.repartition("mini", "slice").sortWithinPartitions(*order)
    found = stored(bucket.mapInArrow(lambda it: repeats(it, window), f"doc_id {kind}, th long, start int, mask long, text string"), "repeats")
    first = found.where("mask is null").select("text", F.struct(*KEY, "start").alias("at"))
    hot = merged(first, first.groupBy("text").agg(F.min("at").alias("earliest")), ["text"]).where(F.col("at") > F.col("earliest"))
    return found.where("mask is not null").select(*KEY, "start", "mask").unionByName(hot.select("at.*", F.lit(1).cast("long").alias("mask")))


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, text (the words that stay, with one space between them).

    A window is that many consecutive words of one document. Words are removed that a window covers which also starts
    earlier: in a document with a smaller id, or earlier in the same one; windows are those of the input. A null text
    has no words. Rows that repeat id and text are one document and share the result; of texts that share an id one
    counts as earlier, by its hash. Rows with a null id keep their words and don't count as copies. Other columns are
    ignored; an empty table gives an empty result.

    Minimisers are counted first, as numbers, and only super-k-mers whose minimiser occurs twice are packed and sent.
    A hot minimiser's are dealt into slices, each of which finds its first windows; these meet by their text. Very long
    texts are read whole in one task each, in arrays of some ten times their size."""
    ship(docs.sparkSession)
    later = repeated_windows(docs, id_col, text_col, window, size)
    later = stored(later.groupBy(*KEY).agg(F.collect_list(F.struct("start", "mask")).alias("later")).withColumn("k", F.xxhash64(*KEY)), "later")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("th"), text.alias("text")).withColumn("k", F.xxhash64(*KEY))
    some, none = split_by_map(rows, bit_map(later.select("k")))
    nothing = F.array().cast(later.schema["later"].dataType)
    both = merged(some.drop("k"), later.drop("k"), KEY, "left").select("doc_id", "text", F.coalesce("later", nothing).alias("later")).unionByName(none.select("doc_id", "text", nothing.alias("later")))
    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(lambda it: _rest(it, window), f"doc_id {kind}, n_words long, n_removed long, text string")


def op11_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over documents, with the rest of each text as a digest."""
    return dedup_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM t),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM s, (SELECT unnest(range(20)) AS k) WHERE n > 1),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM t),
kept AS (
  SELECT doc_id, count(gone.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
