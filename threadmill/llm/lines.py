"""Line dedup: a suffix array over sequences of line ids by prefix doubling; intervals of common prefixes show the
repeated runs of lines, whose later copies are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ship, small, stored, table

#: A repeated run of lines counts if it has as many words.
MIN_WORDS = 50
#: Bits of the map of documents that lose lines, which goes to every task: 2 MB, as 64-bit words.
MAP_BITS = 1 << 24
KEY = ["doc_id", "th"]


def ranked(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """distinct rows with r: their place in the order of cols, from 0. Ranges are numbered one by one and then offset by
    the rows before them, so that no task sees all rows."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(distinct.repartitionByRange(n, *cols).withColumn("part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*cols))
    return parts.withColumn("rn", within).join(F.broadcast(offset), "part").select(*cols, (F.col("offset") + F.col("rn") - 1).alias("r"))


def numbered(batches: Iterator[pd.DataFrame], min_words: int) -> Iterator[pd.DataFrame]:
    """Repeated lines of one range of documents, sorted by document and place -> each with p, its number (rising with
    document and place, by one from line to line of a run), e, the number after its run's last line, and lens, the
    lengths of the windows that start here. A run is a stretch of repeated lines of a document; its windows are, for
    each line, the shortest stretches of it that start or end with the line and have min_words: every line of a longer
    stretch is in one of them."""
    part = TaskContext.get().partitionId()
    size = 0

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        nonlocal size
        q, w, key = pdf["q"].to_numpy(), pdf["w"].to_numpy(), pdf[KEY].to_numpy()
        new = np.ones(len(pdf), bool)
        new[1:] = (key[1:] != key[:-1]).any(1) | (q[1:] != q[:-1] + 1)
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(q))[np.cumsum(new) - 1]
        total = np.concatenate([[0], np.cumsum(w)])
        t = np.arange(len(q))
        end = np.searchsorted(total, total[t] + min_words)
        first = np.searchsorted(total, total[t + 1] - min_words, "right") - 1
        lo, hi = np.concatenate([t, first]), np.concatenate([end, t + 1])
        ok = np.concatenate([end <= stop, first >= start[np.cumsum(new) - 1]])
        lo, hi = np.unique(np.stack([lo[ok], hi[ok]]), axis=1)
        lens = np.split((hi - lo).astype(np.int32), np.searchsorted(lo, t[1:]))
        base = (part << 40) + size
        size += len(q)
        return pdf[[*KEY, "i", "r"]].assign(p=base + t, e=base + stop, lens=lens)

    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf[KEY].to_numpy()
        own = (key == key[-1]).all(1) if len(pdf) else np.zeros(0, bool)
        rest = pdf[own].reset_index(drop=True)
        if not own.all():
            yield number(pdf[~own].reset_index(drop=True))
    if rest is not None and len(rest):
        yield number(rest)


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join at every size: neither side has a bound, so none is sent to all tasks while it happens to be
    small. A line or run with many copies makes its partition large; adaptive execution splits such partitions."""
    return left.join(right.hint("merge"), on, how)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, th, i, p, e, lens, r) of the lines with words that occur more than once: as numbered, with i the number of
    the line in its text and r the rank of its hash. Rows that repeat id and text are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), F.posexplode(F.filter(every, lambda x: x["w"] > 0)).alias("q", "x")).where("doc_id is not null")
    lines = stored(some.select(*KEY, "q", "x.i", F.unhex(F.md5("x.line")).alias("h"), F.col("x.w").cast("long").alias("w")), "lines")
    again = stored(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    names = stored(ranked(again, ["h"]), "names")
    line = merged(lines, names, ["h"]).groupBy(*KEY, "q").agg(*(F.first(c).alias(c) for c in ("i", "w", "r")))
    order = stored(line, "line").repartitionByRange(*KEY).sortWithinPartitions(*KEY, "q")
    return stored(order.mapInPandas(lambda it: numbered(it, min_words), "doc_id long, th long, i int, r long, p long, e long, lens array<int>"), "numbered")


def suffix_ranks(line: DataFrame, longest: int) -> list[DataFrame]:
    """(p, e, r) for 1, 2, 4 ... lines, until longest: the rank of the suffix at p, which ends with its run, in the order
    of its first 2**k lines. Ranks of 2**(k + 1) lines are those of pairs of ranks of 2**k lines (prefix doubling); a
    suffix that ends before its second half comes first."""
    levels = [line.select("p", "e", "r")]
    while 1 << (len(levels) - 1) < longest:
        size, rank = 1 << (len(levels) - 1), levels[-1]
        half = rank.select((F.col("p") - size).alias("p"), F.col("r").alias("r2"))
        pair = merged(rank, half, ["p"], "left").select("p", "e", "r", F.when(F.col("p") + size < F.col("e"), F.col("r2")).otherwise(-1).alias("r2"))
        pair = stored(pair, "pair")
        distinct = pair.select(F.col("r").alias("a"), F.col("r2").alias("b")).distinct()
        names = stored(ranked(distinct, ["a", "b"]).select(F.col("a").alias("r"), F.col("b").alias("r2"), F.col("r").alias("name")), "names")
        levels.append(stored(merged(pair, names, ["r", "r2"]).select("p", "e", F.col("name").alias("r")), "rank"))
    return levels


def suffix_array(levels: list[DataFrame], line: DataFrame) -> DataFrame:
    """(s, p, lens, before, lcp): the suffixes that have windows in their order s, with the suffix before each and the
    lines that both have in common at their start, 2**k at most where k is the last level.

    The common prefix is found from the levels, the largest step first: two suffixes whose ranks of 2**k lines are
    equal have as many lines in common, and go on behind them."""
    order = merged(line.where(F.size("lens") > 0).select("p", "lens", F.col("r").alias("line")), levels[-1].select("p", "r"), ["p"])
    parts = stored(order.repartitionByRange("r", "p").withColumn("part", F.spark_partition_id()), "suffixes")
    within, ahead = Window.partitionBy("part").orderBy("r", "p"), Window.orderBy("part")  # ahead: one row per range
    last = parts.groupBy("part").agg(F.count("*").alias("n"), F.max(F.struct("r", "p", "line")).alias("last"))
    last = last.select("part", F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("last").over(ahead).alias("last"))
    sa = parts.withColumn("rn", F.row_number().over(within)).withColumn("prev", F.lag(F.struct("r", "p", "line")).over(within)).join(F.broadcast(last), "part")
    prev = F.coalesce("prev", "last")
    sa = sa.select((F.col("offset") + F.col("rn") - 1).alias("s"), "p", "lens", prev["p"].alias("before"), (prev["r"] == F.col("r")).alias("same"), (prev["line"] == F.col("line")).alias("meet"))
    sa = stored(sa, "sa")
    top = len(levels) - 1
    apart = sa.where("not same and meet").select("p", "before", F.lit(0).alias("lcp"))
    for k in range(top - 1, -1, -1):
        whole = levels[k].where(F.col("p") + (1 << k) <= F.col("e"))
        step = merged(apart.withColumn("at", F.col("p") + F.col("lcp")), whole.select(F.col("p").alias("at"), F.col("r").alias("r1")), ["at"], "left")
        step = merged(step.withColumn("at2", F.col("before") + F.col("lcp")), whole.select(F.col("p").alias("at2"), F.col("r").alias("r2")), ["at2"], "left")
        apart = stored(step.select("p", "before", (F.col("lcp") + F.when(F.col("r1") == F.col("r2"), 1 << k).otherwise(0)).alias("lcp")), "lcp")
    found = merged(sa, apart.select("p", "lcp"), ["p"], "left")
    return found.select("s", "p", "lens", "before", F.coalesce("lcp", F.when(F.col("same"), 1 << top).otherwise(0)).alias("lcp"))


def open_intervals(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """One range of the suffix array in order -> (p, len, interval, part): for each window of a suffix, where the interval
    of suffixes that have its lines in common starts, null if before this range. Rows with a null p tell for each length
    the last start in this range."""
    part, start = None, np.full(depth + 1, -1)
    for pdf in batches:
        if not len(pdf):
            continue
        part = int(pdf["part"].iloc[0])
        p, size, at = [], [], []
        for s, own, lens, lcp in zip(pdf["s"], pdf["p"], pdf["lens"], pdf["lcp"]):
            start[lcp + 1 :] = s
            p.append(np.full(len(lens), own))
            size.append(lens)
            at.append(start[lens])
        at = np.concatenate(at)
        yield pd.DataFrame({"p": np.concatenate(p), "len": np.concatenate(size), "interval": pd.array(at, "Int64").copy(), "part": part}).assign(interval=lambda x: x["interval"].mask(x["interval"] < 0)).astype({"p": "Int64"})
    if part is not None:
        known = np.flatnonzero(start >= 0)
        yield pd.DataFrame({"p": pd.array([None] * len(known), "Int64"), "len": known.astype(np.int32), "interval": pd.array(start[known], "Int64"), "part": part})


def lcp_intervals(sa: DataFrame, depth: int) -> DataFrame:
    """(interval, len, p): for each window of a suffix the interval of the suffix array in which all suffixes have its
    len lines in common. An interval starts where the common prefix with the suffix before is shorter, and is named by
    its start and length. Intervals that began in an earlier range are found by the last start there, one row per
    range and length."""
    n = int(sa.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = sa.repartitionByRange(n, "s").sortWithinPartitions("s").select("s", "p", "lens", "lcp", F.spark_partition_id().alias("part"))
    found = stored(order.mapInPandas(lambda it: open_intervals(it, depth), "p long, len int, interval long, part int"), "intervals")
    before = found.where("p is null").groupBy("part", "len").agg(F.max("interval").alias("start"))
    parts = found.select("part").distinct()
    every = parts.select(F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("len"), "part").join(before, ["part", "len"], "left")
    carried = F.max("start").over(Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = stored(every.select("part", "len", carried.alias("carried")), "carried")
    return found.where("p is not null").join(small(carried), ["part", "len"]).select(F.coalesce("interval", "carried", F.lit(-1)).alias("interval"), "len", "p")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, lines, n_runs): for each document (id and a hash of its text) the numbers of the lines to delete, and
    how many maximal runs they make.

    Lines without words are passed over: they neither break nor lengthen a run. Lines that occur once can't be in a
    repeated run: only the others, as ranks of their hashes, make the sequences whose suffixes are sorted, each
    stretch of them in a document on its own. Suffixes are told apart by as many lines as the longest window has. Of the
    suffixes of one interval the first, by id and place, stays; the others' windows go, and windows that overlap or
    touch make the maximal run."""
    ship(docs.sparkSession)
    line = line_table(docs, id_col, text_col, min_words)
    longest = line.agg(F.max(F.array_max("lens"))).first()[0] or 1
    sa = suffix_array(suffix_ranks(line, longest), line)
    within = stored(lcp_intervals(sa, longest), "within")
    first = stored(within.groupBy("interval", "len").agg(F.min("p").alias("p")), "first")
    later = merged(within.select("p", "len"), first.select("p", "len"), ["p", "len"], "left_anti")
    later = stored(later.groupBy("p").agg(F.max("len").alias("len")), "later")
    placed = merged(line.select(*KEY, "i", "p"), later.select("p", (F.col("p") + F.col("len")).alias("end")), ["p"], "left")
    upto = Window.partitionBy(*KEY).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    gone = placed.withColumn("end", F.max("end").over(upto)).where(F.col("end") > F.col("p"))
    gone = gone.withColumn("new", F.coalesce(F.col("p") != F.lag("p").over(Window.partitionBy(*KEY).orderBy("p")) + 1, F.lit(True)))
    return gone.groupBy(*KEY).agg(F.sort_array(F.collect_list("i")).alias("lines"), F.sum(F.col("new").cast("int")).alias("n_runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, n_runs, dropped (line numbers, comma-joined), text (what is
    left).

    Of every run of lines with min_words or more that occurs more than once, in one document or in several, the first
    copy stays, by id and place, and later copies go. Runs that overlap their own copy lose what the later copy covers.
    A null text is empty, with one line. Rows that repeat id and text are one document; an id may have several texts.
    Rows with a null id keep their lines and don't count as copies. Other columns are ignored; an empty table gives an
    empty result.

    Only texts that lose lines, and the few that share their bit of a fixed map with one, meet their line numbers by a
    shuffle; all others are passed on where they are read."""
    ship(docs.sparkSession)
    gone = stored(repeated_lines(docs, id_col, text_col, min_words), "gone")
    bit = F.pmod(F.xxhash64(*KEY), F.lit(MAP_BITS))
    marks = gone.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    marks = F.broadcast(stored(marks, "marks"))  # at most MAP_BITS / 64 rows
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), text.alias("text"))
    rows = rows.withColumn("word", F.shiftright(bit, 6)).join(marks, "word", "left")
    hit = F.coalesce(F.getbit("bits", F.pmod(bit, F.lit(64)).cast("int")) == 1, F.lit(False))
    nothing = rows.where(~hit).select("doc_id", "text", F.lit(None).cast("array<int>").alias("lines"), F.lit(None).cast("long").alias("n_runs"))
    both = merged(rows.where(hit).select(*KEY, "text"), gone, KEY, "left").select("doc_id", "text", "lines", "n_runs").unionByName(nothing)

    split = F.split("text", "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("lines"))
    # an array of one, so that the text is split once
    left = F.transform(F.array(split), lambda x: F.array_join(F.transform(numbers, lambda i: x[i]), "\n"))[0]
    dropped = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("n_dropped")
    listed = F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("dropped")
    return both.select("doc_id", F.size(split).alias("n_lines"), dropped, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), listed, F.when(F.col("lines").isNull(), F.col("text")).otherwise(left).alias("text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over documents, with the rest of each text as its length and digest."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_runs", "dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
