"""Candidate pairs without all pairs: what contains what, by an automaton over names, and strings that share enough of
their rarest parts to be worth a comparison."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .store import settled, ship

#: Names of one automaton have so many characters together, about: its nodes take some hundred bytes each at most.
SET_CHARS = 1 << 20
#: Names whose characters go to the tasks at once, and are compared at once.
NAMES_AT_ONCE, NAMES_A_STEP = 1 << 16, 512
#: Texts that a task holds as strings at once, with the names in them.
TEXTS_AT_ONCE = 256
#: Plans of several automata that are joined before the result is stored.
SETS_AT_ONCE = 8

_automata: dict[str, ahocorasick.Automaton] = {}


def characters(text: Column) -> Column:
    """Distinct characters of a text without its white space."""
    bare = F.regexp_replace(text, r"(?U)\s", "")
    return F.array_distinct(F.filter(F.split(bare, ""), lambda c: c != ""))


def _automaton(mark: str, names: list[str]) -> ahocorasick.Automaton:
    """The automaton of a set of names, built once by a worker and kept while it works on that set."""
    if mark not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, name in enumerate(names):
            built.add_word(name, k)
        built.make_automaton()
        _automata[mark] = built
    return _automata[mark]


def _named(batches: Iterator[pa.RecordBatch], mark: str, names: Broadcast) -> Iterator[pa.RecordBatch]:
    """(keys, text) -> (keys, name): the names that each text contains."""
    find = _automaton(mark, names.value).iter
    for batch in (whole.slice(lo, TEXTS_AT_ONCE) for whole in batches for lo in range(0, whole.num_rows, TEXTS_AT_ONCE)):
        rows, found = [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            hits = {k for _, k in find(text)} if text else ()
            rows += [i] * len(hits)
            found += hits
        at = pa.array(rows, pa.int64())
        keys = [batch.column(k).take(at) for k in range(batch.num_columns - 1)]
        yield pa.record_batch([*keys, pa.array([names.value[k] for k in found], pa.string())], names=[*batch.schema.names[:-1], "name"])


def containing(texts: DataFrame, keys: list[str], text: str, names: DataFrame, name: str, least: int = 1) -> DataFrame:
    """(keys, name): the distinct names (`least` characters or more) that each text contains. Null texts contain none.

    Names are dealt by a hash into sets of some SET_CHARS characters. A set goes to every worker, which builds an
    Aho-Corasick automaton of it and runs it once over each text: a text is read as often as there are sets, and only
    keys and names leave the task. The driver holds the names of one set at a time."""
    spark = texts.sparkSession
    ship(spark)
    named = settled(names.where(F.char_length(name) >= max(1, least)).select(F.col(name).alias("name")).distinct())
    sets = math.ceil((named.agg(F.sum(F.char_length("name"))).first()[0] or 0) / SET_CHARS)
    rows = texts.select(*keys, text).where(F.col(text).isNotNull())
    schema = StructType([*rows.schema.fields[:-1], StructField(name, StringType())])
    found = spark.createDataFrame([], schema)
    for k in range(sets):
        own = [r[0] for r in named.where(F.pmod(F.xxhash64("name"), F.lit(sets)) == k).collect()]
        if own:
            find = partial(_named, mark=uuid.uuid4().hex, names=spark.sparkContext.broadcast(own))
            found = found.unionByName(rows.mapInArrow(find, schema))
        if k % SETS_AT_ONCE == SETS_AT_ONCE - 1:
            found = settled(found)
    return found


def _covered(batches: Iterator[pa.RecordBatch], names: Broadcast, most: int) -> Iterator[pa.RecordBatch]:
    """(qid, chars, had) -> (qid, node): see first_covered."""
    nodes, items, need = names.value
    places = {c: k for k, c in enumerate(sorted({c for x in items for c in x}))}

    def bits(chars: list[str] | None) -> np.ndarray:
        out = np.zeros(len(places) // 64 + 1, np.uint64)
        for c in chars or ():
            if (k := places.get(c)) is not None:
                out[k >> 6] |= np.uint64(1 << (k & 63))
        return out

    table, need = np.array([bits(x) for x in items]), np.array(need)
    for batch in batches:
        rows, found = [], []
        for i, (chars, had) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2)))):
            own, known, left = bits(chars), set(had or ()), most
            for at in range(0, len(nodes), NAMES_A_STEP):
                part = slice(at, at + NAMES_A_STEP)
                hits = np.flatnonzero(np.bitwise_count(table[part] & own).sum(axis=1) >= need[part])
                new = [n for k in hits if (n := nodes[at + int(k)]) not in known][:left]
                rows += [i] * len(new)
                found += new
                left -= len(new)
                if not left:
                    break
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["qid", "node"])


def first_covered(questions: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(qid, node): names (node, items, need, size) of whose distinct characters a question (qid, chars, had) has `need` or
    more, without those in had: the `most` first by size, then by name, both descending, of every set of names.

    Characters are few, so that as keys of a join they would make almost all pairs. Names are dealt by a hash into sets
    of NAMES_AT_ONCE; a task has a set's characters as bits in that order and stops at a question's last name. Only what
    is found leaves it. The driver holds the names of one set at a time."""
    spark = questions.sparkSession
    ship(spark)
    names = settled(names.select("node", "items", F.col("need").cast("int").alias("need"), F.col("size").cast("int").alias("size")).where("node is not null"))
    sets = math.ceil(names.count() / NAMES_AT_ONCE)
    rows = questions.select("qid", "chars", "had")
    schema = StructType([rows.schema["qid"], StructField("node", StringType())])
    found = spark.createDataFrame([], schema)
    for k in range(sets):
        own = sorted(((r["size"], r["node"], r["items"], r["need"]) for r in names.where(F.pmod(F.xxhash64("node"), F.lit(sets)) == k).collect()), reverse=True)
        if own:
            _, nodes, items, need = zip(*own)
            found = found.unionByName(rows.mapInArrow(partial(_covered, names=spark.sparkContext.broadcast((nodes, items, need)), most=most), schema))
        if k % SETS_AT_ONCE == SETS_AT_ONCE - 1:
            found = settled(found)
    return found


def numbered_items(items: Column) -> Column:
    """Items of an array with how often each stood before, so that repeats are items of their own."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("\u0001"), F.size(F.filter(F.slice(items, 1, i), lambda y: y == x)).cast("string")))


def rarest(sets: DataFrame, by: list[str], items: str, most: Column) -> DataFrame:
    """(by, item): the `most` rarest items of each row's array, by how many rows have each."""
    flat = sets.select(*by, most.alias("most"), F.explode(items).alias("item"))
    counts = flat.groupBy("item").agg(F.count("*").alias("rows_with"))
    order = Window.partitionBy(*by).orderBy("rows_with", "item")
    return flat.join(counts, "item").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("most")).select(*by, "item")


def overlapping(sets: DataFrame, block: str, items: str, need: Column) -> DataFrame:
    """(early, late): pairs of sets (rank, block, items) of one block that can share as many items as either needs.

    A set that shares `need` of its n items with another shares one of its n - need + 1 rarest: only these meet, by an
    equi join, so that frequent items make no pairs."""
    prefix = rarest(sets, ["rank", block], items, F.greatest(F.size(items) - need + 1, F.lit(1)))
    other = prefix.select(F.col("rank").alias("late"), block, "item")
    return prefix.withColumnRenamed("rank", "early").join(other, [block, "item"]).where("early < late").select("early", "late").distinct()


def _parts(text: pd.Series) -> pd.Series:
    """2-grams and characters of each string, with how often each stood before."""

    def of(x: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for part in [x[i : i + 2] for i in range(len(x) - 1)] + list(x):
            out.append(f"{part}\u0001{seen[part]}")
            seen[part] += 1
        return out

    return text.map(lambda x: None if x is None else of(x))


def parts(text: Column) -> Column:
    """An array of the 2-grams of a string and then its characters, numbered, so that repeats are parts of their own."""
    return F.pandas_udf(_parts, "array<string>")(text)


def window_need(size: Column, ratio: float) -> tuple[Column, Column]:
    """How many of its own 2-grams, and of its characters, a string of this size has in common with any window that is
    alike (partial ratio or more).

    Of n characters, d are missing in the window, which has e others: 200 (n - d) >= ratio (2 n - d + e). A missing
    character takes two 2-grams along, another one parts one. Where 2-grams can't be had, characters can."""
    missing = size * (200 - 2 * ratio) / (200 - ratio)
    return (size - 1 - F.floor(2 * missing + 1e-9)).cast("int"), (size - F.floor(missing + 1e-9)).cast("int")


def window_bound(size: Column, shared: Column, ratio: float) -> Column:
    """The highest partial ratio that strings can have of which the shorter, of this size, shares so many 2-grams (or, if
    too few can be had, characters) with the longer."""
    grams, _ = window_need(size, ratio)
    lost = F.when(grams >= 1, (size - 1 - shared) / 2).otherwise(size - shared)
    return 200 * (size - lost) / (2 * size - lost)


def sharing(short: DataFrame, long: DataFrame, ids: tuple[str, str], block: list[str] = ()) -> DataFrame:
    """(ids, shared): pairs of short (id, own, need, block) and long (id, parts, block) of one block that share `need` of
    own or more: one of its size - need + 1 rarest must be among them, so these meet all parts by an equi join."""
    keys = rarest(short, [ids[0], *block], "own", F.size("own") - F.col("need") + 1)
    met = keys.join(long.select(ids[1], *block, F.explode("parts").alias("item")), [*block, "item"]).select(*ids).distinct()
    both = met.join(short.select(ids[0], "own", "need"), ids[0]).join(long.select(ids[1], "parts"), ids[1])
    return both.withColumn("shared", F.size(F.array_intersect("own", "parts"))).where(F.col("shared") >= F.col("need")).select(*ids, "shared")


def like_windows(left: DataFrame, right: DataFrame, ratio: float, block: list[str] = ()) -> DataFrame:
    """(left_id, right_id, left_name, right_name, bound): pairs of left and right (id, name, block) of one block whose
    partial ratio can be `ratio` or more, with the highest it can be. Ids are unique on their side, names not empty.

    The shorter of two such strings shares as many parts with the longer as window_need says."""
    ship(left.sparkSession)
    sides = {}
    for side, rows in (("left", left), ("right", right)):
        rows = rows.where(F.char_length("name") > 0).select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), *block, F.char_length("name").alias("size"), parts(F.col("name")).alias("parts"))
        grams, letters = window_need(F.col("size"), ratio)
        rows = rows.withColumn("need", F.when(grams >= 1, grams).otherwise(letters))
        sides[side] = settled(rows.withColumn("own", F.when(grams >= 1, F.slice("parts", F.lit(1), F.greatest(F.col("size") - 1, F.lit(0)))).otherwise(F.slice("parts", F.col("size"), F.col("size")))))
    out = None
    for ids in (("left_id", "right_id"), ("right_id", "left_id")):
        short, long = (sides[x.removesuffix("_id")] for x in ids)
        names = [x.replace("_id", "_name") for x in ids]
        met = sharing(short, long, ids, block).join(short.select(ids[0], names[0], "size"), ids[0]).join(long.select(ids[1], names[1], F.col("size").alias("other_size")), ids[1])
        met = met.where(F.col("size") <= F.col("other_size") if ids[0] == "left_id" else F.col("size") < F.col("other_size"))
        met = met.select("left_id", "right_id", "left_name", "right_name", window_bound(F.col("size"), F.col("shared"), ratio).alias("bound"))
        out = met if out is None else out.unionByName(met)
    return out


def like_words(left: DataFrame, right: DataFrame, ratio: float, block: list[str] = ()) -> DataFrame:
    """(left_id, right_id, left_name, right_name): pairs of left and right (id, name, block) of one block whose token-set
    ratio can be `ratio` or more. Ids are unique on their side.

    Either their common words make up the share ratio / (200 - ratio) of one side, its words joined: then one of its
    rarest words is common, those without which the others would be too short. Or all their words, in some order, are
    alike: then the side with n characters, no more than the other's, lacks at most n (100 - ratio) / 100 of them."""
    ship(left.sparkSession)
    sides, words = {}, {}
    share = ratio / (200 - ratio)
    for side, rows in (("left", left), ("right", right)):
        own = F.array_distinct(F.filter(F.split("name", r"(?U)\s+"), lambda w: w != ""))
        rows = rows.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), *block, own.alias("words"))
        rows = rows.where(F.size("words") > 0).withColumn("size", F.char_length(F.array_join("words", " ")))
        bare = F.col("size") - F.size("words") + 1  # characters without the blanks between words
        rows = rows.withColumn("parts", F.slice(parts(F.array_join("words", "")), bare, bare))
        rows = settled(rows.withColumn("need", (bare - F.floor(F.col("size") * (100 - ratio) / 100 + 1e-9)).cast("int"))).withColumn("own", F.col("parts"))
        sides[side] = rows
        flat = rows.select(f"{side}_id", *block, "size", F.explode("words").alias("item"))
        words[side] = settled(flat)
    out = None
    for ids in (("left_id", "right_id"), ("right_id", "left_id")):
        one, two = (x.removesuffix("_id") for x in ids)
        alike = sharing(sides[one], sides[two], ids, block).join(sides[one].select(ids[0], "size"), ids[0]).join(sides[two].select(ids[1], F.col("size").alias("other_size")), ids[1])
        alike = alike.where((F.col("size") <= F.col("other_size")) & (F.col("other_size") <= F.ceil(F.col("size") * (200 - ratio) / ratio - 1e-9))).select("left_id", "right_id")
        often = words[one].groupBy("item").agg(F.count("*").alias("rows_with"))
        rest = F.sum(F.char_length("item") + 1).over(Window.partitionBy(ids[0]).orderBy("rows_with", "item").rowsBetween(Window.currentRow, Window.unboundedFollowing)) - 1
        rare = words[one].join(often, "item").withColumn("rest", rest).where(F.col("rest") >= F.col("size") * share - 1e-9)
        common = rare.join(words[two].select(ids[1], *block, "item"), [*block, "item"]).select("left_id", "right_id")
        out = alike.unionByName(common) if out is None else out.unionByName(alike).unionByName(common)
    out = out.distinct()
    return out.join(sides["left"].select("left_id", "left_name"), "left_id").join(sides["right"].select("right_id", "right_name"), "right_id")
