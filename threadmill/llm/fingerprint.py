"""Document fingerprints: a homomorphic multiset hash of paragraphs. DataFrame only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

#: Lanes that tell texts apart (two 64-bit hashes of each paragraph, in halves), and lanes that measure likeness.
EQUAL_LANES, LIKE_LANES = 4, 64
MODULUS = 1 << 32
ROWS_PER_RANGE, MOST_RANGES = 512, 16384


def _add(lanes: Column, more: Column, sign: int = 1) -> Column:
    return F.zip_with(lanes, more, lambda a, b: F.pmod(a + sign * b, F.lit(MODULUS)))


def insert(lanes: Column, paragraph_lanes: Column) -> Column:
    """The fingerprint once a paragraph (or a whole other text) with these lanes is added."""
    return _add(lanes, paragraph_lanes)


def delete(lanes: Column, paragraph_lanes: Column) -> Column:
    """The fingerprint once a paragraph with these lanes is taken away."""
    return _add(lanes, paragraph_lanes, -1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the signed likeness lanes, which estimates the share of the common sentences by length.
    1 for equal fingerprints, 0 if just one text is empty."""
    signed = lambda v: F.transform(F.slice(v, EQUAL_LANES + 1, LIKE_LANES), lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    x, y = signed(a), signed(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, 1.0).when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / norm)))


def as_text(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and lanes (array<long>) for each row of texts; keys must tell its rows apart.

    A text is the multiset of its lines (paragraphs). A paragraph hashes to a wide vector: EQUAL_LANES numbers, and
    LIKE_LANES signed sums over its sentences, weighted by length. Vectors are summed modulo 2**32, so that order
    doesn't matter and paragraphs can be inserted or deleted. A null text is empty; an empty text has one empty
    paragraph."""
    p = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p"))
    s = p.select(*keys, F.xxhash64(F.lit(7), "p").alias("h1"), F.xxhash64(F.lit(11), "p").alias("h2"), F.posexplode(F.split("p", r"(?<=[.!?|;])\s+")).alias("i", "s"))
    s = s.select(
        *keys, *(F.when(F.col("i") == 0, F.col(c)).otherwise(0).alias(c) for c in ("h1", "h2")), F.xxhash64(F.lit(13), "s").alias("h"), F.char_length("s").cast("long").alias("w")
    )
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(MODULUS - 1)), lambda c: F.shiftrightunsigned(c, 32)
    parts = [low("h1"), high("h1"), low("h2"), high("h2")]
    parts += [F.col("w") * (1 - 2 * F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long"))) for i in range(LIKE_LANES)]
    sums = s.groupBy(*keys).agg(*(F.sum(x).alias(f"x{i}") for i, x in enumerate(parts)))
    return sums.select(*keys, F.array(*(F.pmod(F.col(f"x{i}"), F.lit(MODULUS)) for i in range(len(parts)))).alias("lanes"))


def in_ranges(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """docs (doc_id, text) dealt to ranges of doc_id (part), each with copies (halo) of the next range's first rows.

    Ranges end at ids that occur. In descending order the row after a range's smallest id is the largest id of the
    range below; it is copied up. The largest of all is copied to the lowest range, since it follows the last row."""
    rows = docs.count()
    n = max(1, min(MOST_RANGES, math.ceil(rows / rows_per_range)))
    shares = [(i + 1) / n for i in range(n - 1)]
    found = docs.agg(F.percentile_approx("doc_id", shares or [0.5], 20 * n).alias("q"), F.max("doc_id").alias("top")).first()
    ends = sorted({*(found.q or [] if shares else []), found.top} - {None}) or [0]
    bounds = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(ends).bit_length()))]
    search = lambda at, step: F.when((at + step < len(ends)) & (F.get(bounds, at + step - 1) < F.col("doc_id")), at + step).otherwise(at)
    part = reduce(search, [F.lit(s) for s in steps], F.lit(0)) if len(steps) < 4 else F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)
    dealt = docs.withColumn("part", part)
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"))
    up = F.struct(F.pmod(F.col("part") + 1, F.lit(len(ends))).alias("part"), F.lit(True).alias("halo"))
    copies = F.explode(F.when(F.get(bounds, F.col("part")) == F.col("doc_id"), F.array(here, up)).otherwise(F.array(here))).alias("to")
    return dealt.select("doc_id", "text", copies).select("doc_id", "text", "to.part", "to.halo")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Edited: the last half of the code points gives way to the start of the next document's text (descending id; after
    the last the first). Null texts are empty. Rows that share an id follow each other by a hash of the text; a null id
    comes last. A table of one row is its own next document; an empty table gives no rows. Other columns are ignored.

    Whole texts move once, to ranges of ids; the next document's text and fingerprint are then found within a range."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = in_ranges(rows, rows_per_range)
    order = Window.partitionBy("part").orderBy("halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    row = placed.select("part", "halo", "doc_id", "text", F.row_number().over(order).alias("rn"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    row = row.select("part", "halo", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    row = row.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["part", "halo", "rn", "doc_id", "n_chars", "edited_sha256"]
    both = row.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    lanes = fingerprints(both.select(*keys, "x.kind", "x.t"), [*keys, "kind"], "t")
    pair = lanes.groupBy(*keys).agg(*(F.max(F.when(F.col("kind") == k, F.col("lanes"))).alias(c) for k, c in enumerate(("own", "other"))))
    after = Window.partitionBy("part").orderBy("rn")
    pair = pair.withColumn("next", F.coalesce(F.lead("own").over(after), F.col("own"))).where("not halo")
    return pair.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
