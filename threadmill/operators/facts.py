"""From raw triples to facts: aggregation, grounding, ranges of codes, nearest procedures, leaders of like names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import settled


def aggregate_facts(triples: DataFrame) -> DataFrame:
    """(h, r, t, origin, sources, n_sources) of triples (ord, h, r, t, origin, src): distinct sources in order of first
    sight; origin is rule if any triple's is, else the first one's."""
    first = triples.groupBy("h", "r", "t", "src").agg(F.min("ord").alias("ord"), F.min_by("origin", "ord").alias("origin"), F.max(F.col("origin") == "rule").alias("rule"))
    sources = F.transform(F.array_sort(F.collect_list(F.struct("ord", "src"))), lambda x: x["src"])
    out = first.groupBy("h", "r", "t").agg(F.when(F.max("rule"), "rule").otherwise(F.min_by("origin", "ord")).alias("origin"), sources.alias("sources"))
    return out.select("h", "r", "t", "origin", F.array_join("sources", "; ").alias("sources"), F.size("sources").alias("n_sources"))


def clean_triples(triples: DataFrame, stopwords: list[str]) -> DataFrame:
    """Triples without empty, short, stopword or equal ends."""
    fine = lambda c: (F.char_length(c) >= 2) & ~F.col(c).isin(stopwords)
    return triples.where(fine("h") & fine("t") & (F.col("h") != F.col("t")))


def normalised(name: Column) -> Column:
    """Middle dots unified, white space collapsed, corner brackets and quotes stripped at the ends."""
    dots = F.translate(name, "ㆍ・", "··")
    return F.regexp_replace(F.trim(F.regexp_replace(dots, r"(?U)\s+", " ")), r"^[「」\"']+|[「」\"']+$", "")


def grounded(triples: DataFrame, docs: DataFrame, names: DataFrame, code: str = r"[A-H]-[0-9]{1,2}(?:-[0-9])?") -> DataFrame:
    """triples (h, r, t, origin, src) with -inferred after the origin where an end that is a code stands neither itself nor
    by its name (names: code, label) in its document (src, body) or that one's title. Other ends aren't tested, and
    nothing is dropped."""
    label = names.where("label <> ''").groupBy("code").agg(F.min("label").alias("label"))
    out = triples.join(docs, "src", "left").withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.lit(" "), F.col("src")))
    missing = F.lit(False)
    for end in ("h", "t"):
        out = out.join(label.select(F.col("code").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
        said = F.contains("body", F.col(end)) | F.coalesce(F.contains("body", F.col(f"{end}_label")), F.lit(False))
        missing = missing | (F.col(end).rlike(f"^(?:{code})$") & ~said)
    return out.withColumn("origin", F.when(missing, F.concat("origin", F.lit("-inferred"))).otherwise(F.col("origin"))).drop("body", "h_label", "t_label")


def expand_ranges(ranges: DataFrame, order: DataFrame) -> DataFrame:
    """Every code (code, pos) between the two of a range (id, a, b), both included; unknown or reversed ranges give none."""
    start, end = (order.select(F.col("code").alias(c), F.col("pos").alias(f"p{c}")) for c in "ab")
    known = ranges.join(start, "a").join(end, "b").where("pa <= pb").select("id", F.explode(F.sequence("pa", "pb")).alias("pos"))
    return known.join(order, "pos").select("id", "code")


def nearest(left: DataFrame, right: DataFrame, by: str, reach: int, ahead: bool) -> DataFrame:
    """As-of match within reach: for each left row (id, by, at) the last right row (by, at, what) before it, or the
    first after it. One pass over both sides merged and sorted, so a busy key costs no pairs; and by blocks of reach, of
    which a left row sees its own and the one before or after, so that a long history is many groups."""
    block = F.floor(F.col("at") / reach)
    left = left.withColumn("block", block)
    right = right.withColumn("block", F.explode(F.array(block, block + (-1 if ahead else 1))))
    sides = left.select("id", by, "block", "at", F.lit(None).cast("string").alias("what"), F.lit(1).alias("side"))
    sides = sides.unionByName(right.select(F.lit(None).cast("long").alias("id"), by, "block", "at", "what", F.lit(2).alias("side")))
    hit = F.when(F.col("side") != 1, F.struct("at", "what"))
    # rows at the same place don't count: left rows come before right ones
    order = [F.col("at") if not ahead else F.col("at").desc(), F.col("side"), "what"]
    w = Window.partitionBy(by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sides.withColumn("hit", F.last(hit, ignorenulls=True).over(w)).where("side = 1")
    far = F.abs(F.col("hit.at") - F.col("at"))
    return out.select("id", F.when(far <= reach, F.col("hit.what")).alias("what"), F.when(far <= reach, far).alias("distance"))


def leaders(names: DataFrame, matches: DataFrame) -> DataFrame:
    """(rank, leader): greedy leader clustering of ranked names over match pairs (early < late ranks).

    In rank order a name joins the first earlier leader it matches, or leads. That is the lexicographically first
    maximal independent set: round by round, a name all of whose earlier matches are decided is decided."""
    state = names.select("rank", F.lit(None).cast("boolean").alias("leads"))
    state = settled(state)
    while not state.where("leads is null").isEmpty():
        early = matches.join(state.select(F.col("rank").alias("early"), F.col("leads").alias("led")), "early")
        seen = early.groupBy(F.col("late").alias("rank")).agg(F.max("led").alias("beaten"), F.max(F.col("led").isNull()).alias("open"))
        state = state.join(seen, "rank", "left").select("rank", F.coalesce("leads", F.when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)).alias("leads"))
        state = settled(state)
    led = matches.join(state.where("leads").select(F.col("rank").alias("early")), "early").groupBy(F.col("late").alias("rank")).agg(F.min("early").alias("first"))
    return state.join(led, "rank", "left").select("rank", F.when(F.col("leads"), F.col("rank")).otherwise(F.col("first")).alias("leader"))


def capped(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= most)


def blocks(lines: DataFrame, key: str, heading: Column, member: Column, most: int = 7) -> DataFrame:
    """For each heading line (key, n) how many lines right after it are members, at most `most`."""
    ahead = Window.partitionBy(key).orderBy("n").rowsBetween(1, most)
    stop = F.min(F.when(~member, F.col("n"))).over(ahead)
    last = F.max("n").over(ahead)
    return lines.withColumn("is_heading", heading).withColumn("length", F.coalesce(stop - 1, last, F.col("n")) - F.col("n")).where("is_heading and length > 0").select(key, "n", "length")
