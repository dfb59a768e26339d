"""Mixing sources to target weights: iterative proportional fitting over source, language and topic."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import BROADCAST_ROWS, ship, small, stored, table

DIMS = ("source", "lang", "topic")
#: Exponent that tempers the shares of tokens into target shares; share of all tokens to keep.
TEMPER, KEEP = 0.5, 0.6
#: Raking ends when at most this share of all tokens moves in a round; multiples of cells at 1 grow no further than this.
STILL, MOST_ROUNDS, MOST_MULTIPLE = 1e-9, 500, 1e200
#: Topics of a language are its most widespread words of four and more letters, of those in 1 to 10 % of its documents.
TOPICS, LEAST_SPREAD, MOST_SPREAD, NO_TOPIC = 8, 0.01, 0.1, "none"
UPPER, LOWER, WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "[a-zà-öø-ÿ]{4,}"
#: Distinct words that a task adds up before it passes them on.
MOST_WORDS = 400_000
CELL = ", ".join(f"{d} string" for d in DIMS) + ", w long, p double, " + ", ".join(f"{d}_target double" for d in DIMS)


def content_words(texts: Iterable[str]) -> Iterator[list[str]]:
    find, lower = re.compile(WORD).findall, bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return (find(t.encode().translate(lower).decode()) for t in texts)


#: Adds a column topic to rows that have text, source and lang (no nulls).
Topic = Callable[[DataFrame], DataFrame]
TOKEN = r"[^\x20\x09-\x0D]+"


def themes(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """(lang, themes): for each language the words that make its topics, by place, with their weights: the logarithm of
    the language's documents by those that have the word. Counted over all documents."""
    ship(docs.sparkSession)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            found = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()
            return found

        for b in it:
            for lang, words in zip(b.column("lang").to_pylist(), content_words(b.column("text").to_pylist())):
                seen.update((lang, w) for w in set(words))
                seen[lang, ""] += 1  # the documents themselves
                if len(seen) > MOST_WORDS:
                    yield out()
        yield out()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "text")))
    counts = stored(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    of = counts.where("word = ''").select("lang", F.col("n").alias("of"))
    some = counts.where("word <> ''").join(small(of), "lang").where(F.col("n").between(LEAST_SPREAD * F.col("of"), MOST_SPREAD * F.col("of")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    some = some.withColumn("place", place).where(F.col("place") <= topics)
    theme = F.struct("place", "word", F.log(F.col("of") / F.col("n")).alias("weight"))
    return some.groupBy("lang").agg(F.sort_array(F.collect_list(theme)).alias("themes"))


def by_theme(docs: DataFrame, topics: int = TOPICS) -> Topic:
    """The topic of a text is the place, t1, t2 ..., of the theme of its language that it has most often by weight, the
    first of equal ones; none if it has none. Places, not words, so that a topic is not a language by another name."""
    found = themes(docs, topics).select("lang", F.array_join(F.transform("themes", lambda x: F.concat_ws(" ", x["word"], x["weight"])), " ").alias("themes"))
    found = stored(found, "themes")

    @F.pandas_udf("string")
    def topic(texts: pd.Series, listed: pd.Series) -> pd.Series:
        parsed: dict[str, dict[str, tuple[float, int]]] = {"": {}}
        out = []
        for words, t in zip(content_words(texts), listed.fillna("")):
            if t not in parsed:
                x = t.split()
                parsed[t] = {w: (float(weight), -k) for k, (w, weight) in enumerate(zip(x[::2], x[1::2]))}
            own = parsed[t]
            hits = Counter(w for w in words if w in own)
            best = max(((n * own[w][0], own[w][1]) for w, n in hits.items()), default=None)
            out.append(NO_TOPIC if best is None else f"t{1 - best[1]}")
        return pd.Series(out, dtype=object)

    return lambda rows: rows.join(small(found), "lang", "left").withColumn("topic", topic("text", "themes")).drop("themes")


def by_form(rows: DataFrame) -> DataFrame:
    """Forms of text in place of topics: listing (has a bar), figures (has a digit), brief (under 100 words), prose."""
    text = F.col("text")
    brief = F.regexp_count(text, F.lit(TOKEN)) < 100
    return rows.withColumn("topic", F.when(F.contains(text, F.lit("|")), "listing").when(text.rlike("[0-9]"), "figures").when(brief, "brief").otherwise("prose"))


def described(docs: DataFrame, topic_of: Topic, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id, tokens (words), source, lang and topic of each row, and as a struct `row` the columns keep. Nulls are
    empty strings."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "source", "lang")]
    rest = [F.struct(*keep).alias("row")] if keep else []
    rows = topic_of(docs.select(F.col(id_col).alias("doc_id"), *own, *rest))
    return rows.select("doc_id", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("tokens"), *DIMS, *(["row"] if keep else []))


def attainable(w: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
    """total dealt by share, with no part above what there is (w): what is too much goes to the others by their shares."""
    full, scale = share < 0, 0.0
    while (rest := share[~full].sum()) > 0:
        scale = (total - w[full].sum()) / rest
        more = full | (scale * share >= w)
        if (more == full).all():
            break
        full = more
    return np.where(full, w, scale * share)


def refit(w: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], start: float, rounds: int = MOST_ROUNDS) -> np.ndarray:
    """Probabilities min(1, multiple) of cells of w tokens, codes[axis] their values, whose kept tokens have the targets
    (tokens by value). A value's factor is a Newton step of its kept tokens while they fall short, with cells at 1 held
    fixed, and a ratio while they are too many: neither goes beyond the target. Ends when no tokens move."""
    m = np.full(len(w), start)
    for _ in range(rounds):
        was = np.minimum(1, m)
        for code, t in zip(codes, targets):
            kept = np.bincount(code, w * np.minimum(1, m), len(t))
            free = np.bincount(code, np.where(m < 1, w * m, 0), len(t))
            up = np.divide(t - kept, free, out=np.zeros_like(t), where=free > 0) + 1
            down = np.divide(t, kept, out=np.zeros_like(t), where=kept > 0)
            m = np.minimum(m * np.where(t > kept, up, down)[code], MOST_MULTIPLE)
        if (w * abs(np.minimum(1, m) - was)).sum() <= STILL * w.sum():
            break
    return np.minimum(1, m)


def _few(cells: DataFrame, targets, keep: float, temper: float) -> DataFrame:
    """cells with p and, by dimension, target shares; few enough cells for arrays."""
    rows = cells.orderBy(*DIMS).collect()
    w, codes, shares, names = np.array([r.w for r in rows], float), [], [], []
    for k, d in enumerate(DIMS):
        value, code = np.unique(np.array([r[k] for r in rows], object), return_inverse=True)
        now = np.bincount(code, w, len(value))
        share = np.array([targets[d].get(v, 0.0) for v in value]) if targets and d in targets else (now / max(w.sum(), 1)) ** temper
        codes, shares, names = [*codes, code], [*shares, share / share.sum() if share.sum() else share], [*names, value]
    there = [np.bincount(code, w, len(share)) for code, share in zip(codes, shares)]
    p = refit(w, codes, [attainable(n, s, keep * w.sum()) for n, s in zip(there, shares)], keep)
    aims = [dict(zip(v, map(float, s))) for v, s in zip(names, shares)]
    out = [(*r[:4], float(x), *(aims[k][r[k]] for k in range(len(DIMS)))) for r, x in zip(rows, p)]
    return cells.sparkSession.createDataFrame(out, CELL)


def _many(cells: DataFrame, targets, keep: float, temper: float) -> DataFrame:
    """_few for any number of cells and values: a round is, by dimension, sums by value and a join. Only totals are
    collected."""
    spark, total = cells.sparkSession, float(cells.agg(F.sum("w")).first()[0] or 0)
    table = {}
    for d in DIMS:
        v = cells.groupBy(d).agg(F.sum("w").cast("double").alias("there"))
        if targets and d in targets:
            v = v.join(spark.createDataFrame([(k, float(x)) for k, x in targets[d].items()], f"{d} string, share double"), d, "left").select(d, "there", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            v = v.select(d, "there", F.pow(F.col("there") / max(total, 1), F.lit(temper)).alias("share"))
        v = stored(v, "values")
        s = v.agg(F.sum("share")).first()[0] or 1.0
        v, scale = v.select(d, "there", (F.col("share") / s).alias("share")), 0.0
        while True:
            full = F.col("share") * scale >= F.col("there")
            held, rest = v.agg(F.sum(F.when(full, F.col("there")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).first() if scale else (0.0, 1.0)
            now = (keep * total - held) / rest if rest and rest > 1e-15 else scale
            if now <= scale * (1 + 1e-12):
                break
            scale = now
        table[d] = stored(v.select(d, F.col("share").alias(f"{d}_target"), F.least("there", F.col("share") * scale).alias("t")), "targets")
    now = cells.select(*DIMS, "w", F.lit(keep).alias("m"), F.lit(0.0).alias("was"))
    p = F.least(F.lit(1.0), "m")
    for _ in range(MOST_ROUNDS):
        now = now.withColumn("was", p)
        for d in DIMS:
            sums = now.groupBy(d).agg(F.sum(F.col("w") * p).alias("kept"), F.sum(F.when(F.col("m") < 1, F.col("w") * F.col("m")).otherwise(0.0)).alias("free")).join(table[d], d)
            up = F.lit(1.0) + F.when(F.col("free") > 0, (F.col("t") - F.col("kept")) / F.col("free")).otherwise(0.0)
            down = F.when(F.col("kept") > 0, F.col("t") / F.col("kept")).otherwise(0.0)
            f = F.when(F.col("t") > F.col("kept"), up).otherwise(down)
            now = now.join(small(stored(sums.select(d, f.alias("f")), "factors")), d)
            now = stored(now.select(*DIMS, "w", F.least(F.col("m") * F.col("f"), F.lit(MOST_MULTIPLE)).alias("m"), "was"), "cells")
        if (now.agg(F.sum(F.col("w") * F.abs(p - F.col("was")))).first()[0] or 0.0) <= STILL * total:
            break
    now = now.select(*DIMS, "w", p.alias("p"))
    for d in DIMS:
        now = now.join(small(table[d].select(d, f"{d}_target")), d)
    return stored(now.select(*DIMS, "w", "p", *(f"{d}_target" for d in DIMS)), "cells")


def cell_table(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER, few: int = BROADCAST_ROWS) -> DataFrame:
    """Cells of described rows: source, lang, topic, w tokens, p, and the target share of each of the three values.
    Beyond few cells, none is collected."""
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("w")), "cells")
    return (_few if cells.limit(few + 1).count() <= few else _many)(cells, targets, keep, temper)


def kept_rows(docs: DataFrame, columns: list[str], targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER, id_col: str = "doc_id", few: int = BROADCAST_ROWS, topic_of: Topic | None = None) -> DataFrame:
    """Described rows of docs with p (the probability of their cell), kept, and as a struct `row` the given columns.

    A row is kept if a hash of its id, uniform in [0, 1), is below p: repeated ids of one cell fare alike, and a null id
    counts as an empty one. Texts are read once for their topics, with the columns given written beside what is found,
    and not moved."""
    rows = stored(described(docs, topic_of or by_theme(docs), id_col, columns), "described")
    found = cell_table(rows, targets, keep, temper, few)
    rows = rows.join(small(stored(found.select(*DIMS, "p"), "found")), list(DIMS), "left")
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return rows.withColumn("p", F.coalesce("p", F.lit(0.0))).withColumn("kept", u < F.col("p"))


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER, id_col: str = "doc_id", few: int = BROADCAST_ROWS, topic_of: Topic | None = None) -> DataFrame:
    """One row per row of docs: doc_id, tokens, source, lang, topic, probability, kept.

    topic is that of by_theme(), or what topic_of makes of it. targets: shares by value for some dimensions (values left
    out get none); where it has none, the observed shares are raised to temper and normalised. All values of a dimension
    count, however many there are. A value that has fewer tokens than its share of the kept ones is kept whole, and the
    others share the rest. Probabilities of cells, 1 at most, are raked until the tokens expected to stay have these
    marginals and are the share keep of all; where all dimensions can't be met together, residuals() tells by how much.
    kept is kept_rows'. Texts without words have no weight and share their cell's probability. Nulls count as empty
    strings; other columns are ignored; an empty table gives an empty result."""
    out = kept_rows(docs, [], targets, keep, temper, id_col, few, topic_of)
    return out.select("doc_id", "tokens", *DIMS, F.round("p", 6).alias("probability"), "kept")


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that are kept."""
    return kept_rows(docs, docs.columns, **options).where("kept").select("row.*")


def residuals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER, few: int = BROADCAST_ROWS, id_col: str = "doc_id", topic_of: Topic | None = None) -> DataFrame:
    """dimension, value, and the shares of tokens: observed, target, expected of the sample; residual is expected less
    target, and short says that the value has too few tokens for its target, so that it can't be met."""
    topic_of = topic_of or by_theme(docs)
    cells = stored(cell_table(described(docs, topic_of, id_col), targets, keep, temper, few), "residuals")
    total = cells.agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("p")).alias("stays"))
    by = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("p")).alias("kept"), F.first(f"{d}_target").alias("target")) for d in DIMS]
    got = by[0].unionByName(by[1]).unionByName(by[2]).join(F.broadcast(total))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    got = got.select("dimension", "value", share("w", "all").alias("observed"), "target", share("kept", "stays").alias("expected"), (F.col("target") * keep * F.col("all") > F.col("w") * (1 + 1e-9)).alias("short"))
    six = lambda c: F.round(c, 6).alias(c)
    return got.select("dimension", "value", six("observed"), six("target"), six("expected"), F.round(F.col("expected") - F.col("target"), 6).alias("residual"), "short")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(table(spark, sf_dir, "documents"))


def op6_mixing_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(table(spark, sf_dir, "documents"))


def _sql() -> str:
    q = [
        rf"""d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS tokens, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents)""",
        "n AS MATERIALIZED (SELECT lang, count(*) AS all_docs FROM d GROUP BY 1)",
        "df AS MATERIALIZED (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(words)) AS word FROM d) GROUP BY ALL)",
        f"""k AS MATERIALIZED (SELECT lang, word, ln(all_docs / n) AS weight, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM df JOIN n USING (lang)
        WHERE n BETWEEN {LEAST_SPREAD} * all_docs AND {MOST_SPREAD} * all_docs QUALIFY place <= {TOPICS})""",
        "own AS MATERIALIZED (SELECT rid, place, count(*) * min(weight) AS score FROM (SELECT rid, lang, unnest(words) AS word FROM d) JOIN k USING (lang, word) GROUP BY ALL)",
        "best AS MATERIALIZED (SELECT rid, place FROM own QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, place) = 1)",
        f"t AS MATERIALIZED (SELECT doc_id, tokens, source, lang, coalesce('t' || place, '{NO_TOPIC}') AS topic FROM d LEFT JOIN best USING (rid))",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS w FROM t GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(w) AS w FROM c)",
    ]
    for d in DIMS:  # what each value can attain: its share, or all it has
        q.append(f"s_{d} AS MATERIALIZED (SELECT {d}, sum(w) AS there, pow(sum(w) / (SELECT w FROM total), {TEMPER}) AS s FROM c GROUP BY 1)")
        q.append(f"v_{d} AS MATERIALIZED (SELECT {d}, there, s / (SELECT sum(s) FROM s_{d}) AS share, there / s AS ratio FROM s_{d} WHERE there > 0)")
        q.append(
            f"""z_{d} AS MATERIALIZED (SELECT there, share, row_number() OVER (ORDER BY ratio, {d}) AS k, ({KEEP} * (SELECT w FROM total) - coalesce(sum(there) OVER (ORDER BY ratio, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(share) OVER (ORDER BY ratio, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM v_{d})"""
        )
        q.append(f"t_{d} AS MATERIALIZED (SELECT {d}, least(there, share * (SELECT arg_min(scale, k) FROM z_{d} WHERE scale * share <= there)) AS t_{d} FROM v_{d})")
    step = "SELECT * REPLACE (least(1.0, m) AS was) FROM r WHERE round < {rounds} AND moved > {still} * (SELECT w FROM total)".format(rounds=MOST_ROUNDS, still=STILL)
    for d in DIMS:
        sums = f"SELECT *, sum(w * least(1.0, m)) OVER (PARTITION BY {d}) AS kept, sum(CASE WHEN m < 1 THEN w * m ELSE 0 END) OVER (PARTITION BY {d}) AS free FROM ({step})"
        factor = f"CASE WHEN t_{d} > kept THEN 1 + CASE WHEN free > 0 THEN (t_{d} - kept) / free ELSE 0 END WHEN kept > 0 THEN t_{d} / kept ELSE 0 END"
        step = f"SELECT * EXCLUDE (kept, free) REPLACE (least(m * {factor}, {MOST_MULTIPLE}) AS m) FROM ({sums})"
    q.append(
        f"""r AS (SELECT 0 AS round, 1e300::DOUBLE AS moved, c.*, {KEEP}::DOUBLE AS m, 0.0::DOUBLE AS was, t_source, t_lang, t_topic FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
        UNION ALL SELECT * REPLACE (round + 1 AS round, sum(w * abs(least(1.0, m) - was)) OVER () AS moved) FROM ({step}))"""
    )
    q.append("p AS MATERIALIZED (SELECT source, lang, topic, least(1.0, m) AS p FROM r WHERE round = (SELECT max(round) FROM r))")
    return f"""WITH RECURSIVE {", ".join(q)} SELECT doc_id, tokens, source, lang, topic, round(coalesce(p, 0), 6) AS probability,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < coalesce(p, 0) AS kept FROM t LEFT JOIN p USING (source, lang, topic)"""


OP6_SQL = _sql()
