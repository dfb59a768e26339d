"""Readers and writers of corpora, article and graph files, configurations and run logs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.store import settled, ship


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of Markdown files: `# title`, a blank line, a tag line, a blank line, the body. Columns
    path, title, tags, body, raw; of files with one title the last by path counts."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    parts = raw.withColumn("parts", F.split("raw", "\n\n", 3))
    title = F.regexp_replace(F.split("raw", "\n")[0], "^# ", "")
    body = F.element_at("parts", -1)
    tags = F.regexp_extract("raw", r"(?m)^분류:[ \t]*(.+)$", 1)  # the tag line's fixed word
    out = parts.select("path", title.alias("title"), F.when(tags != "", F.transform(F.split(tags, ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>")).alias("tags"), body.alias("body"), "raw")
    return out.groupBy("title").agg(F.max_by(F.struct("path", "tags", "body", "raw"), "path").alias("d")).select("d.path", "title", "d.tags", "d.body", "d.raw")


def read_articles(spark: SparkSession, path: str, row_tag: str, fields: list[str]) -> DataFrame:
    """Blocks of XML files (row_tag), the text of the fields of each, without tags and with blanks collapsed."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(f"(?s)<{row_tag}[ >](.*?)</{row_tag}>"), F.lit(1))).alias("x"))
    texts = [F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.regexp_extract_all("x", F.lit(f"(?s)<{f}>(.*?)</{f}>"), F.lit(1)), " "), r"<!\[CDATA\[|\]\]>|<[^>]+>", " "), r"\s+", " ")).alias(f) for f in fields]
    return rows.select(*texts)


def read_nested_articles(spark: SparkSession, path: str, row_tag: str, heads: list[str], own: str, levels: list[tuple[str, str]], wanted: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Articles (heads, body) of XML files, and skipped (block, reason) of the blocks that aren't well formed.

    An article is a row_tag element with the texts `heads`, its `own` text and nested items: levels names each level's
    element and its text, from paragraphs down. The body has all texts in the order of the document, an item's before
    those inside it, without tags and with white space collapsed. wanted (a head, a pattern) leaves out other articles."""
    kind = None
    for element, text in reversed(levels):
        kind = f"`{element}`: array<struct<`{text}`: string{', ' + kind if kind else ''}>>"
    schema = ", ".join([*(f"`{h}` string" for h in heads), f"`{own}` string", *([kind.replace(": array", " array", 1)] if kind else []), "broken string"])
    rows = settled(spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").schema(schema).load(path))

    def below(x: Column, depth: int) -> Column:
        """The texts of an element's items and of what is in them, in order."""
        if depth == len(levels):
            return F.array().cast("array<string>")
        element, text = levels[depth]
        items = F.transform(x[element], lambda i: F.concat(F.array(F.coalesce(i[text], F.lit(""))), below(i, depth + 1)))
        return F.coalesce(F.flatten(items), F.array().cast("array<string>"))

    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    texts = F.concat(F.array(F.coalesce(F.col(f"`{own}`"), F.lit(""))), below(whole, 0))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))
    fine = rows.where("broken is null")
    if wanted:
        fine = fine.where(F.rlike(F.col(f"`{wanted[0]}`"), F.lit(wanted[1])))
    articles = fine.select(*(F.trim(F.col(f"`{h}`")).alias(h) for h in heads), plain(F.array_join(texts, " ")).alias("body"))
    return articles, rows.where("broken is not null").select(F.col("broken").alias("block"), F.lit("not well formed").alias("reason"))


#: GraphML's types and Spark's.
GRAPHML_TYPES = {"string": "string", "int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean"}


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) and edges (src, dst, ...) of a GraphML file, with a column of the declared name and type for
    each key that the file declares for them, in the order of the keys' ids. Missing values are null, and so are empty
    ones but of strings."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, _for string, `_attr.name` string, `_attr.type` string").load(path)
    declared = sorted(keys.collect(), key=lambda r: (len(r["_id"]), r["_id"]))  # the schema: a row for each column

    def side(tag: str, ids: dict[str, str]) -> DataFrame:
        kind = ", ".join(f"{i} string" for i in ids) + ", data array<struct<_key: string, _VALUE: string>>"
        rows = spark.read.format("xml").option("rowTag", tag).option("nullValue", "\u0000").schema(kind).load(path)
        there = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key: string, _VALUE: string>>")), lambda d: F.struct(d["_key"], F.coalesce(d["_VALUE"], F.lit("")))))
        rows = rows.withColumn("there", there)
        columns = []
        for k in declared:
            if k["_for"] in (tag, "all"):
                x = F.element_at("there", F.lit(k["_id"]))
                kind = GRAPHML_TYPES[k["_attr.type"] or "string"]
                columns.append((x if kind == "string" else F.when(F.trim(x) != "", F.trim(x)).cast(kind)).alias(k["_attr.name"]))
        return rows.select(*(F.col(i).alias(name) for i, name in ids.items()), *columns)

    return side("node", {"_id": "id"}), side("edge", {"_source": "src", "_target": "dst"})


def read_items(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of an array field of a JSON file, in order (ord)."""
    rows = spark.read.schema(f"{field} array<{schema}>").json(path, multiLine=True)
    out = rows.select(F.posexplode(field).alias("ord", "x"))
    return out.select("ord", "x.*") if schema.startswith("struct") else out.select("ord", F.col("x").alias(field))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K5: nodes and edges as Parquet."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K5: (part, line): a graph as lines of GraphML, in parts that stand one after the other: head, nodes (id, ...),
    edges (src, dst, ...), foot. Every further column is a key of its name and type; null values are left out. A writer
    sorts by part alone."""
    spark = nodes.sparkSession
    kinds = {v: k for k, v in GRAPHML_TYPES.items()}
    sides = {"node": (nodes, ("id",)), "edge": (edges, ("src", "dst"))}
    keys = [(tag, c, kinds.get(kind, "string"), f"d{tag[0]}{i}") for tag, (df, ids) in sides.items() for i, (c, kind) in enumerate((c, k) for c, k in df.dtypes if c not in ids)]
    escaped = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    safe = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    data = lambda tag: [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{k}">'), safe(c), F.lit("</data>"))).otherwise("") for t, c, _, k in keys if t == tag]
    listed = [f'<key id="{k}" for="{t}" attr.name="{c}" attr.type="{kind}"/>' for t, c, kind, k in keys]
    head = [(0, "\n".join(["<?xml version='1.0' encoding='utf-8'?>", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *listed, '<graph edgedefault="directed">'])), (3, "</graph>\n</graphml>")]
    rows = spark.createDataFrame(head, "part int, line string")
    rows = rows.unionByName(nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), safe("id"), F.lit('">'), *data("node"), F.lit("</node>")).alias("line")))
    return rows.unionByName(edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), safe("src"), F.lit('" target="'), safe("dst"), F.lit('">'), *data("edge"), F.lit("</edge>")).alias("line")))


def write_report(rows: DataFrame, path: str) -> None:
    """A result table (manifest, review pairs, facts, scores, probes) as JSON, in place of the last."""
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines."""
    rows.write.mode("append").json(path)


def through_cache(todo: DataFrame, cache: DataFrame | None, key: str, compute) -> DataFrame:
    """Rows of cache for the keys of todo, and compute (DataFrame to DataFrame) over the others only."""
    if cache is None:
        return compute(todo)
    known = cache.join(todo.select(key).distinct(), key, "left_semi")
    return known.unionByName(compute(todo.join(cache.select(key).distinct(), key, "left_anti")))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def published(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, in place of what is there. It is written aside and then takes its place by a
    rename: a write that is killed leaves the old table as it was. One that dies between the last two steps leaves the
    new one aside."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}.aside"
    df.write.parquet(aside)
    files, at = _files(spark, path)
    if files.exists(at):
        files.delete(at, True)
    files.mkdirs(at.getParent())
    if not files.rename(_files(spark, aside)[1], at):
        raise OSError(f"{aside} can't be renamed to {path}")
    return spark.read.schema(df.schema).parquet(path)


def content_key(df: DataFrame) -> str:
    """A hash of the rows of a table, whatever their order: equal for equal tables. Columns count by name."""
    rows = df.select(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    names = list(rows.columns)
    # a null is told from an empty value, and one column's end from the next one's start
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"})
    half = lambda k: F.sum(F.conv(F.substring(F.md5(text), k, 8), 16, 10).cast("decimal(38)"))
    n, *sums = rows.agg(F.count("*"), *(half(k) for k in (1, 9, 17, 25))).first()
    return hashlib.sha256(json.dumps([names, n, *map(str, sums)]).encode()).hexdigest()


def cached_by_content(rows: DataFrame, path: str, compute, force: bool = False) -> DataFrame:
    """K6: what compute makes of rows, kept under path by a hash of their content: any changed row is another entry, so
    a stale result is never read. force computes anew."""
    spark = rows.sparkSession
    at = f"{path.rstrip('/')}/{content_key(rows)}"
    files, entry = _files(spark, at)
    if not force and files.exists(entry):
        return spark.read.parquet(at)
    return published(compute(rows), at)


def kept_in_cache(todo: DataFrame, path: str, key: str, compute, force: bool = False) -> DataFrame:
    """K3, K9: what compute makes of todo, read from the Parquet tables below path as far as it is there, computed and
    added to them where not. force computes all and leaves nothing else there. A batch appears whole or not at all."""
    spark = todo.sparkSession
    files, top = _files(spark, path)
    known = spark.read.parquet(f"{path}/batch-*") if not force and files.exists(top) and len(files.listStatus(top)) else None
    fresh = compute(todo if known is None else todo.join(known.select(key).distinct(), key, "left_anti"))
    name = f"batch-{uuid.uuid4().hex}"
    new = published(fresh, f"{path}/{name}")
    if force:
        for old in files.listStatus(top):
            if old.getPath().getName() != name:
                files.delete(old.getPath(), True)
    every = new if known is None else spark.read.schema(new.schema).parquet(f"{path}/batch-*")
    return every.join(todo.select(key).distinct(), key, "left_semi")


def try_items(items: DataFrame, convert: Callable[[bytes], str]) -> tuple[DataFrame, DataFrame]:
    """(name, text) of items (name, content: binary) that convert can read, and (name, reason) of the others: an item
    that fails is recorded and doesn't end the run. convert runs in tasks."""
    ship(items.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in b.itertuples(index=False):
                try:
                    out.append((name, convert(bytes(content)), None))
                except Exception as e:  # whatever a converter raises is the item's reason
                    out.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "text", "reason"])

    found = settled(items.select("name", "content").mapInPandas(run, "name string, text string, reason string"))
    return found.where("reason is null").select("name", "text"), found.where("reason is not null").select("name", "reason")


def write_corpus(docs: DataFrame, path: str) -> None:
    """K1: documents (title, body) as Parquet with a file name that is safe, codes in parentheses such as (F5) written
    (F-5)."""
    body = F.regexp_replace("body", r"\(([A-H])\s?(\d{1,2})\)", "($1-$2)")
    docs.withColumns({"body": body, "file": F.concat(F.replace(T.safe_name(F.col("title")), F.lit(" "), F.lit("_")), F.lit(".md"))}).write.mode("overwrite").parquet(path)
