"""What the operators of this subpackage share: tables, shared storage, components, UTF-8 buffers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only if it has at most this many narrow rows (some 10 MB); beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_own_dir: dict[str, str] = {}


#: Rows of text that a Python worker gets at once; Spark's own default would hold ten times as many texts in memory.
TEXTS_PER_BATCH = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that no executor needs it installed, and
    bounds the batches of texts they get for the rest of the session: the limit is read when a plan is made, not where
    it is written."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXTS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = _own_dir.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _own_dir[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder, under the application's id, and read again: cuts lineage and survives lost
    executors. The result is read later, so nothing here can tell when a table may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it is small. df should be a stored table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b longs) by alternating large and small stars.

    Returns (node, root): every node that is not the smallest of its component, with the smallest. Edges with a null
    end and loops are ignored. Every round is stored, and no round collects more than two numbers."""
    e = stored(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = large.join(least, "u")
        e = stored(
            linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null is empty."""
    col = col.fill_null("").cast(pa.large_string())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(at: np.ndarray, size: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes, one row at least: they bound the memory of the arrays made from a batch."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: Bytes that separate words: space, \t, \n, \v, \f, \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser on 64-bit hashes (the splitmix64 one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in data, and the index of its first word for each row (one more at the end).

    A row ends a word: rows are contiguous in data, so row starts count as word starts."""
    gap = IS_SPACE[data]
    first = np.empty(len(data), bool)
    if len(data):
        first[0] = True
        first[1:] = gap[:-1]
        edge = at[1:-1][at[1:-1] < len(data)]
        first[edge] = True
    starts = np.flatnonzero(first & ~gap)
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = gap[1:]
        last[edge[edge > 0] - 1] = True
    ends = np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over hashed bytes, from prefix sums, then mixed."""
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _PRIME)]))
    unpower = pow(int(_PRIME), -1, 2**64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[data] * powers[:-1])])
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), np.uint64(unpower))]))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
