"""What iterative plans need: results kept in the shared folder, and this package on the Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only if it has at most this many narrow rows.
BROADCAST_ROWS = 200_000
_shipped: set[str] = set()


_own_dir: dict[str, str] = {}


def _shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a checkpoint folder that was set. Where there is none,
    a local master gets a temporary folder; on a cluster that is an error, for no folder of one machine is seen by others."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _own_dir.get(sc.applicationId)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = _own_dir.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder, under the application's id, and read again: computed once, cuts
    lineage, survives lost executors, and later plans read only the columns they need."""
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/{spark.sparkContext.applicationId}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it is small. df should be settled or a stored table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key that meet in one task in a join by spread_join, about.
ROWS_PER_SLICE = 100_000


def heavy_keys(rows: DataFrame, key: str | list[str]) -> DataFrame | None:
    """(key, slices) of the keys (a column or several) that have more than ROWS_PER_SLICE rows, of which there are rows / ROWS_PER_SLICE at
    most; None where there are no more rows than that in all. rows should be settled or a stored table."""
    if rows.limit(ROWS_PER_SLICE + 1).count() <= ROWS_PER_SLICE:
        return None
    keys = [key] if isinstance(key, str) else key
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > ROWS_PER_SLICE)
    found = settled(counts.select(*keys, F.ceil(F.col("n") / ROWS_PER_SLICE).cast("int").alias("slices")))
    return None if found.isEmpty() else small(found)


def spread_join(rows: DataFrame, right: DataFrame, key: str | list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with right, which has few rows for each key. Rows of a heavy key (heavy_keys of rows) are dealt
    into slices by all of their columns, and right's row goes to each slice: no key is one task's."""
    if heavy is None:
        return rows.join(right, key, how)
    dealt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("slices", F.lit(1))).cast("int")
    left = rows.join(heavy, key, "left").withColumn("slice", dealt).drop("slices")
    copies = right.join(heavy, key, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return left.join(copies, [*([key] if isinstance(key, str) else key), "slice"], how).drop("slice")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that no executor needs it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}-core.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)
