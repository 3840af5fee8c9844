"""What several operators share: the shared folder, materialised steps, hot groups, ordered buckets."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.steps import new_path, shared_dir  # noqa: F401  for the operators here
from ..sources.steps import written as materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A group counts as hot when it holds more than 1 in HOT_PARTS of the rows, so there are at most HOT_PARTS hot groups.
HOT_PARTS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows in an Arrow batch of texts at most: a worker holds one batch and what it makes of it.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_ROWS rows and BATCH_BYTES bytes (or one row)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df


def release() -> None:
    """Gives a worker's free memory back at a task's end: the worker lives on, and what it holds adds to later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def attach_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, without sending a hot group's rows to one task.

    groups must be cheap to read twice (materialised). Groups over total / HOT_PARTS rows are at most
    HOT_PARTS in number and are broadcast; only rows of the other groups are shuffled.
    """
    least = max(64, total // HOT_PARTS)
    hot, cold = groups.filter(F.col(size) > least), groups.filter(F.col(size) <= least)
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
    )


#: Keys up to this many (some 30 MB as a hash relation) are broadcast, more are shuffled with the rows.
BROADCAST_KEYS = 200_000


def drop_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those whose key is in gone. All of gone's columns are the key, and rows has them too; the first
    may be null, and null equals null there."""
    keys = gone.columns
    gone = materialize(gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct(), "gone")
    same = F.col(keys[0]).eqNullSafe(F.col(f"_gone_{keys[0]}"))
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"_gone_{k}"))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, same, "left_anti")


#: Ids per bucket in the sample that cuts the buckets.
SAMPLE = 32


def id_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most buckets - 1 ascending cut points of a long column, about as many rows between each two.

    They come from the SAMPLE * buckets ids of smallest hash, so they depend on the rows alone, not on their
    partitions; the driver gets no more than that sample.
    """
    if buckets < 2:
        return []
    ids = df.select(F.col(column).cast("long").alias("id")).filter("id is not null").select("id", F.xxhash64("id").alias("h"))
    sample = sorted(r["id"] for r in ids.orderBy("h", "id").limit(SAMPLE * buckets).collect())
    return sorted({sample[len(sample) * k // buckets] for k in range(1, buckets)}) if sample else []


def id_bucket(column: Column, bounds: list[int]) -> Column:
    """Number of bounds below the value: buckets in ascending order of the column, nulls in the first.

    A binary search written as nested conditions, so that it stays one compiled expression.
    """

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column > F.lit(bounds[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds))
