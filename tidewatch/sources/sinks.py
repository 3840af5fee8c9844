"""Sinks: keyed upsert, target activation, rounded export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .telemetry import conform


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of their key; rows without a whole key are skipped."""
    new = new.na.drop(subset=keys)
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def write_conformed(df: DataFrame, schema: T.StructType, path: str) -> str:
    """Writes the schema's columns, missing ones null, and returns the path."""
    conform(df, schema).write.mode("overwrite").parquet(path)
    return path


def activate(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All known targets; active are those of the new list."""
    known, listed = old.select(F.col(key)).distinct().withColumn("_o", F.lit(1)), new.select(F.col(key)).distinct().withColumn("_n", F.lit(1))
    return known.join(listed, key, "full_outer").select(key, F.col("_n").isNotNull().alias("is_active"))


def export(df: DataFrame, digits: int = 3) -> DataFrame:
    """Doubles rounded for people; everything else as it is."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
