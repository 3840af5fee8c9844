"""Steps of a plan as written tables: later stages read rows, not the whole history of the plan."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_written: dict[tuple, tuple[str, T.StructType]] = {}
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary folder for
    a session in one process; a cluster has no folder of its own to fall back on."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the application's own, which goes when the application ends."""
    root = f"{shared_dir(spark)}/tidewatch/{spark.sparkContext.applicationId}"
    if root not in _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots.add(root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes a step to the shared folder and reads it back: later stages read rows, and survive lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Files of the folder's tables with sizes and times of change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))


def step(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A stage over a folder of tables, written once per application and state of the folder, as stages after it share
    it; ``forget`` drops what is known."""

    @wraps(f)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, sf_dir), f.__name__)
        if key not in _written:
            path = new_path(spark, f.__name__)
            df = f(spark, sf_dir)
            df.write.parquet(path)
            _written[key] = path, df.schema
        path, schema = _written[key]
        return spark.read.schema(schema).parquet(path)

    return read


def forget() -> None:
    _written.clear()
