"""A stream sink that flushes by rows or by time, and whose batches are there whole or not at all."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage


@dataclass
class Flushed(WriterCommitMessage):
    """What one task wrote."""

    files: list[str]
    rows: int


class FlushingWriter(DataSourceStreamArrowWriter):
    """Tasks write files of at most ``rows`` rows, or of what came within ``seconds``; a batch's manifest, written by
    rename, says which of them count. A batch whose manifest is there already keeps its first files; files of a batch
    that fails, or of a lost attempt, are in no manifest, and what the driver knows of them is deleted."""

    def __init__(self, path: str, rows: int, seconds: float):
        self.path, self.rows, self.seconds = path.rstrip("/"), rows, seconds

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Flushed:
        fs, root = self._fs()
        fs.create_dir(f"{root}/data", recursive=True)
        name, files, waiting, held, total, since = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", [], [], 0, 0, time.monotonic()

        def flush() -> None:
            nonlocal waiting, held, since
            if held:
                files.append(f"{root}/data/{name}-{len(files)}.parquet")
                with fs.open_output_stream(files[-1]) as out:
                    pq.write_table(pa.Table.from_batches(waiting), out)
            waiting, held, since = [], 0, time.monotonic()

        for batch in iterator:
            total += len(batch)
            while len(batch):
                part = batch.slice(0, self.rows - held)
                batch = batch.slice(len(part))
                waiting.append(part)
                held += len(part)
                if held >= self.rows:
                    flush()
            if time.monotonic() - since >= self.seconds:
                flush()
        flush()
        return Flushed(files, total)

    def commit(self, messages: list[Flushed | None], batchId: int) -> None:
        fs, root = self._fs()
        fs.create_dir(f"{root}/manifests", recursive=True)
        final = f"{root}/manifests/{batchId:020d}.json"
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            self._delete(messages)
            return
        done = [m for m in messages if m is not None]
        whole = f"{root}/manifests/_{uuid.uuid4().hex}"
        with fs.open_output_stream(whole) as out:
            out.write(json.dumps({"batch": batchId, "rows": sum(m.rows for m in done), "files": [f for m in done for f in m.files]}).encode())
        fs.move(whole, final)

    def abort(self, messages: list[Flushed | None], batchId: int) -> None:
        self._delete(messages)

    def _delete(self, messages: list[Flushed | None]) -> None:
        fs, _ = self._fs()
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f)


class FlushingSink(DataSource):
    """Options: path (a URI of a shared folder), rows (200) and seconds (3)."""

    @classmethod
    def name(cls) -> str:
        return "flushing"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> FlushingWriter:
        return FlushingWriter(self.options["path"], int(self.options.get("rows", 200)), float(self.options.get("seconds", 3)))


def manifests(path: str) -> list[dict]:
    """The committed batches in order: batch, rows, files."""
    fs, root = pafs.FileSystem.from_uri(path.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(f"{root}/manifests", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json"))
    return [json.loads(fs.open_input_stream(f).read()) for f in names]


def read_flushed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches."""
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    files = [f"{scheme}{f}" for m in manifests(path) for f in m["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
