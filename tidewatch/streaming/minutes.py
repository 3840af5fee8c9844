"""Streaming minute aggregation over a folder of event files.

Late rows inside the watermark change their tick's row; rows behind it are dropped, which a full recomputation would
not do: the watermark bounds both state and lateness. ``recount`` is that recomputation, for the ticks a batch touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import upsert
from ..sources.steps import written
from ..sources.telemetry import message_hash


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive; naive times are read as UTC."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def chat_messages(events: DataFrame) -> DataFrame:
    """Chat events with their broadcast and the hash of their content."""
    chat = events.filter("event_type = 'click'").withColumn("broad_no", F.col("user_id") % 20)
    return chat.withColumn("message_hash", message_hash("broad_no", "user_id", "props", "ts"))


def of_active(stream: DataFrame, targets: DataFrame, key: str = "broad_no") -> DataFrame:
    """Rows of the targets that are active now: a stream-static join, whose table is read anew in every batch."""
    return stream.join(targets.filter("is_active").select(key).distinct(), key, "left_semi")


def _ticks(chat: DataFrame, tick: str) -> DataFrame:
    ticks = chat.groupBy(F.window("ts", tick).alias("w"), "broad_no").agg(F.count("props").alias("chat_count"), F.size(F.collect_set("user_id")).alias("users"))
    return ticks.select("broad_no", F.col("w.start").alias("minute_ts"), "chat_count", "users")


def chat_ticks(stream: DataFrame, tick: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Messages and distinct users per broadcast and tick. A message counts once, however often a source that
    reconnects replays it: equal content within the watermark is one message."""
    return _ticks(chat_messages(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(["message_hash"]), tick)


def recount(events: DataFrame, touched: DataFrame, tick: str = "1 hour") -> DataFrame:
    """The same from all stored events, for the (broad_no, minute_ts) in touched only: late rows of any age converge."""
    chat = chat_messages(events).withColumn("minute_ts", F.window("ts", tick)["start"])
    return _ticks(chat.join(touched.select("broad_no", "minute_ts").distinct(), ["broad_no", "minute_ts"], "left_semi").dropDuplicates(["message_hash"]), tick)


def activity_sessions(stream: DataFrame, gap: str = "90 minutes", late: str = "2 hours") -> DataFrame:
    """Per broadcast, stretches of chat without a pause over gap."""
    chat = stream.filter("event_type = 'click'").withColumn("broad_no", F.col("user_id") % 20).withWatermark("ts", late)
    s = chat.groupBy(F.session_window("ts", gap).alias("w"), "broad_no").agg(F.count(F.lit(1)).alias("chat_count"))
    return s.select("broad_no", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "chat_count")


class UpsertTable:
    """A keyed table in a shared folder, parted by a column's value (the day of a time, if none is given).

    A batch rewrites only the parts that it touches, under a version of its own, and is committed by its entry in the
    log, which is written last. The log knows a batch by its stream and number, so that a stream with a new checkpoint,
    or a second one, starts anew at 0. A batch that is run again, also after a restart, changes nothing; one that was
    lost before its entry is written anew; a number below the stream's last that the log doesn't know is an error, as
    its rows would overwrite later ones. Of rows with equal keys in a batch, the last in ``order`` stays. One batch is
    applied at a time.
    """

    LOG = "part string, version long, stream string, batch long"

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], part: Column | None = None, order: list[Column] | None = None):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.part = F.date_format(keys[-1], "yyyy-MM-dd") if part is None else part
        self.order = order or [F.desc(c) for c in schema.names if c not in keys]

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[str]:
        """The log's whole entries."""
        path, fs = self._folder("log")
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [p.toString() for p in found if fs.exists(p.suffix("/_SUCCESS"))]

    def _log(self) -> DataFrame:
        done = self._entries()
        return self.spark.read.schema(self.LOG).parquet(*done) if done else self.spark.createDataFrame([], self.LOG)

    def _versions(self) -> dict[str, int]:
        """The committed version of each part."""
        return {r["part"]: r["version"] for r in self._log().groupBy("part").agg(F.max("version").alias("version")).collect()}

    def _rows(self, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.root}/data/version={v}/_part={p}" for p, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._versions())

    def apply(self, rows: DataFrame, batch: int, stream: str | None = None) -> None:
        """stream: who numbers the batches; the running query, if none is given."""
        stream = stream or self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batches"
        of = self._log().filter(F.col("stream") == stream).agg(F.max("batch").alias("last"), F.count_if(F.col("batch") == batch).alias("known")).first()
        if of["known"]:
            return
        if of["last"] is not None and batch < of["last"]:
            raise ValueError(f"batch {batch} of {stream} is not in the log, which has batch {of['last']}")
        last = Window.partitionBy(*self.keys).orderBy(*self.order)
        new = rows.select(self.schema.names).na.drop(subset=self.keys).withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
        new = written(new.withColumn("_part", self.part), "upsert-batch")
        touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # the days of one batch
        if not touched:
            return
        versions = self._versions()
        version = max(versions.values(), default=-1) + 1
        old = self._rows({p: versions[p] for p in touched if p in versions})
        out = upsert(old, new.drop("_part"), self.keys).withColumn("_part", self.part)
        out.write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/data/version={version}")
        self._note([(p, version, stream, batch) for p in touched], version)

    def _note(self, rows: list[tuple], version: int, kind: str = "version") -> str:
        path = f"{self.root}/log/{kind}={version}"
        self.spark.createDataFrame(rows, self.LOG).coalesce(1).write.mode("overwrite").parquet(path)
        return path

    def compact(self) -> int:
        """Deletes the parts that later versions replace, and joins the log's entries into one, which is written before
        the others go; returns how many parts went. Readers that still hold an older version must be done."""
        entries, versions = self._entries(), self._versions()
        if not versions:
            return 0
        last = self._log().groupBy("stream").agg(F.max("batch").alias("batch")).collect()  # a row per stream
        gone = [(r["part"], r["version"]) for r in self._log().select("part", "version").distinct().collect() if versions[r["part"]] != r["version"]]
        some, top = next(iter(versions.items())), max(versions.values())
        kept = self._note([(p, v, None, None) for p, v in versions.items()] + [(*some, r["stream"], r["batch"]) for r in last], top, "compacted")
        for path in entries:
            if path.rstrip("/").rsplit("/", 1)[-1] != kept.rsplit("/", 1)[-1]:
                found, fs = self._folder(f"log/{path.rstrip('/').rsplit('/', 1)[-1]}")
                fs.delete(found, True)
        for p, v in gone:
            found, fs = self._folder(f"data/version={v}/_part={p}")
            fs.delete(found, True)
        return len(gone)


def append_batches(root: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each micro-batch in a folder of its own: a batch that is run again replaces itself."""

    def append(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch}")

    return append


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Flushes by size (what the source gives a trigger) and by time: every so often, or all there is and then stop."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(sink).start()


def run_log(spark: SparkSession, root: str, run_id: int, work: Callable[[], int]) -> DataFrame:
    """Runs work, and keeps a row of its life in root: running, then success with its row count, or failed with the
    error, which is raised again. Returns each run's last row."""
    schema = "run_id int, status string, n long, error string, at timestamp"

    def note(step: int, status: str, n: int | None = None, error: str | None = None) -> None:
        row = spark.createDataFrame([(run_id, status, n, error)], "run_id int, status string, n long, error string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/run={run_id}/step={step}")

    note(0, "running")
    try:
        note(1, "success", work())
    except Exception as e:
        note(1, "failed", error=str(e)[:500])
        raise
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root).groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.max_by("n", "at").alias("n"), F.max_by("error", "at").alias("error"))
