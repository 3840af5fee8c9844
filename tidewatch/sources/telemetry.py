"""The minute table: audience snapshots and chat events joined per broadcast and tick.

The events table stands in for broadcast telemetry: clicks are chat messages, other events are audience snapshots,
the day is the run, user_id modulo 20 the broadcast, and an hour the tick.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import id_str
from .steps import written

TICK_MINUTES = 60
#: A clock gap over 1.1 ticks breaks a run or a block.
GAP_MINUTES = 1.1 * TICK_MINUTES
KEY = ["run_id", "broad_no", "minute_ts"]

MINUTE_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.IntegerType()), T.StructField("broad_no", T.LongType()), T.StructField("minute_ts", T.TimestampNTZType()),
        T.StructField("viewer_count_last", T.DoubleType()), T.StructField("category_id", T.StringType()), T.StructField("chat_count", T.LongType()),
        T.StructField("unique_chatters", T.LongType()), T.StructField("avg_msg_len", T.DoubleType()), T.StructField("repeat_msg_ratio", T.DoubleType()),
        T.StructField("new_chatter_ratio", T.DoubleType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order, missing ones null, the others cast (what can't be cast is null)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def telemetry(events: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", "props", F.date_format(ts, "yyyyMMdd").cast("int").alias("run_id"),
        (F.col("user_id") % 20).alias("broad_no"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("minute_ts"),
    )


def chat_events(events: DataFrame) -> DataFrame:
    return telemetry(events).filter("event_type = 'click'").withColumnRenamed("props", "message")


def snapshots(events: DataFrame, run_id: int | None = None) -> DataFrame:
    """Audience snapshots, of one run if given."""
    out = telemetry(events).filter("event_type <> 'click'")
    return out if run_id is None else out.filter(F.col("run_id") == run_id)


def run_status(rows: DataFrame) -> DataFrame:
    """One row per run: started, ended, n, and failed if its last event is an error, else success."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return rows.groupBy("run_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"), F.when(last == "error", "failed").otherwise("success").alias("status"))


def scan_files(spark: SparkSession, paths: list[str], rename: Callable[[str], str] = str.strip) -> DataFrame:
    """Parquet files or folders as one table: headers renamed (trimmed), columns united by name, those that a file
    lacks null, and source_file, the table that a row came from."""
    out = None
    for path in paths:
        df = spark.read.parquet(path)
        df = df.select(*[F.col(c).alias(rename(c)) for c in df.columns], F.regexp_extract("_metadata.file_path", r"/([^/.]+)\.parquet(?:/[^/]*)?$", 1).alias("source_file"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_run_id(df: DataFrame, file: Column, column: str = "run_id") -> DataFrame:
    """run_id from the file's name wherever a file has none of its own in any row."""
    if column not in df.columns:
        return df.withColumn(column, run_id_from_name(file))
    known = F.count(column).over(Window.partitionBy(file))
    return df.withColumn(column, F.when(known == 0, run_id_from_name(file)).otherwise(F.col(column)))


def targets_of_lines(lines: DataFrame) -> DataFrame:
    """Targets from lines of a list by position: user_id, name, channel; lines of fewer columns are dropped."""
    parts = lines.select(F.split("value", ",").alias("p")).filter(F.size("p") >= 3)
    return parts.select(*[F.trim(F.get("p", F.lit(i))).alias(c) for i, c in enumerate(("user_id", "name", "channel"))])


def normalise_minute(saved: DataFrame) -> DataFrame:
    """A saved minute table taken in again: canonical ids, coerced numbers and times, no rows without a key, the first
    of equal keys, and negative counts as null."""
    ids = {c: id_str(F.col(c)).try_cast("bigint") for c in KEY[:2]}
    counts = {c: F.trim(c).try_cast("double") for c in ("chat_count", "unique_chatters", "viewer_count_last") if c in saved.columns}
    out = saved.withColumns(ids | {c: F.when(v >= 0, v) for c, v in counts.items()} | {"minute_ts": F.trim("minute_ts").try_cast("timestamp_ntz")}).na.drop(subset=KEY)
    out = conform(out, MINUTE_SCHEMA).dropDuplicates(KEY)
    return out.withColumn("session_key", F.concat_ws("_", "run_id", "broad_no"))


def join_by_ids(left: DataFrame, right: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """Left join on ids compared as canonical text and on plain keys."""
    other = right.select(*[id_str(F.col(c)).alias(f"_id_{c}") for c in ids], *[F.col(c).alias(f"_key_{c}") for c in keys], *[c for c in right.columns if c not in (*ids, *keys)])
    same = F.lit(True)
    for c in ids:
        same = same & (id_str(F.col(c)) == F.col(f"_id_{c}"))
    for c in keys:
        same = same & (F.col(c) == F.col(f"_key_{c}"))
    return left.join(other, same, "left").drop(*[f"_id_{c}" for c in ids], *[f"_key_{c}" for c in keys])


def chat_minutes(chat: DataFrame) -> DataFrame:
    """Per broadcast and tick: messages, distinct users, mean length, share of repeated messages, and share of users
    who are new to the broadcast. One row per user and tick serves all but the repeats; as ticks are cut from ts, a user
    is new in the tick that has the user's first message, and no row meets the tick's own first message for that."""
    spoke = chat.groupBy(*KEY, "user_id").agg(
        F.count("message").alias("said"), F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.coalesce("message", F.lit("")))).alias("length"), F.min("ts").alias("here")
    )
    entry = F.min("here").over(Window.partitionBy("run_id", "broad_no", "user_id"))  # a row per tick
    new = F.when(F.col("user_id").isNotNull(), F.when(F.col("here") == F.col("entry"), 1.0).otherwise(0.0))
    base = spoke.withColumn("entry", entry).groupBy(*KEY).agg(
        F.sum("said").alias("chat_count"), F.count("user_id").alias("unique_chatters"), (F.sum("length") / F.sum("rows")).alias("avg_msg_len"), F.coalesce(F.avg(new), F.lit(0.0)).alias("new_chatter_ratio")
    )
    said = chat.groupBy(*KEY, F.coalesce("message", F.lit("__NULL__")).alias("m")).agg(F.count(F.lit(1)).alias("c"))
    repeats = said.groupBy(*KEY).agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeat_msg_ratio"))
    return base.join(repeats, KEY, "left")


def snapshot_minutes(shots: DataFrame) -> DataFrame:
    """The last known value of each column per broadcast and tick. The times of the last rows come first, from an
    aggregation of numbers alone; only rows of these times are ordered by (ts, event_id)."""
    known = {"value": "viewer_count_last", "event_type": "category_id"}
    times = shots.groupBy(*KEY).agg(F.max("ts").alias("_t"), *[F.max(F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_t_{c}") for c in known])
    times = written(times.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.explode(F.array_distinct(F.array("_t", *[f"_t_{c}" for c in known]))).alias("_t")), "snapshot-times")
    same = F.col("ts").eqNullSafe(F.col("_t"))
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    at = F.struct("ts", "event_id")
    return shots.join(times, same, "left_semi").groupBy(*KEY).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(name) for c, name in known.items()])


def minute_table(events: DataFrame) -> DataFrame:
    """Snapshots full-outer-joined with chat per tick; ticks without chat count 0 messages."""
    both = snapshot_minutes(snapshots(events)).join(chat_minutes(chat_events(events)), KEY, "full_outer")
    return conform(both.fillna(0, ["chat_count", "unique_chatters"]), MINUTE_SCHEMA).withColumn("session_key", F.concat_ws("_", "run_id", "broad_no"))


def chat_frames(frames: DataFrame, column: str = "frame") -> DataFrame:
    """Chat messages out of raw JSON frames: command 93101 is chat, 93102 a donation; the body is a list, times are
    epoch milliseconds, and the nickname sits in a JSON text of its own."""
    body = "array<struct<uid:string,msg:string,msgTime:bigint,profile:string>>"
    parsed = frames.select(F.from_json(column, f"cmd int, bdy {body}").alias("f")).filter(F.col("f.cmd").isin(93101, 93102))
    rows = parsed.select(F.col("f.cmd").alias("cmd"), F.explode("f.bdy").alias("b"))
    nick = F.coalesce(F.get_json_object("b.profile", "$.nickname"), F.col("b.uid"))
    return rows.select("cmd", F.timestamp_millis("b.msgTime").alias("event_ts"), F.col("b.uid").alias("user_id"), nick.alias("user_nick"), F.col("b.msg").alias("message"))


def message_hash(broad: str, user: str, message: str, ts: str) -> Column:
    return F.sha2(F.concat_ws("_", F.col(broad).cast("string"), F.col(user).cast("string"), message, F.unix_seconds(F.col(ts).cast("timestamp")).cast("string")), 256)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, with or without a byte order mark, read by a known schema by position; malformed rows are
    dropped; a missing path is an empty frame."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED", encoding="UTF-8", enforceSchema=True)


def run_id_from_name(name: Column) -> Column:
    return F.regexp_extract(name, r"Run_(\d+)_Features", 1).try_cast("int")
