"""Starts and stops of sources across a restart, and the flushing sink's batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def plain_changes(seen, patience):
    """[(key, change, minute)] of (key, minute), all stopped at the end."""
    out = []
    for k in sorted({k for k, _ in seen}):
        last = None
        for t in sorted(t for q, t in seen if q == k):
            if last is not None and t - last > patience:
                out.append((k, "stop", last))
                last = None
            if last is None:
                out.append((k, "start", t))
            last = t
        out.append((k, "stop", last))
    return out


def test_sources_start_and_stop(spark, tmp_path):
    from tidewatch.streaming import minutes as M
    from tidewatch.streaming.targets import source_changes

    seen = [(k, 5 * p) for p in range(24) for k in range(4) if k == 0 or (k == 1 and p < 6) or (k == 2 and (p < 4 or p > 12)) or (k == 3 and p in (9, 10))]
    path, sink, schema = f"{tmp_path}/polls", f"{tmp_path}/changes", "broad_no long, ts timestamp"

    def poll(rows):
        spark.createDataFrame([(k, T0 + dt.timedelta(minutes=t)) for k, t in rows], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        M.start(source_changes(stream), M.append_batches(sink), f"{tmp_path}/checkpoint", "append").awaitTermination(200)

    for a, b in ((0, 30), (30, 60)):
        poll([(k, t) for k, t in seen if a <= t < b])
    run()
    poll([(k, t) for k, t in seen if 60 <= t < 90] * 2)  # each poll twice
    poll([(k, t) for k, t in seen if t >= 90] + [(None, 95)])
    poll([(9, 600)])  # lets the watermark pass
    run()  # another query, from the checkpoint
    got = spark.read.option("recursiveFileLookup", "true").parquet(sink).collect()
    got = [(r["broad_no"], r["change"], int((r["at"] - T0).total_seconds() // 60)) for r in got if r["broad_no"] != 9]
    assert sorted(got) == sorted(plain_changes(seen, 10)) and len(got) > 8


def test_flushing_sink(spark, tmp_path):
    from tidewatch.sources import flushing
    from tidewatch.streaming import minutes as M

    spark.dataSource.register(flushing.FlushingSink)
    path, schema = f"{tmp_path}/in", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 5, "click", 1.0, f"m{i}") for i in range(450)]
    write = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    sink, bad = f"file://{tmp_path}/out", F.raise_error(F.lit("lost"))

    def start(fail=False):
        stream = M.chat_messages(M.event_stream(spark, path, spark.createDataFrame([], schema).schema))
        stream = stream.dropDuplicates(["message_hash"]).select("event_id", F.when(F.lit(fail) & (F.col("event_id") == 449), bad.cast("long")).otherwise(F.col("user_id")).alias("user_id"))
        stream.writeStream.format("flushing").option("path", sink).option("rows", 100).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(200)

    read = lambda: sorted(r["event_id"] for r in flushing.read_flushed(spark, sink, spark.createDataFrame([], "event_id long, user_id long").schema).collect())
    assert read() == []
    write(rows[:250])
    start()
    assert read() == list(range(250))
    write(rows[200:])  # the last 50 come again, as after a reconnect
    with pytest.raises(Exception, match="lost"):
        start(fail=True)
    assert read() == list(range(250))  # a failed batch leaves nothing
    start()
    assert read() == list(range(450))
    done = flushing.manifests(sink)
    assert sum(m["rows"] for m in done) == 450 and len({f for m in done for f in m["files"]}) == sum(len(m["files"]) for m in done)
    assert all(spark.read.parquet(f"file://{f}").count() <= 100 for m in done for f in m["files"])
    flushing.FlushingWriter(sink, 100, 3).commit([], done[-1]["batch"])  # a batch that ran already
    assert read() == list(range(450))
