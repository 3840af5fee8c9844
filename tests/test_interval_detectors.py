"""Minute table and interval detectors: what is known is not computed again, with the results of plain versions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import evidence, neighbours
from tidewatch.plans import reviews, telemetry as plans
from tidewatch.sources import telemetry

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def jobs(spark, run) -> int:
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    run()
    return count() - before


def events():
    """Users who come back in later ticks and days, ties in ts, and null users, texts and values."""
    t, rows = datetime(2024, 1, 1, 22), []
    for i in range(900):
        kind = ("click", "view", "signup", "click", None)[i % 5]
        user = None if i % 41 == 0 else 20 * (i * 7 % 23) + i % 3
        rows.append((i, t + timedelta(seconds=(i * 977 % 18000) // 40 * 40), user, kind, None if i % 3 == 0 else i * 0.5, None if i % 13 == 0 else f"m{i * 5 % 17}"))
    return rows


def hour(ts):
    return ts.replace(minute=0, second=0, microsecond=0)


def ticks(rows):
    out = {}
    for r in rows:
        out.setdefault((int(f"{r[1]:%Y%m%d}"), None if r[2] is None else r[2] % 20, hour(r[1])), []).append(r)
    return out


def test_chat_minutes_are_the_plain_ones(spark):
    df = telemetry.chat_minutes(telemetry.chat_events(spark.createDataFrame(events(), EVENTS)))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 1
    got = {(r["run_id"], r["broad_no"], r["minute_ts"]): r for r in df.collect()}
    want = ticks([r for r in events() if r[3] == "click"])
    assert got.keys() == want.keys() and len(want) > 15
    first = {}
    for (run, broad, at), rows in want.items():
        for r in rows:
            first[run, broad, r[2]] = min(first.get((run, broad, r[2]), at), at)
    for (run, broad, at), rows in want.items():
        g, users, said = got[run, broad, at], {r[2] for r in rows} - {None}, [r[5] for r in rows]
        assert (g["chat_count"], g["unique_chatters"]) == (sum(m is not None for m in said), len(users))
        assert g["avg_msg_len"] == pytest.approx(sum(len(m or "") for m in said) / len(said))
        assert g["new_chatter_ratio"] == pytest.approx(sum(first[run, broad, u] == at for u in users) / max(len(users), 1))
        assert g["repeat_msg_ratio"] == (None if broad is None else pytest.approx(sum(said.count(m) > 1 for m in said) / len(said)))
    assert any(0 < r["new_chatter_ratio"] < 1 for r in got.values())


def test_snapshots_take_the_last_known_values(spark):
    shots = [(i, ts, user, kind, None if kind == "signup" else value, p) for i, ts, user, kind, value, p in events() if kind != "click"]
    df = telemetry.snapshot_minutes(telemetry.telemetry(spark.createDataFrame(shots, EVENTS)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # max_by reads the rows of the last times only
    got, want = {(r["run_id"], r["broad_no"], r["minute_ts"]): r for r in df.collect()}, ticks(shots)
    assert got.keys() == want.keys() and len(want) > 15
    for k, rows in want.items():
        last = lambda i, rows=rows: max(((r[1], r[0], r[i]) for r in rows if r[i] is not None), default=(None,))[-1]
        assert (got[k]["viewer_count_last"], got[k]["category_id"]) == (last(4), last(3))
    assert any(r["viewer_count_last"] is None for r in got.values())


def test_more_detectors_keep_what_the_intervals_have(spark, monkeypatch):
    x = lambda i: (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50 + i)) / 4).alias(evidence.ANOMALY[i])
    base = spark.range(80).select(F.format_string("s%03d", "id").alias("session_key"), *[x(i) for i in range(len(evidence.ANOMALY))])
    m = evidence.interval_anomaly(base).localCheckpoint()
    monkeypatch.setattr(reviews, "metrics", lambda spark, d: m)
    found = {}
    assert jobs(spark, lambda: found.update((r["session_key"], r) for r in plans.QUERIES["r9_interval_anomaly_forest_lof"](spark, "").collect())) <= 85
    scored = neighbours.local_outlier_factor(reviews.models.robust_scale(reviews.models.median_impute(m, evidence.ANOMALY), evidence.ANOMALY), evidence.ANOMALY, "session_key", 20)
    w = Window.orderBy(F.round("lof", 9))
    place = F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(F.round("lof", 9))) - 1) / 2
    want = scored.select("session_key", "weight", "ecod_dir", (place / 80 * F.col("weight")).alias("lof_dir")).collect()
    assert len(found) == len(want) == 80
    for r in want:
        g = found[r["session_key"]]
        assert [g[c] for c in ("weight", "ecod_dir", "lof_dir")] == [pytest.approx(r[c], abs=2e-6) for c in ("weight", "ecod_dir", "lof_dir")]
        assert g["anomaly"] == max(g["ecod_dir"], g["forest_dir"], g["lof_dir"])


def test_one_shard_is_asked_once(spark):
    df = spark.range(60).select(F.format_string("k%02d", "id").alias("k"), F.sin("id").alias("a"), F.cos(F.col("id") * 2).alias("b"))
    pts, boxes = neighbours.deal(neighbours.distinct_points(df, ["a", "b"], "k").select("id", "n", "x"), 2)
    assert boxes.several.sum() == 1
    assert jobs(spark, lambda: neighbours.nearest(pts, boxes, 5)) <= 8
    assert neighbours.nearest(pts, boxes, 5).count() == 300
