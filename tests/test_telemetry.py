"""The kernels against small fixtures worked out by hand, and streaming against batch."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import models, ranks, review, scan, windows

T0 = dt.datetime(2026, 1, 1)
MINUTE = "run_id int, broad_no long, minute_ts timestamp_ntz, minute_idx int, z double, flag boolean, x double"


def minutes(spark, values, gaps=()):
    at, rows = T0, []
    for i, (z, flag, x) in enumerate(values):
        at += dt.timedelta(minutes=5 if i in gaps else 1)
        rows.append((1, 2, at, i + 1, z, flag, x))
    return spark.createDataFrame(rows, MINUTE)


def column(df, name):
    return [r[name] for r in df.orderBy("minute_idx").collect()]


def test_zero_run_resets_at_flips_and_gaps(spark):
    flags = [True, True, False, True, True, True]
    m = minutes(spark, [(0.0, f, None) for f in flags], gaps=(4,))
    w = windows.session_window()
    assert column(windows.run_length(m, "flag", "r", w, 1.1), "r") == [1, 2, 0, 1, 1, 2]
    assert column(windows.run_length(m, "flag", "r", w), "r") == [1, 2, 0, 1, 2, 3]


def test_interpolation_and_fill(spark):
    m = minutes(spark, [(0.0, True, x) for x in (None, 2.0, None, None, 8.0, None)])
    w = windows.session_window()
    assert column(windows.interpolate(m, "x", "v", w), "v") == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]
    assert column(m.select("minute_idx", windows.ffill("x", w, 1).alias("v")), "v") == [None, 2.0, 2.0, None, 8.0, 8.0]
    assert column(m.select("minute_idx", windows.rolling("x", 3, w).alias("v")), "v") == [None, 2.0, 2.0, 2.0, 8.0, 8.0]


def test_percentile_rank_averages_ties_and_keeps_null(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([5.0, 1.0, 5.0, None, 3.0])], "i int, x double")
    got = {r["i"]: r["p"] for r in ranks.pct_rank(df, "x", "p").collect()}
    assert got == {0: 0.875, 1: 0.25, 2: 0.875, 3: None, 4: 0.5}
    assert {r["p"] for r in ranks.pct_rank(df.filter("x is null"), "x", "p").collect()} == {None}
    many = spark.range(5000).select((F.col("id") * 7919 % 1000).cast("double").alias("x"))
    for r in ranks.pct_rank(many, "x", "p").distinct().collect():
        assert math.isclose(r["p"], (5 * r["x"] + 3) / 5000)


def test_qcut_drops_equal_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0, 0, 0, 0, 1, 2, 3]], "x double")
    edges = ranks.qcut_edges(df, "x", 4)
    assert edges == [0.0, 1.25, 3.0]
    assert sorted(r["b"] for r in df.select(ranks.qcut(F.col("x"), edges).alias("b")).collect()) == [0, 0, 0, 0, 0, 0, 1, 1]
    assert ranks.qcut_edges(df.filter("x = 0"), "x", 4) == []


def test_bh_and_rra(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r["i"]: r["q"] for r in ranks.bh_q(df, "p", "q").collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02] and got[4] is None
    r = spark.createDataFrame([(0.2, 0.5), (None, 1.0)], "a double, b double").select(S.rra_p([F.col("a"), F.col("b")]).alias("p")).collect()
    # two ranks: smallest 0.2 -> 1 - 0.8^2 = 0.36, largest 0.5 -> 0.25; times 2
    assert math.isclose(r[0]["p"], 0.5) and r[1]["p"] == 1.0


def test_normal_quantile(spark):
    from statistics import NormalDist

    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.98, 0.9999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(F.expr(S.ppf_sql("p")).alias("z")).collect()
    assert all(abs(g["z"] - NormalDist().inv_cdf(x)) < 1e-7 for g, x in zip(got, p, strict=True))


def units(m):
    return m.withColumn("session_key", F.lit("1_2")).withColumn("z", F.round(F.col("z") * scan.UNIT).cast("long"))


def test_scan_finds_the_first_strongest_interval(spark):
    z = [0.1, 2.0, 2.0, 2.0, -1.0, 3.4, 0.0]
    m = units(minutes(spark, [(x, True, None) for x in z], gaps=(5,)))
    b = scan.best_intervals(m, 1.1).collect()[0]
    assert (b["start_idx"], b["end_idx"], b["duration"], b["clock_minutes"]) == (2, 4, 3, 3.0) and math.isclose(b["scan_z"], 6 / math.sqrt(3))
    n = {r["block"]: r for r in scan.scan_blocks(m, 1.1, n_perm=50).collect()}
    assert set(n) == {1, 2} and all(1 / 51 <= r["empirical_p"] <= 1 and r["null_mean"] <= r["null_p95"] for r in n.values())
    one = units(minutes(spark, [(1.0, True, None)] * 2, gaps=(1,)))
    assert {r["empirical_p"] for r in scan.scan_blocks(one, 1.1, n_perm=9).collect()} == {None}


def test_scan_null_permutes_the_whole_block_before_pruning():
    """Brute force over all intervals; a long block is cut to its ends and best rows, its null to the same places."""
    import numpy as np
    import pyarrow as pa

    z = np.random.default_rng(2).normal(0, 1, 40)
    units_ = np.round(z * scan.UNIT).astype(np.int64)
    t = pa.table({"run_id": pa.array([1] * 40, pa.int32()), "broad_no": pa.array([2] * 40, pa.int64()), "session_key": ["1_2"] * 40, "block": pa.array([3] * 40, pa.int64()), "minute_idx": pa.array(range(1, 41), pa.int32()), "minute_ts": [T0 + dt.timedelta(minutes=i) for i in range(40)], "z": units_})
    brute = lambda v: max((v[a : b + 1].sum() / (scan.UNIT * math.sqrt(b - a + 1)), -a, -b) for a in range(len(v)) for b in range(a, len(v)))
    for most in (500, 12):
        keep = sorted({0, 39, *sorted(range(40), key=lambda i: (-units_[i], i))[:most]})
        r = scan._scan(t, 30, most).to_pylist()[0]
        want = brute(units_[keep])
        assert math.isclose(r["scan_z"], want[0]) and (r["start_idx"], r["end_idx"]) == (keep[-want[1]] + 1, keep[-want[2]] + 1)
        null = [brute(units_[scan.permutation("1_2", 3, k, 40)][keep])[0] for k in range(1, 31)]
        assert math.isclose(r["null_mean"], float(np.mean(null))) and r["empirical_p"] == (1 + sum(x >= r["scan_z"] for x in null)) / 31
    assert sorted(scan.permutation("a", 1, 1, 9)) == list(range(9)) and len({tuple(scan.permutation("a", 1, k, 9)) for k in range(50)}) == 50


def test_quantiles_by_brackets(spark):
    import random

    import numpy as np

    r = random.Random(5)
    rows = [(i % 3 if i % 11 else None, float(r.choice([0, 0, 0, 1, 2.5, r.gauss(0, 50)])), None if i % 5 else float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    at = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    for most in (1_000_000, 40):  # with few rows a bracket, they are narrowed several times
        whole = ranks.quantile_row(df, ["x", "y"], at, most)
        assert np.allclose(whole["x"], np.quantile([x for _, x, _ in rows], at)) and np.allclose(whole["y"], np.quantile([y for *_, y in rows if y is not None], at))
        by = ranks.quantiles(df, ["x"], at, "g", most)
        assert all(np.allclose(by[(g, "x")], np.quantile([x for h, x, _ in rows if h == g], at)) for g in (0, 1, 2, None))
    assert ranks.quantile_row(df.filter("x is null"), ["x"], (0.5,)) == {"x": [None]}


def test_places_and_group_ranks(spark):
    df = spark.createDataFrame([(f"s{i:04}", (i * 7919) % 500, None if i % 9 == 0 else float(i % 50)) for i in range(2000)], "k string, a int, x double")
    got = ranks.places(df, [F.desc("a"), F.asc("k")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 2001)) and [(-r["a"], r["k"]) for r in got] == sorted((-r["a"], r["k"]) for r in got)
    df = df.withColumn("g", F.when(F.col("a") % 3 != 0, F.col("a") % 3))
    mine = {r["k"]: r["p"] for r in ranks.group_pct_ranks(df, ["g"], "x", "p", "n").collect()}
    window = {r["k"]: r["p"] for r in df.select("k", ranks.group_pct_rank(F.col("x"), ["g"]).alias("p")).collect()}
    assert mine.keys() == window.keys() and all(mine[k] is None and window[k] is None or math.isclose(mine[k], window[k]) for k in mine)
    hot = spark.range(4000).select("id", F.when(F.col("id") < 3000, 0.0).when(F.col("id") < 3900, F.col("id").cast("double")).alias("x"))
    for r in ranks.pct_rank(hot, "x", "p").collect():
        want = 3001 / 2 / 3900 if r["id"] < 3000 else (r["id"] + 1) / 3900 if r["id"] < 3900 else None
        assert r["p"] is None and want is None or math.isclose(r["p"], want)


def test_episodes_merge_small_gaps(spark):
    m = minutes(spark, [(0.0, True, None)] * 9).filter("minute_idx in (1, 2, 4, 7, 8)")
    assert [r["episode"] for r in windows.episodes(m, 1, windows.session_window(order="minute_idx")).orderBy("minute_idx").collect()] == [1, 1, 1, 2, 2]


def test_time_window_wraps_midnight(spark):
    df = spark.createDataFrame([(m,) for m in (1379, 1380, 1439, 0, 90, 91, 720)], "m int")
    assert [r["ok"] for r in df.select(S.in_window(F.col("m"), 1380, 90).alias("ok")).collect()] == [False, True, True, True, True, False, False]


def test_ids_and_row_statistics(spark):
    df = spark.createDataFrame([(x,) for x in (" 1101.0 ", "", "ab", "7", None, "1.5", "NaN")], "v string")
    assert [r["i"] for r in df.select(S.id_str(F.col("v")).alias("i")).collect()] == ["1101", None, "ab", "7", None, "1.5", "NaN"]
    row = spark.createDataFrame([(4.0, None, 1.0, 9.0)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    r = row.select(S.row_mean(cols).alias("mean"), S.row_median(cols).alias("med"), S.row_trimmed_mean(cols).alias("trim"), S.row_std(cols).alias("std"), S.row_count_at_least(cols, 4.0).alias("n")).collect()[0]
    assert math.isclose(r["mean"], 14 / 3) and r["med"] == 4.0 and r["trim"] == 4.0 and r["n"] == 2 and math.isclose(r["std"], math.sqrt(((4 - 14 / 3) ** 2 + (1 - 14 / 3) ** 2 + (9 - 14 / 3) ** 2) / 3))


SCANNED = "session_key string, empirical_p double, scan_z double, duration long, model_chat_mean double, model_unique_mean double, state_rate double, mismatch_rate double, mismatch_max_run long, mismatch_total_run long, anomaly double, reason_rank_max double, reason_value_max double, eligible boolean"


def test_families_and_review_order(spark):
    """Three sessions with known evidence: long and persistent first, a short spike second, the weak one last."""
    from tidewatch.operators import evidence

    rows = [("s1", 0.01, 9.0, 1, 2.0, 2.5, 0.9, 0.9, 1, 1, 3.0, 1.0, 3.0, True), ("s2", 0.02, 8.0, 40, 2.2, 2.1, 0.8, 0.8, 30, 40, 2.0, 0.9, 2.5, True), ("s3", 0.5, 1.0, 10, 0.1, 0.1, 0.2, 0.2, 5, 8, 0.1, 0.3, 0.2, True), ("s4", None, None, None, None, None, None, None, None, None, None, None, None, False)]
    f = evidence.family_ranks(spark.createDataFrame(rows, SCANNED))
    got = {r["session_key"]: r for r in evidence.raw_evidence(evidence.review(f, 4), 4).collect()}
    assert [got[s]["scan_rank"] for s in ("s1", "s2", "s3", "s4")] == [1, 2, 3, None]
    assert [got[s]["persistence_rank"] for s in ("s1", "s2", "s3")] == [3, 1, 2] and [got[s]["expected_rank"] for s in ("s1", "s2", "s3")] == [1, 2, 3]
    assert math.isclose(got["s1"]["scan_strength"], 1 - 1 / 5) and got["s4"]["consensus"] == 0.0 and got["s4"]["rra_p"] == 1.0
    assert math.isclose(got["s1"]["consensus"], (4 * 0.8 + 0.4) / 5) and math.isclose(got["s2"]["consensus"], (4 * 0.6 + 0.8) / 5)
    assert [got[s]["review_order"] for s in ("s1", "s2", "s3", "s4")] == [1, 2, 3, None] and got["s4"]["review_all_order"] == 4
    assert got["s1"]["raw_count"] == 8 and got["s4"]["raw_count"] == 0
    notes = {r["session_key"]: r["note"] for r in evidence.review(f, 4).filter("eligible").select("session_key", evidence.review_note(f).alias("note")).collect()}
    assert notes["s1"].endswith("confirm by hand") and "hand" not in notes["s2"]


def test_state_transitions_are_recounted(spark):
    from tidewatch.operators import evidence

    rows = [(1, b, name, T0 + dt.timedelta(minutes=i), c) for b, (name, cs) in enumerate((("same", (1, 1, 1)), ("zigzag", (0, 1, 1, 0)))) for i, c in enumerate(cs)]
    m = spark.createDataFrame(rows, "run_id int, broad_no long, session_key string, minute_ts timestamp_ntz, minute_cluster int").withColumn("mismatch_state", (F.col("minute_cluster") == 0).cast("double"))
    d = {r["session_key"]: r for r in evidence.dwell(m).collect()}
    assert (d["same"]["transitions"], d["zigzag"]["transitions"]) == (0, 2) and (d["zigzag"]["mismatch_runs"], d["zigzag"]["active_max_run"], d["same"]["mismatch_mean_run"]) == (2, 2, 0.0)
    stored = spark.createDataFrame([("same", 2), ("zigzag", 2)], "session_key string, transitions long")
    assert [r["session_key"] for r in evidence.transition_audit(stored, m).filter("mismatch").collect()] == ["same"]
    t = {(r["from_state"], r["to_state"]): (r["n"], r["share"]) for r in evidence.state_transitions(m).collect()}
    assert t == {("active", "active"): (3, 0.75), ("active", "mismatch"): (1, 0.25), ("mismatch", "active"): (1, 1.0), ("mismatch", "mismatch"): (0, 0.0)}


def test_recovery_scans_the_injected_rows(spark, tmp_path):
    import random

    from tidewatch.operators import state, synthetic

    r, rows = random.Random(3), []
    for b in range(30):
        for i in range(40):
            chat = r.randint(10, 30)
            rows.append((1, b, f"1_{b}", T0 + dt.timedelta(minutes=i), r.randint(80, 120), chat, chat // 2))
    df = spark.createDataFrame(rows, "run_id int, broad_no long, session_key string, minute_ts timestamp_ntz, viewer_count_last long, chat_count long, unique_chatters long")

    def kept(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    real = kept(state.minute_state(df, 1.1), "state")
    scores = kept(state.mismatch_scores(real), "scores")
    injected = kept(synthetic.inject(real), "injected")
    rescored = kept(state.injected_scores(kept(state.injected_state(injected, real, 1.1), "changed"), scores), "rescored")
    rescored = kept(state.injected_ranks(rescored, scores), "ranked")
    hit, miss = (injected.join(rescored.select("session_key", "minute_idx", "minute_mismatch_rank"), ["session_key", "minute_idx"]).filter(x).agg(F.avg("minute_mismatch_rank")).first()[0] for x in ("injected", "not injected"))
    assert rescored.count() == 1200 and hit > 0.9 > 0.6 > miss
    z = lambda s: s.withColumn("z", F.round(F.expr(S.rank_z_sql("minute_mismatch_rank", "1200")) * scan.UNIT).cast("long"))
    rate = lambda s: synthetic.recovery(injected, scan.best_intervals(z(s), 1.1), ["run_id", "broad_no"]).agg(F.avg(F.col("at_30").cast("double"))).first()[0]
    assert rate(rescored) > 0.9 and rate(scores) < 0.5


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    r = models.binary_metrics(df, "s", "y").collect()[0]
    assert (r["n"], r["positives"], r["roc_auc"]) == (4, 2, 0.875) and math.isclose(r["average_precision"], round(0.5 + 0.5 * 2 / 3, 6))
    scaled = models.robust_scale(spark.createDataFrame([(i, float(i), 1.0) for i in range(5)], "i int, a double, b double"), ["a", "b"])
    assert [(r["a"], r["b"]) for r in scaled.orderBy("i").collect()] == [(-1.0, 0.0), (-0.5, 0.0), (0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=13 * i), i % 41, "click" if i % 3 else "view", 1.0, f"m{i}") for i in range(300)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    df = spark.createDataFrame(rows + rows[:20], schema)
    for k in range(3):
        df.filter(F.floor((F.col("event_id") * 3) / 300) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return df, f"{tmp_path}/events", str(tmp_path)


def batch_counts(df):
    want = df.filter("event_type = 'click'").groupBy((F.col("user_id") % 20).alias("b"), F.date_trunc("hour", "ts").alias("t")).agg(F.count_distinct("event_id").alias("n"), F.count_distinct("user_id").alias("u"))
    return sorted(map(tuple, want.collect()))


def test_stream_converges_to_batch(spark, events):
    from tidewatch.streaming import minutes as M

    df, path, tmp = events
    stream = M.chat_ticks(M.event_stream(spark, path, df.schema))
    table = M.UpsertTable(spark, f"{tmp}/table", stream.schema, ["broad_no", "minute_ts"])
    run = M.start(stream, table.apply, f"{tmp}/checkpoint")
    run.awaitTermination(120)
    rows = lambda t: sorted(map(tuple, t.read().select("broad_no", "minute_ts", "chat_count", "users").collect()))
    assert rows(table) == batch_counts(df)
    again = M.UpsertTable(spark, f"{tmp}/table", stream.schema, ["broad_no", "minute_ts"])  # after a restart
    assert rows(again) == rows(table)
    before = rows(again)
    later = spark.createDataFrame([(1, T0.replace(tzinfo=dt.UTC), 7, 1), (1, T0.replace(tzinfo=dt.UTC), 9, 2)], stream.schema)
    again.apply(later, 0, str(run.id))  # a batch that ran already
    assert rows(again) == before
    again.apply(later, 99)  # of two rows of a key, the last in order stays
    assert [r for r in rows(again) if r not in before] == [(1, T0, 9, 2)] and len(rows(again)) in (len(before), len(before) + 1)
    touched = spark.createDataFrame([(r[0], r[1].replace(tzinfo=dt.UTC)) for r in before], "broad_no long, minute_ts timestamp")
    full = M.recount(df.withColumn("ts", F.col("ts").cast("timestamp")), touched)
    assert sorted(map(tuple, full.select("broad_no", "minute_ts", "chat_count", "users").collect())) == batch_counts(df)


def test_stream_sessions_targets_and_append(spark, events):
    from tidewatch.streaming import minutes as M

    df, path, tmp = events
    targets = spark.createDataFrame([(k, k < 5) for k in range(20)], "broad_no long, is_active boolean")
    active = M.of_active(M.chat_messages(M.event_stream(spark, path, df.schema)), targets)
    M.start(active.select("event_id", "broad_no"), M.append_batches(f"{tmp}/rows"), f"{tmp}/c1", "append").awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp}/rows")
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in df.filter("event_type = 'click' and user_id % 20 < 5").select("event_id").collect())
    kept = []
    stream = M.activity_sessions(M.event_stream(spark, path, df.schema), "6 hours", "1 hour")
    M.start(stream, lambda rows, batch: kept.extend(map(tuple, rows.collect())), f"{tmp}/c2", "append").awaitTermination(120)
    clicks = sorted((r["user_id"] % 20, r["ts"]) for r in df.filter("event_type = 'click'").collect())
    want = []
    for b, t in clicks:
        if want and want[-1][0] == b and t <= want[-1][2]:
            want[-1] = (b, want[-1][1], t + dt.timedelta(hours=6), want[-1][3] + 1)
        else:
            want.append((b, t, t + dt.timedelta(hours=6), 1))
    end = max(t for _, t in clicks)
    closed = [w for w in want if w[2] <= end - dt.timedelta(hours=2)]  # what the watermark has surely passed
    assert closed and set(closed) <= set(kept) <= set(want)


def test_run_log(spark, tmp_path):
    from tidewatch.streaming import minutes as M

    assert [tuple(r) for r in M.run_log(spark, str(tmp_path), 1, lambda: 7).collect()] == [(1, "success", 7, None)]
    with pytest.raises(ValueError):
        M.run_log(spark, str(tmp_path), 2, lambda: int("x"))
    assert {r["run_id"]: r["status"] for r in M.run_log(spark, str(tmp_path), 3, lambda: 0).collect()} == {1: "success", 2: "failed", 3: "success"}


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert first.columns == ["session_key", "n", "zero_rate", "gap_med", "zrun_max", "rule_score", "review_order"] and first.count() > 0


def test_row_statistics_are_compiled(spark):
    """No function over a lambda, which Spark interprets value by value; rows of no, one and two values hold."""
    rows = [(0, None, None, None), (1, None, 2.0, None), (2, 4.0, None, 1.0), (3, 9.0, 2.0, 4.0), (4, float("nan"), 1.0, 3.0)]
    cols = [F.col(c) for c in "abc"]
    named = {"med": S.row_median(cols), "trim": S.row_trimmed_mean(cols), "std": S.row_std(cols), "k": S.row_count_at_least(cols, 2.0), "v": S.row_values(cols)}
    df = spark.createDataFrame(rows, "i int, a double, b double, c double").select("i", *[c.alias(n) for n, c in named.items()])
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in df.orderBy("i").collect()]
    assert got[:4] == [(0, None, None, None, 0, []), (1, 2.0, 2.0, 0.0, 1, [2.0]), (2, 2.5, 2.5, 1.5, 1, [1.0, 4.0]), (3, 4.0, 4.0, pytest.approx(math.sqrt(26 / 3)), 3, [2.0, 4.0, 9.0])]
    assert got[4][1:3] == (3.0, 3.0) and math.isnan(got[4][3]) and got[4][4] == 2


def test_ablation_scans_all_signals_once(spark, tmp_path):
    """The scan of all signals is a written step: six branches read it, so that seven scans are planned, not twelve."""
    from tidewatch.plans import reviews, telemetry

    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 3, ("click", "view", "error")[i % 5 % 3], float(i % 11 + 1), "{}") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    out = telemetry.QUERIES["r26_signal_ablation"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 6
    assert {r["left_out"] for r in out.collect()} == set(reviews.state.SIGNALS)
