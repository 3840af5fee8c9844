"""Cluster metrics over whole embeddings."""

import numpy as np


def test_labels_that_separate_late(spark, tmp_path):
    from tidewatch.plans import telemetry

    r = np.random.default_rng(2)
    y = np.arange(60) % 2
    x = r.normal(0, 1, (60, 12))
    x[:, 9] += 20 * y
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(60)], "vec_id long, label int, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    c = np.array([x[y == k].mean(axis=0) for k in (0, 1)])
    w, b = ((x - c[y]) ** 2).sum(), 30 * ((c - x.mean(axis=0)) ** 2).sum()
    s = [np.sqrt(((x[y == k] - c[k]) ** 2).sum(axis=1)).mean() for k in (0, 1)]
    got = telemetry.QUERIES["m15_cluster_metrics_whole"](spark, str(tmp_path)).first()
    assert abs(got["calinski_harabasz"] - b / (w / 58)) < 1e-5 and abs(got["davies_bouldin"] - sum(s) / np.linalg.norm(c[0] - c[1])) < 1e-5
    assert got["calinski_harabasz"] > 100 > telemetry.QUERIES["m15_cluster_metrics"](spark, str(tmp_path)).first()["calinski_harabasz"]


def few_events(spark, path, hours, quiet=()):
    """One broadcast's hours, each with a snapshot and, unless quiet, a chat message."""
    import datetime as dt

    rows = []
    for h in range(hours):
        at = dt.datetime(2026, 1, 1, h)
        rows += [(2 * h, at, 3, "view", 5.0 + h, "{}")] + ([] if h in quiet else [(2 * h + 1, at, 23, "click", 1.0, "{}")])
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")


def test_best_k_where_no_cut_separates(spark, tmp_path):
    """Without silent ticks every cut has one cluster: no candidate, as by the SQL, instead of a division by zero."""
    import duckdb

    from tidewatch.plans import reviews, telemetry  # noqa: F401  reviews adds the query

    few_events(spark, tmp_path, 12)
    got = telemetry.QUERIES["t5_best_k"](spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got.columns == ["k", "ch", "bal", "sep", "score", "selected"]
    assert got.collect() == [] == duckdb.sql(telemetry.SQL["t5_best_k"]).fetchall()


def test_transitions_of_a_state_that_never_is(spark, tmp_path):
    """No silent tick: its moves are 0 of 0, NaN as by the SQL, instead of a division by zero."""
    import duckdb

    from tidewatch.plans import telemetry

    few_events(spark, tmp_path, 4)
    got = telemetry.QUERIES["a12_transitions"](spark, str(tmp_path)).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duckdb.sql(telemetry.SQL["a12_transitions"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(np.isnan(r["share"]) for r in got) == 2
