"""Models, folds, detectors and permutation nulls against brute force and invariants."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import learn, models, outliers, synthetic
from tidewatch.sources import telemetry

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def points(spark):
    """Two clouds, ten points far off, and a label that the first column tells."""
    r, rows = random.Random(1), []
    for i in range(300):
        c = 0.0 if i % 3 else 6.0
        rows.append((f"k{i:03}", i % 7, r.gauss(c, 1), r.gauss(c, 1), int(c > 0)))
    rows += [(f"far{i}", i % 7, 40.0 + 7 * i, -50.0, 0) for i in range(10)]
    return spark.createDataFrame(rows, "k string, run int, a double, b double, y int").persist()


def test_folds(points):
    s = learn.stratified_fold(points, "y", "k", 5)
    n = {(r["y"], r["fold"]): r["count"] for r in s.groupBy("y", "fold").count().collect()}
    assert set(n) == {(y, f) for y in (0, 1) for f in range(5)} and all(max(n[y, f] for f in range(5)) - min(n[y, f] for f in range(5)) <= 1 for y in (0, 1))
    other = learn.stratified_fold(points, "y", "k", 5, seed=1).join(s.select("k", F.col("fold").alias("f0")), "k")
    assert other.filter("fold <> f0").count() > 100
    g = learn.group_fold(points, "run", 3).groupBy("run").agg(F.count_distinct("fold").alias("d"), F.min("fold").alias("f")).collect()
    assert all(r["d"] == 1 for r in g) and {r["f"] for r in g} == {0, 1, 2}


def test_permuted_keeps_the_values_of_rows_together(points):
    p = learn.permuted(points, ["a", "b"], "k", 3).collect()
    was = {r["k"]: (r["a"], r["b"]) for r in points.collect()}
    assert sorted((r["a"], r["b"]) for r in p) == sorted(was.values()) and sum(was[r["k"]] != (r["a"], r["b"]) for r in p) > 250
    imp = {r["feature"]: r["drop_mean"] for r in learn.permutation_importance(points.filter("k like 'k%'").withColumn("c", F.lit(1.0) + F.crc32("k") % 5), ["a", "c"], "y", "k", folds=2).collect()}
    assert imp["a"] > 0.2 > abs(imp["c"])


def test_detectors_find_the_far_points(points):
    x = models.robust_scale(points.select("k", *COLS), COLS)
    for scored, name in ((outliers.local_outlier_factor(x, COLS, "k"), "lof"), (learn.isolation_forest(x, COLS, "k"), "iforest")):
        top = [r["k"] for r in scored.orderBy(F.desc(name)).limit(10).collect()]
        assert sum(k.startswith("far") for k in top) >= 7, name


def test_one_class_svm(spark):
    """Three rows far off on different sides of one cloud come first."""
    r = random.Random(2)
    rows = [(f"k{i:03}", r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)] + [("far0", 9.0, 9.0), ("far1", -9.0, 8.0), ("far2", 0.0, -12.0)]
    scored = outliers.one_class_svm(spark.createDataFrame(rows, "k string, a double, b double"), COLS, "k")
    assert {r["k"] for r in scored.orderBy(F.desc("ocsvm")).limit(3).collect()} == {"far0", "far1", "far2"}
    assert outliers.one_class_svm(scored.drop("ocsvm").limit(0), COLS, "k").count() == 0


def test_local_outlier_factor_is_the_plain_one(points):
    points = points.filter("k like 'k%'")  # the far ones are evenly spaced, and ties may go either way
    rows = points.orderBy("k").collect()
    x, k = np.array([(r["a"], r["b"]) for r in rows]), 5
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, at, 1)
    lrd = 1 / np.maximum(near, near[:, -1][at]).mean(axis=1)
    want = {r["k"]: v for r, v in zip(rows, lrd[at].mean(axis=1) / lrd, strict=True)}
    got = outliers.local_outlier_factor(points, COLS, "k", k).collect()
    assert all(math.isclose(r["lof"], want[r["k"]], rel_tol=1e-3) for r in got)


def test_k_choice(spark, points):
    near = points.filter("k like 'k%'").select("k", *COLS)
    table, labels = models.choose_k(near, COLS, "k", "a", (2, 4), (42,))
    assert [r["k"] for r in table.filter("selected").collect()] == [2] and models.k_consistency(table, labels) == "ok"
    given = spark.createDataFrame([(2, 0.5, 10.0, 0.5), (5, 0.4, 8.0, 0.8)], "k int, s double, ch double, db double")
    scored = {r["k"]: (r["selection_score"], r["selected"]) for r in models.selection_score(given, {"s": True, "ch": True, "db": False}, "k").collect()}
    assert scored == {2: (1.0, True), 5: (0.5, False)}
    assert models.k_consistency(table.withColumn("selected", F.lit(True)), labels) == "invalid_selected_count" and models.k_consistency(table, labels.limit(1)) == "mismatch"
    assert min(r["ari"] for r in models.kmeans_stability(near, COLS, 2, "k", "a", (1, 2)).collect()) > 0.9
    mix = outliers.mixtures(near, COLS, (2, 4))[0].collect()
    assert [r["k"] for r in mix if r["selected"]] == [2] and all(math.isfinite(r["bic"]) for r in mix)


def test_supervised_and_pu(points):
    near = points.filter("k like 'k%'")
    scores = learn.supervised(near, COLS, "y", "k", 2, ("logistic", "weighted_logistic", "tree", "svm"))
    for m in ("logistic", "weighted_logistic", "tree", "svm"):
        mine = scores.filter(F.col("model") == m)
        assert mine.count() == 300 and models.binary_metrics(mine, "score", "y").first()["roc_auc"] > 0.95, m
    pu = learn.pu_bagging(near.withColumn("y", F.when(F.crc32("k") % 2 == 0, F.col("y")).otherwise(0)), COLS, "y", "k", 2, ("logistic",)).join(near.select("k", F.col("y").alias("truth")), "k")
    assert pu.filter("truth = 1").agg(F.avg("score_mean")).first()[0] > 0.6 > 0.4 > pu.filter("truth = 0").agg(F.avg("score_mean")).first()[0]
    assert learn.pca_error(near, COLS, 2).agg(F.max("pca_error")).first()[0] < 1e-6 < learn.pca_error(near, COLS, 1).agg(F.avg("pca_error")).first()[0]


def test_expected_response_and_fit(spark):
    rows = [(i % 6, float(i % 10), 2.0 * (i % 10) + random.Random(i).gauss(0, 0.1)) for i in range(600)]
    df = spark.createDataFrame(rows, "run int, x double, t double")
    out = learn.expected_response(df, "t", ["x"], "run")
    m = learn.fit_metrics(out, "t").first()
    assert out.count() == 600 and m["mae"] < 1 and math.isclose(m["pinball"], m["mae"] / 2) and m["skill"] > 0.8


def test_persistence_null(spark):
    assert synthetic.durations_of(np.array([1, 1, 0, 1, 0, 0, 1], bool)).tolist() == [4, 1] and synthetic.durations_of(np.zeros(3, bool)).tolist() == []
    rows = [("run", i, 1.0 if 10 <= i < 20 else 0.1) for i in range(60)] + [("scattered", i, 1.0 if i % 6 == 0 else 0.1) for i in range(60)]
    null = synthetic.persistence_null(spark.createDataFrame(rows, "session_key string, minute_idx int, minute_mismatch_rank double"), {0.9: 0.95}, (1, 5), 60)
    got = {(r["session_key"], r["min_duration"]): r for r in null.collect()}
    assert got["run", 5]["episodes"] == 1 and got["run", 5]["longest"] == 10 and got["run", 1]["p"] == 1 / 61 and got["scattered", 1]["p"] > 0.5
    e = {r["min_duration"]: r for r in synthetic.enrichment(null).collect()}
    assert e[5]["session_rate"] == 0.5 and e[5]["episode_ratio"] > 1


def test_synthetic_summary(spark):
    t = "session_key string, start_idx int, end_idx int"
    injected = spark.createDataFrame([("s1", 1, 10)], t).withColumn("injection_type", F.lit("silent_run"))
    found, order = spark.createDataFrame([("s1", 3, 9)], t), spark.createDataFrame([("s1", 3)], "session_key string, review_order int")
    r = synthetic.sanity_summary(injected, found, order, ["session_key"], 5).first()
    assert (r["status"], r["n"], r["recovered_rate"], r["recall_at_k"]) == ("ok", 1, 1.0, 1.0) and math.isclose(r["iou_mean"], 0.7)
    assert tuple(synthetic.sanity_summary(injected, found.withColumn("session_key", F.lit("x")), order, ["session_key"]).first()) == ("not_run_stale_input", 0, None, None, None)
    assert synthetic.sanity_summary(injected, found, order, ["session_key"], enabled=False).first()["status"] == "not_run"


def test_sources(spark, tmp_path):
    for k in (7, 8):
        spark.createDataFrame([(k if k == 8 else None, 1)], "run_id int, v int").write.parquet(f"{tmp_path}/Run_{k}_Features.parquet")
    df = spark.read.parquet(f"{tmp_path}/Run_7_Features.parquet", f"{tmp_path}/Run_8_Features.parquet")
    got = telemetry.with_run_id(df.withColumn("_f", F.col("_metadata.file_path")), F.col("_f")).collect()
    assert sorted(r["run_id"] for r in got) == [7, 8]
    assert telemetry.read_csv(spark, f"{tmp_path}/none.csv", df.schema).count() == 0
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbfrun_id,v\n1,2\nbad,3\n")
    assert [tuple(r) for r in telemetry.read_csv(spark, f"{tmp_path}/x.csv", df.schema).collect()] == [(1, 2)]
    t0 = dt.datetime(2026, 1, 1)
    raw = spark.createDataFrame([(" 1.0", "2", str(t0), "5", "-3"), ("1", "2.0", str(t0), "5", "-3"), ("", "2", str(t0), "5", "1")], "run_id string, broad_no string, minute_ts string, viewer_count_last string, chat_count string")
    assert [(r["run_id"], r["broad_no"], r["minute_ts"], r["viewer_count_last"], r["chat_count"], r["session_key"]) for r in telemetry.normalise_minute(raw).collect()] == [(1, 2, t0, 5.0, None, "1_2")]


def test_mixture_scores(spark, points):
    """Densities and responsibilities equal numpy's, and the least dense row ranks first."""
    x = points.filter("k like 'k%'").select("k", *COLS)
    _, fitted = outliers.mixtures(x, COLS, (2,))
    m = fitted[2]
    got = {r["k"]: r for r in outliers.mixture_scores(x, COLS, "k", m).collect()}
    gauss = [(w, np.array(g.mean.toArray()), np.array(g.cov.toArray())) for w, g in zip(m.weights, m.gaussiansDF.collect(), strict=True)]
    for r in x.collect():
        v = np.array([r["a"], r["b"]])
        p = [w * np.exp(-0.5 * (v - mu) @ np.linalg.inv(c) @ (v - mu)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, mu, c in gauss]
        assert abs(got[r["k"]]["log_density"] - np.log(sum(p))) < 1e-6 and abs(got[r["k"]]["responsibility"] - max(p) / sum(p)) < 1e-6
        assert got[r["k"]]["component"] == int(np.argmax(p))
    ranks_ = sorted(got.values(), key=lambda r: r["low_density_rank"])
    assert ranks_[-1]["log_density"] == min(r["log_density"] for r in got.values()) and ranks_[-1]["low_density_rank"] == 1.0
