"""Calibration, parameter search and kept clusters."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import classify, clusters, learn, models


def pooled(pairs):
    """Pooled adjacent violators over (score, label), the plain way: [(lowest, highest, mean)]."""
    per = {}
    for s, y in pairs:
        per.setdefault(s, []).append(y)
    stack = []
    for s in sorted(per):
        stack.append([s, s, sum(per[s]), len(per[s])])
        while len(stack) > 1 and stack[-2][2] / stack[-2][3] >= stack[-1][2] / stack[-1][3]:
            _, high, t, n = stack.pop()
            stack[-1] = [stack[-1][0], high, stack[-1][2] + t, stack[-1][3] + n]
    return [(low, high, t / n) for low, high, t, n in stack]


def test_isotonic_by_brute_force(spark):
    r = random.Random(3)
    pairs = [(s, int(r.random() < s**2)) for s in (r.randrange(60) / 60 for _ in range(3000))]
    df = spark.createDataFrame(pairs, "s double, y int").repartition(5)
    blocks = pooled(pairs)
    x, y = [v for b in blocks for v in b[:2]], [b[2] for b in blocks for _ in range(2)]
    at = spark.createDataFrame([(v,) for v in [-1.0, 0.005, 0.3, 0.77, 5.0, *x]] + [(None,)], "q double")
    got = classify.isotonic(df, "s", "y")(at, "q", "p").collect()
    assert len(blocks) > 5 and all(abs(g["p"] - np.interp(g["q"], x, y)) < 1e-9 for g in got if g["q"] is not None)
    assert [g["p"] for g in got if g["q"] is None] == [None]
    assert classify.isotonic(df.limit(0), "s", "y") is None and classify.platt(df.limit(0), "s", "y") is None


def test_platt_minimises_its_loss(spark):
    r = random.Random(5)
    pairs = [(s, int(r.random() < 1 / (1 + np.exp(1 - 3 * s)))) for s in (r.gauss(0, 1) for _ in range(800))]
    df = spark.createDataFrame(pairs, "s double, y int")
    two = spark.createDataFrame([(0.0,), (1.0,)], "s double")
    p = [g["p"] for g in classify.platt(df, "s", "y")(two, "s", "p").orderBy("s").collect()]
    shift = np.log(p[0] / (1 - p[0]))
    slope = np.log(p[1] / (1 - p[1])) - shift
    s, y = np.array(pairs).T
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    gradient = 1 / (1 + np.exp(-(slope * s + shift))) - t
    assert abs((gradient * s).mean()) < 1e-4 and abs(gradient.mean()) < 1e-4
    apart = spark.createDataFrame([(-1.0, 0), (1.0, 1)], "s double, y int")  # separable: still finite
    assert all(0 < g["p"] < 1 for g in classify.platt(apart, "s", "y")(apart, "s", "p").collect())


@pytest.mark.parametrize("fit", [classify.isotonic, classify.platt])
def test_maps_mend_a_distorted_score(spark, fit):
    r = random.Random(8)
    data = [(p**4, int(r.random() < p), i % 2) for i, p in enumerate(r.random() for _ in range(6000))]
    df = spark.createDataFrame(data, "raw double, y int, held int").repartition(4).persist()
    out = fit(df.filter("held = 0"), "raw", "y")(df.filter("held = 1"), "raw", "score").withColumn("g", F.lit(0))
    before, after = (classify.group_metrics(out, ["g"], c, "y").first() for c in ("raw", "score"))
    assert after["brier"] < before["brier"] - 0.03 and abs(after["roc_auc"] - before["roc_auc"]) < 0.01


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(11)
    data = [(i, int(i % 4 == 0), r.gauss(1.5 if i % 4 == 0 else 0, 1), r.gauss(0, 1)) for i in range(240)]
    return spark.createDataFrame(data, "id long, y int, a double, b double").repartition(3).persist()


def test_search_and_metrics(spark, rows):
    table = classify.grid_search(rows, ["a", "b"], "y", "id", {"logistic": {"regParam": [0.01, 10.0]}, "tree": {"maxDepth": [1]}}, folds=3, repeats=2)
    got = table.collect()
    assert len(got) == 3 * 3 * 2 and all(r["n"] == 80 and r["positives"] == 20 for r in got)
    summary = classify.search_summary(table).collect()
    assert all(r["folds"] == 6 for r in summary) and sum(r["selected"] for r in summary) == 2
    best = next(r for r in summary if r["model"] == "logistic" and r["selected"])
    assert best["average_precision_mean"] == max(r["average_precision_mean"] for r in summary if r["model"] == "logistic") and "regParam" in json.loads(best["params"])
    scored = learn.out_of_fold(learn.stratified_fold(learn.features(rows, ["a", "b"]), "y", "id", 3), learn.families("y", 2)["tree"], 3, "score").select("fold", "y", "score").persist()
    for r in classify.group_metrics(scored, ["fold"], "score", "y").collect():
        want = models.binary_metrics(scored.filter(F.col("fold") == r["fold"]), "score", "y").first()
        assert (r["n"], r["positives"], r["average_precision"], r["roc_auc"]) == tuple(want)[:4]


def test_calibrated_scores(spark, rows):
    out = classify.calibrated_scores(rows, ["a", "b"], "y", "id", folds=3).persist()
    got = out.collect()
    assert len({r["id"] for r in got}) == len(got) == 240 and all(0 <= r["score"] <= 1 for r in got)
    for k in range(3):
        part = sorted((r["raw"], r["score"]) for r in got if r["fold"] == k)
        assert all(a[1] <= b[1] + 1e-12 for a, b in zip(part, part[1:]))
    assert classify.group_metrics(out.withColumn("g", F.lit(0)), ["g"], "score", "y").first()["roc_auc"] > 0.75
    assert sum(r["n"] for r in classify.reliability(out, "score", "y").collect()) == 240


def test_kept_clusters(spark, tmp_path):
    r = random.Random(2)
    data = [(i, r.gauss(10 * (i % 3), 0.5), None if i == 5 else r.gauss(10 * (i * 2 % 3), 0.5), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, a double, b double, o double")
    table, fitted = clusters.fit(df, ["a", "b"], "id", "o", ks=(2, 3, 4), seeds=(1, 2))
    assert [t["k"] for t in table.filter("selected").collect()] == [3] == [len(fitted.centres)]
    assert all(c["id"] % 3 == c["cluster"] for c in fitted.apply(df).collect() if c["id"] != 5)
    root = f"file://{tmp_path}/kept"
    assert fitted.save(spark, root) == 0 and clusters.Clusters(["a"], [0.0], [1.0], [[5.0]]).save(spark, root) == 1
    again = clusters.load(spark, root, 0)
    assert again == fitted and len(clusters.load(spark, root).centres) == 1
    new = spark.createDataFrame([(1, 9.8, None), (2, float("inf"), 0.0), (3, -50.0, 0.0)], "id long, a double, b double")
    plain = [int(np.argmin([sum((x - c) ** 2 for x, c in zip([((v if v is not None and np.isfinite(v) else m) - m) / s for v, m, s in zip(row[1:], again.medians, again.scales)], centre)) for centre in again.centres])) for row in new.collect()]
    assert [c["cluster"] for c in again.apply(new).collect()] == plain
    with pytest.raises(ValueError):
        clusters.load(spark, root, 7)
    with pytest.raises(ValueError):
        clusters.load(spark, f"{root}-none")


def test_consensus_and_hidden_scores_by_hand(spark):
    from tidewatch.operators import review

    r = random.Random(4)
    names = ["rule", "d1", "d2", "low", "amb"]
    data = [(i, *[None if c == "d2" and i == 7 else float(r.randrange(30)) for c in names], i % 9 == 0, i % 5 == 0 if i else None, r.random(), r.random(), r.random()) for i in range(100)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} double" for c in names) + ", noise boolean, flagged boolean, zero_rate double, gap_med double, chat_mean double")

    def pct(j):
        v = [row[j] for row in data if row[j] is not None]
        return {row[0]: None if row[j] is None else (sum(x < row[j] for x in v) + (sum(x == row[j] for x in v) + 1) / 2) / len(v) for row in data}

    p = {c: pct(1 + j) for j, c in enumerate(names)}
    mean = lambda i, cols: np.mean([p[c][i] for c in cols if p[c][i] is not None])
    got = {x["id"]: x for x in review.model_consensus(df, ["rule", "d1", "d2"]).collect()}
    want = np.array([mean(i, ["rule", "d1", "d2"]) for i in range(100)])
    assert all(abs(got[i]["consensus"] - want[i]) < 1e-8 for i in range(100))
    assert sum(x["review_group"] == "high_review" for x in got.values()) == 5 and sum(x["review_group"] == "medium_review" for x in got.values()) == 5
    out = {x["id"]: x for x in review.fitted_candidates(df, "rule", ["d1", "d2"], ["low", "amb"], "noise", "flagged").collect()}
    hidden = np.array([0.35 * p["rule"][i] + 0.35 * mean(i, ["d1", "d2"]) + 0.2 * mean(i, ["low", "amb"]) + 0.1 * (i % 9 == 0) for i in range(100)])
    cut, zero = np.quantile(hidden, 0.9), np.quantile([row[8] for row in data], 0.9)
    for i, x in out.items():
        assert abs(x["hidden"] - hidden[i]) < 1e-8
        on = i % 5 == 0 and i > 0
        assert x["discovery_group"] == {(True, True): "confirmed_suspicious", (False, True): "hidden_candidate", (True, False): "kmeans_only_candidate", (False, False): "normal_low_priority"}[on, hidden[i] >= cut]
        assert ("very_high_zero_rate" in x["codes"]) == (data[i][8] >= zero) and ("hdbscan_noise" in x["codes"]) == (i % 9 == 0) and x["codes"]
