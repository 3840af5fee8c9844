"""Models that are fitted on all rows, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import learn, models, outliers

COLS = ["a", "b"]


def plain_svm(x: np.ndarray, steps: int) -> np.ndarray:
    """Scores of a one-class SVM of the same random features, by plain steps over all rows."""
    r = np.random.Generator(np.random.PCG64(42))
    gamma = 1 / (x.shape[1] * float(x.var()))
    w, b = r.normal(0, np.sqrt(2 * gamma), (x.shape[1], outliers.FEATURES)), r.uniform(0, 2 * np.pi, outliers.FEATURES)
    z = np.sqrt(2 / outliers.FEATURES) * np.cos(x @ w + b)
    v, few = z.mean(axis=0), max(1, int(outliers.NU * len(z)))
    for step in range(1, steps + 1):
        low = np.argpartition(z @ v, few - 1)[:few]
        v = v + (z[low].mean(axis=0) - v) * 2 / (step + 2)
    return np.quantile(z @ v, outliers.NU) - z @ v


@pytest.mark.parametrize("few", [4096, 1])
def test_svm_is_the_plain_one(spark, monkeypatch, few):
    """In one place and over files alike; rows that repeat weigh as often."""
    monkeypatch.setattr(outliers, "FEW_POINTS", few)
    r = np.random.default_rng(4)
    x = np.round(np.concatenate([r.normal(0, 1, (240, 2)), r.normal(4, 2, (60, 2))]), 1)
    x[-40:] = x[:40]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double")
    got = np.array([s["ocsvm"] for s in outliers.one_class_svm(df, COLS, "k").orderBy("k").collect()])
    assert np.abs(got - plain_svm(x, 3000)).max() < 0.02 * got.std()
    assert np.abs(np.quantile(got, 1 - outliers.NU)) < 1e-9  # rho is the quantile of all rows' scores


@pytest.fixture(scope="module")
def apart(spark):
    """6,000 rows; those that a sample of 4,096 by hash leaves out are a cloud of their own."""
    last = {s["k"] for s in spark.range(6000).select(F.col("id").alias("k")).orderBy(F.xxhash64("k"), "k").collect()[4096:]}
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (6000, 2)) + np.array([[8.0 if i in last else 0.0] for i in range(6000)])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double").persist(), last


def test_svm_is_fitted_on_all_rows(apart):
    """The cloud lies inside as well."""
    df, last = apart
    got = {s["k"]: s["ocsvm"] for s in outliers.one_class_svm(df, COLS, "k").collect()}
    assert len(got) == 6000 and np.mean([got[k] > 0 for k in last]) < 0.15
    assert np.mean([s > 0 for s in got.values()]) == pytest.approx(outliers.NU, abs=0.001)


def test_trees_draw_among_all_rows(apart):
    """The cloud has its share of every tree's rows, and its middle is no outlier."""
    df, last = apart
    trees = learn._drawn(df, COLS, "k")
    assert len(trees) == learn.TREES and all(len(np.unique(t, axis=0)) == learn.TREE_ROWS for t in trees)
    assert len(np.unique(np.concatenate(trees), axis=0)) > 5500
    assert np.mean([np.mean(t[:, 0] > 4) for t in trees]) == pytest.approx(len(last) / 6000, abs=0.02)
    assert all(0.15 < np.mean(t[:, 0] > 4) < 0.5 for t in trees)


def test_forest_is_grown_on_all_rows(apart):
    df, last = apart
    got = {s["k"]: s["iforest"] for s in learn.isolation_forest(df, COLS, "k").collect()}
    assert len(got) == 6000 and np.median([got[k] for k in last]) < 0.6


def plain_silhouette(x: np.ndarray, y: np.ndarray) -> float:
    d, out = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), []
    for i, own in enumerate(y):
        a, n = d[i][y == own].sum(), np.sum(y == own) - 1
        b = min(d[i][y == other].mean() for other in np.unique(y) if other != own)
        out.append((b - a / n) / max(a / n, b) if n else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_silhouette_by_blocks_is_the_plain_one(spark, monkeypatch, block):
    """Labels that fill several blocks, share one or have one row; rows that repeat."""
    monkeypatch.setattr(models, "SILHOUETTE_ROWS", 10)
    monkeypatch.setattr(models, "BLOCK_ROWS", block)
    r = np.random.default_rng(6)
    y = np.repeat(np.arange(8), [60, 40, 1, 3, 30, 5, 2, 20])
    x = np.round(r.normal(0, 1, (len(y), 2)) + y[:, None] % 5, 1)
    x[:20] = x[20:40]
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], "k long, c int, a double, b double")
    assert models.silhouette(df, "c", COLS, "k") == pytest.approx(plain_silhouette(x, y), abs=1e-8)
    assert models.silhouette(df.filter("c = 0"), "c", COLS, "k") is None


def test_silhouette_is_taken_over_all_rows(spark):
    """Of 2,400 rows, those that a sample of 2,000 by hash leaves out have each other's labels."""
    last = {s["k"] for s in spark.range(2400).select(F.col("id").alias("k")).orderBy(F.xxhash64("k"), "k").collect()[2000:]}
    r = np.random.default_rng(7)
    at = np.arange(2400) % 2
    x, y = r.normal(0, 1, (2400, 2)) + 8.0 * at[:, None], np.array([1 - c if i in last else c for i, c in enumerate(at)])
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], "k long, c int, a double, b double")
    assert models.silhouette(df, "c", COLS, "k") == pytest.approx(plain_silhouette(x, y), abs=1e-8)
