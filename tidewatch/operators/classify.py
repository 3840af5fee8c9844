"""Calibrated classifiers, and the search over their parameters in repeated stratified folds."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written
from .learn import families, features, out_of_fold, scored_by, stratified_fold
from .ranks import value_bounds, value_range

#: Parameters that are searched, by model family.
GRID = {
    "logistic": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "forest": {"numTrees": [50, 100], "maxDepth": [3, 6]},
    "boosted": {"maxIter": [10, 20], "maxDepth": [2, 3]},
}
METRICS = ("average_precision", "roc_auc", "brier")

Map = Callable[[DataFrame, str, str], DataFrame]


def isotonic(df: DataFrame, score: str, label: str) -> Map | None:
    """The non-decreasing map from a score to the share of positives with least squared error: pooled adjacent
    violators, linear between the pools' ends, constant beyond them. One row per distinct score is fitted, weighted by
    its count. None without rows."""
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(F.avg(label).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    if per.isEmpty():
        return None
    fitted = IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w", predictionCol="_p").fit(per)
    return lambda rows, column, name: fitted.transform(rows.withColumn("_s", F.col(column).cast("double"))).withColumn(name, F.when(F.col(column).isNotNull(), F.col("_p"))).drop("_s", "_p")


def platt(df: DataFrame, score: str, label: str) -> Map | None:
    """The logistic map of a score. Targets are (positives + 1) / (positives + 2) and 1 / (negatives + 2) in place of 1
    and 0, so that separable scores get a finite slope; each row is two weighted ones. None without rows."""
    rows = df.filter(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).alias("y"))
    pos, n = rows.agg(F.count_if(F.col("y") == 1), F.count(F.lit(1))).first()
    if not n:
        return None
    t = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (n - pos + 2))
    both = rows.groupBy("s", "y").agg(F.count(F.lit(1)).alias("c")).select("s", F.explode(F.array(F.struct(F.lit(1.0).alias("t"), (t * F.col("c")).alias("w")), F.struct(F.lit(0.0).alias("t"), ((1 - t) * F.col("c")).alias("w")))).alias("x")).select("s", "x.*")
    x = VectorAssembler(inputCols=["s"], outputCol="features").transform(both)
    fitted = LogisticRegression(labelCol="t", weightCol="w", maxIter=200, tol=1e-10).fit(x)
    slope, shift = float(fitted.coefficients[0]), float(fitted.intercept)
    return lambda rows, column, name: rows.withColumn(name, 1 / (1 + F.exp(-(F.col(column).cast("double") * slope + shift))))


def calibrated(train: DataFrame, test: DataFrame, estimator: Estimator, label: str, key: str, folds: int = 3, fit: Callable = isotonic) -> DataFrame:
    """test with raw (the score of the estimator fitted on all of train) and score: raw through a map that is fitted on
    train's own out-of-fold scores. Both tables have features."""
    inner = stratified_fold(train.drop("fold"), label, key, folds, seed=1)
    held = written(out_of_fold(inner, estimator, folds, "raw").select(label, "raw"), "held-out")
    mapping = fit(held, "raw", label)
    scored = scored_by(estimator.fit(train).transform(test), test.columns, "raw")
    return scored.withColumn("score", F.lit(None).cast("double")) if mapping is None else mapping(scored, "raw", "score")


def calibrated_scores(df: DataFrame, columns: list[str], label: str, key: str, models: tuple[str, ...] = ("svm",), folds: int = 5, inner: int = 3, fit: Callable = isotonic) -> DataFrame:
    """Out-of-fold scores, calibrated inside each fold's training rows: key, label, model, fold, raw, score."""
    x = written(stratified_fold(features(df, columns), label, key, folds), "folds")
    out = None
    for name, k in itertools.product(models, range(folds)):
        part = calibrated(x.filter(F.col("fold") != k), x.filter(F.col("fold") == k), families(label, len(columns))[name], label, key, inner, fit)
        part = part.select(key, label, F.lit(name).alias("model"), "fold", "raw", "score")
        out = part if out is None else out.unionByName(part)
    return out


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, score_mean, positive_rate): how often a score of each equal-width bin comes true."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score_mean"), F.avg(label).alias("positive_rate"))


def group_metrics(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Per group: n, positives, average precision (step), ROC AUC (ties averaged) and the Brier score. Ties share a
    step. All groups are taken in one pass over ranges of scores, so that no group's rows meet in one task; a group
    without positives or without negatives has no AUC, one without positives no average precision."""
    s = (-F.col(score).cast("double")).alias("_s")
    hist = df.filter(F.col(score).isNotNull()).groupBy(*groups, s).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("c"), F.sum((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("e"))
    hist = hist.withColumn("_range", value_range(F.col("_s"), value_bounds(hist, ["_s"])["_s"]))
    every = Window.partitionBy(*groups)  # a few rows per group: one per range
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = hist.groupBy(*groups, "_range").agg(F.sum("p").alias("_p"), F.sum("c").alias("_c"), F.sum("e").alias("_e"))
    sums = sums.select(*groups, "_range", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("c0"), F.sum("_p").over(every).alias("pos"), F.sum("_c").over(every).alias("n"), F.sum("_e").over(every).alias("err"))
    run = Window.partitionBy(*groups, "_range").orderBy("_s")
    x = hist.join(sums, [*groups, "_range"]).withColumns({"tp": F.sum("p").over(run) + F.col("p0"), "seen": F.sum("c").over(run) + F.col("c0")})
    neg = F.col("n") - F.col("pos")
    below = neg - (F.col("seen") - F.col("tp")) + (F.col("c") - F.col("p")) / 2
    return x.groupBy(*groups).agg(
        F.max("n").alias("n"), F.max("pos").alias("positives"), F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.max("pos")), 6).alias("average_precision"),
        F.round(F.try_divide(F.sum(F.col("p") * below), F.max(F.col("pos") * neg)), 6).alias("roc_auc"), F.round(F.max("err") / F.max("n"), 6).alias("brier"),
    )


def grid_search(df: DataFrame, columns: list[str], label: str, key: str, grid: dict[str, dict[str, list]] | None = None, folds: int = 5, repeats: int = 3) -> DataFrame:
    """One row per model, parameters, repetition and fold: metrics of the rows that were held out. A repetition deals
    its folds by another hash; every fold keeps both classes' shares."""
    out = None
    for r in range(repeats):
        x = written(stratified_fold(features(df, columns), label, key, folds, seed=r), "folds")
        for name, choices in (grid or GRID).items():
            estimator = families(label, len(columns))[name]
            for values in itertools.product(*choices.values()):
                params = dict(zip(choices, values, strict=True))
                fitted = out_of_fold(x, estimator.copy({estimator.getParam(p): v for p, v in params.items()}), folds, "score")
                part = fitted.select(F.lit(name).alias("model"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), F.lit(r).alias("repetition"), "fold", F.col(label).alias("_y"), "score")
                out = part if out is None else out.unionByName(part)
    return group_metrics(written(out, "grid-scores"), ["model", "params", "repetition", "fold"], "score", "_y")


def search_summary(table: DataFrame, metric: str = "average_precision") -> DataFrame:
    """Of a grid's table, per model and parameters: folds, mean and deviation of each metric over all folds and
    repetitions, and selected, the best mean of metric in its model (ties to the first parameters as text)."""
    out = table.groupBy("model", "params").agg(F.count(F.lit(1)).alias("folds"), *[f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    best = Window.partitionBy("model").orderBy(F.desc_nulls_last(f"{metric}_mean"), "params")  # a row per choice of parameters
    return out.withColumn("selected", F.row_number().over(best) == 1)
