"""Models over session rows: isolation forest, boosted baseline by group folds, supervised and PU scores, PCA error."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written
from .models import binary_metrics
from .ranks import group_pct_ranks, places, quantile_row

#: An isolation forest's trees and the rows that each draws among all rows. Up to FOREST_ROWS rows meet in one place; of
#: more, only what the trees draw.
FOREST_ROWS, TREES, TREE_ROWS = 4096, 100, 256


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def fold(df: DataFrame, key: str, folds: int, name: str = "fold") -> DataFrame:
    """Folds by hash of a key: rows of a key stay together, and reruns agree."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key), F.lit(42)), F.lit(folds)).cast("int"))


def scored_by(fitted: DataFrame, columns: list[str], score: str) -> DataFrame:
    """A fitted estimator's output as one score: the probability, else the margin squashed, else the prediction."""
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1)) if "rawPrediction" in fitted.columns else None
    value = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in fitted.columns else F.col("prediction") if margin is None else 1 / (1 + F.exp(-margin))
    return fitted.select(*columns, value.alias(score))


def out_of_fold(df: DataFrame, estimator: Estimator, folds: int, score: str) -> DataFrame:
    """Each row scored by a model that saw only other folds. df: features, fold, and the estimator's label."""
    out = None
    for k in range(folds):
        fitted = estimator.fit(df.filter(F.col("fold") != k)).transform(df.filter(F.col("fold") == k))
        part = scored_by(fitted, df.columns, score)
        out = part if out is None else out.unionByName(part)
    return out


def expected_response(df: DataFrame, target: str, columns: list[str], group: str, folds: int = 3) -> DataFrame:
    """Conditional median of target by boosted trees with absolute loss, out of fold by group; deficit = expected - actual."""
    x = group_fold(features(df, columns), group, folds)
    gbt = GBTRegressor(labelCol=target, lossType="absolute", maxIter=10, maxDepth=4, seed=42, predictionCol="prediction")
    out = out_of_fold(x, gbt, folds, "expected").drop("features")
    return out.withColumn("deficit", F.col("expected") - F.col(target))


def fit_metrics(df: DataFrame, target: str) -> DataFrame:
    """MAE, pinball loss at the median, MAE of the global median, and the skill over it."""
    mid = quantile_row(df, [target], (0.5,))[target][0]
    e = df.agg(F.avg(F.abs(F.col("expected") - F.col(target))).alias("mae"), F.avg(F.abs(F.lit(mid) - F.col(target))).alias("base_mae"))
    return e.select("mae", (F.col("mae") / 2).alias("pinball"), "base_mae", F.when(F.col("base_mae") > 0, 1 - F.col("mae") / F.col("base_mae")).alias("skill"))


def stratified_fold(df: DataFrame, label: str, key: str, folds: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds of nearly equal size in every class, dealt by the rank of a hash inside the class; another seed, another
    repetition."""
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)).cast("double"))
    out = group_pct_ranks(h, [label], "_h", "_r")
    return out.withColumn(name, F.least(F.floor((F.col("_r") - 1e-9) * folds), F.lit(folds - 1)).cast("int")).drop("_h", "_r")


def group_fold(df: DataFrame, key: str, folds: int, name: str = "fold") -> DataFrame:
    """Folds of whole groups, the largest first into the emptiest fold. The groups (runs) are few and meet on the driver."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).collect()
    load, of = [0] * folds, {}
    for r in sizes:
        k = load.index(min(load))
        of[r[key]], load[k] = k, load[k] + r["n"]
    table = df.sparkSession.createDataFrame(list(of.items()), f"_k {df.schema[key].dataType.simpleString()}, {name} int") if of else df.sparkSession.createDataFrame([], f"_k {df.schema[key].dataType.simpleString()}, {name} int")
    return df.join(F.broadcast(table), F.col(key) == F.col("_k"), "left").drop("_k")


def families(label: str, width: int, weight: str | None = None) -> dict[str, Estimator]:
    """Model families by name; weighted_logistic needs a column of weights."""
    out = {
        "logistic": LogisticRegression(labelCol=label, regParam=0.01), "tree": DecisionTreeClassifier(labelCol=label, maxDepth=4, seed=42), "bayes": NaiveBayes(labelCol=label, modelType="gaussian"), "forest": RandomForestClassifier(labelCol=label, numTrees=20, seed=42),
        "boosted": GBTClassifier(labelCol=label, maxIter=10, seed=42), "svm": LinearSVC(labelCol=label, maxIter=20), "perceptron": MultilayerPerceptronClassifier(labelCol=label, layers=[width, 8, 2], seed=42, maxIter=50),
    }
    return out | ({"weighted_logistic": LogisticRegression(labelCol=label, regParam=0.01, weightCol=weight)} if weight else {})


def supervised(df: DataFrame, columns: list[str], label: str, key: str, folds: int = 3, models: tuple[str, ...] | None = None) -> DataFrame:
    """Out-of-fold scores of the model families in stratified folds, long: key, label, model, score. The weighted
    logistic model gives both classes the same weight in all; the linear SVM's score is its margin, squashed."""
    pos, n = df.agg(F.count_if(F.col(label) == 1), F.count(F.lit(1))).first()
    x = features(written(stratified_fold(df, label, key, folds), "folds"), columns)  # every fit reads it
    x = x.withColumn("_w", F.when(F.col(label) == 1, n / max(1, 2 * pos)).otherwise(n / max(1, 2 * (n - pos))))
    out = None
    for name, m in families(label, len(columns), "_w").items():
        if models is None or name in models:
            part = out_of_fold(x, m, folds, "score").select(key, label, F.lit(name).alias("model"), "score")
            out = part if out is None else out.unionByName(part)
    return out


def pu_bagging(df: DataFrame, columns: list[str], label: str, key: str, rounds: int = 30, models: tuple[str, ...] = ("logistic", "tree", "forest")) -> DataFrame:
    """Positive-unlabelled bagging: each round learns positives against a hash sample of as many unlabelled rows with
    several models and scores the rest. Mean, spread and stability over rounds and models."""
    x = features(df, columns)
    pos, n = (x.agg(F.count_if(F.col(label) == 1), F.count(F.lit(1))).first())
    share = int(1_000_000 * min(1.0, pos / max(1, n - pos)))
    out, every = None, families(label, len(columns))
    for r in range(rounds):
        drawn = (F.col(label) == 0) & (F.pmod(F.xxhash64(F.col(key), F.lit(r)), F.lit(1_000_000)) < share)
        for name in models:
            m = every[name].fit(x.filter((F.col(label) == 1) | drawn))
            part = m.transform(x.filter(~drawn)).select(key, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
            out = part if out is None else out.unionByName(part)
    return pu_summary(out, key)


def pu_summary(scores: DataFrame, key: str) -> DataFrame:
    """Of a row's scores: mean, sample deviation, extremes, and the share of at least a half."""
    return scores.groupBy(key).agg(F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg((F.col("score") >= 0.5).cast("double")).alias("stability"))


def permuted(df: DataFrame, columns: list[str], key: str, seed: int = 0) -> DataFrame:
    """df with some columns' values dealt anew among its rows, all of them together: the row at a place by key takes
    the values of the row at that place by a hash of the key."""
    a = places(df.drop(*columns), [F.asc(key)], "_place")
    b = places(df.select(key, *columns), [F.xxhash64(F.col(key), F.lit(seed)).asc(), F.asc(key)], "_place").drop(key)
    return a.join(b, "_place").drop("_place").select(df.columns)


def permutation_importance(df: DataFrame, columns: list[str], label: str, key: str, model: str = "logistic", folds: int = 3, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(feature, drop_mean, drop_std): how much average precision out of fold falls when a feature, or a group of them,
    is permuted in the rows that are scored; deviation over folds."""
    x = written(stratified_fold(df, label, key, folds), "folds")  # every fit and permutation reads it
    rows: dict[str, list[float]] = {}
    for k in range(folds):
        test = x.filter(F.col("fold") == k).drop("fold")
        fitted = families(label, len(columns))[model].fit(features(x.filter(F.col("fold") != k), columns))

        def quality(rows_: DataFrame, fitted=fitted) -> float:
            s = fitted.transform(features(rows_, columns)).select(label, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
            return binary_metrics(written(s, "permuted-scores"), "score", label).first()["average_precision"] or 0.0

        base = quality(test)
        for name, cols in (groups or {c: [c] for c in columns}).items():
            rows.setdefault(name, []).append(base - quality(permuted(test, cols, key, k)))
    return df.sparkSession.createDataFrame([(n, float(np.mean(v)), float(np.std(v))) for n, v in rows.items()], "feature string, drop_mean double, drop_std double")


def pca_error(df: DataFrame, columns: list[str], k: int, name: str = "pca_error", fit_on: DataFrame | None = None) -> DataFrame:
    """Squared distance from the plane of the first k components of fit_on (df, if none is given); columns are centred
    by its means first."""
    base = df if fit_on is None else fit_on
    mean = base.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns])
    centred = lambda t: VectorAssembler(inputCols=[f"_c_{y}" for y in columns], outputCol="_v").transform(t.join(F.broadcast(mean)).select(*t.columns, *[(F.col(x) - F.col(f"_a_{x}")).alias(f"_c_{x}") for x in columns]))
    m, x = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred(base)), centred(df)
    total = sum((F.col(f"_c_{y}") * F.col(f"_c_{y}") for y in columns), F.lit(0.0))
    kept = F.aggregate(vector_to_array("_p"), F.lit(0.0), lambda a, z: a + z * z)
    return m.transform(x).select(*df.columns, F.greatest(total - kept, F.lit(0.0)).alias(name))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    if depth == 0 or len(x) <= 1 or not spread.any():
        return (len(x),)
    f = int(rng.choice(np.flatnonzero(spread)))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1)


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _length(tree: tuple, x: np.ndarray, rows: np.ndarray, out: np.ndarray, depth: int = 0) -> None:
    if len(tree) == 1:
        out[rows] += depth + _path(tree[0])
        return
    left = x[rows, tree[0]] < tree[1]
    _length(tree[2], x, rows[left], out, depth + 1)
    _length(tree[3], x, rows[~left], out, depth + 1)


def _score(frames: Iterator[pd.DataFrame], trees: list, columns: list[str], size: int, name: str) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        x, out = pdf[columns].to_numpy(float), np.zeros(len(pdf))
        for t in trees:
            _length(t, x, np.arange(len(x)), out)
        yield pdf.assign(**{name: 2.0 ** (-out / len(trees) / max(_path(size), 1e-9))})


def _drawn(df: DataFrame, columns: list[str], key: str) -> list[np.ndarray]:
    """For each tree, TREE_ROWS of all rows: those with the smallest hashes of the key with the tree's number."""
    share = 2 * TREE_ROWS / df.count()  # as many again come along, so that none is missing
    tree = F.array(*[F.struct(F.lit(t).alias("_t"), F.xxhash64(F.col(key), F.lit(t)).alias("_h")) for t in range(TREES)])
    drawn = F.explode(F.filter(tree, lambda s: s["_h"] < F.lit(int((share - 0.5) * 2**64))))
    rows = df.select(drawn.alias("_s"), *columns).select("_s.*", *columns).toPandas().sort_values(["_t", "_h"])
    return [g[columns].to_numpy(float)[:TREE_ROWS] for _, g in rows.groupby("_t")]


def isolation_forest(df: DataFrame, columns: list[str], key: str, name: str = "iforest", fit_on: DataFrame | None = None) -> DataFrame:
    """Isolation-forest score of every row; each tree grows on TREE_ROWS rows that it draws among all rows of fit_on (df,
    if none is given)."""
    base = df if fit_on is None else fit_on
    few = base.orderBy(F.xxhash64(F.col(key)), key).limit(FOREST_ROWS + 1).select(columns).toPandas().to_numpy(float)
    rng = np.random.Generator(np.random.PCG64(42))
    size = min(TREE_ROWS, len(few))
    drawn = _drawn(base, columns, key) if len(few) > FOREST_ROWS else (few[rng.choice(len(few), size, replace=False)] for _ in range(TREES if size else 0))
    trees = [_grow(x, rng, int(np.ceil(np.log2(max(2, size))))) for x in drawn]
    if not trees:
        return df.withColumn(name, F.lit(None).cast("double"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {name} double"
    return df.mapInPandas(partial(_score, trees=trees, columns=columns, size=size, name=name), schema)
