"""Outlier detectors and mixtures over rows of features: local outlier factor, one-class SVM, Gaussian mixtures.

The outlier factor is taken among all rows (``neighbours``). The SVM is fitted on all rows, a few sums per task at a time;
every row is scored, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written
from .learn import isolation_forest
from .models import median_impute, robust_scale
from .neighbours import local_outlier_factor
from .ranks import pct_ranks, quantile_row

#: Random features of the one-class SVM, its share of outliers and its steps at most.
FEATURES, NU, STEPS = 1500, 0.05, 300
#: The SVM's steps end when its duality gap is at most this share of the squared norm.
GAP = 1e-5
#: Bins that the scores around the SVM's threshold are counted in, and rows that are lifted at a time.
BINS, LIFTED = 4096, 128
#: Up to so many different rows are lifted once, in one place; more lie in files of about FILE_ROWS, in FILES at most, as
#: a partial sum of each meets on the driver.
FEW_POINTS, FILE_ROWS, FILES = 4096, 2048, 512


def scored_by(df: DataFrame, columns: list[str], key: str, name: str, score: Callable[[np.ndarray, list], np.ndarray]) -> DataFrame:
    """df with a score of each row's features and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns]).T.reshape(b.num_rows, len(columns))
            out = score(x, b.column(b.schema.get_field_index(key)).to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {name} double")


def _sums(points: DataFrame, columns: list[str], lift: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """A function that sums over all points an array that each gives for some of their lifted rows and counts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            x = np.array([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns) + 1)])
            for i in range(0, b.num_rows, LIFTED):
                yield lift(x[:-1, i : i + LIFTED].T), x[-1, i : i + LIFTED]

    def sums(each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for z, n in parts(batches):
                total = each(z, n) if total is None else total + each(z, n)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], ["part"])

        return sum(np.frombuffer(r["part"]) for r in points.mapInArrow(run, "part binary").collect())

    points = points.select(*columns, "_n")
    if len(points.limit(FEW_POINTS + 1).collect()) > FEW_POINTS:
        return sums
    whole = [np.concatenate(part) for part in zip(*parts(points.toArrow().to_batches()), strict=True)]
    return lambda each: each(*whole)


def _nearest(atoms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minor cycles of Wolfe's algorithm: those atoms, with their weights, whose mean is the hull's nearest point to the
    origin. All but the last atom have positive weights."""
    while True:
        n = len(weights)
        lines = np.block([[atoms @ atoms.T, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        best = np.linalg.lstsq(lines, np.append(np.zeros(n), 1.0), rcond=1e-13)[0][:n]
        out = best <= 1e-12
        if not out.any():
            return atoms, best / best.sum()
        step = weights[out] / np.maximum(weights[out] - best[out], 1e-300)
        weights = weights + step.min() * (best - weights)
        weights[np.flatnonzero(out)[step.argmin()]] = 0.0
        keep = weights > 1e-12
        atoms, weights = atoms[keep], weights[keep] / weights[keep].sum()


def one_class_svm(df: DataFrame, columns: list[str], key: str, name: str = "ocsvm", fit_on: DataFrame | None = None) -> DataFrame:
    """How far a row lies outside the one-class SVM of an RBF kernel, which random cosine features stand for. All rows of
    fit_on (df, if none is given) give the kernel's width, the support and the threshold.

    The SVM is the point nearest to the origin of all means of NU of the lifted rows (Wolfe's algorithm). A step counts
    scores around the threshold and sums the rows that score least; what lies in the threshold's own bin, which narrows
    as the steps do, shares the weight that is left."""
    base = df if fit_on is None else fit_on
    rows = base.count()
    if not rows:
        return df.withColumn(name, F.lit(None).cast("double"))
    points = base.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).repartition(min(FILES, ceil(rows / FILE_ROWS)), *columns)
    points = written(points.sortWithinPartitions(*columns), "svm-points")  # equal rows are one point; every step reads it
    plain = _sums(points, columns, lambda x: x)
    mean = plain(lambda x, n: np.array([(n @ x).sum()]))[0] / (rows * len(columns))
    var = plain(lambda x, n: np.array([(n @ (x - mean) ** 2).sum()]))[0] / (rows * len(columns))
    r = np.random.Generator(np.random.PCG64(42))
    gamma = 1 / (len(columns) * max(float(var), 1e-9))
    w, b = r.normal(0, np.sqrt(2 * gamma), (len(columns), FEATURES)) / (2 * np.pi), r.uniform(0, 1, FEATURES)

    def lift(x: np.ndarray) -> np.ndarray:
        turns = x @ w + b
        turns -= np.rint(turns)  # a part of a turn is safe in single precision, whose cosine is six times as fast
        return np.sqrt(2 / FEATURES) * np.cos((2 * np.pi * turns).astype(np.float32)).astype(float)

    sums, few = _sums(points, columns, lift), max(1, int(NU * rows))
    v = sums(lambda z, n: n @ z) / rows
    atoms, weights = v[None], np.ones(1)
    far = lambda v: float(np.sqrt(2 * (v @ v))) + 1e-9  # a lifted row's norm is at most the root of 2
    low, high = -far(v), far(v)  # the score of the row at few lies between
    for _ in range(STEPS):
        bins = lambda z, v=v, low=low, high=high: np.clip(np.floor((z @ v - low) / (high - low) * BINS), -1, BINS).astype(int) + 1
        upto = sums(lambda z, n, bins=bins: np.bincount(bins(z), n, BINS + 2)).cumsum()
        at = int(np.searchsorted(upto, few))
        below = upto[at - 1] if at else 0.0
        share = (few - below) / (upto[at] - below)
        weigh = lambda k, at=at, share=share: (k < at) + share * (k == at)
        atom, was = sums(lambda z, n, bins=bins, weigh=weigh: (n * weigh(bins(z))) @ z) / few, v
        if v @ v - v @ atom <= GAP * (v @ v):
            break
        atoms, weights = _nearest(np.vstack([atoms, atom]), np.append(weights, 0.0))
        v = weights @ atoms
        if not v @ v < was @ was:
            break
        edge, width = low + (at - 1) * (high - low) / BINS, (high - low) / BINS
        low, high = (edge if at else -far(was)) - far(v - was), (edge + width if at <= BINS else far(was)) + far(v - was)  # no score moves further
    score = lambda x: np.concatenate([lift(x[i : i + LIFTED]) @ v for i in range(0, len(x), LIFTED)])
    scores = written(scored_by(base.select(key, *columns), columns, key, "_s", lambda x, _: score(x)).select("_s"), "svm-scores")
    rho = quantile_row(scores, ["_s"], (NU,))["_s"][0]
    return scored_by(df, columns, key, name, lambda x, _: rho - score(x))


def minute_detectors(minutes: DataFrame, columns: list[str]) -> DataFrame:
    """Per minute row: each detector's percentile rank times the mean percentile rank of the deficits."""
    rows = minutes.withColumn("_key", F.concat_ws("|", "session_key", "minute_idx")).select("_key", "session_key", F.col("minute_idx").cast("long").alias("minute_idx"), *columns)
    x = written(robust_scale(median_impute(rows, columns), columns), "detectors-scaled")
    x = written(local_outlier_factor(isolation_forest(x, columns, "_key", "forest"), columns, "_key", 35), "detectors-near")
    x = written(one_class_svm(x, columns, "_key"), "detectors-scored")
    x = pct_ranks(x, {f"_d_{c}": c for c in columns} | {f"_r_{n}": n for n in ("forest", "lof", "ocsvm")}, 9)
    weight = sum((F.col(f"_d_{c}") for c in columns[1:]), F.col(f"_d_{columns[0]}")) / len(columns)
    return x.select("session_key", "minute_idx", *[F.round(F.col(f"_r_{n}") * weight, 6).alias(f"{n}_score") for n in ("forest", "lof", "ocsvm")])


def mixtures(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 42) -> tuple[DataFrame, dict]:
    """Gaussian mixtures of several sizes: (k, log_likelihood, bic, aic, selected by BIC), and the models by k."""
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    n, p, rows, fitted = df.count(), len(columns), [], {}
    for k in ks:
        m = fitted[k] = GaussianMixture(k=k, seed=seed, maxIter=50).fit(x)
        free, ll = k * (p + p * (p + 1) / 2) + k - 1, float(m.summary.logLikelihood)
        rows.append((k, ll, float(-2 * ll + free * np.log(n)), float(-2 * ll + 2 * free)))
    best = min(rows, key=lambda r: (r[2], r[0]))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, log_likelihood double, bic double, aic double, selected boolean"), fitted


def mixture_scores(df: DataFrame, columns: list[str], key: str, model) -> DataFrame:
    """Of a fitted mixture, for every row: component (the likeliest), responsibility (its probability), log_density, and
    low_density_rank: the percentile rank of the density turned round, 1 for the least dense row."""
    parts = [(float(w), np.array(g.mean.toArray()), np.array(g.cov.toArray())) for w, g in zip(model.weights, model.gaussiansDF.collect(), strict=True)]  # a row per component
    whiten = []
    for w, mean, cov in parts:
        values, vectors = np.linalg.eigh(cov)
        some = values > 1e-9 * max(float(values.max()), 1e-300)  # a flat direction has no density of its own
        whiten.append((np.log(max(w, 1e-300)) - 0.5 * (np.log(values[some]).sum() + some.sum() * np.log(2 * np.pi)), mean, vectors[:, some] / np.sqrt(values[some])))

    def each(x: np.ndarray) -> np.ndarray:
        return np.stack([c - 0.5 * (((x - mean) @ turn) ** 2).sum(axis=1) for c, mean, turn in whiten], axis=1)

    def density(x: np.ndarray, _: list) -> np.ndarray:
        z = each(x)
        most = z.max(axis=1)
        return most + np.log(np.exp(z - most[:, None]).sum(axis=1))

    out = scored_by(df, columns, key, "component", lambda x, _: each(x).argmax(axis=1).astype(float))
    out = scored_by(out, columns, key, "log_density", density)
    out = scored_by(out, columns, key, "responsibility", lambda x, k: np.exp(each(x).max(axis=1) - density(x, k)))
    out = written(out.withColumns({"component": F.col("component").cast("int"), "_low": F.round(-F.col("log_density"), 9)}), "mixture")
    return pct_ranks(out, {"low_density_rank": "_low"}).drop("_low")
