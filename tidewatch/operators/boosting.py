"""Conditional quantiles by histogram boosting, for several targets and group folds at once; expected response.

Columns are binned once. Every model (target, fold) learns from the rows of the other folds, and all models grow in the
same passes: a level of their trees is one aggregation of counts by (model, node, column, bin), summed inside tasks
first. As a quantile loss has two gradients only, these are whole numbers, so trees don't depend on partitions. A leaf's
value is its residuals' quantile, narrowed by two histograms. The driver holds the trees and one level's counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written
from .learn import group_fold
from .models import median_impute
from .ranks import places, quantile_row

BINS, LEAST_ROWS, CELLS = 32, 20, 4096
FORM = "model int, counts array<double>"


@dataclass
class Tree:
    """A complete tree in heap order; a node without a split has column -1 and sends everything left."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray | None = None

    def leaf(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row at a depth, counted from the level's first."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            c = self.column[at]
            right = (c >= 0) & (bins[np.arange(len(bins)), c] > self.cut[at])
            at = 2 * at + 1 + right
        return at - (2**depth - 1)


@dataclass
class Boosted:
    """Models in the order target by target, fold by fold."""

    folds: int
    quantile: float
    depth: int
    rate: float
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def predict(self, bins: np.ndarray, model: int) -> np.ndarray:
        out = np.full(len(bins), self.base[model])
        for t in self.trees:
            if t[model].value is not None:
                out += self.rate * t[model].value[t[model].leaf(bins, self.depth)]
        return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bins, targets (nan where unknown) and folds of (bins, targets, fold)."""
    n = batch.num_rows
    return (
        batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64),
        batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1),
        batch.column(2).to_numpy(),
    )


def _count(batches: Iterator[pa.RecordBatch], fitted: Boosted, each: Callable) -> Iterator[pa.RecordBatch]:
    """each(model, bins, residuals) -> numbers to add up (or bounds to widen, where it has a ``merge``)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        bins, y, fold = _read(batch)
        for m in range(len(fitted.base)):
            t, f = divmod(m, fitted.folds)
            rows = (fold != f) & ~np.isnan(y[:, t])
            part = each(m, bins[rows], y[rows, t] - fitted.predict(bins[rows], m))
            total[m] = part if m not in total else each.merge(total[m], part) if hasattr(each, "merge") else total[m] + part
    for m, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["model", "counts"])


class Level:
    """Counts and counts of positive residuals by node, column and bin."""

    def __init__(self, trees: list[Tree], depth: int, columns: int):
        self.trees, self.depth, self.shape = trees, depth, (2**depth, columns, BINS)

    def __call__(self, model: int, bins: np.ndarray, residual: np.ndarray) -> np.ndarray:
        node, size = self.trees[model].leaf(bins, self.depth), int(np.prod(self.shape))
        cell = ((node[:, None] * self.shape[1] + np.arange(self.shape[1])) * BINS + bins).ravel()
        up = np.repeat(residual > 0, self.shape[1])
        return np.concatenate([np.bincount(cell, minlength=size), np.bincount(cell[up], minlength=size)]).astype(float)


class Range:
    """The least and the largest residual of each leaf (the least negated), and its rows."""

    def __init__(self, trees: list[Tree], depth: int):
        self.trees, self.depth = trees, depth

    def __call__(self, model: int, bins: np.ndarray, residual: np.ndarray) -> np.ndarray:
        leaf, n = self.trees[model].leaf(bins, self.depth), 2**self.depth
        low, high = np.full(n, -np.inf), np.full(n, -np.inf)
        np.maximum.at(low, leaf, -residual)
        np.maximum.at(high, leaf, residual)
        return np.concatenate([low, high])

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)


class Cells:
    """Rows below each leaf's bracket, and in each of its CELLS cells."""

    def __init__(self, trees: list[Tree], depth: int, low: np.ndarray, high: np.ndarray):
        self.trees, self.depth, self.low, self.high = trees, depth, low, high

    def __call__(self, model: int, bins: np.ndarray, residual: np.ndarray) -> np.ndarray:
        leaf, n = self.trees[model].leaf(bins, self.depth), 2**self.depth
        low, width = self.low[model][leaf], np.maximum(self.high[model][leaf] - self.low[model][leaf], 1e-300)
        cell = np.clip(np.floor((residual - low) / width * CELLS), -1, CELLS).astype(np.int64) + 1
        return np.bincount(leaf * (CELLS + 2) + cell, minlength=n * (CELLS + 2)).astype(float)


def _sum(batches: Iterator[pa.RecordBatch], each: Callable) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for m, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = v.values.to_numpy(zero_copy_only=False)
            total[m] = v.copy() if m not in total else each.merge(total[m], v) if hasattr(each, "merge") else total[m] + v
    for m, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["model", "counts"])


def _totals(rows: DataFrame, fitted: Boosted, each: Callable) -> dict[int, np.ndarray]:
    parts = rows.mapInArrow(partial(_count, fitted=fitted, each=each), FORM)
    return {r["model"]: np.array(r["counts"]) for r in parts.repartition("model").mapInArrow(partial(_sum, each=each), FORM).collect()}  # a row per model


def _split(counts: np.ndarray, shape: tuple, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """Column and cut of each node of a level, by the fall of the squared gradients."""
    n, up = counts[: counts.size // 2].reshape(shape), counts[counts.size // 2 :].reshape(shape)
    g = up - (1 - quantile) * n  # q where the residual is positive, q - 1 elsewhere
    nl, gl = n.cumsum(axis=2)[:, :, :-1], g.cumsum(axis=2)[:, :, :-1]
    nt, gt = n.sum(axis=2, keepdims=True), g.sum(axis=2, keepdims=True)
    nr, gr = nt - nl, gt - gl
    ok = (nl >= LEAST_ROWS) & (nr >= LEAST_ROWS)
    gain = np.where(ok, gl**2 / np.maximum(nl, 1) + gr**2 / np.maximum(nr, 1) - gt**2 / np.maximum(nt, 1), -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    found = flat[np.arange(len(flat)), best] > 1e-9
    return np.where(found, best // (shape[2] - 1), -1), np.where(found, best % (shape[2] - 1), 0)


def fit(rows: DataFrame, columns: int, targets: int, folds: int, rounds: int = 100, depth: int = 4, rate: float = 0.1, quantile: float = 0.5, base: list[float] | None = None) -> Boosted:
    """rows: bins array<int>, targets array<double>, fold. base: where each target starts."""
    fitted = Boosted(folds, quantile, depth, rate, [b for b in (base or [0.0] * targets) for _ in range(folds)])
    models = len(fitted.base)
    for _ in range(rounds):
        trees = [Tree(np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64)) for _ in range(models)]
        for level in range(depth):
            each = Level(trees, level, columns)
            for m, counts in _totals(rows, fitted, each).items():
                at = slice(2**level - 1, 2 ** (level + 1) - 1)
                trees[m].column[at], trees[m].cut[at] = _split(counts, each.shape, quantile)
        bounds = _totals(rows, fitted, Range(trees, depth))
        if not bounds:
            return fitted
        none = np.full(2 ** (depth + 1), -np.inf)
        low = np.array([-bounds.get(m, none)[: 2**depth] for m in range(models)])
        high = np.array([bounds.get(m, none)[2**depth :] for m in range(models)])
        low, high = np.where(np.isfinite(low), low, 0.0), np.where(np.isfinite(high), high, 0.0)
        for _ in range(2):
            found = _totals(rows, fitted, Cells(trees, depth, low, high))
            for m, c in found.items():
                c = c.reshape(2**depth, -1)
                need = np.ceil(quantile * c.sum(axis=1))
                cell = np.clip((c.cumsum(axis=1) < need[:, None]).sum(axis=1) - 1, 0, CELLS - 1)
                step = (high[m] - low[m]) / CELLS
                low[m], high[m] = low[m] + cell * step, low[m] + (cell + 1) * step
        for m in range(models):
            trees[m].value = (low[m] + high[m]) / 2
        fitted.trees.append(trees)
    return fitted


def _out_of_fold(batches: Iterator[pa.RecordBatch], fitted: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins, y, fold = _read(batch)
        out = np.zeros(y.shape)
        for m in range(len(fitted.base)):
            t, f = divmod(m, fitted.folds)
            rows = fold == f
            if rows.any():
                out[rows, t] = fitted.predict(bins[rows], m)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "predicted"])


def out_of_fold(rows: DataFrame, fitted: Boosted) -> DataFrame:
    """rows (bins, targets, fold first) with what the models that didn't see a row's fold say of its targets."""
    return rows.mapInArrow(partial(_out_of_fold, fitted=fitted), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", predicted array<double>")


def category_encoder(df: DataFrame, column: str, top: int = 50) -> tuple[Column, list[str]]:
    """The column's ``top`` most frequent values (of equal ones the smaller), OTHER for the rest and UNKNOWN for null,
    as an expression, and its values."""
    known = F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN_CAT"))
    names = [r["c"] for r in df.groupBy(known.alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(top).collect()]
    return F.when(known.isin(names), known).otherwise("OTHER_CAT") if names else known, sorted({*names, "OTHER_CAT"})


def binned(df: DataFrame, columns: list[str], bins: int = BINS) -> Column:
    """array<int> of each column's bin, by its quantiles (each taken once)."""
    at = tuple(i / bins for i in range(1, bins))
    q = quantile_row(df, columns, at)
    edges = {c: sorted({float(x) for x in q[c] if x is not None}) for c in columns}

    def below(c: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges[c]]), lambda e: e < F.col(c))) if edges[c] else F.lit(0)

    return F.array(*[below(c) for c in columns])


@dataclass
class Response:
    """Rows with bins, targets, fold and predictions, the models, and the places of each feature group's columns."""

    rows: DataFrame
    fitted: Boosted
    groups: dict[str, list[int]]
    targets: list[str]


NUMBERS = ("log_viewer", "viewer_bin", "minute_idx_norm", "hour")


def expected_response(minutes: DataFrame, key: list[str], targets: tuple[str, ...] = ("log_chat", "log_unique"), group: str = "run_id", folds: int = 5, top: int = 50, rounds: int = 100, depth: int = 4, rate: float = 0.1) -> Response:
    """Conditional medians of the targets out of group folds, from audience, its bin, the place in the session, the hour
    and the category. Unknown numbers take their column's median. minutes: one row per tick, session_key included."""
    last = minutes.groupBy("session_key").agg(F.max("minute_idx").alias("_n"))  # a row per session
    x = minutes.join(last, "session_key").withColumns({
        "minute_idx_norm": F.coalesce((F.col("minute_idx") - 1) / F.when(F.col("_n") > 1, F.col("_n") - 1), F.lit(0.0)), "hour": F.hour("minute_ts").cast("double"), "viewer_bin": F.col("viewer_bin").cast("double"),
    })
    cat, names = category_encoder(minutes, "category_id", top)
    x = x.select(*dict.fromkeys([*key, group]), *NUMBERS, cat.alias("_cat"), *targets)
    x = written(median_impute(x, list(NUMBERS)), "response-features")
    ready = group_fold(x, group, min(folds, max(2, x.select(group).distinct().limit(folds).count())))
    width = len(NUMBERS) + len(names)
    one_hot = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: (F.col("_cat") == n).cast("int"))
    ready = written(ready.select(F.concat(binned(x, list(NUMBERS)), one_hot).alias("bins"), F.array(*[F.col(t).cast("double") for t in targets]).alias("targets"), "fold", *key), "response-binned")
    mid = quantile_row(x, list(targets), (0.5,))
    base = [float(mid[t][0] or 0.0) for t in targets]
    fitted = fit(ready.select("bins", "targets", "fold"), width, len(targets), folds, rounds, depth, rate, 0.5, base)
    groups = {n: [i] for i, n in enumerate(NUMBERS)} | {"category": list(range(len(NUMBERS), width))}
    return Response(written(out_of_fold(ready, fitted), "response"), fitted, groups, list(targets))


def deficits(response: Response, key: list[str]) -> DataFrame:
    """Per tick, as the expected family reads it: expected and deficit of each target, and whether all are positive."""
    out = response.rows
    for i, t in enumerate(response.targets):
        name = t.removeprefix("log_")
        out = out.withColumns({f"expected_{name}": F.col("predicted")[i], f"model_{name}_deficit": F.col("predicted")[i] - F.col("targets")[i]})
    names = [t.removeprefix("log_") for t in response.targets]
    both = F.lit(True)
    for n in names:
        both = both & F.coalesce(F.col(f"model_{n}_deficit") > 0, F.lit(False))
    return out.select(*key, *[f"{p}{n}{s}" for n in names for p, s in (("expected_", ""), ("model_", "_deficit"))], both.cast("int").alias("agreement"))


def _error(rows: DataFrame, targets: list[str]) -> DataFrame:
    """(fold, mae_i): the mean absolute error of each target by held-out fold."""
    return rows.groupBy("fold").agg(*[F.avg(F.abs(F.col("predicted")[i] - F.col("targets")[i])).alias(f"mae_{i}") for i in range(len(targets))])


def _taken(mine: str, other: str, first: int, last: int) -> Column:
    """The array of mine with other's elements from first to last."""
    return F.transform(mine, lambda b, i: F.when(i.between(first, last), F.get(other, i)).otherwise(b))


def importance(response: Response, key: list[str], repeats: int = 5) -> DataFrame:
    """(target, feature, importance_mae_increase, importance_std, fold_count): how much a feature group's values, dealt
    anew among the rows of their held-out fold, add to the error there; mean and deviation over folds."""
    rows, spark = response.rows, response.rows.sparkSession
    base = {r["fold"]: r for r in _error(rows, response.targets).collect()}  # a row per fold
    plain = written(places(rows.drop("predicted"), [F.asc("fold"), *[F.asc(k) for k in key]], "_place"), "importance-rows")
    rises: dict[tuple[str, str], dict[int, list[float]]] = {}
    for k in range(repeats):
        # both orders begin with the fold, so a fold's rows hold the same places in both
        other = places(rows.select("fold", F.col("bins").alias("_other"), *key), [F.asc("fold"), F.xxhash64(*key, F.lit(k)).asc(), *[F.asc(c) for c in key]], "_place").select("_place", "_other")
        dealt = written(plain.join(other, "_place"), "importance-dealt")
        for name, cols in response.groups.items():
            scored = out_of_fold(dealt.select(_taken("bins", "_other", cols[0], cols[-1]).alias("bins"), "targets", "fold"), response.fitted)
            for r in _error(scored, response.targets).collect():
                for i, t in enumerate(response.targets):
                    rises.setdefault((t, name), {}).setdefault(r["fold"], []).append(r[f"mae_{i}"] - base[r["fold"]][f"mae_{i}"])
    out = [(t, n, float(np.mean(v)), float(np.std(v)), len(v)) for (t, n), by in rises.items() for v in [[float(np.mean(x)) for x in by.values()]]]
    return spark.createDataFrame(out, "target string, feature string, importance_mae_increase double, importance_std double, fold_count long")
