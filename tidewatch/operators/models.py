"""Estimators and metrics: exact scaling, ECOD, cluster metrics, classification metrics, KMeans."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, ieee_div, row_mean
from ..sources.steps import written
from .ranks import by_value, cumulative, group_pct_ranks, histograms, places, quantile_row, quantiles, value_bounds


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinite values take the column's exact median, or 0 where all are missing."""
    clean = df.select(*[c for c in df.columns if c not in columns], *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    med = quantile_row(clean, columns, (0.5,))
    return clean.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.col(c), F.lit(med[c][0]), F.lit(0.0)).alias(c) for c in columns])


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR with exact quartiles; an IQR of 0 divides by 1."""
    q = quantile_row(df, columns, (0.25, 0.5, 0.75))
    scale = lambda c: F.lit(None).cast("double") if q[c][1] is None else (F.col(c) - q[c][1]) / ((q[c][2] - q[c][0]) or 1.0)
    return df.select(*[c for c in df.columns if c not in columns], *[scale(c).alias(c) for c in columns])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column to [0, 1]; a constant column to 0.5."""
    b = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(b))
    span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    return out.select(*[c for c in df.columns if c not in columns], *[F.when(span(c) > 0, (F.col(c) - F.col(f"_lo_{c}")) / F.when(span(c) > 0, span(c))).otherwise(0.5).alias(c) for c in columns])


def ecod(df: DataFrame, columns: list[str], name: str = "ecod") -> DataFrame:
    """Empirical-CDF outlier score: per feature -log of the left and right tails, the skewed side chosen by the
    feature's skewness; the largest of the three sums. Tails come from one histogram per feature."""
    skew = df.agg(F.count(F.lit(1)), *[F.skewness(c) for c in columns]).first()
    n, bounds, out = skew[0], value_bounds(df, columns), df
    for c, (hist, values) in histograms(df, columns, bounds, nulls=True).items():
        hist = hist.select("_hist_x", "_hist_c", F.col("_hist_c").alias(f"_c_{c}"), F.col("_hist_u").alias(f"_u_{c}"))
        out = by_value(out, c, hist, "_hist_x", "_hist_c", n, [f"_c_{c}", f"_u_{c}"], values)
    left = {c: -F.log(F.col(f"_u_{c}") / n) for c in columns}
    right = {c: -F.log((n - F.col(f"_u_{c}") + F.col(f"_c_{c}")) / n) for c in columns}
    auto = [left[c] if (s or 0) < 0 else right[c] for c, s in zip(columns, skew[1:], strict=True)]
    total = lambda xs: sum(list(xs)[1:], list(xs)[0])
    return out.select(*df.columns, F.greatest(total(left.values()), total(right.values()), total(auto)).alias(name))


def _dist(a: str, b: str, columns: list[str]) -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in columns[1:]), (F.col(f"{a}.{columns[0]}") - F.col(f"{b}.{columns[0]}")) * (F.col(f"{a}.{columns[0]}") - F.col(f"{b}.{columns[0]}"))))


def centroids(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c_{c}") for c in columns])


def calinski_davies(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One row: k, n, Calinski-Harabasz, Davies-Bouldin, size balance. Centroids are k rows.
    Divisions by zero (one cluster, no spread, equal centroids) are infinite or NaN."""
    cent = centroids(df, label, columns)
    near = df.join(F.broadcast(cent), label)
    d2 = sum(((F.col(c) - F.col(f"c_{c}")) * (F.col(c) - F.col(f"c_{c}")) for c in columns), F.lit(0.0))
    per = near.groupBy(label).agg(F.first("n").alias("n"), F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("s"), *[F.first(f"c_{c}").alias(f"c_{c}") for c in columns])
    mean = df.agg(*[F.avg(c).alias(f"g_{c}") for c in columns])
    b2 = sum(((F.col(f"c_{c}") - F.col(f"g_{c}")) * (F.col(f"c_{c}") - F.col(f"g_{c}")) for c in columns), F.lit(0.0))
    ch = per.join(F.broadcast(mean)).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * b2).alias("b"), F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = per.alias("a"), per.alias("b")  # k by k rows
    between = _dist("a", "b", [f"c_{c}" for c in columns])
    db = a.join(b, F.col(f"a.{label}") != F.col(f"b.{label}")).groupBy(F.col(f"a.{label}").alias("l")).agg(F.max(ieee_div(F.col("a.s") + F.col("b.s"), between)).alias("r")).agg(F.avg("r").alias("db"))
    return ch.join(F.broadcast(db)).select(
        "k", "n", F.round(ieee_div(ieee_div(F.col("b"), F.col("k") - 1), ieee_div(F.col("w"), F.col("n") - F.col("k"))), 6).alias("calinski_harabasz"), F.round("db", 6).alias("davies_bouldin"),
        F.round(F.col("least") / F.col("most"), 6).alias("size_balance"),
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cell = cells.agg(pairs("n").alias("i"), F.sum("n").alias("t"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(f"p{k}")) for k, c in enumerate((a, b)))
    e = F.col("p0") * F.col("p1") / (F.col("t") * (F.col("t") - 1) / 2)
    most = (F.col("p0") + F.col("p1")) / 2
    return cell.join(F.broadcast(rows)).join(F.broadcast(cols)).select(F.round(F.when(most == e, 1.0).otherwise((F.col("i") - e) / F.when(most != e, most - e)), 6).alias("ari"))


def binary_metrics(df: DataFrame, score: str, label: str, threshold: float | None = None) -> DataFrame:
    """One row: n, positives, average precision (step), ROC AUC (ties averaged), and F2 at the prior-rate threshold.

    Counts are taken per distinct score, so ties share one step; the sums run over ranges of scores.
    """
    per = df.groupBy((-F.col(score)).alias("_s")).agg(F.sum(label).cast("long").alias("p"), F.count(F.lit(1)).alias("c"))
    run = cumulative(per, "_s", {"tp": "p", "seen": "c"})
    total = per.agg(F.sum("p").alias("pos"), F.sum("c").alias("n"))
    x = run.join(F.broadcast(total))
    fp, neg = F.col("seen") - F.col("tp"), F.col("n") - F.col("pos")
    below = (neg - fp) + (F.col("c") - F.col("p")) / 2  # negatives under this score, ties half
    x = x.select("*", (F.col("p") * F.col("tp") / F.col("seen")).alias("ap"), (F.col("p") * below).alias("auc"), F.when(F.col("seen") - F.col("c") < F.col("pos"), F.struct("seen", "tp")).alias("at"))
    out = x.agg(F.max("n").alias("n"), F.max("pos").alias("positives"), F.round(F.sum("ap") / F.max("pos"), 6).alias("average_precision"), F.round(F.sum("auc") / (F.max("pos") * (F.max("n") - F.max("pos"))), 6).alias("roc_auc"), F.max("at").alias("at"))
    precision, recall = F.col("at.tp") / F.col("at.seen"), F.col("at.tp") / F.col("positives")
    return out.select("n", "positives", "average_precision", "roc_auc", F.round(5 * precision * recall / F.when(4 * precision + recall > 0, 4 * precision + recall), 6).alias("f2_at_prior"))


def precision_at(df: DataFrame, score: str, label: str, key: str, ks: tuple[int, ...]) -> DataFrame:
    """Precision and recall among the k best, ties to the smaller key; only the largest k rows are ranked."""
    total = df.agg(F.sum(label).alias("pos"))
    top = df.orderBy(F.desc(score), key).limit(max(ks))
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), key))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("place <= k")
    out = top.groupBy("k").agg(F.sum(label).alias("hits"), F.count(F.lit(1)).alias("taken")).join(F.broadcast(total))
    return out.select(F.col("k").cast("long").alias("k"), F.col("hits").cast("long").alias("hits"), F.round(F.col("hits") / F.col("taken"), 6).alias("precision"), F.round(F.col("hits") / F.col("pos"), 6).alias("recall"))


def cohens_d(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Standardised mean difference of the true group against the rest, pooled deviation with n - 1."""
    long = df.select(group, F.expr("stack({}, {}) as (measure, x)".format(len(columns), ", ".join(f"'{c}', cast({c} as double)" for c in columns)))).filter("x is not null")
    one, two = F.col(group), ~F.col(group)
    g = long.groupBy("measure").agg(*[f(F.when(c, F.col("x"))).alias(f"{n}{i}") for i, c in enumerate((one, two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return g.select("measure", F.round((F.col("m0") - F.col("m1")) / F.when(pooled > 0, pooled), 6).alias("d"))


def kmeans_labels(df: DataFrame, columns: list[str], k: int, order: str, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """KMeans of least cost over several seeds; labels renumbered by ascending mean of order, so that runs agree."""
    features = VectorAssembler(inputCols=columns, outputCol="_features").transform(df)
    best = min((KMeans(k=k, seed=s, featuresCol="_features", predictionCol="_raw").fit(features) for s in seeds), key=lambda m: m.summary.trainingCost)
    out = best.transform(features).drop("_features")
    means = out.groupBy("_raw").agg(F.avg(order).alias("_m"))
    names = means.select("_raw", (F.row_number().over(Window.orderBy("_m", "_raw")) - 1).alias("cluster"))  # k rows
    return out.join(F.broadcast(names), "_raw").drop("_raw")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, known, missing, mean, std, low, high) of each column."""
    stats = {"known": F.count, "mean": F.avg, "std": F.stddev_samp, "low": F.min, "high": F.max}
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[(f(c) if n == "known" else F.round(f(F.col(c).cast("double")), 6)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in stats.items()])
    parts = ", ".join(f"'{c}', known_{i}, _n - known_{i}, mean_{i}, std_{i}, low_{i}, high_{i}" for i, c in enumerate(columns))
    return row.select(F.expr(f"stack({len(columns)}, {parts}) as (name, known, missing, mean, std, low, high)"))


def median_separation(df: DataFrame, label: str, columns: list[str]) -> float | None:
    """Mean distance between the clusters' centres of medians."""
    q = quantiles(df, columns, (0.5,), label)
    centres = [[q[(g, c)][0] for c in columns] for g in sorted({g for g, _ in q})]
    far = [math.dist(a, b) for i, a in enumerate(centres) for b in centres[:i]]
    return sum(far) / len(far) if far else None


#: Rows that a silhouette is taken over in one place; more are compared in blocks of BLOCK_ROWS.
SILHOUETTE_ROWS, BLOCK_ROWS = 2000, 4096


def _distances(columns: list[str], label: str) -> Callable[[pa.Table], pa.Table]:
    """Of a pair of blocks: for each asking row, the sum of distances to its own label's rows and to those of labels that
    reach into other blocks, and the least mean distance to the labels that are whole in this one."""

    def each(t: pa.Table) -> pa.Table:
        of = {c: t.column(c).to_numpy() for c in ("_asks", "_id", "_label", "_n", "_size", "_whole")}
        x = np.array([t.column(c).to_numpy().astype(float) for c in columns])
        asks, order = np.flatnonzero(of["_asks"]), np.argsort(of["_id"], kind="stable")
        has = order[~of["_asks"][order]]  # by label
        first = np.flatnonzero(np.diff(of["_label"][has], prepend=-1))
        labels, sizes, whole = (of[c][has][first] for c in ("_label", "_size", "_whole"))
        out = []
        for i in range(0, len(asks), 256):
            a = asks[i : i + 256]
            d = np.zeros((len(a), len(has)))
            for v in x:
                d += (v[a][:, None] - v[has]) ** 2
            sums = np.add.reduceat(np.sqrt(d) * of["_n"][has], first, axis=1)
            own = of["_label"][a][:, None] == labels
            row, at = np.nonzero(own | ~whole)
            out.append(pa.table([of["_id"][a[row]], of["_n"][a[row]], labels[at], own[row, at], sizes[at], sums[row, at]], names=_SUMS))
            least = np.where(own | ~whole, np.inf, sums / sizes).min(axis=1)
            row = np.flatnonzero(np.isfinite(least))
            out.append(pa.table([of["_id"][a[row]], of["_n"][a[row]], np.full(len(row), -1), np.zeros(len(row), bool), np.ones(len(row), np.int64), least[row]], names=_SUMS))
        return pa.concat_tables(out)

    return each


_SUMS = ["id", "n", "label", "own", "size", "d"]


def _silhouette_by_blocks(df: DataFrame, label: str, columns: list[str]) -> float | None:
    """Rows lie in blocks in order of their label, and each pair of blocks is a group: equal rows are one with a count, and
    a block gives a row's own label, two that other blocks share, and the least of the others."""
    x = places(df.groupBy(label, *columns).agg(F.count(F.lit(1)).alias("_n")), [F.asc(c) for c in (label, *columns)], "_id")
    x = x.select("_id", F.col(label).cast("long").alias("_label"), "_n", *columns, F.floor((F.col("_id") - 1) / BLOCK_ROWS).cast("int").alias("_block"))
    x = written(x, "silhouette-rows")
    sizes = x.groupBy("_label").agg(F.sum("_n").alias("_size"), (F.min("_block") == F.max("_block")).alias("_whole"))
    last, found = x.agg(F.max("_block"), F.count_distinct("_label")).first()
    if found < 2:
        return None
    x, every = x.join(F.broadcast(sizes), "_label"), F.explode(F.sequence(F.lit(0), F.lit(last)))
    pairs = x.select("*", F.lit(True).alias("_asks"), F.col("_block").alias("_i"), every.alias("_j"))
    pairs = pairs.unionByName(x.select("*", F.lit(False).alias("_asks"), every.alias("_i"), F.col("_block").alias("_j")))
    sums = pairs.groupBy("_i", "_j").applyInArrow(_distances(columns, label), "id long, n long, label long, own boolean, size long, d double")
    sums = sums.groupBy("id", "n", "label", "own", "size").agg(F.sum("d").alias("s"), F.min("d").alias("least"))
    near = F.when(F.col("label") == -1, F.col("least")).when(~F.col("own"), F.col("s") / F.col("size"))
    row = sums.groupBy("id", "n").agg(F.max(F.when(F.col("own"), F.col("size"))).alias("size"), F.max(F.when(F.col("own"), F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"), F.min(near).alias("b"))
    s = F.when(F.col("size") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).otherwise(0.0)
    return row.agg(F.round(F.sum(s * F.col("n")) / F.sum("n"), 9)).first()[0]  # nine digits: sums' order decides no tie


def silhouette(df: DataFrame, label: str, columns: list[str], key: str, most: int | None = None) -> float | None:
    """Mean silhouette of all rows, or of a sample of so many at most, drawn by hash of the key. Labels are whole numbers
    from 0 on."""
    rows = df.select(label, *columns).orderBy(F.xxhash64(F.col(key)), key).limit(most or SILHOUETTE_ROWS + 1).collect()
    if most is None and len(rows) > SILHOUETTE_ROWS:
        return _silhouette_by_blocks(df, label, columns)
    x, y = np.array([[float(r[c]) for c in columns] for r in rows]).reshape(len(rows), -1), np.array([r[label] for r in rows])
    names = np.unique(y)
    if len(names) < 2:
        return None
    d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ x.T + (x**2).sum(axis=1), 0))
    np.fill_diagonal(d, 0)
    sums, sizes = np.array([d[:, y == n].sum(axis=1) for n in names]).T, np.array([(y == n).sum() for n in names])
    own = np.searchsorted(names, y)
    mine = np.take_along_axis(sums, own[:, None], 1)[:, 0] / np.maximum(sizes[own] - 1, 1)
    other = np.where(np.arange(len(names)) == own[:, None], np.inf, sums / sizes).min(axis=1)
    s = np.where(sizes[own] > 1, (other - mine) / np.maximum(np.maximum(mine, other), 1e-300), 0)
    return float(s.mean())


def selection_score(df: DataFrame, metrics: dict[str, bool], key: str) -> DataFrame:
    """Adds the mean percentile rank of a few candidates' metrics (column -> larger is better), and selected: the best
    of it, the smallest key among equals."""
    every, parts = Window.partitionBy(), []
    for c, up in metrics.items():
        x = F.round(F.col(c) if up else -F.col(c), 9)
        place = F.rank().over(Window.orderBy(x.asc_nulls_last()))
        parts.append(F.when(F.col(c).isNotNull(), (place + (F.count(F.lit(1)).over(Window.partitionBy(x)) - 1) / 2) / F.count(c).over(every)))
    out = df.withColumn("selection_score", F.round(row_mean(parts), 6))
    return out.withColumn("selected", F.row_number().over(Window.orderBy(F.desc_nulls_last("selection_score"), key)) == 1)


def choose_k(df: DataFrame, columns: list[str], key: str, order: str, ks: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8), seeds: tuple[int, ...] = (42, 43, 44), labels: Callable = kmeans_labels, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """KMeans over several K, judged by silhouette (of a sample of so many rows, if most is given), Calinski-Harabasz,
    Davies-Bouldin, size balance and separation: the table of candidates with one selected, and df with the labels of the
    selected K."""
    rows, labelled = [], {}
    for k in ks:
        out = labelled[k] = labels(df, columns, k, order, seeds)
        m = calinski_davies(out, "cluster", columns).first()
        ch = m["calinski_harabasz"] if m["k"] > 1 and m["n"] > m["k"] else None  # else undefined, and no candidate's best
        rows.append((k, silhouette(out, "cluster", columns, key, most), ch, m["davies_bouldin"], m["size_balance"], median_separation(out, "cluster", columns)))
    table = df.sparkSession.createDataFrame(rows, "k int, silhouette double, calinski_harabasz double, davies_bouldin double, size_balance double, separation double")
    table = selection_score(table, {"silhouette": True, "calinski_harabasz": True, "davies_bouldin": False, "size_balance": True, "separation": True}, "k")
    return table, labelled[table.filter("selected").first()["k"]]


def k_consistency(table: DataFrame, labels: DataFrame, label: str = "cluster") -> str:
    """ok if exactly one K is selected and it is the number of labels there are."""
    chosen = [r["k"] for r in table.filter("selected").select("k").collect()]
    if len(chosen) != 1:
        return "invalid_selected_count"
    return "ok" if labels.select(label).distinct().count() == chosen[0] else "mismatch"


def kmeans_stability(df: DataFrame, columns: list[str], k: int, key: str, order: str, seeds: tuple[int, ...] = tuple(range(42, 52)), share: int = 80) -> DataFrame:
    """(seed, ari): labels learned on a hash sample of share percent of the rows, against those learned on all."""
    whole, out = kmeans_labels(df, columns, k, order).select(key, F.col("cluster").alias("a")), None
    for s in seeds:
        part = kmeans_labels(df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(s)), F.lit(100)) < share), columns, k, order, (s,)).select(key, F.col("cluster").alias("b"))
        row = adjusted_rand(whole.join(part, key), "a", "b").select(F.lit(s).alias("seed"), "ari")
        out = row if out is None else out.unionByName(row)
    return out


def sturges_histogram(df: DataFrame, column: str) -> DataFrame:
    """(bucket, n): equal widths between the extremes, as many as Sturges' rule asks for."""
    b = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.ceil(F.log2(F.count(column).cast("double")) + 1).alias("_k"))  # one row
    at = F.least(F.floor((F.col(column) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / F.col("_k"))), F.col("_k") - 1)
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(b)).groupBy(at.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def spearman_by(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns per key, average ranks for ties: key, n, r. No key's rows meet in one task."""
    x = df.select(key, F.round(F.col(a).cast("double"), 9).alias("_a"), F.round(F.col(b).cast("double"), 9).alias("_b")).filter("_a is not null and _b is not null")
    x = group_pct_ranks(group_pct_ranks(x, [key], "_a", "_ra"), [key], "_b", "_rb")
    return x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("r"))


def embedding_columns(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.select("*", *[F.get(column, F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)])
