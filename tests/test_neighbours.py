"""Neighbours, outlier factors and density clusters against plain all-pairs versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import neighbours

COLS = ["a", "b", "c"]


def cloud(n, seed, copies=0):
    r = random.Random(seed)
    rows = [(f"k{i:05}", *(r.gauss(6.0 * (i % 3), 1) for _ in COLS)) for i in range(n)]
    rows += [(f"same{i:04}", 1.0, 1.0, 1.0) for i in range(copies)] + [(f"grid{i:03}", float(i % 4), float(i // 4 % 4), 0.0) for i in range(48)]
    return rows


def lof_by_force(rows, k):
    """Rows ordered by distance, then the smallest key of their point, then key."""
    keys, x = [r[0] for r in rows], np.array([r[1:] for r in rows])
    least: dict[tuple, str] = {}
    for key, *v in rows:
        least[tuple(v)] = min(least.get(tuple(v), key), key)
    first = np.array([sorted(least.values()).index(least[tuple(r[1:])]) for r in rows])
    d = np.array([np.sqrt(((x[:, 0] - p[0]) ** 2 + (x[:, 1] - p[1]) ** 2) + (x[:, 2] - p[2]) ** 2) for p in x])
    np.fill_diagonal(d, np.inf)
    at = np.array([np.lexsort((np.arange(len(x)), first, row))[:k] for row in d])
    reach = np.take_along_axis(d, at, 1)[:, -1]
    density = 1 / np.maximum(np.maximum(np.take_along_axis(d, at, 1), reach[at]).mean(axis=1), 1e-10)
    return dict(zip(keys, density[at].mean(axis=1) / density, strict=True))


@pytest.mark.parametrize(("n", "copies", "k", "shard"), [(5000, 40, 20, 700), (60, 30, 35, 16), (3, 0, 5, 2048)])
def test_local_outlier_factor_of_all_rows(spark, n, copies, k, shard):
    rows = cloud(n, 1, copies)
    df = spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(5)
    got = {r["k"]: r["lof"] for r in neighbours.local_outlier_factor(df, COLS, "k", k, shard_rows=shard).collect()}
    want = lof_by_force(rows, min(k, len(rows) - 1))
    assert len(got) == len(rows) and max(abs(got[i] - want[i]) / want[i] for i in want) < 1e-9


def test_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "k string, a double, b double, c double")
    assert neighbours.local_outlier_factor(df, COLS, "k").first()["lof"] is None
    assert neighbours.local_outlier_factor(df.limit(0), COLS, "k").count() == 0
    two = df.unionByName(df.withColumn("k", F.lit("b")))
    assert [r["lof"] for r in neighbours.local_outlier_factor(two, COLS, "k").collect()] == [1.0, 1.0]


def hdbscan_by_force(rows, least, min_samples):
    """Prim's tree over all pairs in the order (weight, ids), Kruskal, the condensed tree as nested sets."""
    by: dict[tuple, list] = {}
    for key, *v in rows:
        by.setdefault(tuple(v), []).append(key)
    pts = sorted(by, key=lambda v: min(by[v]))
    n, x = np.array([len(by[p]) for p in pts]), np.array(pts)
    d = np.array([np.sqrt(sum((x[:, i] - p[i]) ** 2 for i in range(x.shape[1]))) for p in x])
    order = np.argsort(d, axis=1, kind="stable")
    core = np.array([next((d[i, j] for j, c in zip(order[i], np.cumsum(n[order[i]]), strict=True) if c >= min_samples), d[i].max()) for i in range(len(x))])
    w = np.maximum(np.maximum(d, core[:, None]), core)
    edges = sorted((w[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    node = {i: ("leaf", i) for i in range(len(x))}  # the top node of each component
    size, member = {("leaf", i): int(n[i]) for i in range(len(x))}, {i: [i] for i in range(len(x))}
    comp, kids, weight = list(range(len(x))), {}, {("leaf", i): core[i] for i in range(len(x))}
    for q, (v, i, j) in enumerate(edges):
        a, b = comp[i], comp[j]
        if a == b:
            continue
        new = ("merge", q)
        kids[new], weight[new], size[new] = (node[a], node[b]), v, size[node[a]] + size[node[b]]
        for m in member[b]:
            comp[m] = a
        member[a] += member.pop(b)
        node[a] = new
    top = node[comp[0]]
    labels = {k: -1 for p in pts for k in by[p]}
    if size[top] < least:
        return labels
    lam = lambda v: 1 / max(v, 1e-10)

    def points_of(v):
        out, pending = [], [v]
        while pending:
            u = pending.pop()
            pending += kids.get(u, ())
            out += [u[1]] if u[0] == "leaf" else []
        return out

    def best(start, birth, is_root):
        """Worth and chosen starts of the cluster that begins at a node."""
        v, stability, below = start, 0.0, []
        while True:
            if v not in kids:
                stability += size[v] * (lam(weight[v]) - birth)
                break
            at, (a, b) = lam(weight[v]), kids[v]
            large = [u for u in (a, b) if size[u] >= least]
            if len(large) == 1:
                stability += (size[v] - size[large[0]]) * (at - birth)
                v = large[0]
                continue
            stability += size[v] * (at - birth)
            below = [best(u, at, False) for u in large]
            break
        worth = sum(x for x, _ in below)
        return (worth, [s for _, c in below for s in c]) if is_root or (below and worth > stability) else (stability, [start])

    for start in best(top, 0.0, True)[1]:
        for p in points_of(start):
            for k in by[pts[p]]:
                labels[k] = start
    names = {s: i for i, s in enumerate(sorted({v for v in labels.values() if v != -1}, key=lambda s: min(min(by[pts[p]]) for p in points_of(s))))}
    return {k: names.get(v, -1) for k, v in labels.items()}


@pytest.mark.parametrize(("n", "copies", "least", "shard", "segment"), [(2000, 30, 8, 700, 1100), (300, 3, 5, 2048, 200_000), (4, 0, 60, 2048, 99), (0, 0, 5, 8, 7)])
def test_density_clusters(spark, n, copies, least, shard, segment):
    from tidewatch.operators.density import hdbscan

    rows = cloud(n, 3, copies)[: None if n else -40]
    want = hdbscan_by_force(rows, least, max(2, least // 2))
    df = spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(3)
    got = {r["k"]: r["hdbscan"] for r in hdbscan(df, COLS, "k", least, shard_rows=shard, segment=segment).collect()}
    assert got == want
    if n > 1000:
        assert max(got.values()) >= 3 and -1 in got.values()


def test_density_clusters_of_nothing(spark):
    from tidewatch.operators.density import hdbscan

    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)] * 1, "k string, a double, b double, c double")
    assert hdbscan(df.limit(0), COLS, "k").count() == 0 and [r["hdbscan"] for r in hdbscan(df, COLS, "k").collect()] == [-1]
    same = spark.createDataFrame([(f"k{i}", 1.0, 2.0, 3.0) for i in range(20)], df.schema)
    assert {r["hdbscan"] for r in hdbscan(same, COLS, "k").collect()} == {-1}
