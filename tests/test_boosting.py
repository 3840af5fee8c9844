"""Histogram boosting against a plain version, and the expected response by invariants."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boosting


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    out = []
    for i in range(1500):
        x = [r.randrange(32), r.randrange(32), r.randrange(2)]
        out.append((x, [0.2 * x[0] + (3.0 if x[2] else 0.0) + r.gauss(0, 0.3), None if i % 50 == 0 else r.gauss(0, 1)], i % 3, i))
    return spark.createDataFrame(out, "bins array<int>, targets array<double>, fold int, i int").repartition(5).persist()


def plain(data, target, held, rounds, depth, rate, base):
    """One model, a node at a time; leaves take the exact median."""
    x = np.array([d["bins"] for d in data if d["fold"] != held and d["targets"][target] is not None])
    y = np.array([d["targets"][target] for d in data if d["fold"] != held and d["targets"][target] is not None])
    pred, losses = np.full(len(y), base), []
    for _ in range(rounds):
        g, value = np.where(y > pred, 0.5, -0.5), np.zeros(len(y))

        def grow(at, level, g=g, value=value, res=y - pred):
            best = (1e-9, None, None)
            for c in range(x.shape[1] if level < depth else 0):
                for cut in range(boosting.BINS - 1):
                    left = at[x[at, c] <= cut]
                    nl, n, gl, gt = len(left), len(at), g[left].sum(), g[at].sum()
                    if nl >= boosting.LEAST_ROWS and n - nl >= boosting.LEAST_ROWS:
                        gain = gl**2 / nl + (gt - gl) ** 2 / (n - nl) - gt**2 / n
                        if gain > best[0]:
                            best = (gain, c, cut)
            if best[1] is None:
                if level < depth:
                    return grow(at, level + 1)
                value[at] = np.sort(res[at])[int(np.ceil(0.5 * len(at))) - 1] if len(at) else 0
                return None
            grow(at[x[at, best[1]] <= best[2]], level + 1)
            grow(at[x[at, best[1]] > best[2]], level + 1)
            return None

        grow(np.arange(len(y)), 0)
        pred = pred + rate * value
        losses.append(np.abs(y - pred).mean())
    return x, pred, losses


def test_equals_a_plain_version(rows):
    data = rows.collect()
    fitted = boosting.fit(rows.select("bins", "targets", "fold"), 3, 2, 3, rounds=4, depth=2, rate=0.5, base=[1.0, 0.0])
    for target, held in ((0, 0), (0, 2), (1, 1)):
        x, pred, losses = plain(data, target, held, 4, 2, 0.5, [1.0, 0.0][target])
        assert np.abs(fitted.predict(x, target * 3 + held) - pred).max() < 1e-5
        assert target or all(b < a for a, b in zip(losses, losses[1:], strict=False))
    again = boosting.fit(rows.select("bins", "targets", "fold").repartition(2), 3, 2, 3, rounds=1, depth=2, rate=0.5, base=[1.0, 0.0])
    assert all((a.column == b.column).all() and (a.cut == b.cut).all() for a, b in zip(fitted.trees[0], again.trees[0], strict=True))


def test_expected_response_and_importance(spark):
    r, out = random.Random(9), []
    for run in range(6):
        for s in range(3):
            cat = r.choice(["talk", "game", None])
            for m in range(60):
                v = r.uniform(0, 6)
                chat = 0.8 * v + (2 if cat == "game" else 0) + r.gauss(0, 0.2)
                out.append((f"r{run}", s, f"{run}_{s}", m + 1, dt.datetime(2024, 1, 1, (m // 10) % 24, m % 60), v if m % 9 else None, int(v), cat, chat, None if m % 13 == 0 else chat / 2))
    df = spark.createDataFrame(out, "run_id string, broad_no int, session_key string, minute_idx int, minute_ts timestamp, log_viewer double, viewer_bin int, category_id string, log_chat double, log_unique double")
    key = ["run_id", "broad_no", "minute_idx"]
    response = boosting.expected_response(df, key, rounds=12, depth=3, rate=0.4)
    got = boosting.deficits(response, key).collect()
    actual = {(a, b, m): (c, u) for a, b, _, m, _, _, _, _, c, u in out}
    assert len(got) == len(out) and all((g["model_unique_deficit"] is None) == (actual[g["run_id"], g["broad_no"], g["minute_idx"]][1] is None) for g in got)
    error = np.mean([abs(g["model_chat_deficit"]) for g in got])
    flat = np.median([c for c, _ in actual.values()])
    assert error < 0.5 * np.mean([abs(c - flat) for c, _ in actual.values()])
    assert all(g["agreement"] == int(g["model_chat_deficit"] > 0 and (g["model_unique_deficit"] or 0) > 0) for g in got)
    folds = response.rows.groupBy("run_id").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(f["n"] == 1 for f in folds) and response.rows.select("fold").distinct().count() == 5
    rise = {(i["target"], i["feature"]): i for i in boosting.importance(response, key, repeats=1).collect()}
    assert len(rise) == 10 and all(i["fold_count"] == 5 for i in rise.values())
    of = lambda n: rise["log_chat", n]["importance_mae_increase"]
    assert of("category") > 0.1 > abs(of("hour")) and of("log_viewer") + of("viewer_bin") > 0.3


def test_category_encoder(spark):
    df = spark.createDataFrame([(c,) for c in ["a", "a", "b", "b", "c", None, None, "d"]], "category_id string")
    cat, names = boosting.category_encoder(df, "category_id", 3)
    assert names == ["OTHER_CAT", "UNKNOWN_CAT", "a", "b"]
    assert sorted(r["c"] for r in df.select(cat.alias("c")).collect()) == ["OTHER_CAT", "OTHER_CAT", "UNKNOWN_CAT", "UNKNOWN_CAT", "a", "a", "b", "b"]
