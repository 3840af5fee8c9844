"""Evidence on sessions: minute clusters and dwell, expected response, interval anomaly, reasons, evidence families.

Inputs of the later steps are one row per session; minute rows are only aggregated by session, cluster or cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import arg_max, clip, row_mean, rra_p
from ..sources.steps import written
from .models import ecod, median_impute
from .ranks import bh_q, pct_ranks, places, quantiles
from .review import strength
from .windows import KEYS, island, session_window

#: Evidence families in the order in which they break ties; reasons stay outside the consensus.
FAMILIES = ("scan", "persistence", "expected", "minute_state", "anomaly")
#: What a cluster's mismatch rank is the mean of: median, share or quantile of a column.
PROFILE = {
    "viewer_med": ("viewer_count_last", 0.5), "chat_med": ("chat_count", 0.5), "unique_med": ("unique_chatters", 0.5), "chat_deficit_med": ("chat_deficit", 0.5), "unique_deficit_med": ("unique_deficit", 0.5),
    "rolling_chat_med": ("rolling_chat_deficit_5m", 0.5), "zrun_p75": ("zero_run_len", 0.75), "rolling_zero_p90": ("rolling_zero_rate_5m", 0.9), "rolling_zero_p95": ("rolling_zero_rate_5m", 0.95),
}
MISMATCH = ("chat_deficit_med", "unique_deficit_med", "rolling_chat_med", "zero_rate", "zrun_p75", "rolling_zero_p90")
REASONS = {
    "high_chat_deficit": "chat_deficit_mean", "high_unique_deficit": "unique_deficit_mean", "high_rolling_chat_deficit": "rolling_chat_mean", "long_zero_run": "max_zero_run",
    "high_rolling_zero_rate": "rolling_zero_mean", "mismatch_cluster_state": "state_rate", "high_interval_anomaly": "anomaly",
}
ANOMALY = ["duration", "rank_mean", "rank_p95", "chat_deficit_mean", "unique_deficit_mean", "model_chat_mean", "model_unique_mean", "zero_rate", "max_zero_run", "state_rate"]


def expected_by_cell(state: DataFrame, cell: Column, fold: Column, folds: int, cells: int) -> DataFrame:
    """Adds model_chat_deficit and model_unique_deficit: the median response of a cell (a number below cells, null too)
    among the rows of other folds, or of all rows where those have none, less the actual response."""
    names, out = {"chat": "log_chat", "unique": "log_unique"}, state.withColumns({"_cell": cell, "_fold": fold})
    model = out.filter("not all_zero")
    others = model.select("_fold", "_cell", *names.values(), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_f")).filter("_f <> _fold")
    others = others.withColumn("_g", F.col("_f") * (cells + 1) + F.coalesce("_cell", F.lit(cells)))
    cols = list(names.values())
    by_cell, overall = quantiles(others, cols, (0.5,), "_g"), quantiles(model, cols, (0.5,))
    table = state.sparkSession.createDataFrame([(int(g), *[(by_cell.get((g, c)) or [None])[0] for c in cols]) for g in sorted({g for g, _ in by_cell})], "_g2 int, _e0 double, _e1 double")
    out = out.withColumn("_g", F.col("_fold") * (cells + 1) + F.coalesce("_cell", F.lit(cells)))
    out = out.join(F.broadcast(table), F.col("_g") == F.col("_g2"), "left")  # folds * (cells + 1) rows at most
    whole = {c: F.lit((overall.get((None, c)) or [None])[0]).cast("double") for c in cols}
    return out.select(*state.columns, *[(F.coalesce(f"_e{i}", whole[c]) - F.col(c)).alias(f"model_{name}_deficit") for i, (name, c) in enumerate(names.items())])


def cluster_profiles(rows: DataFrame, cluster: str = "minute_cluster") -> DataFrame:
    """One row per cluster (a few): n, share, medians and quantiles, mismatch rank and interpretation."""
    spark, at = rows.sparkSession, sorted({q for _, q in PROFILE.values()})
    found = quantiles(rows, list(dict.fromkeys(c for c, _ in PROFILE.values())), tuple(at), cluster)
    counts = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("zero_chat").cast("double")).alias("zero_rate"), F.avg("rolling_zero_rate_5m").alias("rolling_zero_mean")).collect()
    total = sum(r["n"] for r in counts)
    table = [(r[0], r["n"], r["n"] / max(total, 1), r["zero_rate"], r["rolling_zero_mean"], *[(found.get((r[0], c)) or [None] * len(at))[at.index(q)] for c, q in PROFILE.values()]) for r in counts]
    out = spark.createDataFrame(table, f"cluster_id {rows.schema[cluster].dataType.simpleString()}, n long, share double, zero_rate double, rolling_zero_mean double, " + ", ".join(f"{c} double" for c in PROFILE))
    return interpret(out)


def pct_of_few(column: str) -> Column:
    """Average percentile rank over a table of a few rows."""
    x = F.round(column, 9)
    place = F.rank().over(Window.partitionBy().orderBy(x.asc_nulls_last()))
    same = F.count(F.lit(1)).over(Window.partitionBy(x))
    return F.when(F.col(column).isNotNull(), (place + (same - 1) / 2) / F.count(column).over(Window.partitionBy()))


def interpret(profile: DataFrame) -> DataFrame:
    """Adds the mismatch rank (mean of six percentile ranks over the clusters) and what it makes of each cluster."""
    every = Window.partitionBy()
    out = profile.withColumn("cluster_mismatch_rank", row_mean([pct_of_few(c) for c in MISMATCH]))
    mid = {c: F.percentile(c, F.lit(0.5)).over(every) for c in ("viewer_med", "chat_med", "unique_med")}
    top = F.col("cluster_mismatch_rank") == F.max("cluster_mismatch_rank").over(every)
    active = (F.col("chat_med") >= mid["chat_med"]) & (F.col("unique_med") >= mid["unique_med"]) & (F.col("chat_deficit_med") <= 0)
    quiet = (F.col("viewer_med") <= mid["viewer_med"]) & (F.col("chat_med") <= mid["chat_med"])
    return out.withColumn("interpretation", F.when(top, "mismatch").when(active, "active").when(quiet, "quiet").otherwise("mixed"))


def mark_mismatch(rows: DataFrame, profile: DataFrame, cluster: str = "minute_cluster") -> DataFrame:
    """Joins each row's cluster rank and flags the rows of the cluster that ranks first (the smaller number wins)."""
    best = profile.agg(F.max_by("cluster_id", F.struct("cluster_mismatch_rank", -F.col("cluster_id"))).alias("_best"))
    few = profile.select(F.col("cluster_id").alias("_id"), "cluster_mismatch_rank")
    out = rows.join(F.broadcast(few), F.col(cluster) == F.col("_id"), "left").join(F.broadcast(best))
    return out.withColumn("mismatch_state", (F.col(cluster) == F.col("_best")).cast("double")).drop("_id", "_best")


def dwell(rows: DataFrame, cluster: str = "minute_cluster") -> DataFrame:
    """Per session: minutes, mismatch count and rate, runs of the mismatch state (count, longest, total, mean), the
    longest active run, and changes of cluster (the first row counts as none)."""
    w = session_window()
    s = rows.withColumn("_m", F.coalesce(F.col("mismatch_state") == 1, F.lit(False))).withColumn("_change", (F.col(cluster) != F.lag(cluster).over(w)).cast("int"))
    s = island(s, F.col("_m") != F.lag("_m").over(w), "_run", w)
    runs = s.groupBy(*KEYS, "session_key", "_run").agg(F.bool_or("_m").alias("m"), F.count(F.lit(1)).alias("len"), F.sum("_change").alias("changes"))
    mine, other = F.when(F.col("m"), F.col("len")), F.when(~F.col("m"), F.col("len"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = runs.groupBy(*KEYS, "session_key").agg(
        F.sum("len").alias("minutes"), zero(F.sum(mine)).alias("mismatch_minutes"), F.count(mine).alias("mismatch_runs"), zero(F.max(mine)).alias("mismatch_max_run"), zero(F.sum(mine)).alias("mismatch_total_run"),
        F.coalesce(F.avg(mine), F.lit(0.0)).alias("mismatch_mean_run"), zero(F.max(other)).alias("active_max_run"), zero(F.sum("changes")).alias("transitions"),
    )
    return out.withColumn("mismatch_rate", F.col("mismatch_minutes") / F.col("minutes"))


def state_transitions(rows: DataFrame) -> DataFrame:
    """The 2 x 2 table of moves between the active and the mismatch state inside sessions, with shares by origin."""
    w = session_window()
    name = F.when(F.coalesce(F.col("mismatch_state") == 1, F.lit(False)), "mismatch").otherwise("active")
    moves = rows.withColumn("to_state", name).withColumn("from_state", F.lag("to_state").over(w)).filter("from_state is not null")
    counts = moves.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(F.lit("active"), F.lit("mismatch"))
    grid = rows.sparkSession.range(1).select(F.explode(names).alias("from_state")).select("from_state", F.explode(names).alias("to_state"))
    out = grid.join(counts, ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("from_state"))), F.lit(0.0)))


def interval_anomaly(metrics: DataFrame) -> DataFrame:
    """Adds ecod, weight (mean percentile rank of four directional metrics) and ecod_dir, the score's percentile rank
    times the weight, which is the ``anomaly``."""
    metrics = written(metrics, "metrics")
    direction = {f"_d{i}": c for i, c in enumerate(("chat_deficit_mean", "unique_deficit_mean", "zero_rate", "state_rate"))}
    x = metrics.select("session_key", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in ANOMALY])  # means that are equal but for the order of their sums tie
    x = written(ecod(written(median_impute(x, ANOMALY), "imputed"), ANOMALY, "ecod").select("session_key", "ecod"), "ecod")
    out = written(metrics.join(x, "session_key", "left"), "metrics")
    out = pct_ranks(out, direction | {"_r": "ecod"}, 9).withColumn("weight", row_mean([F.col(d) for d in direction])).drop(*direction)
    return out.withColumn("ecod_dir", F.col("_r") * F.col("weight")).withColumn("anomaly", F.col("ecod_dir")).drop("_r")


def more_detectors(anomalies: DataFrame, scores: dict[str, str]) -> DataFrame:
    """interval_anomaly's rows with more detectors beside ECOD: each score's percentile rank times the weight that the
    rows have, and ``anomaly``, the largest of all. scores: name -> column."""
    out = pct_ranks(written(anomalies, "detectors"), {f"_r_{n}": c for n, c in scores.items()}, 9)
    out = out.withColumns({f"{n}_dir": F.col(f"_r_{n}") * F.col("weight") for n in scores}).drop(*[f"_r_{n}" for n in scores])
    return out.withColumn("anomaly", F.greatest("ecod_dir", *[f"{n}_dir" for n in scores]))


def interval_reason(metrics: DataFrame) -> DataFrame:
    """Adds dominant_reason: the metric with the highest percentile rank over sessions, the first listed among equals."""
    named = {"high_chat_deficit": "chat_deficit_mean", "high_unique_deficit": "unique_deficit_mean", "high_rolling_zero_rate": "zero_rate", "long_zero_run": "max_zero_run", "mismatch_cluster_state": "state_rate"}
    out = pct_ranks(metrics, {f"_r_{n}": c for n, c in named.items()}, 9)
    return out.withColumn("dominant_reason", arg_max({n: F.col(f"_r_{n}") for n in named})).drop(*[f"_r_{n}" for n in named])


def reason_support(metrics: DataFrame) -> DataFrame:
    """(session_key, reason, value, support, place): each reason's percentile rank over the sessions that have it, and
    its place in its session; the first three places are a session's reasons."""
    ranked = pct_ranks(metrics.select("session_key", *dict.fromkeys(REASONS.values())), {f"_r_{r}": c for r, c in REASONS.items()}, 9)
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.round(F.col(c).cast("double"), 9).alias("value"), F.col(f"_r_{r}").alias("support")) for r, c in REASONS.items()])
    long = ranked.select("session_key", F.explode(pairs).alias("x")).select("session_key", "x.*").filter("value is not null")
    w = Window.partitionBy("session_key").orderBy(F.desc("support"), F.desc("value"), "reason")  # seven rows at most
    return long.withColumn("place", F.row_number().over(w))


def _ranked(df: DataFrame, every: dict[str, dict[str, bool]]) -> DataFrame:
    """Adds places: name -> metrics (column -> ascending), ties by session_key; none where all metrics are null. A row
    per session and order is numbered in one total order, in which the orders follow each other."""
    width = max(len(metrics) for metrics in every.values())

    def keys(i: int, metrics: dict[str, bool]) -> Column:
        known, at = F.coalesce(*[F.col(m).cast("double") for m in metrics]).isNotNull(), list(metrics.items())
        value = lambda k, up: (F.round(F.col(at[k][0]).cast("double"), 9) if k < len(at) and at[k][1] == up else F.lit(None).cast("double")).alias(f"_{'up' if up else 'down'}{k}")
        return F.struct(F.lit(i).alias("_o"), F.when(known, 0).otherwise(1).alias("_none"), *[value(k, up) for k in range(width) for up in (True, False)])

    long = df.select("session_key", F.explode(F.array(*[keys(i, metrics) for i, metrics in enumerate(every.values())])).alias("_x")).select("session_key", "_x.*")
    order = [F.asc("_o"), F.asc("_none"), *[f for k in range(width) for f in (F.asc_nulls_last(f"_up{k}"), F.desc_nulls_last(f"_down{k}"))], F.asc("session_key")]
    at = places(long, order, "_place")
    n = at.count() // len(every)  # each order has every session
    found = at.filter("_none = 0").groupBy("session_key").agg(*[F.max(F.when(F.col("_o") == i, F.col("_place") - i * n)).alias(name) for i, name in enumerate(every)])
    return df.join(found, "session_key", "left")


def family_ranks(df: DataFrame) -> DataFrame:
    """Places of the five families and of the reasons. df: empirical_p, scan_z, duration, mismatch_max_run,
    mismatch_total_run, model_chat_mean, model_unique_mean, state_rate, mismatch_rate, anomaly, reason_rank_max,
    reason_value_max."""
    out = pct_ranks(written(df, "evidence"), {"_p0": "duration", "_p1": "mismatch_max_run", "_p2": "mismatch_total_run", "_m0": "state_rate", "_m1": "mismatch_rate"}, 9)
    out = out.withColumns({
        "persistence_metric": row_mean([F.col("_p0"), F.col("_p1"), F.col("_p2")]), "minute_state_metric": row_mean([F.col("_m0"), F.col("_m1")]),
        "expected_metric": F.greatest("model_chat_mean", "model_unique_mean"),
    }).drop("_p0", "_p1", "_p2", "_m0", "_m1")
    ranks = {"scan_rank": {"empirical_p": True, "scan_z": False}}
    for name, metric in (("persistence", "persistence_metric"), ("expected", "expected_metric"), ("minute_state", "minute_state_metric"), ("anomaly", "anomaly")):
        ranks[f"{name}_rank"] = {metric: False}
    return _ranked(out, ranks | {"reason_rank": {"reason_rank_max": False, "reason_value_max": False}})


#: Raw evidence: rank -> metrics and whether small ones come first.
RAW = {
    "raw_scan": {"empirical_p": True, "scan_z": False}, "raw_p": {"empirical_p": True}, "raw_duration": {"duration": False}, "raw_z": {"scan_z": False}, "raw_expected": {"expected_metric": False},
    "raw_dwell": {"mismatch_rate": False, "mismatch_max_run": False}, "raw_anomaly": {"anomaly": False}, "raw_reason": {"reason_rank_max": False, "reason_value_max": False},
}


def raw_evidence(df: DataFrame, sessions: int) -> DataFrame:
    """The eight raw places, their RRA p, mean strength and number, beside family_ranks' columns."""
    out = _ranked(df, RAW)
    known = [F.col(n) for n in RAW]
    return out.withColumns({
        "raw_rra_p": F.round(rra_p([clip(r / (sessions + 1), None, 1.0) for r in known]), 12), "raw_strength": row_mean([strength(r, F.lit(sessions)) for r in known]),
        "raw_count": sum((r.isNotNull().cast("int") for r in known[1:]), known[0].isNotNull().cast("int")),
    })


def review(df: DataFrame, sessions: int) -> DataFrame:
    """Strengths, consensus, RRA p, BH q and both orders: review_all_order over all scanned sessions (eligible ones
    first), review_order over the eligible ones. df: family_ranks' rows with ``eligible``; sessions: how many were
    scanned. A missing family counts as no strength and as the worst rank."""
    out = df.withColumns({f"{f}_strength": strength(F.col(f"{f}_rank"), F.lit(sessions)) for f in FAMILIES})
    out = out.withColumn("consensus", F.round(row_mean([F.coalesce(F.col(f"{f}_strength"), F.lit(0.0)) for f in FAMILIES]), 9))
    out = out.withColumn("rra_p", F.round(rra_p([clip(F.col(f"{f}_rank") / (sessions + 1), None, 1.0) for f in FAMILIES]), 12))
    out = bh_q(out, "rra_p", "rra_q").withColumn("rra_q", F.round("rra_q", 12))
    order = [F.desc("consensus"), F.asc_nulls_last("rra_q"), F.asc_nulls_last("rra_p"), F.asc_nulls_last("persistence_rank"), F.asc_nulls_last("scan_rank"), F.asc("session_key")]
    out = places(out, [F.desc("eligible"), *order], "review_all_order")
    return out.withColumn("review_order", F.when(F.col("eligible"), F.col("review_all_order")))  # eligible ones come first


def review_note(df: DataFrame) -> Column:
    """What a reviewer reads beside a session."""
    short = F.when(F.col("duration") <= 1, "; short interval, confirm by hand").otherwise("")
    return F.concat(F.format_string("consensus %.4f, persistence %d, scan %d, interval of %d", F.col("consensus"), F.col("persistence_rank").cast("long"), F.col("scan_rank").cast("long"), F.col("duration").cast("long")), short)


def rank_audit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old against new places (session_key, place) over all sessions of either, nulls compared as values."""
    j = old.select("session_key", F.col("place").alias("old_place")).join(new.select("session_key", F.col("place").alias("new_place")), "session_key", "full_outer")
    changed = ~F.col("old_place").eqNullSafe(F.col("new_place"))
    note = F.when(F.col("old_place").isNull() & F.col("new_place").isNotNull(), "new").when(changed, "changed").otherwise("same")
    return j.select("session_key", "old_place", "new_place", changed.alias("changed"), note.alias("note"))


def transition_audit(stored: DataFrame, rows: DataFrame, cluster: str = "minute_cluster") -> DataFrame:
    """Stored transition counts (session_key, transitions) against a recount from the minute rows."""
    w = Window.partitionBy("session_key").orderBy("minute_ts")
    moves = rows.select("session_key", (F.col(cluster) != F.lag(cluster).over(w)).cast("int").alias("c")).groupBy("session_key").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("recount"))
    j = stored.select("session_key", F.col("transitions").alias("stored")).join(moves, "session_key", "full_outer")
    return j.select("session_key", "stored", "recount", (~F.col("stored").eqNullSafe(F.col("recount"))).alias("mismatch"))


def sparse_cluster(sessions: DataFrame, cluster: str) -> DataFrame:
    """(cluster, score, sparse): how silent each cluster of sessions is, as the mean of five percentile ranks over the
    clusters; the highest, or the smaller number among equals, is the sparse one."""
    q = quantiles(sessions, ["gap_med", "zrun_max"], (0.5,), cluster)
    means = sessions.groupBy(cluster).agg(F.avg("zero_rate").alias("a"), (-F.avg("chat_mean")).alias("e"), (-F.avg(F.col("unique_sum") / F.col("n"))).alias("f")).collect()  # a few clusters
    rows = [(r[0], r["a"], *[(q.get((r[0], c)) or [None])[0] for c in ("gap_med", "zrun_max")], r["e"], r["f"]) for r in means]
    out = sessions.sparkSession.createDataFrame(rows, "cluster int, a double, b double, c double, e double, f double")
    ranked = [pct_of_few(x) for x in "abcef"]
    out = out.withColumn("score", sum(ranked[1:], ranked[0]) / 5)
    best = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "cluster"))
    return out.select("cluster", "score", (best == 1).alias("sparse"))
