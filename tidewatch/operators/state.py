"""Minute state: indices, logs, runs, expected response by audience bin, deficits, mismatch score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import arg_max, row_mean
from ..sources.steps import written
from .ranks import average_percentiles, cut_or_nearest, pct_rank, pct_ranks, places, qcut, qcut_edges, quantiles
from .windows import gap_minutes, interpolate, rolling, run_length, session_window

SIGNALS = ("chat_deficit", "unique_deficit", "rolling_chat_deficit_5m", "rolling_unique_deficit_5m", "rolling_zero_rate_5m", "zero_run_len")


def clean_viewers(minute: DataFrame) -> DataFrame:
    """Viewers that are not positive are unknown; unknown ones are interpolated inside the session. v_miss tells."""
    raw = minute.withColumn("v_miss", F.coalesce(F.col("viewer_count_last") <= 0, F.lit(True)))
    raw = raw.withColumn("_v", F.when(F.col("viewer_count_last") > 0, F.col("viewer_count_last")))
    return interpolate(raw, "_v", "viewer", session_window()).drop("_v")


def minute_state(minute: DataFrame, gap_minutes: float, bins: int = 10) -> DataFrame:
    """All state columns. Bins and medians come from sessions that chat at all; the edges are a few numbers."""
    w = session_window()
    out = clean_viewers(minute).withColumn("minute_idx", F.row_number().over(w))
    out = _logs(out, gap_minutes)
    out = out.withColumn("all_zero", F.max("chat_count").over(Window.partitionBy("run_id", "broad_no")) == 0)
    model = out.filter("not all_zero")
    edges = qcut_edges(model, "viewer", bins)
    out = out.withColumn("viewer_bin", qcut(F.col("viewer"), edges))
    return _deficits(out, out.filter("not all_zero"))


def _logs(out: DataFrame, gap_minutes: float) -> DataFrame:
    out = out.select("*", F.log1p("viewer").alias("log_viewer"), F.log1p("chat_count").alias("log_chat"), F.log1p("unique_chatters").alias("log_unique"), (F.col("chat_count") == 0).alias("zero_chat"))
    return run_length(out, "zero_chat", "zero_run_len", session_window(), gap_minutes)


def _deficits(out: DataFrame, model: DataFrame) -> DataFrame:
    """Deficits against the medians that the model's rows have in each bin, and what rolls over them."""
    w, logs = session_window(), {"chat": "log_chat", "unique": "log_unique"}
    per_bin, overall = quantiles(model, list(logs.values()), (0.5,), "viewer_bin"), quantiles(model, list(logs.values()), (0.5,))
    bins = sorted({b for b, _ in per_bin if b is not None})  # ten at most

    def expected(column: str):
        mid = lambda b: F.lit((per_bin.get((b, column)) or [None])[0]).cast("double")
        out = F.when(F.col("viewer_bin").isNull(), mid(None))
        for b in bins:
            out = out.when(F.col("viewer_bin") == b, mid(b))
        return F.coalesce(out, F.lit((overall.get((None, column)) or [None])[0]).cast("double"))

    out = out.select("*", *[(expected(c) - F.col(c)).alias(f"{name}_deficit") for name, c in logs.items()])
    out = out.withColumn("_z", F.col("zero_chat").cast("double"))
    for k in (5, 10):
        out = out.select(
            "*", rolling("chat_deficit", k, w).alias(f"rolling_chat_deficit_{k}m"), rolling("unique_deficit", k, w).alias(f"rolling_unique_deficit_{k}m"),
            rolling("_z", k, w).alias(f"rolling_zero_rate_{k}m"), rolling("chat_count", k, w, "sum").alias(f"rolling_chat_sum_{k}m"),
        )
    return out.drop("_z")


def mismatch_scores(state: DataFrame, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Mean of the signals' percentile ranks, and its own rank; the strongest signal is the reason."""
    out = pct_ranks(state, {f"r_{s}": s for s in signals}, 9)
    ranks = {s: F.col(f"r_{s}") for s in signals}
    out = out.withColumn("minute_mismatch_score", F.round(row_mean(list(ranks.values())), 12)).withColumn("reason", arg_max(ranks))
    out = written(out, "mismatch")  # the rank reads it three times
    return pct_rank(out, "minute_mismatch_score", "minute_mismatch_rank")


def injected_state(injected: DataFrame, real: DataFrame, gap_minutes: float, bins: int = 10) -> DataFrame:
    """State columns of changed rows, anew from their counts; bins and medians are those of the real rows' state. An
    audience beyond the real edges takes its session's bin before it, else the one after it."""
    model = real.filter("not all_zero")
    out = _logs(injected.select("run_id", "broad_no", "session_key", "minute_ts", "minute_idx", "viewer", "chat_count", "unique_chatters"), gap_minutes)
    return _deficits(out.withColumn("viewer_bin", cut_or_nearest(F.col("viewer"), qcut_edges(model, "viewer", bins), session_window())), model)


def injected_scores(state: DataFrame, real: DataFrame, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Mismatch score of changed rows by their place among the real rows' signals; injected_ranks ranks the score."""
    nine = lambda df: df.withColumns({f"_s_{s}": F.round(F.col(s).cast("double"), 9) for s in signals})
    out, ref = nine(state), nine(real)
    out = average_percentiles(out, ref, {f"r_{s}": f"_s_{s}" for s in signals})
    out = out.withColumn("minute_mismatch_score", F.round(row_mean([F.col(f"r_{s}") for s in signals]), 12)).drop(*[f"_s_{s}" for s in signals])
    return out


def injected_ranks(scores: DataFrame, real: DataFrame) -> DataFrame:
    return average_percentiles(scores, real, {"minute_mismatch_rank": "minute_mismatch_score"})


def session_summary(state: DataFrame, min_n: int = 10) -> DataFrame:
    """One row per session with eligibility; sessions without chat or with too few ticks are not eligible."""
    med = lambda c: F.percentile(c, F.lit(0.5))
    out = state.groupBy("run_id", "broad_no", "session_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("minute_ts").alias("start_ts"), F.max("minute_ts").alias("end_ts"), med("viewer").alias("viewer_median"), F.max("viewer").alias("viewer_max"),
        F.sum("chat_count").alias("chat_sum"), F.avg("chat_count").alias("chat_mean"), F.sum("unique_chatters").alias("unique_sum"), F.avg(F.col("zero_chat").cast("double")).alias("zero_rate"),
        F.max("zero_run_len").alias("zrun_max"), med(F.col("log_viewer") - F.col("log_chat")).alias("gap_med"), F.bool_and("zero_chat").alias("all_zero"),
        F.avg(F.col("v_miss").cast("double")).alias("v_miss_rate"), F.min_by("category_id", F.when(F.col("category_id").isNotNull(), F.col("minute_ts"))).alias("category_id"),
    )
    reasons = F.concat_ws(";", F.when(F.col("n") < min_n, "short_session"), F.when(F.col("all_zero"), "all_zero_chat"))
    return out.withColumn("eligible", (F.col("n") >= min_n) & ~F.col("all_zero")).withColumn("eligibility_reason", F.when(reasons == "", "eligible").otherwise(reasons))


def rule_scores(sessions: DataFrame) -> DataFrame:
    """Directional rule score of eligible sessions: mean percentile rank of five measures; order by score."""
    e = sessions.filter("eligible").withColumns({"_nc": -F.col("chat_mean"), "_nu": -F.col("unique_sum") / F.col("n")})
    parts = {f"p_{c.strip('_')}": c for c in ("zero_rate", "gap_med", "zrun_max", "_nc", "_nu")}
    e = pct_ranks(e, parts, 9).drop("_nc", "_nu")
    e = e.withColumn("rule_score", F.round(row_mean([F.col(p) for p in parts]), 9))
    return places(e, [F.desc("rule_score"), F.asc("session_key")], "review_order")


def eligibility(sessions: DataFrame, min_n: int = 10) -> DataFrame:
    """Adds ok and the reason: enough ticks, no audience fault (v_qc) and not silent throughout."""
    reasons = F.concat_ws(";", F.when(F.col("n").isNull(), "missing_n").when(F.col("n") < min_n, f"n_below_min_n_{min_n}"), F.when(F.col("v_qc"), "v_qc_nonzero"), F.when(F.col("all_zero"), "all_zero_session"))
    return sessions.withColumn("ok", reasons == "").withColumn("reason", F.when(reasons == "", "eligible").otherwise(reasons))


def row_qc(state: DataFrame, gap: float) -> DataFrame:
    """Rows with any of five faults, and which."""
    w = session_window()
    tests = {"v_miss": F.col("v_miss"), "chat_below_unique": F.col("chat_count") < F.col("unique_chatters"), "v_edge": (F.col("minute_idx") == 1) & F.col("v_miss"), "clock_gap": gap_minutes("minute_ts", w) > gap, "negative": F.col("chat_count") < 0}
    return state.withColumn("flags", F.concat_ws(";", *[F.when(t, name) for name, t in tests.items()])).filter("flags <> ''")


def qc_zero_sessions(state: DataFrame) -> DataFrame:
    """One row per session without any chat."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("minute_ts"))).alias(c)
    return state.filter("all_zero").groupBy("run_id", "broad_no", "session_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("minute_ts").alias("start_ts"), F.max("minute_ts").alias("end_ts"), F.percentile("viewer", F.lit(0.5)).alias("viewer_median"), F.max("viewer").alias("viewer_max"),
        F.avg(F.col("v_miss").cast("double")).alias("v_miss_rate"), F.sum("chat_count").alias("total_chat"), F.sum("unique_chatters").alias("total_unique"), F.bool_and("zero_chat").alias("all_zero_chat"), first("category_id"),
    )


def case_features(state: DataFrame) -> DataFrame:
    """Per session: the audience's range, the share of ticks with chat, and the longest silence whatever the clock."""
    s = run_length(state.select("run_id", "broad_no", "session_key", "minute_ts", "viewer", "chat_count", "zero_chat"), "zero_chat", "_z", session_window())
    return s.groupBy("session_key").agg((F.max("viewer") - F.min("viewer")).alias("viewer_range"), F.avg((F.col("chat_count") > 0).cast("double")).alias("chat_positive"), F.max("_z").alias("longest_zero"))
