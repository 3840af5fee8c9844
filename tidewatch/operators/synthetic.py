"""Injected mismatch intervals, their recovery, permutation nulls of persistence, and integrity checks."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import overlap_hull

#: kind -> (viewers factor, chat factor)
KINDS = {"hi_view_low_chat": (2.0, 0.1), "silent_run": (1.0, 0.0), "view_spike_no_chat": (5.0, 0.0)}


def inject(state: DataFrame, least: int = 8) -> DataFrame:
    """One interval per session of at least least ticks: place, length and kind come from a hash of the session, so
    reruns and other engines agree. Adds injection_type, start_idx, end_idx, injected, and changed counts."""
    s = Window.partitionBy("session_key")
    h = F.conv(F.substring(F.md5("session_key"), 1, 8), 16, 10).cast("long")
    out = state.withColumn("_n", F.count(F.lit(1)).over(s)).filter(F.col("_n") >= least).withColumn("_h", h)
    names = F.array(*[F.lit(k) for k in KINDS])
    length = F.lit(3) + F.pmod(F.col("_h"), F.lit(3))
    out = out.withColumn("injection_type", F.get(names, F.pmod(F.col("_h"), F.lit(len(KINDS))).cast("int"))).withColumn("_len", length)
    out = out.withColumn("start_idx", F.lit(1) + F.pmod(F.expr("_h div 7"), F.col("_n") - F.col("_len") + 1)).withColumn("end_idx", F.col("start_idx") + F.col("_len") - 1)
    out = out.withColumn("injected", F.col("minute_idx").between(F.col("start_idx"), F.col("end_idx")))
    factor = lambda k: F.coalesce(*[F.when(F.col("injection_type") == name, F.lit(f[k])) for name, f in KINDS.items()])
    viewers = F.when(F.col("injected"), F.col("viewer") * factor(0)).otherwise(F.col("viewer"))
    chat = F.when(F.col("injected"), F.floor(F.col("chat_count") * factor(1))).otherwise(F.col("chat_count"))
    unique = F.when(F.col("injected"), F.floor(F.col("unique_chatters") * factor(1))).otherwise(F.col("unique_chatters"))
    return out.withColumns({"viewer": viewers, "chat_count": chat.cast("long"), "unique_chatters": unique.cast("long")}).drop("_n", "_h", "_len")


def recovery(injected: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """Injected against detected intervals per session: overlap over hull, and whether it reaches .3, .5 and .7."""
    a = injected.select(*keys, F.col("start_idx").alias("is"), F.col("end_idx").alias("ie"), "injection_type").distinct()
    j = a.join(detected.select(*keys, F.col("start_idx").alias("ds"), F.col("end_idx").alias("de")), keys, "left")
    iou = F.coalesce(overlap_hull(F.col("is"), F.col("ie"), F.col("ds"), F.col("de")), F.lit(0.0))
    return j.select(*keys, "injection_type", iou.alias("iou"), *[(iou >= t).alias(f"at_{int(t * 100)}") for t in (0.3, 0.5, 0.7)])


def recovery_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("injection_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("iou", F.lit(0.5)), 6).alias("iou_median"), *[F.round(F.avg(F.col(f"at_{t}").cast("double")), 6).alias(f"rate_{t}") for t in (30, 50, 70)])


def durations_of(flags: np.ndarray, merge_gap: int = 1) -> np.ndarray:
    """Lengths of the episodes of a row of flags; gaps of at most merge_gap are bridged."""
    at = np.flatnonzero(flags)
    if not len(at):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(at) > merge_gap + 1)
    return at[np.append(cut, len(at) - 1)] - at[np.concatenate([[0], cut + 1])] + 1


def _permuted(key: tuple, pdf: pd.DataFrame, cuts: dict[float, float], durations: tuple[int, ...], n_perm: int, merge_gap: int) -> pd.DataFrame:
    rank = pdf.sort_values("minute_idx")["rank"].to_numpy(float)
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(str(key[0]).encode()).digest()[:8], "little")))
    orders, out = [rng.permutation(len(rank)) for _ in range(n_perm)], []
    for q, cut in cuts.items():
        flags = rank >= cut
        seen, null = durations_of(flags, merge_gap), [durations_of(flags[o], merge_gap) for o in orders]
        top, tops = int(seen.max(initial=0)), np.array([x.max(initial=0) for x in null])
        for d in durations:
            out.append((key[0], q, d, int((seen >= d).sum()), float(np.mean([(x >= d).sum() for x in null])), float((tops >= d).mean()), top, float((1 + (tops >= top).sum()) / (1 + n_perm))))
    return pd.DataFrame(out, columns=["session_key", "q", "min_duration", "episodes", "null_episodes", "null_rate", "longest", "p"])


def persistence_null(scores: DataFrame, cuts: dict[float, float], durations: tuple[int, ...], n_perm: int = 100, merge_gap: int = 1, rank: str = "minute_mismatch_rank") -> DataFrame:
    """Per session, quantile (with its cut) and least duration: episodes against those of the flags in random order,
    how often the null has any, the longest episode and its p. One session is one group."""
    rows = scores.select("session_key", "minute_idx", F.col(rank).alias("rank"))
    job = partial(_permuted, cuts=cuts, durations=durations, n_perm=n_perm, merge_gap=merge_gap)
    return rows.groupBy("session_key").applyInPandas(lambda key, pdf: job(key, pdf), "session_key string, q double, min_duration long, episodes long, null_episodes double, null_rate double, longest long, p double")


def enrichment(null: DataFrame) -> DataFrame:
    """Per quantile and duration: episodes and sessions with any, seen and under the null, and their ratios."""
    out = null.groupBy("q", "min_duration").agg(F.sum("episodes").alias("episodes"), F.sum("null_episodes").alias("null_episodes"), F.avg((F.col("episodes") > 0).cast("double")).alias("session_rate"), F.avg("null_rate").alias("null_session_rate"), F.avg((F.col("p") <= 0.05).cast("double")).alias("p05_rate"))
    return out.withColumn("episode_ratio", F.try_divide("episodes", "null_episodes")).withColumn("session_ratio", F.try_divide("session_rate", "null_session_rate"))


def sanity_summary(injected: DataFrame, detected: DataFrame, order: DataFrame, keys: list[str], k: int = 100, enabled: bool = True) -> DataFrame:
    """One row: status, injected sessions, mean IoU, rate of IoU of a half or more, and recall among the k first of the
    order (session_key, review_order). not_run if switched off; not_run_stale_input if no injected session is scored."""
    scored = injected.select(*keys).distinct().join(detected.select(*keys).distinct(), keys, "left_semi").count() if enabled else 0
    spark, schema = injected.sparkSession, "status string, n long, iou_mean double, recovered_rate double, recall_at_k double"
    if not scored:
        return spark.createDataFrame([("not_run_stale_input" if enabled else "not_run", 0, None, None, None)], schema)
    r = recovery(injected, detected, keys)
    hit = r.join(order, keys, "left").agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("iou_mean"), F.avg(F.col("at_50").cast("double")).alias("recovered_rate"), F.avg(F.coalesce(F.col("review_order") <= k, F.lit(False)).cast("double")).alias("recall_at_k"))
    return hit.select(F.lit("ok").alias("status"), "n", "iou_mean", "recovered_rate", "recall_at_k")


def checks(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(check_name, violations, ok) of row predicates that should hold everywhere, in one pass."""
    row = df.agg(*[F.count_if(~F.coalesce(t, F.lit(False))).alias(f"_{i}") for i, t in enumerate(tests.values())])
    pairs = ", ".join(f"'{name}', _{i}" for i, name in enumerate(tests))
    return row.select(F.expr(f"stack({len(tests)}, {pairs}) as (check_name, violations)")).withColumn("ok", F.col("violations") == 0)
