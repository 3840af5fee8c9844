"""Adaptive scan statistic: the strongest contiguous interval of each session, and its permutation null.

Blocks are clock-contiguous stretches. The score of an interval of a block is the sum of its rows' z over the square
root of its length. One Arrow group holds one block: prefix sums give all intervals of one length at a time, so that
no pairs of rows are ever made. z is kept as whole billionths, so that sums are exact in any order. A block over
``max_rows`` rows is scanned at its first, its last and its max_rows best rows, as the method asks for; its null
permutes the whole block first and takes the same places afterwards.

The null's permutations come from arithmetic on the session, block, round and row numbers: reruns, other partitions
and other engines draw the same ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clock_minutes
from .ranks import places, quantile_row
from .windows import KEYS, gap_minutes, island, session_window

#: z is kept in this part of one.
UNIT = 1_000_000_000
#: A prime; the permutations' arithmetic is modulo it.
PRIME = 2_147_483_647


def blocks(scores: DataFrame, gap: float) -> DataFrame:
    w = session_window()
    return island(scores, gap_minutes("minute_ts", w) > gap, "block", w)


def _fifth(x: np.ndarray) -> np.ndarray:
    """x ** 5 modulo PRIME, one to one."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def permutation(session: str, block: int, turn: int, n: int) -> np.ndarray:
    """The places 0..n-1 in the order of a round (from 1) of the null."""
    seed = int(hashlib.md5(session.encode()).hexdigest()[:7], 16) + 7919 * block + 104_729 * turn
    key = _fifth((_fifth((seed + 15_485_863 * np.arange(1, n + 1, dtype=np.int64)) % PRIME) + 12_345) % PRIME)
    return key.argsort(kind="stable")


def best_scan(z: np.ndarray) -> tuple[float, int, int]:
    """The largest score of a vector of whole billionths, and the first interval (by start, then end) that has it."""
    c, best = np.concatenate([[0], np.cumsum(z)]), (-np.inf, 0, 0)
    for k in range(1, len(z) + 1):
        s = (c[k:] - c[:-k]).astype(float) / (UNIT * np.sqrt(float(k)))
        at = int(s.argmax())
        if s[at] > best[0] or s[at] == best[0] and (at, at + k - 1) < best[1:]:
            best = (float(s[at]), at, at + k - 1)
    return best


def largest_scans(z: np.ndarray) -> np.ndarray:
    """The largest score of each row of a matrix."""
    c, out = np.concatenate([np.zeros((len(z), 1), np.int64), np.cumsum(z, axis=1)], axis=1), np.full(len(z), -np.inf)
    for k in range(1, z.shape[1] + 1):
        np.maximum(out, ((c[:, k:] - c[:, :-k]).astype(float) / (UNIT * np.sqrt(float(k)))).max(axis=1), out=out)
    return out


_BLOCK = "run_id int, broad_no long, session_key string, block long, n long, start_idx int, end_idx int, start_ts timestamp_ntz, end_ts timestamp_ntz, duration long, scan_z double, null_mean double, null_p95 double, empirical_p double"


def _scan(t: pa.Table, n_perm: int, max_rows: int) -> pa.Table:
    t = t.sort_by([("minute_ts", "ascending")])
    z, n = t.column("z").to_numpy().astype(np.int64), len(t)
    keep = np.arange(n)
    if n > max_rows:
        keep = np.unique(np.concatenate([[0, n - 1], np.lexsort((np.arange(n), -z))[:max_rows]]))
    score, a, b = best_scan(z[keep])
    a, b = int(keep[a]), int(keep[b])
    first = {c: t.column(c)[0].as_py() for c in ("run_id", "broad_no", "session_key", "block")}
    null = np.zeros(0)
    if n_perm and n > 1:
        null = np.concatenate([largest_scans(np.array([z[permutation(first["session_key"], first["block"], r, n)][keep] for r in range(i + 1, min(i + 50, n_perm) + 1)])) for i in range(0, n_perm, 50)])
    at = lambda c, i: t.column(c)[i].as_py()
    row = first | {"n": n, "start_idx": at("minute_idx", a), "end_idx": at("minute_idx", b), "start_ts": at("minute_ts", a), "end_ts": at("minute_ts", b), "duration": b - a + 1, "scan_z": score}
    row |= {"null_mean": float(null.mean()), "null_p95": float(np.quantile(null, 0.95)), "empirical_p": float((1 + (null >= score).sum()) / (1 + len(null)))} if len(null) else dict.fromkeys(("null_mean", "null_p95", "empirical_p"))
    return pa.Table.from_pylist([row], pa.schema([("run_id", pa.int32()), ("broad_no", pa.int64()), ("session_key", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("start_idx", pa.int32()), ("end_idx", pa.int32()), ("start_ts", pa.timestamp("us")), ("end_ts", pa.timestamp("us")), ("duration", pa.int64()), ("scan_z", pa.float64()), ("null_mean", pa.float64()), ("null_p95", pa.float64()), ("empirical_p", pa.float64())]))


def scan_blocks(scores: DataFrame, gap: float, n_perm: int = 0, max_rows: int = 500) -> DataFrame:
    """One row per block: its best interval, and with n_perm the null's mean and 95 % quantile and the empirical p
    (1 + as many as reach the score) / (1 + n_perm); p is null for a block of one row. scores: z in whole billionths."""
    rows = blocks(scores, gap).select(*KEYS, "session_key", "block", "minute_idx", "minute_ts", "z")
    return rows.groupBy(*KEYS, "session_key", "block").applyInArrow(lambda t: _scan(t, n_perm, max_rows), _BLOCK)


def best_intervals(scores: DataFrame, gap: float, n_perm: int = 0, max_rows: int = 500) -> DataFrame:
    """The best block of each session: the smallest p (none comes last), then the largest score, then the first."""
    w = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_last("empirical_p"), F.desc("scan_z"), "block")
    found = scan_blocks(scores, gap, n_perm, max_rows)
    return found.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k").withColumn("clock_minutes", clock_minutes(F.col("start_ts"), F.col("end_ts")))


#: metric of an interval -> column of its rows, whose mean it is
MEANS = {
    "rank_mean": "minute_mismatch_rank", "chat_deficit_mean": "chat_deficit", "unique_deficit_mean": "unique_deficit", "model_chat_mean": "model_chat_deficit",
    "model_unique_mean": "model_unique_deficit", "state_rate": "mismatch_state", "rolling_chat_mean": "rolling_chat_deficit_5m", "rolling_zero_mean": "rolling_zero_rate_5m",
}


def interval_metrics(intervals: DataFrame, state: DataFrame, gap: float) -> DataFrame:
    """Means and extremes of the state rows inside each session's interval (equi join with a range condition), and the
    clock gaps between its rows. Columns that the state lacks give null."""
    w = session_window()
    rows = state.withColumn("_gap", gap_minutes("minute_ts", w)).join(intervals.select(*KEYS, "start_idx", "end_idx"), list(KEYS)).filter("minute_idx between start_idx and end_idx")
    inner = F.when(F.col("minute_idx") > F.col("start_idx"), F.col("_gap"))
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("minutes"), F.percentile("minute_mismatch_rank", F.lit(0.95)).alias("rank_p95"), F.avg(F.col("zero_chat").cast("double")).alias("zero_rate"), F.max("zero_run_len").alias("max_zero_run"),
        *[(F.avg(F.col(c).cast("double")) if c in state.columns else F.lit(None).cast("double")).alias(name) for name, c in MEANS.items()],
        F.count_if(inner > gap).alias("clock_gaps"), F.coalesce(F.max(inner), F.lit(0.0)).alias("max_clock_gap"),
    )


def episode_grid(scores: DataFrame, quantiles: tuple[float, ...], durations: tuple[int, ...], merge_gap: int = 1, rank: str = "minute_mismatch_rank") -> DataFrame:
    """Episodes of minutes at or above each quantile, lasting at least each duration; the grid is a few rows."""
    cuts = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(c).cast("double").alias("cutoff")) for q, c in zip(quantiles, quantile_row(scores, [rank], quantiles)[rank], strict=True)])
    hot = scores.select(*KEYS, "minute_idx", rank, F.explode(cuts).alias("_c")).select(*KEYS, "minute_idx", rank, "_c.*").filter(F.col(rank) >= F.col("cutoff"))
    w = Window.partitionBy(*KEYS, "q").orderBy("minute_idx")
    hot = island(hot, (F.col("minute_idx") - F.lag("minute_idx").over(w)) > merge_gap + 1, "episode", w)
    eps = hot.groupBy(*KEYS, "q", "episode").agg(F.min("minute_idx").alias("start_idx"), F.max("minute_idx").alias("end_idx"), F.count(F.lit(1)).alias("hot_minutes"))
    eps = eps.withColumn("duration", F.col("end_idx") - F.col("start_idx") + 1)
    return eps.withColumn("min_duration", F.explode(F.array(*[F.lit(d) for d in durations]))).filter("duration >= min_duration")


def _episodes(scores: DataFrame, quantiles: tuple[float, ...], durations: tuple[int, ...], rank: str) -> DataFrame:
    top = scores.select(*KEYS, "session_key", "minute_idx", F.col(rank).alias("_r"))
    e = episode_grid(scores, quantiles, durations, rank=rank)
    j = e.alias("e").join(top.alias("t"), (F.col("e.run_id") == F.col("t.run_id")) & (F.col("e.broad_no") == F.col("t.broad_no")) & F.col("t.minute_idx").between(F.col("e.start_idx"), F.col("e.end_idx")))
    return j.groupBy("e.run_id", "t.session_key", "q", "min_duration", "episode").agg(F.first("duration").alias("duration"), F.max("_r").alias("top"))


def candidates(scores: DataFrame, quantiles: tuple[float, ...], durations: tuple[int, ...], rank: str = "minute_mismatch_rank") -> DataFrame:
    """Per cell of the grid, sessions with episodes in order: share of minutes in episodes, best score, 95 % quantile,
    number of episodes."""
    m = scores.groupBy("session_key").agg(F.count(F.lit(1)).alias("n"), F.percentile(rank, F.lit(0.95)).alias("p95"))  # a session's ticks
    a = _episodes(scores, quantiles, durations, rank).groupBy("session_key", "q", "min_duration").agg(F.count(F.lit(1)).alias("episodes"), F.sum("duration").alias("total"), F.max("top").alias("top"))
    out = a.join(m, "session_key").withColumn("ratio", F.col("total") / F.col("n"))
    order = [F.desc("q"), F.desc("min_duration"), F.desc(F.round("ratio", 9)), F.desc(F.round("top", 9)), F.desc(F.round("p95", 9)), F.desc("episodes"), F.asc("session_key")]
    out = places(out, order, "_all")  # cells follow each other in one order
    first = out.groupBy("q", "min_duration").agg((F.min("_all") - 1).alias("_before"))
    return out.join(F.broadcast(first), ["q", "min_duration"]).withColumn("place", F.col("_all") - F.col("_before")).drop("_all", "_before", "n")


def stability(scores: DataFrame, quantiles: tuple[float, ...], durations: tuple[int, ...], rank: str = "minute_mismatch_rank") -> DataFrame:
    """Episodes and sessions with any per quarter of the runs and cell of the grid, cells without any as 0."""
    quarters = scores.select("run_id").distinct().withColumn("quarter", F.ntile(4).over(Window.orderBy("run_id")))  # one row per run
    quarters = F.broadcast(quarters)
    n = scores.join(quarters, "run_id").groupBy("quarter").agg(F.count_distinct("session_key").alias("_n"))
    lits = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    grid = n.withColumn("q", lits(quantiles)).withColumn("min_duration", lits(durations))
    a = _episodes(scores, quantiles, durations, rank).join(quarters, "run_id").groupBy("quarter", "q", "min_duration").agg(F.count(F.lit(1)).alias("episodes"), F.count_distinct("session_key").alias("sessions"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return grid.join(a, ["quarter", "q", "min_duration"], "left").select("quarter", "q", "min_duration", zero("episodes"), zero("sessions"), (F.coalesce("sessions", F.lit(0)) / F.col("_n")).alias("rate"))
