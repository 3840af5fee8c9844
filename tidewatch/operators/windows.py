"""Window operators inside a session; every function takes the ordered window so that a stage sorts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("run_id", "broad_no")


def session_window(keys: tuple[str, ...] = KEYS, order: str = "minute_ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def delta(column: str, w: WindowSpec) -> Column:
    return F.col(column) - F.lag(column).over(w)


def gap_minutes(ts: str, w: WindowSpec) -> Column:
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return (seconds(F.col(ts)) - seconds(F.lag(ts).over(w))) / 60


def rolling(column: str, rows: int, w: WindowSpec, how: str = "avg") -> Column:
    """Over the last rows rows, nulls skipped; clock gaps are not looked at."""
    return getattr(F, how)(column).over(w.rowsBetween(-(rows - 1), 0))


def ffill(column: str, w: WindowSpec, limit: int | None = None) -> Column:
    before = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(column, ignorenulls=True).over(before)


def fill_both(column: str, w: WindowSpec) -> Column:
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(ffill(column, w), after)


def interpolate(df: DataFrame, column: str, name: str, w: WindowSpec) -> DataFrame:
    """Linear by row position between the nearest values on both sides; ends take the nearest value."""
    at = F.when(F.col(column).isNotNull(), F.col("_i"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("_i", F.row_number().over(w))
    out = out.select(
        "*", F.last(column, True).over(back).alias("_p"), F.first(column, True).over(ahead).alias("_n"), F.last(at, True).over(back).alias("_ip"), F.first(at, True).over(ahead).alias("_in")
    )
    line = F.when(F.col("_in") > F.col("_ip"), F.col("_p") + (F.col("_n") - F.col("_p")) * (F.col("_i") - F.col("_ip")) / (F.col("_in") - F.col("_ip")))
    return out.withColumn(name, F.coalesce(F.col(column), line, "_p", "_n")).drop("_i", "_p", "_n", "_ip", "_in")


def island(df: DataFrame, changed: Column, name: str, w: WindowSpec) -> DataFrame:
    """Numbers the runs of rows: a run begins where changed is true or unknown (the first row)."""
    flag = F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_begin", flag).withColumn(name, F.sum("_begin").over(w)).drop("_begin")


def run_length(df: DataFrame, flag: str, name: str, w: WindowSpec, gap: float | None = None, keys: tuple[str, ...] = KEYS, order: str = "minute_ts") -> DataFrame:
    """Position inside the current run of true flags, 0 outside; with gap, a clock gap over it begins a new run."""
    changed = F.col(flag) != F.lag(flag).over(w)
    if gap is not None:
        changed = changed | (gap_minutes(order, w) > gap)
    out = island(df, changed, "_island", w)
    place = F.row_number().over(Window.partitionBy(*keys, "_island").orderBy(order))
    return out.withColumn(name, F.when(F.col(flag), place).otherwise(0)).drop("_island")


def episodes(flagged: DataFrame, merge_gap: int, w: WindowSpec, index: str = "minute_idx") -> DataFrame:
    """Numbers the episodes of flagged rows: indices at most merge_gap + 1 apart belong together."""
    return island(flagged, (F.col(index) - F.lag(index).over(w)) > merge_gap + 1, "episode", w)


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order; null keys are one key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")
