"""Live collection: whose stamps are local time already, and whether a collection falls in a valid window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def _seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _hours(ts: Column, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(hours), ts)


def settle_stamps(df: DataFrame, keys: list[str], ts: str, now: str, hours: int) -> DataFrame:
    """Stamps that may be UTC or local time (UTC + hours). A group whose median stamp is nearer to its ``now`` as it is
    than moved by ``hours`` is local already: it is moved back, so that one shift fits all groups. Adds already_local.

    Null stamps stay null and don't count; a group without stamps or without a now is not local. The median is taken over
    a group's distinct stamps with their counts, of which a collection has one a minute at most.
    """
    counted = df.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"), F.max(now).alias("_now"))
    gap = lambda by: F.abs(F.col("_m") + by - _seconds(F.col("_now")))
    at = counted.groupBy(*keys).agg(F.percentile(_seconds(F.col(ts)), F.lit(0.5), F.col("_n")).alias("_m"), F.max("_now").alias("_now"))
    local = at.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.lit(bool(hours)) & (gap(0) < gap(3600 * hours))).alias("_local"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = df.join(local, same, "left").withColumn("already_local", F.coalesce("_local", F.lit(False)))
    return out.withColumn(ts, F.when(F.col("already_local"), _hours(F.col(ts), -hours)).otherwise(F.col(ts))).select(*df.columns, "already_local")


def live_windows(df: DataFrame, keys: list[str], ts: str, windows: tuple[tuple[int, int], ...], off_max: float = 0.0) -> DataFrame:
    """Per group: live_window (whole hours around its stamps, HH:mm-HH:mm), matched (number of the window that holds most
    of its stamps, the first of equals), off_rate (share outside it) and in_window (off_rate is at most off_max). A
    group without stamps has no window: null, null, 1 and false."""
    t = F.col(ts).cast("timestamp_ntz")
    m = S.minute_of_day(t)
    g = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.array(*[F.avg(S.in_window(m, *w).cast("double")) for w in windows]).alias("_r"))
    start = F.date_trunc("HOUR", "_a").cast("timestamp_ntz")
    late = F.timestamp_add("MINUTE", F.lit(1), F.col("_b"))
    floor = F.date_trunc("HOUR", late).cast("timestamp_ntz")
    end = F.when((floor == late) & (late > start), late).otherwise(_hours(floor, 1))
    top = F.array_max("_r")
    off = F.coalesce(1 - top, F.lit(1.0))
    label = F.concat_ws("-", F.date_format(start, "HH:mm"), F.date_format(end, "HH:mm"))
    return g.select(*keys, F.when(F.col("_a").isNotNull(), label).alias("live_window"), (F.array_position("_r", top) - 1).cast("int").alias("matched"), off.alias("off_rate"), (F.col("_a").isNotNull() & (off <= off_max)).alias("in_window"))


def planned_windows(df: DataFrame, keys: list[str], now: str, seconds: str, windows: tuple[tuple[int, int], ...], off_max: float = 0.0) -> DataFrame:
    """live_windows of the minutes that collections of so many seconds from ``now`` on would cover, both ends included;
    60 seconds at least."""
    start = F.date_trunc("MINUTE", now).cast("timestamp_ntz")
    minutes = F.ceil(F.greatest(F.col(seconds), F.lit(60)) / 60).cast("int")
    span = df.select(*keys, start.alias("_s"), F.explode_outer(F.sequence(F.lit(0), minutes)).alias("_i"))
    return live_windows(span.withColumn("_t", F.timestamp_add("MINUTE", F.col("_i"), F.col("_s"))), keys, "_t", windows, off_max)
