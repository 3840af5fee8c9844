"""Expressions over one row. All stay inside Spark's code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_str(value: Column) -> Column:
    """Canonical id: trimmed, '' as null, whole numbers written as such ('1101.0' -> '1101')."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    near = F.floor(number)
    whole = F.abs(number - near) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(near)
    return F.when(text == "", None).when(whole & (F.abs(number) < 9e15), F.round(number).try_cast("bigint").cast("string")).otherwise(text)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def ieee_div(num: Column, den: Column) -> Column:
    """num / den over doubles as SQL engines without ANSI errors have it: x / 0 is infinite, 0 / 0 is NaN."""
    return F.when(den != 0, num / den).when(den == 0, num.cast("double") * F.lit(float("inf")))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value if low is None else F.greatest(value, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def finite(value: Column) -> Column:
    """NaN and infinities as null: the boundary rule for every double that enters."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_window(minute: Column, start: int, end: int, tolerance: int = 0) -> Column:
    """Minute of day inside [start - tolerance, end + tolerance], both ends in, across midnight if need be."""
    low, high = start - tolerance, end + tolerance
    if end < start:
        high += 1440
    inside = F.lit(False)
    for shift in (-1440, 0, 1440):
        inside = inside | minute.between(low + shift, high + shift)
    return inside


def level(top_percent: Column) -> Column:
    return F.when(top_percent <= 1, "very_high").when(top_percent <= 5, "high").when(top_percent <= 10, "elevated").when(top_percent <= 25, "watch").otherwise("normal")


def order_bucket(order: Column) -> Column:
    return F.when(order <= 20, "top20").when(order <= 50, "top50").when(order <= 100, "top100").when(order <= 200, "top200").otherwise("rest")


def arg_max(named: dict[str, Column], default: str = "insufficient_signal") -> Column:
    """The first name with the largest value; nulls never win."""
    top = F.greatest(*named.values()) if len(named) > 1 else next(iter(named.values()))
    out = F.when(top.isNull(), default)
    for name, value in named.items():
        out = out.when(value == top, name)
    return out.otherwise(default)


def _known(columns: list[Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))


def row_values(columns: list[Column]) -> Column:
    """The non-null values of several columns, ascending. No lambda: those are interpreted value by value."""
    return F.slice(F.sort_array(F.array(*columns)), len(columns) - _known(columns) + 1, _known(columns))  # nulls come first


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-null values, added in the columns' order."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    n = _known(columns)
    return F.when(n > 0, total / n)


def _total(values: list[Column]) -> Column:
    """Sum of the values in order, null as nothing."""
    return sum((F.coalesce(x, F.lit(0.0)) for x in values), F.lit(0.0))


def _positive(n: Column) -> Column:
    return F.when(n > 0, n)


def row_median(columns: list[Column]) -> Column:
    v, n = row_values(columns), _known(columns)
    return (F.get(v, F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def row_trimmed_mean(columns: list[Column]) -> Column:
    """Mean without the smallest and the largest value where there are more than two."""
    v, n = row_values(columns), _known(columns)
    off = (n > 2).cast("int")
    return _total([F.when(off <= i, F.when(n - off > i, F.get(v, F.lit(i)))) for i in range(len(columns))]) / _positive(n - 2 * off)


def row_std(columns: list[Column]) -> Column:
    v, n = row_values(columns), _known(columns)
    at = [F.get(v, F.lit(i)) for i in range(len(columns))]
    mean = _total(at) / _positive(n)
    return F.sqrt(_total([(x - mean) * (x - mean) for x in at]) / _positive(n))


def row_entropy(columns: list[Column]) -> Column:
    """Shannon entropy of the values' shares over log(count); null without a positive sum or with one value."""
    v = row_values(columns)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(F.filter(v, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / total * F.log(x / total))
    return F.when((total > 0) & (F.size(v) > 1), h / F.log(F.size(v).cast("double")))


def row_count_at_least(columns: list[Column], threshold: float) -> Column:
    return sum((F.coalesce((c >= threshold).cast("long"), F.lit(0)) for c in columns), F.lit(0)).cast("long")


#: Coefficients of a published rational approximation of the normal quantile (relative error 1.15e-9).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def ppf_sql(p: str) -> str:
    """The normal quantile of 0 < p < 1 as an SQL expression that Spark and others evaluate alike."""
    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    low, high = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))"
    tail = lambda t: f"({_poly(PPF_C, t)} / ({_poly(PPF_D, t)} * {t} + 1e0))"
    return f"(CASE WHEN {p} < 0.02425e0 THEN {tail(low)} WHEN {p} <= 0.97575e0 THEN {_poly(PPF_A, r)} * {q} / ({_poly(PPF_B, r)} * {r} + 1e0) ELSE -{tail(high)} END)"


def rank_z_sql(rank: str, rows: str) -> str:
    """z of a percentile rank among so many rows: the normal quantile of the rank, which stays 1 / (rows + 1) away
    from 1; a rank within that of 0, or no rank, scores 0."""
    eps = f"(1e0 / ({rows} + 1))"
    u = f"(1e0 - greatest(least(1e0 - coalesce({rank}, 0e0) + {eps}, 1e0), {eps}))"
    return f"(CASE WHEN {u} <= 0e0 THEN 0e0 ELSE {ppf_sql(u)} END)"


def rra_p(ranks: list[Column]) -> Column:
    """Robust rank aggregation over m normalised ranks in (0, 1], null as 1: m times the smallest tail probability
    P(Beta(i, m - i + 1) <= r_(i)) over the sorted ranks, at most 1."""
    m = len(ranks)
    v = F.array_sort(F.array(*[F.coalesce(r, F.lit(1.0)) for r in ranks]))
    tails = []
    for i in range(1, m + 1):
        r = F.get(v, F.lit(i - 1))
        tails.append(sum((F.lit(float(math.comb(m, j))) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(i, m + 1)), F.lit(0.0)))
    return clip(F.lit(float(m)) * (F.least(*tails) if m > 1 else tails[0]), 0.0, 1.0)


def clock_minutes(start: Column, end: Column) -> Column:
    """Minutes from the start of the first minute to the end of the last."""
    return (F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 60 + 1


def time_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over union hull of two inclusive minute intervals given by their first and last minutes."""
    inter = F.greatest(clock_minutes(F.greatest(start_a, start_b), F.least(end_a, end_b)), F.lit(0.0))
    return inter / clock_minutes(F.least(start_a, start_b), F.greatest(end_a, end_b))


def overlap_hull(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over hull of two inclusive index intervals."""
    inter = F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1, F.lit(0))
    return inter / (F.greatest(end_a, end_b) - F.least(start_a, start_b) + 1)
