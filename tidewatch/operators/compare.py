"""Difference of two tables by key, with a tolerance for numbers, and checks over columns' names and types.

Rows meet in ranges of their first key. A range's rows are counted and hashed in a first pass that shuffles one row per
range; only ranges whose hashes differ are read again, by filters on the key that reach the scan, and compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import value_bounds, value_range

#: Ranges of the first key.
RANGES = 256
#: Parts of names that features may not have: they come from the scores that a model should predict. Fixed values.
LEAK_STARTS, LEAK_PARTS = ("m2_",), ("_m2", "review", "rra", "score", "probability", "label")


def leak_columns(df: DataFrame) -> list[str]:
    """Columns whose names, whatever their case, say that they come from a score or a label."""
    return [c for c in df.columns if c.lower().startswith(LEAK_STARTS) or any(p in c.lower() for p in LEAK_PARTS)]


def schema_difference(old: DataFrame, new: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, old type, new type) of the columns that one table lacks or that have another type."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    return [(c, a.get(c), b.get(c)) for c in dict.fromkeys([*old.columns, *new.columns]) if a.get(c) != b.get(c)]


def _same(a: Column, b: Column, kind: T.DataType, rtol: float, atol: float) -> Column:
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return a.eqNullSafe(b)
    x, y = a.cast("double"), b.cast("double")
    near = (F.abs(x - y) <= atol + rtol * F.greatest(F.abs(x), F.abs(y))) & (F.abs(x) < math.inf) & (F.abs(y) < math.inf)
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def _hashed(df: DataFrame, columns: list[str], place: Column) -> DataFrame:
    row = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    return df.groupBy(place.alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.sum(row.cast("decimal(20,0)")).alias("_sum"), F.bit_xor(row).alias("_xor"))


def unequal_ranges(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], ranges: int = RANGES) -> tuple[Column, Column, list[int]]:
    """What deals a row to a range of the first key, a filter for the unequal ranges that a scan can take, and those
    ranges. Numbers and times are dealt by value, other keys by hash, whose filter no scan can take."""
    first, kind = F.col(keys[0]), old.schema[keys[0]].dataType
    if isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
        bounds = [kind.fromInternal(x) if isinstance(kind, T.IntegralType) else x for x in value_bounds(old, [keys[0]], ranges)[keys[0]]]
        place = F.when(first.isNotNull(), value_range(first, bounds)).otherwise(-1)
    else:
        bounds, place = None, F.pmod(F.xxhash64(first), F.lit(ranges)).cast("int")
    a, b = _hashed(old, columns, place).alias("a"), _hashed(new, columns, place).alias("b")
    unlike = F.lit(False)
    for c in ("_n", "_sum", "_xor"):
        unlike = unlike | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    open_ = sorted(r[0] for r in a.join(b, F.col("a._range") == F.col("b._range"), "full_outer").filter(unlike).select(F.coalesce("a._range", "b._range")).collect())
    if bounds is None:
        return place, place.isin(open_), open_
    where = F.lit(False)
    for start in [r for r in open_ if r - 1 not in open_ or r == 0]:
        end = start
        while end + 1 in open_ and end >= 0:
            end += 1
        if start < 0:
            where = where | first.isNull()
            continue
        low = F.lit(True) if start == 0 or not bounds else first > bounds[start - 1]
        high = F.lit(True) if end >= len(bounds) else first <= bounds[end]
        where = where | (first.isNotNull() & low & high)
    return place, where, open_


def difference(old: DataFrame, new: DataFrame, keys: list[str], rtol: float = 1e-9, atol: float = 0.0, ranges: int = RANGES) -> DataFrame:
    """What differs between two tables: keys, kind, column_name, old_value, new_value.

    kind is added or removed (a row; the column is null), changed (a value) or repeated (a key that one of the tables
    has several times in a range that isn't equal throughout; it is not compared further). Floating-point values are
    equal within atol + rtol * the larger magnitude; NaN equals NaN, null equals null, an infinity itself. Null keys
    match null keys. Columns that only one table has are left to ``schema_difference``; a shared column with two types
    is compared as text. Two empty tables have no difference.
    """
    kinds = {f.name: f.dataType for f in old.schema}
    shared = [c for c in old.columns if c in new.columns]
    values = [c for c in shared if c not in keys]
    other = {c for c in values if kinds[c] != new.schema[c].dataType}
    a, b = (df.select([F.col(c).cast("string").alias(c) if c in other else F.col(c) for c in shared]) for df in (old, new))
    kinds |= dict.fromkeys(other, T.StringType())
    _, where, _ = unequal_ranges(a, b, keys, shared, ranges)

    def side(df: DataFrame, tag: str) -> DataFrame:
        named = [F.col(k).alias(f"_{tag}{i}") for i, k in enumerate(keys)]
        row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)], F.lit(1).alias("there"))
        return df.filter(where).groupBy(*named).agg(F.count(F.lit(1)).alias(f"_n{tag}"), F.first(row).alias(f"_{tag}"))

    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    both = side(a, "a").join(side(b, "b"), on, "full_outer")
    text = lambda c: F.col(c).cast("string")
    diff = lambda kind, name=None, x=None, y=None: F.struct(F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("column_name"), (x if x is not None else F.lit(None).cast("string")).alias("old_value"), (y if y is not None else F.lit(None).cast("string")).alias("new_value"))
    changed = F.array(*[F.when(~_same(F.col(f"_a.v{i}"), F.col(f"_b.v{i}"), kinds[c], rtol, atol), diff("changed", c, text(f"_a.v{i}"), text(f"_b.v{i}"))) for i, c in enumerate(values)])
    found = F.when((F.col("_na") > 1) | (F.col("_nb") > 1), F.array(diff("repeated"))).when(F.col("_na").isNull(), F.array(diff("added"))).when(F.col("_nb").isNull(), F.array(diff("removed")))
    found = found.otherwise(F.filter(changed, lambda x: x.isNotNull())) if values else found
    own = [F.when(F.col("_na").isNotNull(), F.col(f"_a{i}")).otherwise(F.col(f"_b{i}")).alias(k) for i, k in enumerate(keys)]
    return both.select(*own, F.explode(found).alias("_d")).select(*keys, "_d.*")
