"""Ranks over whole tables and groups.

A rank over a whole table is taken on the histogram of distinct values, dealt to ranges of values: each range sums
its own counts, and only one total per range meets in one place. Quantiles are exact and come from brackets that are
narrowed by aggregation until few values are left in them. No operator here sorts all rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.steps import written

RANGES = 32


def value_bounds(df: DataFrame, columns: list[str], ranges: int = RANGES) -> dict[str, list[float]]:
    """Per column, the distinct approximate quantiles that cut its ranges: one action, a few numbers to the driver."""
    at = [i / ranges for i in range(1, ranges)]
    found = df.agg(*[F.percentile_approx(c, at, 2000).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted(set(found[i] or [])) for i, c in enumerate(columns)}


def value_range(column: Column, bounds: list[float]) -> Column:
    """The number of bounds below the value. The value stands once in the expression, however it is computed."""
    return F.size(F.filter(F.lit(bounds), lambda b: b < column)) if bounds else F.lit(0)


def cumulative(df: DataFrame, order: str, values: dict[str, str], bounds: list[float] | None = None) -> DataFrame:
    """Adds to each row (distinct in order) the sums of columns up to and with it; values: new name -> column."""
    bounds = value_bounds(df, [order])[order] if bounds is None else bounds
    ranged = df.withColumn("_range", value_range(F.col(order), bounds))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(values.values())])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(values))])
    run = Window.partitionBy("_range").orderBy(order)
    out = ranged.join(F.broadcast(offsets), "_range")
    out = out.select("*", *[(F.sum(c).over(run) + F.col(f"_o{i}")).alias(name) for i, (name, c) in enumerate(values.items())])
    return out.drop("_range", *[f"_o{i}" for i in range(len(values))])


#: A bracket with more rows than this is narrowed; the values of one with fewer are sorted by one task.
BRACKET_ROWS = 1_000_000
#: Share of a bracket's rows on either side that the next one keeps; percentile_approx is off by 1 in 10,000 at most.
MARGIN = 0.001


@dataclass
class _Bracket:
    group: object
    column: int
    at: float
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...], group: str | None = None, most: int = BRACKET_ROWS) -> dict:
    """Exact quantiles with linear interpolation: {(group, column): [value per at]}, None without values.

    group: a column of few values (bins, flags). Only aggregates and the brackets' last few values leave the tasks.
    """
    g = F.col(group) if group else F.lit(0)
    values = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(g.alias("g"), F.explode(values).alias("x")).select("g", "x.c", "x.v").filter("v is not null")
    counts = {(r["g"], r["c"]): r["n"] for r in long.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")).collect()}
    brackets = [_Bracket(g, c, (n - 1) * q, inside=n) for (g, c), n in counts.items() for q in at]
    if not brackets:
        return {}
    spark, kind = df.sparkSession, long.schema["g"].dataType.simpleString()

    def inside(low: bool = False) -> DataFrame:
        """The values in each bracket (or below it)."""
        rows = [(i, b.group, b.column, b.low, b.high) for i, b in enumerate(brackets)]
        table = spark.createDataFrame(rows, f"b int, g2 {kind}, c2 int, low double, high double")
        same = F.col("g").eqNullSafe(F.col("g2")) & (F.col("c") == F.col("c2"))
        return long.join(F.broadcast(table), same & ((F.col("v") < F.col("low")) if low else (F.col("low").isNull() | F.col("v").between(F.col("low"), F.col("high")))))

    wide = [i for i, b in enumerate(brackets) if b.inside > most]
    while wide:
        share = [(b.at - b.below) / max(1, b.inside - 1) for b in brackets]
        sketch = {r["b"]: r["e"] for r in inside().groupBy("b").agg(F.percentile_approx("v", [i / 1000 for i in range(1001)], 10_000).alias("e")).collect()}
        for i in wide:
            brackets[i].low, brackets[i].high = sketch[i][max(0, floor((share[i] - MARGIN) * 1000))], sketch[i][min(1000, ceil((share[i] + MARGIN) * 1000))]
        before = [b.inside for b in brackets]
        below, within = ({r["b"]: r["n"] for r in inside(low).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()} for low in (True, False))
        for i, b in enumerate(brackets):
            b.below, b.inside = below.get(i, 0), within[i]
        wide = [i for i in wide if most < brackets[i].inside < before[i] and brackets[i].low != brackets[i].high]
    run = Window.partitionBy("b").orderBy("v")
    hist = inside().groupBy("b", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(run))
    want = F.array(*[F.struct(F.lit(floor(b.at) - b.below).alias("a"), F.lit(ceil(b.at) - b.below).alias("z")) for b in brackets])
    hist = hist.withColumn("w", F.get(want, F.col("b")))
    has = lambda f: F.max(F.when((F.col(f"w.{f}") < F.col("upto")) & (F.col(f"w.{f}") >= F.col("upto") - F.col("n")), F.col("v"))).alias(f)
    found = {r["b"]: (r["a"], r["z"]) for r in hist.groupBy("b").agg(has("a"), has("z")).collect()}
    out: dict = {}
    for i, b in enumerate(brackets):
        (low, high), part = found[i], b.at - floor(b.at)
        out.setdefault((b.group if group else None, columns[b.column]), []).append(low if low == high else low + (high - low) * part)
    return out


def quantile_row(df: DataFrame, columns: list[str], at: tuple[float, ...], most: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """quantiles of the whole table by column, None for a column without values."""
    found = quantiles(df, columns, at, most=most)
    return {c: found.get((None, c), [None] * len(at)) for c in columns}


#: A value is hot if more than 1 in HOT_PARTS of the rows have it: there are at most HOT_PARTS of them.
HOT_PARTS = 1024


#: A histogram of at most this many values is broadcast whole.
FEW_VALUES = 50_000


def histograms(df: DataFrame, columns: list[str], bounds: dict[str, list[float]], nulls: bool = False) -> dict[str, tuple[DataFrame, int]]:
    """Of each column, (_hist_x, _hist_c, _hist_u): its values, their counts, and the counts up to and with them; and how
    many values it has. Columns of one type are counted, dealt to ranges and written together, so that the number of
    jobs doesn't grow with the columns; only a total per range and column meets on the driver. nulls: count them as the
    smallest value."""
    out: dict[str, tuple[DataFrame, int]] = {}
    kinds: dict[str, list[str]] = {}
    for c in dict.fromkeys(columns):
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for kind, names in kinds.items():
        pairs = F.array(*[F.struct(F.lit(i).alias("_hist_i"), F.col(c).alias("_hist_x")) for i, c in enumerate(names)])
        long = df.select(F.explode(pairs).alias("_p")).select("_p.*")
        hist = (long if nulls else long.filter("_hist_x is not null")).groupBy("_hist_i", "_hist_x").agg(F.count(F.lit(1)).alias("_hist_c"))
        cuts = F.array(*[(F.lit(bounds[c]) if bounds[c] else F.array()).cast(f"array<{kind}>") for c in names])
        hist = hist.withColumn("_range", F.size(F.filter(F.get(cuts, F.col("_hist_i")), lambda b: b < F.col("_hist_x"))))
        run = Window.partitionBy("_hist_i", "_range").orderBy("_hist_x")
        hist = written(hist.withColumn("_in", F.sum("_hist_c").over(run)), "histograms")
        ranges = {(r["_hist_i"], r["_range"]): r for r in hist.groupBy("_hist_i", "_range").agg(F.sum("_hist_c").alias("rows"), F.count(F.lit(1)).alias("values")).collect()}
        before = [[sum(r["rows"] for (j, q), r in ranges.items() if j == i and q < p) for p in range(len(bounds[c]) + 1)] for i, c in enumerate(names)]
        offset = F.get(F.get(F.array(*[F.array(*[F.lit(b).cast("long") for b in row]) for row in before]), F.col("_hist_i")), F.col("_range"))
        hist = hist.withColumn("_hist_u", F.col("_in") + offset)
        for i, c in enumerate(names):
            out[c] = hist.filter(F.col("_hist_i") == i).select("_hist_x", "_hist_c", "_hist_u"), sum(r["values"] for (j, _), r in ranges.items() if j == i)
    return out


def by_value(df: DataFrame, key: str, hist: DataFrame, value: str, count: str, total: int, names: list[str], values: int | None = None) -> DataFrame:
    """Left join of rows with their value's row of a histogram. Hot values are broadcast, and neither their rows nor
    those without a value meet in one task. values: how many the histogram has; a few are all broadcast."""
    if values is not None and values <= FEW_VALUES:
        return df.join(F.broadcast(hist.select(F.col(value).alias("_few"), *names)), F.col(key) == F.col("_few"), "left").drop("_few")
    hot =hist.filter(F.col(count) > max(1000, total // HOT_PARTS)).select(F.col(value).alias("_hot"), *[F.col(n).alias(f"_h_{n}") for n in names])
    cold = hist.filter(F.col(count) <= max(1000, total // HOT_PARTS)).select(F.col(value).alias("_cold"), *names, F.lit(0).alias("_cs"))
    out = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    out = out.withColumn("_s", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS))).cast("int"))
    out = out.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_s") == F.col("_cs")), "left")
    return out.select(*df.columns, *[F.coalesce(f"_h_{n}", n).alias(n) for n in names])


def pct_ranks(df: DataFrame, columns: dict[str, str], digits: int | None = None) -> DataFrame:
    """Average percentile ranks over the whole table: (smallest + largest place of the value) / 2 / non-null count;
    new name -> column. Null stays null. With digits, values are compared after rounding.

    One action reads the bounds and counts of all columns, another their histograms: write what is costly to compute
    three times.
    """
    keys = {name: f"_v_{name}" for name in columns}
    out = df.select("*", *[(F.col(c) if digits is None else F.round(F.col(c).cast("double"), digits)).alias(keys[name]) for name, c in columns.items()])
    at = [i / RANGES for i in range(1, RANGES)]
    row = out.agg(*[f(k) for k in keys.values() for f in (F.count, lambda c: F.percentile_approx(c, at, 2000))]).first()
    totals = {k: row[2 * i] for i, k in enumerate(keys.values())}
    hists = histograms(out, [k for k in totals if totals[k]], {k: sorted(set(row[2 * i + 1] or [])) for i, k in enumerate(totals)})
    for name, k in keys.items():
        if not totals[k]:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        hist, values = hists[k]
        hist = hist.select("_hist_x", "_hist_c", ((2 * F.col("_hist_u") - F.col("_hist_c") + 1) / 2 / F.lit(totals[k])).alias(name))
        out = by_value(out, k, hist, "_hist_x", "_hist_c", totals[k], [name], values)
    return out.drop(*keys.values())


def pct_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    return pct_ranks(df, {name: column})


def group_pct_rank(column: Column, keys: list[str]) -> Column:
    """The same rank inside groups of bounded size, as a window expression; ``group_pct_ranks`` bounds no group."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(column.asc_nulls_last()))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, column))
    return F.when(column.isNotNull(), (place + (same - 1) / 2) / F.count(column).over(Window.partitionBy(*keys)))


def group_pct_ranks(df: DataFrame, keys: list[str], column: str, name: str, count: str | None = None) -> DataFrame:
    """The same rank inside groups of any size, from one histogram by group and value that is dealt to ranges of
    values, so that no group meets in one task. count: adds the group's rows under this name."""
    bounds = value_bounds(df, [column])[column]
    hist = df.groupBy(*keys, F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_range", value_range(F.col("_x"), bounds))
    sums = hist.groupBy(*keys, "_range").agg(F.sum(F.when(F.col("_x").isNotNull(), F.col("_c"))).alias("_t"), F.sum("_c").alias("_all"))
    every = Window.partitionBy(*keys)  # RANGES rows of a group at most
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_t").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(every).alias("_n"), F.sum("_all").over(every).alias("_rows"))
    key = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_range"]]
    renamed = sums.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_range"]], "_o", "_n", "_rows")
    joined = hist
    cond = key[0]
    for k in key[1:]:
        cond = cond & k
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy(F.col("_x").asc_nulls_last()))
    joined = joined.withColumn("_u", upto).join(renamed, cond).drop(*[f"_k_{k}" for k in [*keys, "_range"]])
    rank = F.when(F.col("_x").isNotNull(), (F.col("_o") + F.col("_u") - (F.col("_c") - 1) / 2) / F.col("_n"))
    ranks = joined.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_x", rank.alias(name), *([F.col("_rows").alias(count)] if count else []))
    cond = F.col(column).eqNullSafe(F.col("_x"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(ranks, cond, "left").drop("_x", *[f"_k_{k}" for k in keys])


def _ranged(df: DataFrame, order: list[Column]) -> tuple[DataFrame, dict[int, int]]:
    """df dealt to ranges of a total order and written, with _p, the range; and the rows of the ranges that have any."""
    out = written(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id()), "ranged")
    return out, dict(sorted((r["_p"], r["n"]) for r in out.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()))


def _by_range(values: dict[int, object]) -> Column:
    """A small number of values by range as one expression."""
    return F.create_map(*[F.lit(x) for p, v in values.items() for x in (p, v)])[F.col("_p")]


def places(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds places 1..n in a total order. Each range of the order is numbered by itself; only the ranges' counts meet."""
    out, counts = _ranged(df, order)
    if not counts:
        return out.drop("_p").withColumn(name, F.lit(None).cast("long"))
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    return out.withColumn(name, F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + _by_range(before)).withColumn(name, F.col(name).cast("long")).drop("_p")


def qcut_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Linear quantile edges without repeats, bins lowered to the number of distinct values."""
    few = df.filter(F.col(column).isNotNull()).select(column).distinct().limit(bins).count()  # bins rows at most
    if few < 2:
        return []
    q = min(bins, few)
    return sorted(set(quantile_row(df, [column], tuple(i / q for i in range(q + 1)))[column]))


def qcut(column: Column, edges: list[float]) -> Column:
    """Right-closed bins by inner edges, the lowest value in the first bin; 0 without edges."""
    inner = edges[1:-1]
    bin_ = sum(((F.lit(e) < column).cast("int") for e in inner), F.lit(0))
    return F.when(column.isNotNull(), bin_)


def cut_or_nearest(column: Column, edges: list[float], w: WindowSpec) -> Column:
    """Bins by given edges for values that need not lie between them: one outside takes the bin before it in the
    window, else the one after it, else 0."""
    if len(edges) < 2:
        return F.lit(0)
    inside = F.when(column.between(edges[0], edges[-1]), qcut(column, edges))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(inside, True).over(before), F.first(inside, True).over(after), F.lit(0))


def top_share(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """The first ceil(share * n) rows in a total order."""
    out = places(df, order, "_place")
    n = out.count()
    return out.filter(F.col("_place") <= ceil(n * share)).drop("_place")


def average_percentile(df: DataFrame, column: str, reference: DataFrame, ref_column: str, name: str) -> DataFrame:
    """Share of reference values below the value, and half of those equal to it: values and reference are counted
    in one histogram."""
    a = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_hist_x")).distinct().withColumn("_r", F.lit(0).cast("long"))
    b = reference.filter(F.col(ref_column).isNotNull()).groupBy(F.col(ref_column).cast("double").alias("_hist_x")).agg(F.count(F.lit(1)).alias("_r"))
    hist = cumulative(a.unionByName(b).groupBy("_hist_x").agg(F.sum("_r").alias("_r")), "_hist_x", {"_upto": "_r"})
    n = reference.agg(F.count(ref_column).alias("_n"))
    ranks = hist.join(F.broadcast(n)).select("_hist_x", ((2 * F.col("_upto") - F.col("_r")) / (2 * F.col("_n"))).alias(name))
    return df.join(ranks, F.col(column).cast("double") == F.col("_hist_x"), "left").drop("_hist_x")


def average_percentiles(df: DataFrame, reference: DataFrame, columns: dict[str, str]) -> DataFrame:
    """average_percentile of several columns that both tables have, new name -> column; each histogram is taken from
    the tables themselves, so that plans don't nest."""
    names = list(columns.values())
    both = df.select(*names, F.lit(0).cast("long").alias("_w")).unionByName(reference.select(*names, F.lit(1).cast("long").alias("_w")))
    bounds, total = value_bounds(both, names), reference.agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(names)])
    out = df
    for i, (name, c) in enumerate(columns.items()):
        hist = both.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_hist_x")).agg(F.sum("_w").alias("_r"))
        hist = cumulative(hist, "_hist_x", {"_upto": "_r"}, bounds[c]).join(F.broadcast(total.select(f"_n{i}")))
        rank = hist.select("_hist_x", ((2 * F.col("_upto") - F.col("_r")) / (2 * F.col(f"_n{i}"))).alias(name))
        out = out.join(rank, F.col(c) == F.col("_hist_x"), "left").drop("_hist_x")
    return out


def bh_q(df: DataFrame, p: str, name: str) -> DataFrame:
    """Benjamini-Hochberg step-up q values; null p stays null. Ranges of p are numbered and scanned each by itself;
    their counts and least values meet on the driver."""
    out, counts = _ranged(df.filter(F.col(p).isNotNull()), [F.asc(p)])
    if not counts:
        return df.withColumn(name, F.lit(None).cast("double"))
    n, before = sum(counts.values()), {q: sum(k for x, k in counts.items() if x < q) for q in counts}
    w = Window.partitionBy("_p").orderBy(p)
    # equal p share the last of their places
    out = out.withColumn("_raw", F.col(p) * n / (F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0)) + _by_range(before)))
    least = {r["_p"]: r["m"] for r in out.groupBy("_p").agg(F.min("_raw").alias("m")).collect()}
    after = {q: min([least[x] for x in counts if x > q], default=float("inf")) for q in counts}
    q = F.min("_raw").over(Window.partitionBy("_p").orderBy(F.desc(p)))
    out = out.withColumn(name, F.least(q, _by_range(after), F.lit(1.0))).drop("_p", "_raw")
    return out.unionByName(df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))
