"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document gets a 60-bit hash of its id. Per source, words are summed by the top bits of the hash; the
bucket in which the budget runs out is the only one refined with the next bits, until the boundary is a single
hash value. A document's part of the budget is then a filter on its hash: nothing is sorted and reruns agree.

Defined cases: null text has 0 words; a null source is a source of its own, last in order; a source without
words has target 0; documents with equal hashes (repeated ids) are taken together; empty tables give empty
results; each source's taken words differ from its target by less than its boundary document's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Sources up to this many are broadcast (under 20 MB); beyond it the same joins are shuffled.
BROADCAST_SOURCES = 100_000
_STEP, _BITS = 12, 60


def _targets(rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Per source: source_size, weight, target, full copies of every document, and the budget of words beyond them.

    The excess over cap goes to the others by weight until none is above: sorted by cap / weight, a source is
    capped if its cap is at most its share of what the capped ones before it leave.
    """
    sums = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())  # one row per source, not per document
    k = f"pmod(place - 1, {len(weights)})"
    sums = sums.withColumn("place", F.row_number().over(by_name)).withColumn("w", F.expr(f"element_at(array({','.join(map(str, weights))}), cast({k} as int) + 1)").cast("long"))
    w = Window.orderBy(F.expr(f"({cap} * source_size) / w"), "place")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    c = sums.select("*", F.sum("source_size").over(every).alias("total"), F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)).alias("capped"), F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("left_w"))
    c = c.withColumn("is_capped", F.expr(f"cast({cap} * source_size as decimal(38,0)) * left_w <= cast(total - capped as decimal(38,0)) * w"))
    c = c.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("is_capped"), cap * F.col("source_size"))).over(every), F.lit(0)))
    c = c.withColumn("rest_w", F.coalesce(F.sum(F.when(~F.col("is_capped"), F.col("w"))).over(every), F.lit(1)))
    c = c.withColumn("target", F.when(F.col("is_capped"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("rest")).cast("double") / F.col("rest_w").cast("double")))
    c = c.withColumn("copies", F.expr(f"case when source_size = 0 then 0 when is_capped then {cap} else (w * rest) div (rest_w * source_size) end"))
    return c.select("_source", "source_size", "target", F.col("copies").cast("long").alias("copies"), F.expr("case when source_size = 0 or is_capped then 0 else (w * rest) div rest_w - copies * source_size end").cast("long").alias("budget"))


def _hash(id_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def _beside(left: DataFrame, right: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("_source", "_s")
    return left.join(F.broadcast(right) if few else right, F.col("_source").eqNullSafe(F.col("_s")), how).drop("_s")


def _plan(rows: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, bool]:
    """Per source: source_size, target, full copies, and the hash below which a document is taken once more; and
    whether the sources are few enough to broadcast."""
    targets = materialize(_targets(rows, weights, cap), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    at = targets.filter("source_size > 0").select("_source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for shift in range(_BITS - _STEP, -1, -_STEP):
        inside = _beside(rows, at, few).filter(F.expr(f"shiftright(_h, {shift + _STEP}) = prefix"))
        sums = inside.groupBy("_source", F.expr(f"shiftright(_h, {shift})").alias("bucket")).agg(F.sum("_size").alias("n"), F.max("left").alias("left"))
        run = Window.partitionBy("_source").orderBy("bucket")  # 4096 buckets of a source at most
        sums = sums.withColumn("upto", F.sum("n").over(run)).filter("upto > left and upto - n <= left")
        at = materialize(sums.select("_source", F.col("bucket").alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "n"), "mix-bounds")
    # the boundary document goes in if that brings the sum nearer the budget
    bounds = at.select("_source", F.expr("prefix + if(n - left < left, 1, 0)").alias("below"))
    below = F.when(F.col("budget") > 0, F.coalesce("below", F.lit(0))).otherwise(F.lit(0))
    return materialize(_beside(targets, bounds, few, "left").select("_source", "source_size", "target", "copies", below.alias("below")), "mix-plan"), few


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return materialize(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), _hash(id_col).alias("_h")), "mix-rows")


_COPIES = "copies + cast(_h < below as bigint)"


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken (= copies * size)."""
    rows = _rows(docs, id_col, text_col, source_col)
    out = _beside(rows, *_plan(rows, weights, cap)).withColumn("copies", F.expr(_COPIES))
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: each row of docs as many times as the mix takes it, with the columns of docs. The plan of
    the sources goes to the rows; with few sources the rows aren't shuffled at all."""
    plan, few = _plan(_rows(docs, id_col, text_col, source_col), weights, cap)
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).alias("_source"), _hash(id_col).alias("_h"))
    taken = _beside(boxed, plan, few).withColumn("n", F.expr(_COPIES).cast("int")).filter("n > 0")
    return taken.select("_row", F.explode(F.expr("sequence(1, n)")).alias("_k")).select("_row.*")
