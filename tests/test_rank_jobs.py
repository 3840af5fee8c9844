"""Ranks of many columns and orders in a number of jobs that doesn't grow with them, with the results of plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import evidence, models, ranks


def jobs(spark, run) -> int:
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    run()
    return count() - before


def rows(spark):
    x = lambda i: F.when(F.col("id") % (i + 5) != 0, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9 + i)) / 4)
    return spark.range(400).select(F.format_string("s%03d", "id").alias("session_key"), (F.col("id") % 7).alias("whole"), *[x(i).alias(f"x{i}") for i in range(8)], F.lit(None).cast("double").alias("none"))


@pytest.mark.parametrize("few", [50_000, 0])
def test_ranks_of_columns_of_several_types(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW_VALUES", few)
    cols = ["whole", "x0", "x1", "none"]
    got = ranks.pct_ranks(rows(spark), {f"p_{c}": c for c in cols})
    want = rows(spark)
    for c in cols:
        w = Window.orderBy(F.col(c).asc_nulls_last())
        place = (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2) / F.count(c).over(Window.partitionBy())
        want = want.withColumn(f"p_{c}", F.when(F.col(c).isNotNull(), place))
    a, b = ({r["session_key"]: [r[f"p_{c}"] for c in cols] for r in t.collect()} for t in (got, want))
    assert len(a) == 400 and a.keys() == b.keys()
    for k, v in a.items():
        assert v == [None if y is None else pytest.approx(y, abs=1e-12) for y in b[k]]


def test_jobs_of_ranks_do_not_grow_with_columns(spark):
    """A column more costs its broadcast and nothing else."""
    df = rows(spark)
    run = lambda n: lambda: ranks.pct_ranks(df, {f"p{i}": f"x{i}" for i in range(n)}).write.format("noop").mode("overwrite").save()
    assert jobs(spark, run(8)) - jobs(spark, run(2)) <= 2 * 6
    tails = lambda n: lambda: models.ecod(df.na.fill(0.0), [f"x{i}" for i in range(n)]).write.format("noop").mode("overwrite").save()
    assert jobs(spark, tails(8)) - jobs(spark, tails(2)) <= 2 * 6


def test_raw_places_are_taken_in_one_order(spark):
    names = {"empirical_p": "x0", "scan_z": "x1", "duration": "whole", "expected_metric": "x2", "mismatch_rate": "x3", "mismatch_max_run": "whole", "anomaly": "x4", "reason_rank_max": "x5", "reason_value_max": "none"}
    df = rows(spark).select("session_key", *[F.col(c).alias(n) for n, c in names.items()])
    found = {}
    assert jobs(spark, lambda: found.update((r["session_key"], r) for r in evidence.raw_evidence(df, 400).collect())) <= 20
    assert len(found) == 400
    for name, metrics in evidence.RAW.items():
        known = F.coalesce(*[F.col(m).cast("double") for m in metrics]).isNotNull()
        w = Window.orderBy(F.when(known, 0).otherwise(1), *[(F.asc_nulls_last if up else F.desc_nulls_last)(F.round(m, 9)) for m, up in metrics.items()], "session_key")
        for r in df.select("session_key", F.when(known, F.row_number().over(w)).alias("place")).collect():
            assert found[r["session_key"]][name] == r["place"]
