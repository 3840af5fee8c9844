"""Density clusters and folds: bounded groups in place of rounds, inputs that are read a few times only."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import density, learn


def jobs(spark, run) -> int:
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    run()
    return count() - before


@pytest.mark.parametrize("segment", [200_000, 1])
def test_links_are_followed(spark, segment):
    """Chains of 40, one of which leads to a node that is none: its rows go."""
    rows = [(i, i if i % 40 == 0 else i - 1) for i in range(200)] + [(i, i - 1) for i in range(1001, 1006)]
    links = spark.createDataFrame(rows, "n long, u long").repartition(3)
    got = sorted((r["n"], r["u"]) for r in density.doubled(links, "n", "u", "t", segment).collect())
    assert got == [(i, i - i % 40) for i in range(200)]
    assert density.doubled(links.limit(0), "n", "u", "t", segment).count() == 0


def test_clusters_are_chosen_alike(spark):
    """One bounded group chooses as rounds do; half the parents are worth less than what is below them, some as much."""
    r = random.Random(5)
    parent = {1000: None} | {1000 - i: 1000 - (i + 1) // 2 + (1 if i % 2 == 0 else 0) for i in range(1, 41)}
    rows = [(c, p if p is None or p > c else 1000, float(r.choice([1, 2, 3, 5, 8]))) for c, p in parent.items()]
    df = spark.createDataFrame(rows, "cluster long, parent long, stability double").repartition(3)
    one, rounds = ({x["cluster"]: x["chosen"] for x in density.chosen(df, s).collect()} for s in (200_000, 1))
    assert one == rounds and len(one) == 41 and one[1000] is None and len(set(one.values())) > 5


def test_few_points_need_few_jobs(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(f"k{i:03}", r.gauss(6.0 * (i % 3), 1), r.gauss(0, 1)) for i in range(200)], "k string, a double, b double")
    assert jobs(spark, lambda: density.hdbscan_sizes(df, ["a", "b"], "k").count()) <= 330


def watched(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(i):
        seen.add(1)
        return float(i)

    df = spark.range(60).select(F.format_string("k%02d", "id").alias("k"), F.udf(mark, "double")("id").alias("a"), F.sin("id").alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    return df, seen


def test_permutations_read_their_input_a_few_times(spark):
    df, seen = watched(spark)
    assert learn.permutation_importance(df, ["a", "b"], "y", "k", folds=2).count() == 2
    assert 60 <= seen.value <= 6 * 60


def test_supervised_models_read_their_input_a_few_times(spark):
    df, seen = watched(spark)
    assert learn.supervised(df, ["a", "b"], "y", "k", models=("weighted_logistic", "boosted")).count() == 120
    assert 60 <= seen.value <= 6 * 60
