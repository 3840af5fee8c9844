"""Table differences, the keyed table's log, and what they do with odd input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import compare

T0 = dt.datetime(2024, 1, 1)


def test_one_change_in_a_million(spark, tmp_path):
    old = spark.range(0, 1_000_000, 1, 8).select("id", (F.col("id") % 97).alias("a"), (F.col("id") / 7).alias("x"))
    old.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/old")
    new = old.withColumn("x", F.when(F.col("id") == 123_456, F.col("x") * (1 + 1e-6)).otherwise(F.col("x")))
    new.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/new")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new"))
    _, where, open_ = compare.unequal_ranges(a, b, ["id"], a.columns)
    assert len(open_) == 1 and 0 < a.filter(where).count() < 10_000
    found = compare.difference(a, b, ["id"])
    assert "GreaterThan(id" in found._jdf.queryExecution().toString() and "LessThanOrEqual(id" in found._jdf.queryExecution().toString()
    assert [(r["id"], r["kind"], r["column_name"]) for r in found.collect()] == [(123_456, "changed", "x")]
    assert compare.difference(a, b, ["id"], rtol=1e-5).collect() == []
    assert compare.difference(a, a, ["id"]).collect() == []


@pytest.mark.parametrize("key", ["int", "string"])
def test_difference_by_brute_force(spark, key):
    nan, inf = float("nan"), float("inf")
    old = [(1, 0, "a", 1.0), (2, 0, None, nan), (3, 0, "c", inf), (None, 0, "n", 1.0), (4, 0, "d", None), (5, 0, "e", 5.0), (6, 0, "f", 6.0), (6, 0, "f", 6.0), (8, 0, "h", 0.0)]
    new = [(1, 0, "a", 1.0 + 1e-12), (2, 0, "b", nan), (3, 0, "c", -inf), (None, 0, "m", 1.0), (4, 0, "d", 4.0), (6, 0, "f", 6.0), (7, 0, "g", 7.0), (8, 0, "h", -0.0)]
    schema = f"k {key}, j int, s string, x double"
    rows = lambda data: spark.createDataFrame([(str(r[0]) if key == "string" and r[0] is not None else r[0], *r[1:]) for r in data], schema)
    got = compare.difference(rows(old), rows(new), ["k", "j"], ranges=3)
    assert got.columns == ["k", "j", "kind", "column_name", "old_value", "new_value"]
    got = {(None if r["k"] is None else int(r["k"]), r["kind"], r["column_name"]) for r in got.collect()}
    assert got == {(2, "changed", "s"), (3, "changed", "x"), (None, "changed", "s"), (4, "changed", "x"), (5, "removed", None), (6, "repeated", None), (7, "added", None)}
    empty = rows([])
    assert compare.difference(empty, empty, ["k", "j"]).count() == 0
    assert {r["kind"] for r in compare.difference(empty, rows(new), ["k", "j"]).collect()} == {"added"}


def test_names_and_types(spark):
    a = spark.createDataFrame([(1, 2.0, 3)], "id int, Review_order double, n int")
    b = spark.createDataFrame([(1, 3, "x")], "id int, n long, more string")
    assert compare.leak_columns(a) == ["Review_order"]
    assert compare.schema_difference(a, b) == [("Review_order", "double", None), ("n", "int", "bigint"), ("more", None, "string")]
    assert compare.difference(a, b, ["id"]).count() == 0


def test_keyed_table_streams_and_compaction(spark, tmp_path):
    from tidewatch.streaming.minutes import UpsertTable

    schema = spark.createDataFrame([], "k long, at timestamp, n long").schema
    table = UpsertTable(spark, f"{tmp_path}/t", schema, ["k", "at"])
    row = lambda k, n, day=0: spark.createDataFrame([(k, T0 + dt.timedelta(days=day), n)], schema)
    rows = lambda: sorted((r["k"], r["n"]) for r in table.read().collect())
    table.apply(row(1, 1), 0, "one")
    table.apply(row(2, 1, 1), 1, "one")
    table.apply(row(3, 1), 0, "two")  # another stream's first batch
    assert rows() == [(1, 1), (2, 1), (3, 1)]
    table.apply(row(3, 9), 0, "two")  # run again
    assert rows() == [(1, 1), (2, 1), (3, 1)]
    table.apply(row(1, 5), 5, "one")
    with pytest.raises(ValueError):
        table.apply(row(9, 9), 3, "one")  # neither known nor later
    assert rows() == [(1, 5), (2, 1), (3, 1)]
    assert table.compact() == 2 and rows() == [(1, 5), (2, 1), (3, 1)]
    again = UpsertTable(spark, f"{tmp_path}/t", schema, ["k", "at"])
    again.apply(row(1, 7), 5, "one")  # still known
    assert rows() == [(1, 5), (2, 1), (3, 1)]
    again.apply(row(1, 7), 6, "one")
    assert rows() == [(1, 7), (2, 1), (3, 1)] and again.compact() == 1 and again.compact() == 0
    with pytest.raises(ValueError):
        again.apply(row(9, 9), 2, "one")
