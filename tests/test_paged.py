"""The paged source: cursors, page limit, pushed targets, odd fields; whose live stamps are local."""

import datetime as dt
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

SCHEMA = "id long, user_id string, viewers long, rate double"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    from tidewatch.sources import paged

    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", "c", 'd "x"\n', None]), r.choice([None, 3, 50]), r.choice([None, 0.5])) for i in range(203)]
    root = f"file://{tmp_path_factory.mktemp('pages')}/p"
    assert paged.write_pages(spark.createDataFrame(r.sample(rows, len(rows)), SCHEMA).repartition(5), [F.col("id")], root, 10) == 21
    return root, [(i, u or "", v or 0, x or 0.0) for i, u, v, x in rows]


def test_pages_are_walked_in_order(spark, pages):
    from tidewatch.sources import paged

    root, rows = pages
    for most in (None, 0, 1, 7, 21, 100):
        got = [tuple(x) for x in paged.read_pages(spark, root, SCHEMA, "user_id", most).collect()]
        assert sorted(got) == (rows if most is None else rows[: 10 * most])
    chain, at = {}, "0"
    for path in spark.read.text(root).collect():
        page = json.loads(path["value"])
        if "cursor" in page:
            chain[page["cursor"]] = page
    for k in range(21):
        assert [x["id"] for x in chain[at]["data"]] == [x[0] for x in rows[10 * k : 10 * k + 10]]
        at = chain[at]["next"]
    assert at is None


def test_targets_reach_the_reader(spark, pages, monkeypatch):
    from tidewatch.sources import paged

    root, rows = pages
    items = paged.read_pages(spark, root, SCHEMA, "user_id")
    targets = spark.createDataFrame([("a",), ('d "x"\n',), ("none",), (None,), ("a",)], "user_id string")
    want = [x for x in rows if x[1] in ("a", 'd "x"\n')]
    few = paged.of_targets(items, targets, "user_id")
    assert "Filter (" not in plan_of(few).split("(1)")[0] and sorted(map(tuple, few.collect())) == want
    both = items.filter((F.col("user_id") == "a") & F.col("user_id").isin("a", "b") & (F.col("viewers") > 3))  # the last one stays with Spark
    assert sorted(map(tuple, both.collect())) == [x for x in rows if x[1] == "a" and x[2] > 3]
    monkeypatch.setattr(paged, "PUSHED_TARGETS", 1)
    many = paged.of_targets(items, targets, "user_id")
    assert "LeftSemi" in plan_of(many) and sorted(map(tuple, many.collect())) == want
    assert paged.of_targets(items, targets.limit(0), "user_id").count() == 0


def test_odd_pages(spark, tmp_path):
    from tidewatch.sources import paged

    root = f"file://{tmp_path}/none"
    assert paged.write_pages(spark.createDataFrame([], SCHEMA), [F.col("id")], root) == 0
    assert paged.read_pages(spark, root, SCHEMA, "user_id").count() == 0
    odd = spark.createDataFrame([("1", "x", None, "0.25"), ("z", None, "7", "q")], "id string, user_id string, viewers string, rate string")
    paged.write_pages(odd, [F.col("id")], f"{root}2", 1)
    assert sorted(map(tuple, paged.read_pages(spark, f"{root}2", SCHEMA, "user_id").collect()), key=str) == [(1, "x", 0, 0.25), (None, "", 7, None)]
    with pytest.raises(Exception, match="string, long or double"):
        paged.read_pages(spark, f"{root}2", "id date", "id").count()


def test_live_stamps(spark):
    """Groups that are local, UTC, without stamps and with a null key, against the plain rule."""
    from tidewatch.operators import live

    r, t0 = random.Random(2), dt.datetime(2024, 3, 1, 11, 40)
    rows = []
    for g in (*range(8), None):
        now = t0 + dt.timedelta(minutes=r.randrange(3000))
        lag = dt.timedelta(hours=0 if (g or 0) % 2 else -9)
        rows += [(g, None if g == 4 else now + lag - dt.timedelta(minutes=r.randrange(200)), now) for _ in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "g int, ts timestamp_ntz, now timestamp_ntz")
    got = live.settle_stamps(df, ["g"], "ts", "now", 9)
    assert got.columns == ["g", "ts", "now", "already_local"] and got.count() == len(rows)
    for g in (*range(8), None):
        mine = [x for x in rows if x[0] == g and x[1]]
        now = rows[[x[0] for x in rows].index(g)][2]
        off = statistics.median((x[1] - now).total_seconds() for x in mine) if mine else 0
        local = bool(mine) and abs(off) < abs(off + 32400)
        assert local == ((g or 0) % 2 == 1)
        here = [x for x in got.collect() if x["g"] == g]
        assert {x["already_local"] for x in here} == {local}
        assert sorted(x["ts"] for x in here if x["ts"]) == sorted(x[1] - dt.timedelta(hours=9 * local) for x in mine)
    assert not live.settle_stamps(df, ["g"], "ts", "now", 0).filter("already_local").count()
    w = {x["g"]: tuple(x)[1:] for x in live.live_windows(df, ["g"], "ts", ((1200, 1320), (1380, 90))).collect()}
    assert w[4] == (None, None, 1.0, False) and len(w) == 9


def test_planned_windows(spark):
    from tidewatch.operators import live

    at = lambda h, m, s=0: dt.datetime(2024, 3, 1, h, m, s)
    rows = [(1, at(20, 0, 30), 3600), (2, at(21, 30), 3600), (3, at(23, 50), 10), (4, at(21, 59), 0), (5, None, 60)]
    got = live.planned_windows(spark.createDataFrame(rows, "g int, now timestamp_ntz, seconds int"), ["g"], "now", "seconds", ((1200, 1320), (1380, 90)))
    got = {x["g"]: tuple(x)[1:] for x in got.collect()}
    assert got[1] == ("20:00-22:00", 0, 0.0, True) and got[3] == ("23:00-00:00", 1, 0.0, True) and got[4] == ("21:00-23:00", 0, 0.0, True)
    assert got[2][:2] == ("21:00-23:00", 0) and not got[2][3] and abs(got[2][2] - 30 / 61) < 1e-9
    assert got[5] == (None, None, 1.0, False)
