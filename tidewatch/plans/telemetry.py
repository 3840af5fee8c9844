"""The telemetry analyses as queries over a folder of tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evidence, models, ranks, review, scan, state, windows
from ..sources import sinks, telemetry
from ..sources.steps import step
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GRID_Q, GRID_D = (0.90, 0.95, 0.97, 0.99), (1, 2, 3, 5, 10)
FAMILIES = list(evidence.FAMILIES)


def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@step
def minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.minute_table(read(spark, sf_dir, "events"))


@step
def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.minute_state(minute(spark, sf_dir), telemetry.GAP_MINUTES)


@step
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.mismatch_scores(stated(spark, sf_dir))


@step
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.session_summary(stated(spark, sf_dir))


@step
def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rule_scores(sessions(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str, min_n: int = 10) -> DataFrame:
    """Sessions in review order, from raw events in one go; min_n: fewest ticks of a session under review."""
    return state.rule_scores(state.session_summary(stated(spark, sf_dir), min_n)).orderBy("review_order")


def with_z(scores: DataFrame, rows: int) -> DataFrame:
    """z of the mismatch rank among so many rows, in whole billionths."""
    return scores.withColumn("z", F.round(F.expr(S.rank_z_sql("minute_mismatch_rank", str(rows))) * scan.UNIT).cast("long"))


@step
def zed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return with_z(s, s.count())


@step
def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute rows with their cluster (audience half by silence), its mismatch rank and state, and the expected response."""
    cluster = 2 * F.coalesce(F.col("viewer_bin") >= 5, F.lit(False)).cast("int") + F.col("zero_chat").cast("int")
    s = evidence.expected_by_cell(zed(spark, sf_dir), F.col("viewer_bin") * 4 + F.floor(F.hour("minute_ts") / 6).cast("int"), F.col("run_id") % 5, 5, 40)
    s = s.withColumn("minute_cluster", cluster)
    return evidence.mark_mismatch(s, evidence.cluster_profiles(s))


@step
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's best interval by empirical p."""
    return scan.best_intervals(zed(spark, sf_dir), telemetry.GAP_MINUTES, Q.N_PERM)


@step
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen interval's scan result and metrics, with its anomaly; one row per session."""
    f = found(spark, sf_dir)
    m = f.select(*ID, "session_key", "duration", "scan_z", "empirical_p").join(scan.interval_metrics(f, marked(spark, sf_dir), telemetry.GAP_MINUTES), ID)
    return evidence.interval_anomaly(m)


@step
def dwelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.dwell(marked(spark, sf_dir))


@step
def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.reason_support(metrics(spark, sf_dir))


@step
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family ranks of all scanned sessions, with eligibility."""
    r = supported(spark, sf_dir).groupBy("session_key").agg(F.max("support").alias("reason_rank_max"), F.max("value").alias("reason_value_max"))
    s = metrics(spark, sf_dir).join(dwelt(spark, sf_dir).select("session_key", "mismatch_max_run", "mismatch_total_run", "mismatch_rate", "transitions"), "session_key").join(r, "session_key", "left")
    return evidence.family_ranks(s.join(sessions(spark, sf_dir).select("session_key", "eligible"), "session_key", "left").fillna(False, ["eligible"]))


@step
def reviewed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ranked(spark, sf_dir)
    return evidence.review(s, s.count())


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible sessions in review order."""
    return reviewed_all(spark, sf_dir).filter("eligible")


def text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def r6(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


def r6s(*names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


ID = ["run_id", "broad_no"]


# --- sources and sinks ---
@query("j1_minute_table", f"WITH {Q.MINUTE} SELECT run_id, broad_no, minute_ts::VARCHAR AS minute_ts, {r6s('viewer_count_last')}, category_id, chat_count, unique_chatters, {r6s('avg_msg_len', 'repeat_msg_ratio', 'new_chatter_ratio')} FROM minute")
def _(spark, d):
    return minute(spark, d).select(*ID, text("minute_ts"), *r6("viewer_count_last"), "category_id", "chat_count", "unique_chatters", *r6("avg_msg_len", "repeat_msg_ratio", "new_chatter_ratio"))


@query("src2_run_id_from_name", f"WITH {Q.EVENTS} SELECT regexp_extract('data/Run_' || run_id || '_Features.csv', 'Run_(\\d+)_Features', 1)::INT AS run_id, count(*) AS n FROM ev GROUP BY 1")
def _(spark, d):
    e = telemetry.telemetry(read(spark, d, "events")).select(F.concat(F.lit("data/Run_"), "run_id", F.lit("_Features.csv")).alias("name"))
    return e.groupBy(telemetry.run_id_from_name(F.col("name")).alias("run_id")).agg(F.count(F.lit(1)).alias("n"))


@query("src3_chat_of_run", f"WITH {Q.EVENTS} SELECT event_id, broad_no, user_id, message FROM click WHERE run_id = (SELECT max(run_id) FROM ev)")
def _(spark, d):
    e = read(spark, d, "events")
    last = telemetry.telemetry(e).agg(F.max("run_id").alias("_last"))  # one row
    return telemetry.chat_events(e).join(F.broadcast(last), F.col("run_id") == F.col("_last")).select("event_id", "broad_no", "user_id", "message")


@query("src5_run_scalars", f"WITH {Q.EVENTS} SELECT max(run_id) AS latest_run, count(*) AS events, count(*) FILTER (event_type = 'click') AS chats, count(DISTINCT broad_no) AS broads FROM ev")
def _(spark, d):
    e = telemetry.telemetry(read(spark, d, "events"))
    return e.agg(F.max("run_id").alias("latest_run"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "click").alias("chats"), F.count_distinct("broad_no").alias("broads"))


@query("src8_chat_frames", "SELECT CASE WHEN event_id % 5 = 0 THEN 93102 ELSE 93101 END AS cmd, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS event_ts, user_id::VARCHAR AS user_id, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR ELSE 'nick' || user_id END AS user_nick, props AS message FROM events WHERE event_type = 'click' AND event_id % 7 <> 0")
def _(spark, d):
    e = read(spark, d, "events").filter("event_type = 'click'")
    profile = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(F.concat(F.lit("nick"), "user_id").alias("nickname"))))
    body = F.array(F.struct(F.col("user_id").cast("string").alias("uid"), F.col("props").alias("msg"), F.unix_millis(F.date_trunc("second", "ts")).alias("msgTime"), profile.alias("profile")))
    cmd = F.when(F.col("event_id") % 7 == 0, 100).when(F.col("event_id") % 5 == 0, 93102).otherwise(93101)
    frames = e.select(F.to_json(F.struct(cmd.alias("cmd"), body.alias("bdy"))).alias("frame"))
    out = telemetry.chat_frames(frames)
    return out.select("cmd", F.date_format(F.col("event_ts"), "yyyy-MM-dd HH:mm:ss").alias("event_ts"), "user_id", "user_nick", "message")


@query("snk2_upsert", f"WITH {Q.MINUTE}, o AS (SELECT run_id, broad_no, minute_ts, chat_count FROM minute WHERE broad_no < 15), n AS (SELECT run_id, broad_no, minute_ts, chat_count + 1000 AS chat_count FROM minute WHERE broad_no >= 10) SELECT run_id, broad_no, minute_ts::VARCHAR AS minute_ts, chat_count FROM (SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (run_id, broad_no, minute_ts))")
def _(spark, d):
    m = minute(spark, d).select(*telemetry.KEY, "chat_count")
    out = sinks.upsert(m.filter("broad_no < 15"), m.filter("broad_no >= 10").withColumn("chat_count", F.col("chat_count") + 1000), telemetry.KEY)
    return out.select(*ID, text("minute_ts"), "chat_count")


@query("snk5_activate_targets", "SELECT user_id, bool_or(event_type = 'signup') AS is_active FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id")
def _(spark, d):
    e = read(spark, d, "events")
    return sinks.activate(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), "user_id")


@query("snk4_rounded_export", "SELECT o_orderkey, round(o_totalprice / 7, 3) AS share FROM orders")
def _(spark, d):
    return sinks.export(read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("share")))


# --- filters and scalar rules ---
@query("f1_coerce", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("f2_id_str", "WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id || '.0' WHEN 1 THEN ' ' || user_id || ' ' WHEN 2 THEN '' WHEN 3 THEN 'u' || user_id ELSE user_id::VARCHAR END AS raw, user_id FROM events) SELECT event_id, CASE event_id % 5 WHEN 2 THEN NULL WHEN 3 THEN 'u' || user_id ELSE user_id::VARCHAR END AS id FROM t")
def _(spark, d):
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    raw = F.when(k == 0, F.concat(u, F.lit(".0"))).when(k == 1, F.concat(F.lit(" "), u, F.lit(" "))).when(k == 2, "").when(k == 3, F.concat(F.lit("u"), u)).otherwise(u)
    return read(spark, d, "events").select("event_id", S.id_str(raw).alias("id"))


WINDOWS = ((1200, 1320), (1380, 90), (480, 720))  # 20:00-22:00, 23:00-01:30, 08:00-12:00


def _in_sql(m: str, start: int, end: int) -> str:
    end = end + 1440 if end < start else end
    return "(" + " OR ".join(f"{m} BETWEEN {start + k} AND {end + k}" for k in (-1440, 0, 1440)) + ")"


@query("f5_time_window", "SELECT event_id FROM events WHERE " + _in_sql("(hour(ts) * 60 + minute(ts))", 1375, 95))
def _(spark, d):
    return read(spark, d, "events").filter(S.in_window(S.minute_of_day(F.col("ts")), 1380, 90, 5)).select("event_id")


_F6 = f"""{Q.EVENTS}, r AS (SELECT run_id, w, avg(ok::INT) AS rate FROM (
  SELECT run_id, 0 AS w, {_in_sql("(hour(ts) * 60 + minute(ts))", *WINDOWS[0])} AS ok FROM ev UNION ALL SELECT run_id, 1, {_in_sql("(hour(ts) * 60 + minute(ts))", *WINDOWS[1])} FROM ev
  UNION ALL SELECT run_id, 2, {_in_sql("(hour(ts) * 60 + minute(ts))", *WINDOWS[2])} FROM ev) GROUP BY ALL),
best AS (SELECT run_id, w, 1 - rate AS off_rate FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rate DESC, w) AS k FROM r) WHERE k = 1)"""


def _best_window(e: DataFrame) -> DataFrame:
    """Per run the window with the highest share of its rows; the first listed wins ties. One row per run and window."""
    m = S.minute_of_day(F.col("ts"))
    rates = e.groupBy("run_id").agg(F.array(*[F.avg(S.in_window(m, *w).cast("double")) for w in WINDOWS]).alias("r"))
    top = F.array_max("r")
    return rates.select("run_id", (F.array_position("r", top) - 1).cast("int").alias("w"), (1 - top).alias("off_rate"))


@query("f6_best_window", f"WITH {_F6} SELECT run_id, w, {r6s('off_rate')} FROM best")
def _(spark, d):
    return _best_window(telemetry.telemetry(read(spark, d, "events"))).select("run_id", "w", *r6("off_rate"))


@query("f7_admission_policy", f"WITH {_F6} SELECT run_id, CASE WHEN run_id % 10 = 0 THEN 'drop_by_id' WHEN off_rate = 1 THEN 'no_valid' WHEN off_rate = 0 THEN 'keep_all' WHEN off_rate <= 0.005 THEN 'trim_rows' WHEN off_rate > 0.9 THEN 'drop_major' ELSE 'drop_minor' END AS policy FROM best")
def _(spark, d):
    off = F.col("off_rate")
    policy = F.when(F.col("run_id") % 10 == 0, "drop_by_id").when(off == 1, "no_valid").when(off == 0, "keep_all").when(off <= 0.005, "trim_rows").when(off > 0.9, "drop_major").otherwise("drop_minor")
    return _best_window(telemetry.telemetry(read(spark, d, "events"))).select("run_id", policy.alias("policy"))


@query("f8_split_sessions", f"WITH {Q.STATE} SELECT CASE WHEN all_zero THEN 'qc_zero' ELSE 'model' END AS part, count(*) AS minutes, count(DISTINCT session_key) AS sessions, count(*) FILTER (v_miss) AS row_qc FROM state GROUP BY 1")
def _(spark, d):
    part = F.when(F.col("all_zero"), "qc_zero").otherwise("model").alias("part")
    return stated(spark, d).groupBy(part).agg(F.count(F.lit(1)).alias("minutes"), F.count_distinct("session_key").alias("sessions"), F.count_if("v_miss").alias("row_qc"))


@query("f16_priority_level", f"WITH {Q.RULES} SELECT session_key, CASE WHEN p <= 1 THEN 'very_high' WHEN p <= 5 THEN 'high' WHEN p <= 10 THEN 'elevated' WHEN p <= 25 THEN 'watch' ELSE 'normal' END AS level, CASE WHEN review_order <= 20 THEN 'top20' WHEN review_order <= 50 THEN 'top50' WHEN review_order <= 100 THEN 'top100' WHEN review_order <= 200 THEN 'top200' ELSE 'rest' END AS bucket FROM (SELECT *, 100.0 * review_order / count(*) OVER () AS p FROM rules)")
def _(spark, d):
    p = 100.0 * F.col("review_order") / F.lit(max(ruled(spark, d).count(), 1))
    return ruled(spark, d).withColumn("_p", p).select("session_key", S.level(F.col("_p")).alias("level"), S.order_bucket(F.col("review_order")).alias("bucket"))


# --- joins ---
@query("j12_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    o = read(spark, d, "orders")
    c = read(spark, d, "customer").join(o.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    big = o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("big", F.lit(True))
    return c.select("c_custkey").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("j13_key_union", "SELECT k, bool_or(s = 0) AS in_orders, bool_or(s = 1) AS in_building FROM (SELECT o_custkey AS k, 0 AS s FROM orders UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY k")
def _(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(0).alias("s"))
    b = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.lit(1).alias("s"))
    return a.unionByName(b).groupBy("k").agg(F.bool_or(F.col("s") == 0).alias("in_orders"), F.bool_or(F.col("s") == 1).alias("in_building"))


@query("j6_interval_metrics", f"WITH {Q.METRICS} SELECT session_key, duration, minutes, {r6s('rank_mean', 'rank_p95', 'chat_deficit_mean', 'unique_deficit_mean', 'zero_rate')}, max_zero_run FROM metrics")
def _(spark, d):
    return metrics(spark, d).select("session_key", "duration", "minutes", *r6("rank_mean", "rank_p95", "chat_deficit_mean", "unique_deficit_mean", "zero_rate"), F.col("max_zero_run").cast("long").alias("max_zero_run"))


# --- aggregations ---
@query("a2_dedup_messages", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click') WHERE k = 1")
def _(spark, d):
    e = telemetry.chat_events(read(spark, d, "events")).withColumn("h", F.sha2(F.concat_ws("_", F.col("user_id").cast("string"), "message"), 256))
    return windows.dedup_first(e, "h", ["ts", "event_id"]).select("event_id")


@query("a6_session_summary", f"WITH {Q.SESSIONS} SELECT session_key, n, start_ts::VARCHAR AS start_ts, end_ts::VARCHAR AS end_ts, {r6s('viewer_median', 'viewer_max')}, chat_sum, {r6s('chat_mean')}, unique_sum, {r6s('zero_rate')}, zrun_max, {r6s('gap_med')}, all_zero, {r6s('v_miss_rate')}, category_id, eligible, eligibility_reason FROM sess")
def _(spark, d):
    return sessions(spark, d).select("session_key", "n", text("start_ts"), text("end_ts"), *r6("viewer_median", "viewer_max"), "chat_sum", *r6("chat_mean"), "unique_sum", *r6("zero_rate"), F.col("zrun_max").cast("long").alias("zrun_max"), *r6("gap_med"), "all_zero", *r6("v_miss_rate"), "category_id", "eligible", "eligibility_reason")


@query("a8_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def _(spark, d):
    at = {"p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = ranks.quantiles(read(spark, d, "lineitem"), ["l_extendedprice"], tuple(at.values()), "l_returnflag")
    rows = spark.createDataFrame([(g, *q) for (g, _), q in found.items()], "l_returnflag string, " + ", ".join(f"{n} double" for n in at))  # one row per flag
    return rows.select("l_returnflag", *[F.round(n, 4).alias(n) for n in at])


@query("a11_state_dwell", f"WITH {Q.STATE}, r AS (SELECT session_key, isl_plain, bool_and(zero_chat) AS z, count(*) AS len FROM state GROUP BY ALL) SELECT session_key, sum(len)::BIGINT AS minutes, coalesce(sum(len) FILTER (z), 0)::BIGINT AS zero_minutes, count(*) FILTER (z) AS zero_runs, coalesce(max(len) FILTER (z), 0)::BIGINT AS zero_max_run, count(*) - 1 AS transitions FROM r GROUP BY 1")
def _(spark, d):
    w = windows.session_window()
    s = windows.island(minute(spark, d).withColumn("z", F.col("chat_count") == 0), F.col("z") != F.lag("z").over(w), "isl", w)
    runs = s.groupBy("session_key", "isl").agg(F.bool_and("z").alias("z"), F.count(F.lit(1)).alias("len"))
    return runs.groupBy("session_key").agg(F.sum("len").alias("minutes"), F.sum(F.when(F.col("z"), F.col("len")).otherwise(0)).alias("zero_minutes"), F.count_if("z").alias("zero_runs"), F.max(F.when(F.col("z"), F.col("len")).otherwise(0)).alias("zero_max_run"), (F.count(F.lit(1)) - 1).alias("transitions"))


@query("a12_transitions", f"WITH {Q.STATE}, t AS (SELECT lag(zero_chat) OVER (PARTITION BY run_id, broad_no ORDER BY minute_ts) AS f, zero_chat AS t FROM state), c AS (SELECT f, t, count(*) AS n FROM t WHERE f IS NOT NULL GROUP BY ALL) SELECT a.f AS from_zero, b.t AS to_zero, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.f), 6) AS share FROM (VALUES (true), (false)) a(f) CROSS JOIN (VALUES (true), (false)) b(t) LEFT JOIN c ON c.f = a.f AND c.t = b.t")
def _(spark, d):
    w = windows.session_window()
    m = minute(spark, d).withColumn("t", F.col("chat_count") == 0).withColumn("f", F.lag("t").over(w)).filter("f is not null")
    c = m.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(4).select((F.col("id") % 2 == 0).alias("f"), (F.col("id") < 2).alias("t"))
    out = grid.join(c, ["f", "t"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select(F.col("f").alias("from_zero"), F.col("t").alias("to_zero"), "n", F.round(S.ieee_div(F.col("n"), F.sum("n").over(Window.partitionBy("f"))), 6).alias("share"))  # an origin never left: 0 / 0, NaN


@query("a18_trajectory", f"WITH {Q.STATE} SELECT minute_idx, count(DISTINCT session_key) AS sessions, round(quantile_cont(viewer, 0.5), 6) AS med, round(quantile_cont(viewer, 0.75) - quantile_cont(viewer, 0.25), 6) AS iqr FROM state GROUP BY 1")
def _(spark, d):
    p = lambda q: F.percentile("viewer", F.lit(q))
    out = stated(spark, d).groupBy("minute_idx").agg(F.count_distinct("session_key").alias("sessions"), F.round(p(0.5), 6).alias("med"), F.round(p(0.75) - p(0.25), 6).alias("iqr"))
    return out.withColumn("minute_idx", F.col("minute_idx").cast("long"))


@query("a19_zero_rate_by_bin", f"WITH {Q.STATE} SELECT viewer_bin::INT AS viewer_bin, count(*) AS n, round(avg(zero_chat::INT), 6) AS zero_rate FROM state GROUP BY 1")
def _(spark, d):
    return stated(spark, d).groupBy("viewer_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("zero_chat").cast("double")), 6).alias("zero_rate"))


@query("a20_run_histogram", f"WITH {Q.STATE}, r AS (SELECT session_key, isl, count(*) AS len FROM state WHERE zero_chat GROUP BY ALL) SELECT len, count(*) AS runs FROM r GROUP BY 1 ORDER BY runs DESC, len LIMIT 25")
def _(spark, d):
    w = windows.session_window()
    z = windows.run_length(minute(spark, d).withColumn("z", F.col("chat_count") == 0), "z", "k", w, telemetry.GAP_MINUTES).withColumn("last", F.coalesce(F.lead("k").over(w) <= 1, F.lit(True)))
    return z.filter("k > 0 and last").groupBy(F.col("k").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("runs")).orderBy(F.desc("runs"), "len").limit(25)


@query("a22_session_audit", f"WITH {Q.EVENTS} SELECT run_id, user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM ev GROUP BY ALL HAVING count(DISTINCT event_type) > 1")
def _(spark, d):
    return telemetry.telemetry(read(spark, d, "events")).groupBy("run_id", "user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n")).filter("kinds > 1")


@query("a23_entity_counts", "SELECT 'users' AS entity, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'types', count(DISTINCT event_type) FROM events UNION ALL SELECT 'messages', count(DISTINCT props) FROM events")
def _(spark, d):
    e = read(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_distinct("props").alias("messages"))
    return e.select(F.expr("stack(3, 'users', users, 'types', types, 'messages', messages) as (entity, n)"))


@query("a25_nonzero_share", f"WITH {Q.MINUTE} SELECT session_key, round(100 * avg((chat_count <> 0)::INT), 6) AS pct FROM minute GROUP BY 1")
def _(spark, d):
    return minute(spark, d).groupBy("session_key").agg(F.round(100 * F.avg((F.col("chat_count") != 0).cast("double")), 6).alias("pct"))


@query("a27_tie_audit", f"WITH {Q.RULES}, c AS (SELECT rule_score, count(*) AS c FROM rules GROUP BY 1) SELECT count(*) AS distinct_scores, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS tied, max(c) AS largest_tie FROM c")
def _(spark, d):
    c = ruled(spark, d).groupBy("rule_score").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.count(F.lit(1)).alias("distinct_scores"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("tied"), F.max("c").alias("largest_tie"))


@query("a28_row_statistics", "WITH t AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber::DOUBLE END] AS a FROM lineitem), u AS (SELECT *, list_sort([x for x in a if x IS NOT NULL]) AS v FROM t) SELECT l_orderkey, l_linenumber, round(list_avg(v), 9) AS mean, round(list_median(v), 9) AS median, round(list_avg(v[2:len(v) - 1]), 9) AS trimmed, round(list_stddev_pop(v), 9) AS std, len([x for x in v if x >= 5])::BIGINT AS at_least_5 FROM u")
def _(spark, d):
    c = [F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100, F.when(F.col("l_linenumber") != 1, F.col("l_linenumber").cast("double"))]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.row_mean(c), 9).alias("mean"), F.round(S.row_median(c), 9).alias("median"), F.round(S.row_trimmed_mean(c), 9).alias("trimmed"), F.round(S.row_std(c), 9).alias("std"), S.row_count_at_least(c, 5.0).alias("at_least_5"))


@query("a29_cohens_d", f"WITH {Q.RULES}, l AS (SELECT review_order <= 50 AS g, unnest(['zero_rate', 'gap_med', 'viewer_median']) AS measure, unnest([zero_rate, gap_med, viewer_median]) AS x FROM rules), s AS (SELECT measure, count(x) FILTER (g) AS n0, count(x) FILTER (NOT g) AS n1, avg(x) FILTER (g) AS m0, avg(x) FILTER (NOT g) AS m1, var_samp(x) FILTER (g) AS v0, var_samp(x) FILTER (NOT g) AS v1 FROM l GROUP BY 1) SELECT measure, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS d FROM s")
def _(spark, d):
    return models.cohens_d(ruled(spark, d).withColumn("g", F.col("review_order") <= 50), "g", ["zero_rate", "gap_med", "viewer_median"])


@query("a34_quality_counts", f"WITH {Q.STATE} SELECT count(*) - count(DISTINCT (run_id, broad_no, minute_ts)) AS duplicate_keys, count(*) FILTER (chat_count < 0) AS negative, count(*) FILTER (chat_count < unique_chatters) AS chat_below_unique, count(*) FILTER (gap > 66) AS gaps FROM state")
def _(spark, d):
    w = windows.session_window()
    m = minute(spark, d).withColumn("gap", windows.gap_minutes("minute_ts", w))
    return m.agg((F.count(F.lit(1)) - F.count_distinct(*telemetry.KEY)).alias("duplicate_keys"), F.count_if(F.col("chat_count") < 0).alias("negative"), F.count_if(F.col("chat_count") < F.col("unique_chatters")).alias("chat_below_unique"), F.count_if(F.col("gap") > telemetry.GAP_MINUTES).alias("gaps"))


# --- windows ---
@query("w2_deltas", f"WITH {Q.MINUTE} SELECT run_id, broad_no, minute_ts::VARCHAR AS minute_ts, chat_count - lag(chat_count) OVER w AS delta_chat, lead(unique_chatters, 2) OVER w AS lead2 FROM minute WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts)")
def _(spark, d):
    w = windows.session_window()
    return minute(spark, d).select(*ID, text("minute_ts"), windows.delta("chat_count", w).alias("delta_chat"), F.lead("unique_chatters", 2).over(w).alias("lead2"))


@query("w3_zero_runs", f"WITH {Q.STATE} SELECT run_id, broad_no, minute_idx, zero_run_len, zero_run_plain FROM state")
def _(spark, d):
    w = windows.session_window()
    m = minute(spark, d).select(*ID, "minute_ts", (F.col("chat_count") == 0).alias("z"), F.row_number().over(w).cast("long").alias("minute_idx"))
    m = windows.run_length(windows.run_length(m, "z", "zero_run_len", w, telemetry.GAP_MINUTES), "z", "zero_run_plain", w)
    return m.select(*ID, "minute_idx", F.col("zero_run_len").cast("long").alias("zero_run_len"), F.col("zero_run_plain").cast("long").alias("zero_run_plain"))


@query("w5_rolling", f"WITH {Q.STATE} SELECT run_id, broad_no, minute_idx, {r6s('rolling_chat_deficit_5m', 'rolling_zero_rate_5m', 'rolling_chat_deficit_10m', 'rolling_zero_rate_10m')}, rolling_chat_sum_5m::BIGINT AS rolling_chat_sum_5m FROM state")
def _(spark, d):
    return stated(spark, d).select(*ID, F.col("minute_idx").cast("long").alias("minute_idx"), *r6("rolling_chat_deficit_5m", "rolling_zero_rate_5m", "rolling_chat_deficit_10m", "rolling_zero_rate_10m"), "rolling_chat_sum_5m")


@query("w6_interpolation", f"WITH {Q.STATE} SELECT run_id, broad_no, minute_idx, round(viewer, 6) AS viewer, v_miss FROM state")
def _(spark, d):
    w = windows.session_window()
    return state.clean_viewers(minute(spark, d)).select(*ID, F.row_number().over(w).cast("long").alias("minute_idx"), *r6("viewer"), "v_miss")


@query("w7_fill", f"WITH {Q.MINUTE} SELECT run_id, broad_no, minute_ts::VARCHAR AS minute_ts, coalesce(category_id, lag(category_id) OVER w) AS one, coalesce(last_value(category_id IGNORE NULLS) OVER b, first_value(category_id IGNORE NULLS) OVER a) AS filled FROM minute WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts), b AS (PARTITION BY run_id, broad_no ORDER BY minute_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run_id, broad_no ORDER BY minute_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def _(spark, d):
    w = windows.session_window()
    return minute(spark, d).select(*ID, text("minute_ts"), windows.ffill("category_id", w, 1).alias("one"), windows.fill_both("category_id", w).alias("filled"))


@query("w8_pct_rank", f"SELECT o_orderkey, round({Q.pct('o_totalprice')}, 9) AS pct, round({Q.pct('x')}, 9) AS tied FROM (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice / 5000) END AS x FROM orders)")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("x"))
    o = ranks.pct_ranks(o, {"pct": "o_totalprice", "tied": "x"})
    return o.select("o_orderkey", F.round("pct", 9).alias("pct"), F.round("tied", 9).alias("tied"))


@query("w9_qcut", "SELECT l_orderkey, l_linenumber, len([x for x in e if x < l_extendedprice])::INT AS bin FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM lineitem)")
def _(spark, d):
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ranks.qcut(F.col("l_extendedprice"), ranks.qcut_edges(li, "l_extendedprice", 10)).alias("bin"))


@query("w11_average_percentile", "WITH r AS (SELECT p_retailprice AS x, count(*) AS c FROM part GROUP BY 1), s AS (SELECT DISTINCT s_acctbal AS v FROM supplier), p AS (SELECT v, (coalesce(sum(c) FILTER (x < v), 0) + coalesce(sum(c) FILTER (x <= v), 0)) / (2.0 * (SELECT count(*) FROM part)) AS p FROM s, r GROUP BY v) SELECT s_suppkey, round(p, 9) AS pct FROM supplier JOIN p ON s_acctbal = v")
def _(spark, d):
    return ranks.average_percentile(read(spark, d, "supplier"), "s_acctbal", read(spark, d, "part"), "p_retailprice", "pct").select("s_suppkey", F.round("pct", 9).alias("pct"))


@query("w19_episodes", "WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_totalprice > 150000 AS hot FROM orders), g AS (SELECT *, sum(CASE WHEN coalesce(i - p > 2, true) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i) AS e FROM (SELECT *, lag(i) OVER (PARTITION BY o_custkey ORDER BY i) AS p FROM f WHERE hot)) SELECT o_custkey, e::BIGINT AS episode, min(i) AS first_idx, max(i) AS last_idx, count(*) AS n FROM g GROUP BY ALL")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, d, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w).cast("long").alias("i")).filter("o_totalprice > 150000")
    e = windows.episodes(o, 1, Window.partitionBy("o_custkey").orderBy("i"), "i")
    return e.groupBy("o_custkey", "episode").agg(F.min("i").alias("first_idx"), F.max("i").alias("last_idx"), F.count(F.lit(1)).alias("n"))


# --- top k and set operations ---
@query("t3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("t4_top_share", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE k <= ceil(n * 0.05)")
def _(spark, d):
    w = Window.partitionBy("l_suppkey")
    li = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return li.filter(F.col("k") <= F.ceil(F.col("n") * 0.05)).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("so_set_algebra", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_n, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard")
def _(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority").like("1%")).alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("both_n"), F.count_if(a & ~b).alias("only_a"), F.round(F.count_if(a & b) / F.count_if(a | b), 6).alias("jaccard"))


# --- statistics and ranking ---
@query("r1_state", f"WITH {Q.STATE} SELECT run_id, broad_no, minute_idx, viewer_bin::INT AS viewer_bin, {r6s('chat_deficit', 'unique_deficit', 'log_viewer')} FROM state")
def _(spark, d):
    return stated(spark, d).select(*ID, F.col("minute_idx").cast("long").alias("minute_idx"), "viewer_bin", *r6("chat_deficit", "unique_deficit", "log_viewer"))


@query("r2_mismatch_rank", f"WITH {Q.SCORES} SELECT run_id, broad_no, minute_idx, {r6s('minute_mismatch_score', 'minute_mismatch_rank')}, reason FROM scores")
def _(spark, d):
    return scored(spark, d).select(*ID, F.col("minute_idx").cast("long").alias("minute_idx"), *r6("minute_mismatch_score", "minute_mismatch_rank"), "reason")


@query("r3_scan", f"WITH {Q.SCAN} SELECT run_id, broad_no, block::BIGINT AS block, start_idx, end_idx, round(scan_z, 6) AS scan_z, end_idx - start_idx + 1 AS duration FROM scan")
def _(spark, d):
    out = scan.best_intervals(zed(spark, d), telemetry.GAP_MINUTES)
    return out.select(*ID, "block", F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), *r6("scan_z"), "duration")


@query("r3_scan_null", f"WITH {Q.BEST} SELECT run_id, broad_no, block::BIGINT AS block, n_rows AS n, round(scan_z, 6) AS scan_z, round(null_mean, 6) AS null_mean, round(null_p95, 6) AS null_p95, round(CASE WHEN n_rows > 1 THEN p0 END, 6) AS empirical_p FROM (SELECT * REPLACE (CASE WHEN n_rows > 1 THEN null_mean END AS null_mean, CASE WHEN n_rows > 1 THEN null_p95 END AS null_p95) FROM pm4)")
def _(spark, d):
    return scan.scan_blocks(zed(spark, d), telemetry.GAP_MINUTES, Q.N_PERM).select(*ID, "block", "n", *r6("scan_z", "null_mean", "null_p95", "empirical_p"))


@query("t7_best_block", f"WITH {Q.BEST} SELECT session_key, block::BIGINT AS block, start_idx, end_idx, duration, {r6s('scan_z', 'empirical_p')}, ((epoch(end_ts) - epoch(start_ts)) / 60 + 1)::DOUBLE AS clock_minutes FROM bestscan")
def _(spark, d):
    i = lambda c: F.col(c).cast("long").alias(c)
    return found(spark, d).select("session_key", "block", i("start_idx"), i("end_idx"), "duration", *r6("scan_z", "empirical_p"), F.col("clock_minutes").cast("double").alias("clock_minutes"))


@query("r3_scan_null_200")
def _(spark, d):
    """The method's 200 permutations; the SQL repeats 19 of them."""
    return scan.best_intervals(zed(spark, d), telemetry.GAP_MINUTES, 200)


@query("r18_episode_grid", f"WITH {Q.SCORES}, cut AS (SELECT unnest([0.90, 0.95, 0.97, 0.99])::DOUBLE AS q, unnest(quantile_cont(minute_mismatch_rank, [0.90, 0.95, 0.97, 0.99])) AS cutoff FROM scores), h AS (SELECT run_id, broad_no, q, minute_idx, lag(minute_idx) OVER (PARTITION BY run_id, broad_no, q ORDER BY minute_idx) AS p FROM scores JOIN cut ON minute_mismatch_rank >= cutoff), g AS (SELECT *, sum(CASE WHEN coalesce(minute_idx - p > 2, true) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, broad_no, q ORDER BY minute_idx) AS e FROM h), ep AS (SELECT run_id, broad_no, q, e, max(minute_idx) - min(minute_idx) + 1 AS duration FROM g GROUP BY ALL) SELECT q, d.d::BIGINT AS min_duration, count(*) AS episodes, count(DISTINCT (run_id, broad_no)) AS sessions, max(duration)::BIGINT AS longest FROM ep, (VALUES (1), (2), (3), (5), (10)) d(d) WHERE duration >= d.d GROUP BY ALL")
def _(spark, d):
    g = scan.episode_grid(scored(spark, d), GRID_Q, GRID_D)
    return g.groupBy("q", F.col("min_duration").cast("long").alias("min_duration")).agg(F.count(F.lit(1)).alias("episodes"), F.count_distinct(*ID).alias("sessions"), F.max("duration").cast("long").alias("longest"))


@query("r30_rule_order", f"WITH {Q.RULES} SELECT session_key, {r6s('rule_score')}, review_order FROM rules")
def _(spark, d):
    return ruled(spark, d).select("session_key", *r6("rule_score"), F.col("review_order").cast("long").alias("review_order"))


_FAM = FAMILIES
_REVIEW = Q.REVIEW
_families = reviewed


@query("r15_review_order", f"WITH {_REVIEW} SELECT session_key, {r6s('consensus')}, round(rra_p, 9) AS rra_p, round(rra_q, 9) AS rra_q, review_order FROM review")
def _(spark, d):
    return _families(spark, d).select("session_key", *r6("consensus"), F.round("rra_p", 9).alias("rra_p"), F.round("rra_q", 9).alias("rra_q"), F.col("review_order").cast("long").alias("review_order"))


@query("r24_aggregation_variants", f"WITH {_REVIEW}, s AS (SELECT session_key, list_sort([x for x in [{', '.join(f'{f}_strength' for f in _FAM)}] if x IS NOT NULL]) AS s FROM review) SELECT session_key, round(round(list_avg(s), 9), 6) AS v_mean, round(round(list_median(s), 9), 6) AS v_median, round(round(list_sum(s[2:len(s) - 1]) / (len(s) - 2), 9), 6) AS v_trimmed FROM s")
def _(spark, d):
    return review.variants(_families(spark, d), FAMILIES).select("session_key", *r6("v_mean", "v_median", "v_trimmed"))


@query("r23_family_ablation", "WITH " + _REVIEW + ", o AS (" + " UNION ALL ".join(f"SELECT '{x}' AS family, review_order, row_number() OVER (ORDER BY round(({' + '.join(f'{f}_strength' for f in _FAM if f != x)}) / 4, 9) DESC, session_key) AS other FROM review" for x in _FAM) + ") SELECT family, count(*) FILTER (review_order <= 100 AND other <= 100) AS overlap, round(corr(review_order, other), 6) AS spearman FROM o GROUP BY 1")
def _(spark, d):
    return review.ablation(_families(spark, d), FAMILIES, 100)


@query("r34_compare_rankings", f"WITH {_REVIEW}, a AS (SELECT session_key, review_order AS pa FROM review), b AS (SELECT session_key, review_order AS pb FROM rules), j AS (SELECT * FROM a FULL JOIN b USING (session_key)), k AS (SELECT k.k::BIGINT AS k, count(*) FILTER (pa <= k.k AND pb <= k.k) AS overlap, count(*) FILTER (pa <= k.k OR pb <= k.k) AS e, count(*) FILTER (pa <= k.k) AS ia FROM j, (VALUES (50), (100), (200), (500)) k(k) GROUP BY 1) SELECT k, overlap, round(overlap / e, 6) AS jaccard, round(overlap / ia, 6) AS recall FROM k")
def _(spark, d):
    a = _families(spark, d).withColumn("place", F.col("review_order"))
    return review.compare_orders(a, ruled(spark, d).withColumn("place", F.col("review_order")), (50, 100, 200, 500))


@query("r34_rank_gap", f"WITH {_REVIEW} SELECT count(*) AS n, round(corr(a.review_order, b.review_order), 6) AS spearman, round(avg(abs(a.review_order - b.review_order)), 6) AS mean_gap, quantile_cont(abs(a.review_order - b.review_order), 0.5)::DOUBLE AS median_gap FROM review a JOIN rules b USING (session_key)")
def _(spark, d):
    return review.rank_gap(_families(spark, d).withColumn("place", F.col("review_order")), ruled(spark, d).withColumn("place", F.col("review_order")))


_RS = ("zero_rate", "gap_med", "zrun_max", "v_miss_rate")
_REASONS = Q.SESSIONS + f", lg AS (SELECT session_key, unnest([{', '.join(repr(x) for x in _RS)}]) AS reason, unnest([{', '.join(f'{x}::DOUBLE' for x in _RS)}]) AS value FROM sess WHERE eligible), rk AS (SELECT session_key, reason, {Q.pct('value', 'reason')} AS pct FROM lg WHERE value IS NOT NULL), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY pct DESC, reason) AS place FROM rk) WHERE place <= 3)"


@query("r16_reasons", f"WITH {_REASONS} SELECT session_key, reason, {r6s('pct')}, place FROM top")
def _(spark, d):
    out = review.reasons(sessions(spark, d).filter("eligible"), list(_RS))
    return out.select("session_key", "reason", *r6("pct"), F.col("place").cast("long").alias("place"))


@query("a13_reason_patterns", f"WITH {_REASONS}, p AS (SELECT session_key, string_agg(reason, ';' ORDER BY reason) AS pattern FROM top GROUP BY 1) SELECT pattern, count(*) AS sessions, array_to_string(list(session_key ORDER BY session_key)[1:5], ';') AS examples, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM p GROUP BY 1")
def _(spark, d):
    return review.reason_patterns(review.reasons(sessions(spark, d).filter("eligible"), list(_RS)))


@query("r35_correlations", f"WITH {Q.STATE} SELECT round(corr(viewer, chat_count), 6) AS viewer_chat, round(corr(log_viewer, log_chat), 6) AS log_viewer_chat, round(corr(chat_count, unique_chatters), 6) AS chat_unique FROM state")
def _(spark, d):
    return stated(spark, d).agg(F.round(F.corr("viewer", "chat_count"), 6).alias("viewer_chat"), F.round(F.corr("log_viewer", "log_chat"), 6).alias("log_viewer_chat"), F.round(F.corr("chat_count", "unique_chatters"), 6).alias("chat_unique"))


# --- models and metrics ---
_LI = ["l_quantity", "l_extendedprice", "l_discount"]


@query("m1_robust_scale", f"WITH q AS (SELECT {', '.join(f'quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}' for c in _LI)} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 6) AS {c}' for c in _LI)} FROM lineitem, q")
def _(spark, d):
    return models.robust_scale(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LI), _LI).select("l_orderkey", "l_linenumber", *r6(*_LI))


@query("x18_min_max", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}' for c in _LI)} FROM lineitem")
def _(spark, d):
    return models.min_max(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LI), _LI).select("l_orderkey", "l_linenumber", *r6(*_LI))


_EC = ["l_quantity", "l_discount", "l_tax"]


@query("m8_ecod", f"WITH n AS (SELECT count(*) AS n, {', '.join(f'(avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) AS s_{c}' for c in _EC)} FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, n.*, {', '.join(f'-ln(count(*) OVER (ORDER BY {c} RANGE UNBOUNDED PRECEDING) / n) AS l_{c}, -ln(count(*) OVER (ORDER BY {c} DESC RANGE UNBOUNDED PRECEDING) / n) AS r_{c}' for c in _EC)} FROM lineitem, n) SELECT l_orderkey, l_linenumber, round(greatest({' + '.join(f'l_{c}' for c in _EC)}, {' + '.join(f'r_{c}' for c in _EC)}, {' + '.join(f'CASE WHEN s_{c} < 0 THEN l_{c} ELSE r_{c} END' for c in _EC)}), 6) AS ecod FROM t")
def _(spark, d):
    return models.ecod(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_EC), _EC).select("l_orderkey", "l_linenumber", *r6("ecod"))


@query("m14_binary_metrics", "WITH x AS (SELECT -n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, sum(y) AS p, count(*) AS c FROM x GROUP BY 1), r AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS seen, sum(p) OVER () AS pos, sum(c) OVER () AS n FROM g WINDOW w AS (ORDER BY s)), t AS (SELECT tp / seen AS pr, tp / pos AS rc FROM r WHERE seen - c < pos ORDER BY seen DESC LIMIT 1) SELECT max(n)::BIGINT AS n, max(pos)::BIGINT AS positives, round(sum(p * tp / seen) / max(pos), 6) AS average_precision, round(sum(p * ((n - pos - (seen - tp)) + (c - p) / 2)) / (max(pos) * (max(n) - max(pos))), 6) AS roc_auc, (SELECT round(5 * pr * rc / (4 * pr + rc), 6) FROM t) AS f2_at_prior FROM r")
def _(spark, d):
    x = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return models.binary_metrics(x, "n_chars", "quality")


@query("m14_precision_at_k", "WITH x AS (SELECT doc_id, n_chars, quality AS y FROM documents JOIN labels USING (doc_id)), t AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM x) SELECT k.k::BIGINT AS k, sum(y)::BIGINT AS hits, round(sum(y) / count(*), 6) AS precision, round(sum(y) / (SELECT sum(y) FROM x), 6) AS recall FROM t, (VALUES (20), (50), (100)) k(k) WHERE place <= k.k GROUP BY 1")
def _(spark, d):
    x = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return models.precision_at(x, "n_chars", "quality", "doc_id", (20, 50, 100))


_X = [f"x{i}" for i in range(4)]


@query("m15_cluster_metrics", f"WITH e AS (SELECT label, {', '.join(f'embedding[{i + 1}]::DOUBLE AS x{i}' for i in range(4))} FROM embeddings), c AS (SELECT label, count(*) AS n, {', '.join(f'avg({x}) AS c_{x}' for x in _X)} FROM e GROUP BY 1), p AS (SELECT e.label, any_value(n) AS n, sum({' + '.join(f'pow({x} - c_{x}, 2)' for x in _X)}) AS w, avg(sqrt({' + '.join(f'pow({x} - c_{x}, 2)' for x in _X)})) AS s, {', '.join(f'any_value(c_{x}) AS c_{x}' for x in _X)} FROM e JOIN c USING (label) GROUP BY 1), g AS (SELECT {', '.join(f'avg({x}) AS g_{x}' for x in _X)} FROM e), h AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS w, sum(n * ({' + '.join(f'pow(c_{x} - g_{x}, 2)' for x in _X)})) AS b, min(n) AS lo, max(n) AS hi FROM p, g), db AS (SELECT avg(r) AS db FROM (SELECT a.label, max((a.s + b.s) / sqrt({' + '.join(f'pow(a.c_{x} - b.c_{x}, 2)' for x in _X)})) AS r FROM p a JOIN p b ON a.label <> b.label GROUP BY 1)) SELECT k, n::BIGINT AS n, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, round(db, 6) AS davies_bouldin, round(lo / hi, 6) AS size_balance FROM h, db")
def _(spark, d):
    e = models.embedding_columns(read(spark, d, "embeddings"), "embedding", 4).select("label", *_X)
    return models.calinski_davies(e, "label", _X)


@query("m15_cluster_metrics_whole")
def _(spark, d):
    """The same over all components; the SQL of m15_cluster_metrics holds that one to the first four."""
    e = read(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = [f"x{i}" for i in range(max(width, 1))]
    return models.calinski_davies(models.embedding_columns(e, "embedding", len(x)).select("label", *x), "label", x)


@query("m15_adjusted_rand", "WITH e AS (SELECT label AS a, (vec_id % 4)::INT AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), p AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)), q AS (SELECT sum(n * (n - 1) / 2) AS q FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1)) SELECT round((i - p * q / (t * (t - 1) / 2)) / ((p + q) / 2 - p * q / (t * (t - 1) / 2)), 6) AS ari FROM i, p, q")
def _(spark, d):
    e = read(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 4).cast("int").alias("b"))
    return models.adjusted_rand(e, "a", "b")


@query("m2_kmeans_sessions")
def _(spark, d):
    s = models.robust_scale(models.median_impute(sessions(spark, d).filter("eligible").select("session_key", *_RS), list(_RS)), list(_RS))
    return models.kmeans_labels(s, list(_RS), 2, "zero_rate").select("session_key", F.col("cluster").cast("long").alias("cluster"))
