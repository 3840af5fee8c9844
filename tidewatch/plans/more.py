"""Sources, sinks, joins, profiles and audits that the other modules don't have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evidence, live, models, ranks, review, scan, state, synthetic, windows
from ..sources import paged, sinks, telemetry
from ..sources.steps import new_path
from . import sql as Q
from .telemetry import GRID_D, GRID_Q, ID, WINDOWS, _in_sql, dwelt, found, marked, metrics, minute, query, r6, r6s, ranked, read, reviewed, reviewed_all, ruled, scored, sessions, stated, supported, text

i8 = lambda *names: [F.col(c).cast("long").alias(c) for c in names]


# --- sources and sinks ---
@query("src1_multi_file_scan", "SELECT 'customer' AS source_file, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier")
def _(spark, d):
    return telemetry.scan_files(spark, [f"{d}/customer.parquet", f"{d}/supplier.parquet"], lambda c: c[2:]).select("source_file", "name", "acctbal", F.col("mktsegment").alias("segment"))


@query("src4_snapshots_of_run", f"WITH {Q.EVENTS} SELECT event_id, broad_no, event_type, value FROM shot WHERE run_id = 20240105")
def _(spark, d):
    return telemetry.snapshots(read(spark, d, "events"), 20240105).select("event_id", "broad_no", "event_type", "value")


@query("src5_run_lookups", f"WITH {Q.EVENTS}, r AS (SELECT run_id, count(*) AS n, max(ts) AS ended, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'success' END AS status FROM ev GROUP BY 1) SELECT 'by_id' AS lookup, run_id, n FROM r WHERE run_id = 20240105 UNION ALL SELECT * FROM (SELECT 'last_failed', run_id, n FROM r WHERE status = 'failed' ORDER BY run_id DESC LIMIT 1)")
def _(spark, d):
    r = telemetry.run_status(telemetry.telemetry(read(spark, d, "events")))
    last = r.filter("status = 'failed'").orderBy(F.desc("run_id")).limit(1)
    return r.filter("run_id = 20240105").select(F.lit("by_id").alias("lookup"), "run_id", "n").unionByName(last.select(F.lit("last_failed").alias("lookup"), "run_id", "n"))


@query("src6_csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    """Written with a byte order mark before the header, and read back by a known schema."""
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = new_path(spark, "csv")
    n.select(F.col("n_nationkey").alias("﻿n_nationkey"), "n_name", "n_regionkey").write.csv(path, header=True)
    return telemetry.read_csv(spark, path, n.schema)


_TARGETS = "SELECT c_custkey FROM customer WHERE c_nationkey = 3"


@query("src7_paged_items", f"SELECT broad_no, user_id, priority, viewers, page FROM (SELECT o_orderkey AS broad_no, o_custkey::VARCHAR AS user_id, o_custkey, o_orderpriority AS priority, coalesce(floor(o_totalprice)::BIGINT, 0) AS viewers, (row_number() OVER (ORDER BY o_orderkey) - 1) // 20 AS page FROM orders) WHERE o_custkey IN ({_TARGETS})")
def _(spark, d):
    """All orders as pages of 20 items behind cursors, walked for the items of one nation's customers."""
    orders = ranks.places(read(spark, d, "orders"), [F.col("o_orderkey")], "place")
    items = orders.select(F.col("o_orderkey").cast("long").alias("broad_no"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("priority"), F.floor("o_totalprice").cast("long").alias("viewers"), F.floor((F.col("place") - 1) / 20).cast("long").alias("page"))
    path = new_path(spark, "pages")
    paged.write_pages(items, [F.col("broad_no")], path)
    targets = read(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("user_id"))
    return paged.of_targets(paged.read_pages(spark, path, "broad_no long, user_id string, priority string, viewers long, page long", "user_id"), targets, "user_id")


def _rates(rows: str, keys: str) -> str:
    m = "(hour(ts) * 60 + minute(ts))"
    rates = " UNION ALL ".join(f"SELECT {keys}, {i} AS w, avg({_in_sql(m, *w)}::INT) AS rate FROM {rows} GROUP BY {keys}" for i, w in enumerate(WINDOWS))
    return f"best AS (SELECT {keys}, w AS matched, 1 - rate AS off_rate FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rate DESC, w) AS k FROM ({rates})) WHERE k = 1), ends AS (SELECT {keys}, date_trunc('hour', min(ts)) AS a, max(ts) + INTERVAL 1 MINUTE AS z FROM {rows} GROUP BY {keys}), spans AS (SELECT {keys}, strftime(a, '%H:%M') || '-' || strftime(CASE WHEN date_trunc('hour', z) = z AND z > a THEN z ELSE date_trunc('hour', z) + INTERVAL 1 HOUR END, '%H:%M') AS live_window FROM ends)"


_LIVE = f"{Q.MINUTE}, m AS (SELECT run_id, broad_no, minute_ts, max(minute_ts) OVER (PARTITION BY run_id) + CASE WHEN run_id % 2 = 1 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END AS now FROM minute), g AS (SELECT run_id, broad_no, quantile_cont(epoch(minute_ts), 0.5) AS md, epoch(max(now)) AS now FROM m GROUP BY ALL), l AS (SELECT run_id, broad_no, abs(md - now) < abs(md + 32400 - now) AS already_local FROM g), t AS (SELECT run_id, broad_no, already_local, minute_ts + CASE WHEN already_local THEN INTERVAL 0 HOUR ELSE INTERVAL 9 HOUR END AS ts FROM minute JOIN l USING (run_id, broad_no))"


@query("f15_live_stamps", f"WITH {_LIVE}, {_rates('t', 'run_id, broad_no')} SELECT run_id, broad_no, already_local, live_window, matched, round(off_rate, 6) AS off_rate, off_rate <= 0.85 AS in_window FROM l JOIN best USING (run_id, broad_no) JOIN spans USING (run_id, broad_no)")
def _(spark, d):
    """Sessions of odd runs as if collected nine hours later: their stamps read as UTC, the others' as local time."""
    m = minute(spark, d).select(*ID, "minute_ts")
    late = m.groupBy("run_id").agg(F.max("minute_ts").alias("now"))
    late = late.withColumn("now", F.timestamp_add("HOUR", F.when(F.col("run_id") % 2 == 1, 9).otherwise(0), F.col("now")))
    settled = live.settle_stamps(m.join(late, "run_id"), ID, "minute_ts", "now", 9).withColumn("ts", F.timestamp_add("HOUR", F.lit(9), F.col("minute_ts")))
    return live.live_windows(settled, [*ID, "already_local"], "ts", WINDOWS, 0.85).select(*ID, "already_local", "live_window", "matched", *r6("off_rate"), "in_window")


@query("f15_planned_window", f"WITH ev AS (SELECT event_id, unnest(generate_series(date_trunc('minute', ts), date_trunc('minute', ts) + to_minutes(ceil(greatest(event_id % 7200, 60) / 60)::INT), INTERVAL 1 MINUTE)) AS ts FROM events), {_rates('ev', 'event_id')} SELECT event_id, live_window, matched, round(off_rate, 6) AS off_rate, off_rate <= 0 AS in_window FROM best JOIN spans USING (event_id)")
def _(spark, d):
    """Each event as the moment before a collection of up to two hours."""
    e = read(spark, d, "events").select("event_id", "ts", (F.col("event_id") % 7200).alias("seconds"))
    return live.planned_windows(e, ["event_id"], "ts", "seconds", WINDOWS).select("event_id", "live_window", "matched", *r6("off_rate"), "in_window")


_LINES = "SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey || ',' || c_name ELSE c_custkey || ', ' || c_name || ' ,' || c_mktsegment || ',x' END AS value FROM customer"


@query("src9_targets", f"WITH l AS (SELECT string_split(value, ',') AS p FROM ({_LINES})) SELECT trim(p[1]) AS user_id, trim(p[2]) AS name, trim(p[3]) AS channel FROM l WHERE len(p) >= 3")
def _(spark, d):
    c = read(spark, d, "customer")
    short, long = F.concat_ws(",", "c_custkey", "c_name"), F.concat(F.col("c_custkey").cast("string"), F.lit(", "), "c_name", F.lit(" ,"), "c_mktsegment", F.lit(",x"))
    return telemetry.targets_of_lines(c.select(F.when(F.col("c_custkey") % 10 == 0, short).otherwise(long).alias("value")))


@query("src10_manual_labels", "SELECT doc_id, coalesce(quality, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END) AS label, quality IS NOT NULL AS by_hand FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    j = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", (F.col("n_chars") >= 500).cast("int")).alias("label"), F.col("quality").isNotNull().alias("by_hand"))


@query("src12_normalised_minute", f"WITH {Q.MINUTE} SELECT run_id, broad_no, session_key, minute_ts::VARCHAR AS minute_ts, round(viewer_count_last, 6) AS viewer_count_last, chat_count FROM minute")
def _(spark, d):
    """A saved minute table, all text with padded numbers and a repeated row each, taken in again."""
    m = minute(spark, d).select("minute_ts", *ID, "viewer_count_last", "chat_count", "unique_chatters")
    saved = m.select(*[F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(".0" if c in (*ID, "chat_count", "unique_chatters") else "")).alias(c) for c in m.columns])
    return telemetry.normalise_minute(saved.unionByName(saved)).select(*ID, "session_key", text("minute_ts"), *r6("viewer_count_last"), "chat_count")


@query("snk3_conformed_write", "SELECT s_suppkey AS broad_no, s_acctbal::DOUBLE AS viewer_count_last, NULL::VARCHAR AS category_id, NULL::BIGINT AS chat_count FROM supplier")
def _(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("broad_no"), F.col("s_acctbal").alias("viewer_count_last"), F.lit(1).alias("dropped"))
    path = sinks.write_conformed(s, telemetry.MINUTE_SCHEMA, new_path(spark, "conformed"))
    return spark.read.parquet(path).select("broad_no", "viewer_count_last", "category_id", "chat_count")


@query("snk6_run_lifecycle", f"WITH {Q.EVENTS} SELECT run_id, min(ts)::VARCHAR AS started, max(ts)::VARCHAR AS ended, count(*) AS n, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'success' END AS status FROM ev GROUP BY 1")
def _(spark, d):
    return telemetry.run_status(telemetry.telemetry(read(spark, d, "events"))).select("run_id", text("started"), text("ended"), "n", "status")


# --- filters ---
@query("f3_drop_null_keys", "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", "source").na.drop().select("doc_id")


@query("f4_time_shift", "SELECT event_id, (ts + INTERVAL 9 HOUR)::VARCHAR AS ts FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(9))).cast("string").alias("ts"))


_QC = f"{Q.STATE}, qc AS (SELECT *, v_miss AS q1, chat_count < unique_chatters AS q2, minute_idx = 1 AND v_miss AS q3, coalesce(gap > 66, false) AS q4, chat_count < 0 AS q5 FROM state)"


@query("f9_row_qc", f"WITH {_QC} SELECT session_key, minute_idx, concat_ws(';', CASE WHEN q1 THEN 'v_miss' END, CASE WHEN q2 THEN 'chat_below_unique' END, CASE WHEN q3 THEN 'v_edge' END, CASE WHEN q4 THEN 'clock_gap' END, CASE WHEN q5 THEN 'negative' END) AS flags FROM qc WHERE q1 OR q2 OR q3 OR q4 OR q5")
def _(spark, d):
    return state.row_qc(stated(spark, d), telemetry.GAP_MINUTES).select("session_key", *i8("minute_idx"), "flags")


@query("f10_eligibility", f"WITH {Q.SESSIONS}, e AS (SELECT *, v_miss_rate > 0.5 AS v_qc FROM sess) SELECT session_key, n >= 10 AND NOT v_qc AND NOT all_zero AS ok, coalesce(nullif(concat_ws(';', CASE WHEN n < 10 THEN 'n_below_min_n_10' END, CASE WHEN v_qc THEN 'v_qc_nonzero' END, CASE WHEN all_zero THEN 'all_zero_session' END), ''), 'eligible') AS reason FROM e")
def _(spark, d):
    return state.eligibility(sessions(spark, d).withColumn("v_qc", F.col("v_miss_rate") > 0.5)).select("session_key", "ok", "reason")


@query("f13_median_impute", f"WITH {Q.SESSIONS}, x AS (SELECT session_key, CASE WHEN n % 7 <> 0 THEN gap_med END AS gap_med, CASE WHEN n % 5 <> 0 THEN viewer_median END AS viewer_median FROM sess) SELECT session_key, round(coalesce(gap_med, (SELECT quantile_cont(gap_med, 0.5) FROM x), 0), 6) AS gap_med, round(coalesce(viewer_median, (SELECT quantile_cont(viewer_median, 0.5) FROM x), 0), 6) AS viewer_median FROM x")
def _(spark, d):
    s = sessions(spark, d).select("session_key", F.when(F.col("n") % 7 != 0, F.col("gap_med")).otherwise(F.when(F.col("n") % 2 == 0, F.lit(float("inf")))).alias("gap_med"), F.when(F.col("n") % 5 != 0, F.col("viewer_median")).alias("viewer_median"))
    return models.median_impute(s, ["gap_med", "viewer_median"]).select("session_key", *r6("gap_med", "viewer_median"))


# --- joins ---
@query("j3_base_pred", f"WITH {Q.CLUSTERS} SELECT run_id::VARCHAR AS run_id, broad_no::VARCHAR AS broad_no, minute_idx::BIGINT AS minute_idx, {r6s('minute_mismatch_rank', 'model_chat_deficit')}, CASE WHEN minute_idx % 3 <> 0 THEN chat_deficit > 0 AND model_chat_deficit > 0 END AS agree FROM (SELECT * REPLACE (CASE WHEN minute_idx % 3 <> 0 THEN model_chat_deficit END AS model_chat_deficit) FROM marked)")
def _(spark, d):
    """Scores beside the expected response on four keys, compared as canonical text."""
    pred = marked(spark, d).filter("minute_idx % 3 <> 0").select(*[F.concat(F.col(c).cast("string"), F.lit(".0")).alias(c) for c in (*ID, "minute_idx")], "minute_ts", "model_chat_deficit")
    out = telemetry.join_by_ids(scored(spark, d), pred, [*ID, "minute_idx"], ["minute_ts"])
    agree = (F.col("chat_deficit") > 0) & (F.col("model_chat_deficit") > 0)
    return out.select(*[F.col(c).cast("string").alias(c) for c in ID], *i8("minute_idx"), *r6("minute_mismatch_rank", "model_chat_deficit"), F.when(F.col("model_chat_deficit").isNotNull(), agree).alias("agree"))


@query("j5_cluster_rank", f"WITH {Q.CLUSTERS} SELECT session_key, minute_idx::BIGINT AS minute_idx, minute_cluster, {r6s('cluster_mismatch_rank')}, mismatch_state FROM marked")
def _(spark, d):
    return marked(spark, d).select("session_key", *i8("minute_idx"), "minute_cluster", *r6("cluster_mismatch_rank"), "mismatch_state")


@query("j11_multi_broad", f"WITH {Q.EVENTS}, k AS (SELECT run_id, user_id % 7 AS group_id FROM ev GROUP BY ALL HAVING count(DISTINCT broad_no) > 15) SELECT event_id, run_id, broad_no FROM ev WHERE (run_id, user_id % 7) IN (SELECT (run_id, group_id) FROM k)")
def _(spark, d):
    e = telemetry.telemetry(read(spark, d, "events")).withColumn("group_id", F.col("user_id") % 7)
    k = e.groupBy("run_id", "group_id").agg(F.count_distinct("broad_no").alias("n")).filter("n > 15")
    return e.join(k, ["run_id", "group_id"], "left_semi").select("event_id", "run_id", "broad_no")


@query("a22_broads_of_group", f"WITH {Q.EVENTS} SELECT run_id, user_id % 7 AS group_id, count(DISTINCT broad_no) AS broads FROM ev GROUP BY ALL")
def _(spark, d):
    return telemetry.telemetry(read(spark, d, "events")).groupBy("run_id", (F.col("user_id") % 7).alias("group_id")).agg(F.count_distinct("broad_no").alias("broads"))


_FIVE = ["zero_rate", "gap_med", "zrun_max", "nc", "nu"]


@query("j14_five_rankings", f"WITH {Q.RULES}, o AS (SELECT session_key, {', '.join(f'row_number() OVER (ORDER BY p{k + 1} DESC, session_key) AS {c}_place' for k, c in enumerate(_FIVE))} FROM rules) SELECT *, {' + '.join(f'({c}_place <= 50)::INT' for c in _FIVE)} AS flags FROM o")
def _(spark, d):
    """Five rankings side by side, each with its flag, by left joins on the session."""
    s = ruled(spark, d)
    frames = {c: ranks.places(s.select("session_key", F.col(f"p_{c}").alias("p")), [F.desc("p"), F.asc("session_key")], "place").drop("p") for c in _FIVE}
    return review.widen(s.select("session_key"), frames, 50)


# --- aggregations ---
@query("a7_qc_zero", f"WITH {Q.STATE} SELECT session_key, count(*) AS n, min(minute_ts)::VARCHAR AS start_ts, max(minute_ts)::VARCHAR AS end_ts, round(quantile_cont(viewer, 0.5), 6) AS viewer_median, round(max(viewer), 6) AS viewer_max, round(avg(v_miss::INT), 6) AS v_miss_rate, sum(chat_count)::BIGINT AS total_chat, bool_and(zero_chat) AS all_zero_chat, arg_min(category_id, minute_ts) FILTER (category_id IS NOT NULL) AS category_id FROM state WHERE all_zero GROUP BY 1")
def _(spark, d):
    return state.qc_zero_sessions(stated(spark, d)).select("session_key", "n", text("start_ts"), text("end_ts"), *r6("viewer_median", "viewer_max", "v_miss_rate"), "total_chat", "all_zero_chat", "category_id")


_PROF = ("share", "zero_rate", "rolling_zero_mean", *evidence.PROFILE, "cluster_mismatch_rank")


@query("a10_minute_cluster_profile", f"WITH {Q.CLUSTERS} SELECT cluster_id, n, {r6s(*_PROF)}, interpretation FROM prof")
def _(spark, d):
    return evidence.cluster_profiles(marked(spark, d).drop("cluster_mismatch_rank")).select("cluster_id", "n", *r6(*_PROF), "interpretation")


@query("a11_dwell", f"WITH {Q.DWELL} SELECT session_key, minutes, mismatch_minutes, mismatch_runs, mismatch_max_run, mismatch_total_run, {r6s('mismatch_mean_run', 'mismatch_rate')}, active_max_run, transitions FROM dwell")
def _(spark, d):
    return dwelt(spark, d).select("session_key", "minutes", "mismatch_minutes", "mismatch_runs", "mismatch_max_run", "mismatch_total_run", *r6("mismatch_mean_run", "mismatch_rate"), "active_max_run", "transitions")


@query("a12_state_transitions", f"WITH {Q.CLUSTERS}, t AS (SELECT CASE WHEN mismatch_state = 1 THEN 'mismatch' ELSE 'active' END AS t, lag(CASE WHEN mismatch_state = 1 THEN 'mismatch' ELSE 'active' END) OVER (PARTITION BY run_id, broad_no ORDER BY minute_ts) AS f FROM marked), c AS (SELECT f, t, count(*) AS n FROM t WHERE f IS NOT NULL GROUP BY ALL) SELECT a.f AS from_state, b.t AS to_state, coalesce(n, 0)::BIGINT AS n, round(coalesce(n / sum(n) OVER (PARTITION BY a.f), 0), 6) AS share FROM (VALUES ('active'), ('mismatch')) a(f) CROSS JOIN (VALUES ('active'), ('mismatch')) b(t) LEFT JOIN c ON c.f = a.f AND c.t = b.t")
def _(spark, d):
    return evidence.state_transitions(marked(spark, d)).select("from_state", "to_state", "n", *r6("share"))


_CUT = "cut AS (SELECT unnest([0.90, 0.95, 0.97, 0.99])::DOUBLE AS q, unnest(quantile_cont(minute_mismatch_rank, [0.90, 0.95, 0.97, 0.99])) AS cutoff FROM scores)"
_EPS = f"{Q.SCORES}, {_CUT}, h AS (SELECT session_key, run_id, q, minute_idx, minute_mismatch_rank AS r, lag(minute_idx) OVER (PARTITION BY session_key, q ORDER BY minute_idx) AS p FROM scores JOIN cut ON minute_mismatch_rank >= cutoff), g AS (SELECT *, sum(CASE WHEN coalesce(minute_idx - p > 2, true) THEN 1 ELSE 0 END) OVER (PARTITION BY session_key, q ORDER BY minute_idx) AS e FROM h), ep AS (SELECT session_key, run_id, q, e, max(minute_idx) - min(minute_idx) + 1 AS duration, max(r) AS top FROM g GROUP BY ALL), epd AS (SELECT ep.*, d.d FROM ep, (VALUES (1), (2), (3), (5), (10)) d(d) WHERE duration >= d.d)"


@query("a14_candidates", f"WITH {_EPS}, m AS (SELECT session_key, count(*) AS n, quantile_cont(minute_mismatch_rank, 0.95) AS p95 FROM scores GROUP BY 1), a AS (SELECT session_key, q, d, count(*) AS episodes, sum(duration)::BIGINT AS total, max(top) AS top FROM epd GROUP BY ALL) SELECT q, d::BIGINT AS min_duration, session_key, episodes, total, round(top, 6) AS top, round(p95, 6) AS p95, round(total / n, 6) AS ratio, row_number() OVER (PARTITION BY q, d ORDER BY round(total / n, 9) DESC, round(top, 9) DESC, round(p95, 9) DESC, episodes DESC, session_key) AS place FROM a JOIN m USING (session_key)")
def _(spark, d):
    out = scan.candidates(scored(spark, d), GRID_Q, GRID_D)
    return out.select("q", *i8("min_duration"), "session_key", "episodes", "total", *r6("top", "p95", "ratio"), *i8("place"))


@query("a16_stability", f"WITH {_EPS}, t AS (SELECT run_id, ntile(4) OVER (ORDER BY run_id) AS quarter FROM (SELECT DISTINCT run_id FROM scores)), k AS (SELECT DISTINCT quarter, q, d.d FROM t, cut, (VALUES (1), (2), (3), (5), (10)) d(d)), s AS (SELECT quarter, count(DISTINCT session_key) AS n FROM scores JOIN t USING (run_id) GROUP BY 1), a AS (SELECT quarter, q, d, count(*) AS episodes, count(DISTINCT session_key) AS sessions FROM epd JOIN t USING (run_id) GROUP BY ALL) SELECT k.quarter::INT AS quarter, k.q, k.d::BIGINT AS min_duration, coalesce(episodes, 0) AS episodes, coalesce(sessions, 0) AS sessions, round(coalesce(sessions, 0) / s.n, 6) AS rate FROM k JOIN s USING (quarter) LEFT JOIN a ON a.quarter = k.quarter AND a.q = k.q AND a.d = k.d")
def _(spark, d):
    return scan.stability(scored(spark, d), GRID_Q, GRID_D).select("quarter", "q", *i8("min_duration"), "episodes", "sessions", *r6("rate"))


@query("a17_load_audit", f"WITH {Q.EVENTS} SELECT run_id, count(*) AS rows_in, count(*) FILTER (event_type = 'error') AS dropped, count(*) FILTER (value IS NULL) AS no_value, count(DISTINCT broad_no) AS broads, round(avg((event_type = 'error')::INT), 6) AS drop_rate, CASE WHEN avg((event_type = 'error')::INT) > 0.25 THEN 'drop_major' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'drop_minor' ELSE 'keep_all' END AS policy FROM ev GROUP BY 1")
def _(spark, d):
    e, bad = telemetry.telemetry(read(spark, d, "events")), F.col("event_type") == "error"
    out = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("dropped"), F.count_if(F.col("value").isNull()).alias("no_value"), F.count_distinct("broad_no").alias("broads"), F.avg(bad.cast("double")).alias("drop_rate"))
    return out.withColumn("policy", F.when(F.col("drop_rate") > 0.25, "drop_major").when(F.col("dropped") > 0, "drop_minor").otherwise("keep_all")).withColumn("drop_rate", F.round("drop_rate", 6))


_TRAJ = ("viewer", "chat_count", "unique_chatters", "chat_deficit")


@query("a18_trajectories", f"WITH {Q.STATE} SELECT minute_idx::BIGINT AS minute_idx, count(DISTINCT session_key) AS sessions, {', '.join(f'round(quantile_cont({c}, 0.5), 6) AS {c}_med, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS {c}_iqr' for c in _TRAJ)} FROM state GROUP BY 1")
def _(spark, d):
    s = stated(spark, d)
    q = ranks.quantiles(s, list(_TRAJ), (0.25, 0.5, 0.75), "minute_idx")  # ticks of a session
    rows = [(k, *[v for c in _TRAJ for a, m, z in [q.get((k, c), [None] * 3)] for v in (m, None if m is None else z - a)]) for k in sorted({k for k, _ in q})]
    table = spark.createDataFrame(rows, "minute_idx long, " + ", ".join(f"{c}_med double, {c}_iqr double" for c in _TRAJ))
    n = s.groupBy(F.col("minute_idx").cast("long").alias("minute_idx")).agg(F.count_distinct("session_key").alias("sessions"))
    return n.join(F.broadcast(table), "minute_idx").select("minute_idx", "sessions", *r6(*[f"{c}_{m}" for c in _TRAJ for m in ("med", "iqr")]))


@query("a21_zero_block_positions", f"WITH {Q.STATE} SELECT session_key, zero_run_plain::BIGINT AS position, count(*) AS n, round(avg(viewer), 6) AS viewer_mean, min(minute_ts)::VARCHAR AS first_ts FROM state WHERE zero_chat GROUP BY ALL")
def _(spark, d):
    w = windows.session_window()
    s = windows.run_length(stated(spark, d).select(*ID, "session_key", "minute_ts", "zero_chat", "viewer"), "zero_chat", "position", w).filter("position > 0")
    return s.groupBy("session_key", F.col("position").cast("long").alias("position")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("viewer"), 6).alias("viewer_mean"), F.min("minute_ts").cast("string").alias("first_ts"))


@query("a24_histogram", "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, ceil(log2(count(*)) + 1) AS k FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bucket, count(*) AS n FROM orders, b GROUP BY 1")
def _(spark, d):
    return models.sturges_histogram(read(spark, d, "orders"), "o_totalprice")


@query("a24_hexbin_counts", f"WITH {Q.STATE} SELECT floor(log_viewer * 4)::BIGINT AS x, floor(log_chat * 4)::BIGINT AS y, count(*) AS n FROM state WHERE log_viewer IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return stated(spark, d).filter("log_viewer is not null").groupBy(F.floor(F.col("log_viewer") * 4).alias("x"), F.floor(F.col("log_chat") * 4).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("a31_case_features", f"WITH {Q.STATE} SELECT session_key, round(max(viewer) - min(viewer), 6) AS viewer_range, round(avg((chat_count > 0)::INT), 6) AS chat_positive, max(zero_run_plain)::BIGINT AS longest_zero FROM state GROUP BY 1")
def _(spark, d):
    return state.case_features(stated(spark, d)).select("session_key", *r6("viewer_range", "chat_positive"), *i8("longest_zero"))


@query("f18_case_studies", f"WITH {Q.RULES}, f AS (SELECT session_key, avg((chat_count > 0)::INT) AS pos, max(zero_run_plain) AS lz FROM state GROUP BY 1) SELECT r.session_key, round(f.pos, 6) AS chat_positive, r.review_order FROM rules r JOIN f USING (session_key) WHERE (p1 >= 0.5)::INT + (p2 >= 0.5)::INT + (p3 >= 0.5)::INT + (p4 >= 0.5)::INT + (p5 >= 0.5)::INT >= 3 AND r.review_order >= 50 AND f.pos >= 0.1 AND f.lz <= 9")
def _(spark, d):
    s = ruled(spark, d).join(state.case_features(stated(spark, d)), "session_key").withColumn("flags", S.row_count_at_least([F.col(f"p_{c}") for c in _FIVE], 0.5))
    return s.filter("flags >= 3 and review_order >= 50 and chat_positive >= 0.1 and longest_zero <= 9").select("session_key", *r6("chat_positive"), *i8("review_order"))


# --- windows, top k ---
@query("w10_cut_by_real_edges", f"WITH {Q.STATE}, x AS (SELECT session_key, minute_idx, viewer * (1 + minute_idx % 3) AS v FROM state), e2 AS (SELECT list_distinct(quantile_cont(viewer, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS u FROM state WHERE NOT all_zero), b AS (SELECT *, CASE WHEN v >= list_min(u) AND v <= list_max(u) THEN greatest(len([y for y in list_sort(u) if y < v]) - 1, 0) END AS bin FROM x, e2) SELECT session_key, minute_idx::BIGINT AS minute_idx, coalesce(bin, last_value(bin IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY minute_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(bin IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY minute_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::BIGINT AS bin FROM b")
def _(spark, d):
    s = stated(spark, d)
    edges = ranks.qcut_edges(s.filter("not all_zero"), "viewer", 10)
    x = s.select("session_key", "minute_idx", (F.col("viewer") * (1 + F.col("minute_idx") % 3)).alias("v"))
    return x.select("session_key", *i8("minute_idx"), ranks.cut_or_nearest(F.col("v"), edges, Window.partitionBy("session_key").orderBy("minute_idx")).cast("long").alias("bin"))


_LAGS = range(11)


@query("w14_lag_spearman", f"WITH {Q.STATE}, l AS (SELECT run_id, broad_no, minute_ts, log_viewer, {', '.join(f'lead(log_chat, {k}) OVER w AS c{k}' for k in _LAGS)} FROM state WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts)) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS lag, count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT {Q.pct('log_viewer')} AS a, {Q.pct(f'c{k}')} AS b FROM l WHERE log_viewer IS NOT NULL AND c{k} IS NOT NULL)" for k in _LAGS))
def _(spark, d):
    w = windows.session_window()
    x = stated(spark, d).select("log_viewer", *[F.lead("log_chat", k).over(w).alias(f"c{k}") for k in _LAGS])
    out = None
    for k in _LAGS:
        pairs = x.select(F.lit(k).cast("long").alias("lag"), F.col("log_viewer").alias("a"), F.col(f"c{k}").alias("b")).filter("a is not null and b is not null")
        out = pairs if out is None else out.unionByName(pairs)
    return models.spearman_by(out, "lag", "a", "b").select("lag", "n", *r6("r"))


@query("w20_interval_gaps", f"WITH {Q.METRICS} SELECT session_key, clock_gaps, round(max_clock_gap, 6) AS max_clock_gap FROM metrics")
def _(spark, d):
    return metrics(spark, d).select("session_key", "clock_gaps", *r6("max_clock_gap"))


@query("t4_top_minutes", f"WITH {Q.SCORES} SELECT session_key, minute_idx::BIGINT AS minute_idx FROM (SELECT *, row_number() OVER (ORDER BY round(minute_mismatch_rank, 9) DESC, session_key, minute_idx) AS k, count(*) OVER () AS n FROM scores) WHERE k <= ceil(n * 0.01)")
def _(spark, d):
    return ranks.top_share(scored(spark, d).withColumn("_x", F.round("minute_mismatch_rank", 9)), [F.desc("_x"), F.asc("session_key"), F.asc("minute_idx")], 0.01).select("session_key", *i8("minute_idx"))


@query("t6_pool", "WITH t AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100) SELECT c_custkey FROM t ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 30")
def _(spark, d):
    """The hundred largest, and thirty of them drawn by hash."""
    t = read(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return t.orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey").limit(30).select("c_custkey")


@query("sc_message_hash", "SELECT event_id, sha256((user_id % 20) || '_' || user_id || '_' || props || '_' || epoch(ts)::BIGINT) AS h FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) WHERE event_type = 'click'")
def _(spark, d):
    e = telemetry.chat_events(read(spark, d, "events"))
    return e.select("event_id", telemetry.message_hash("broad_no", "user_id", "message", "ts").alias("h"))


@query("sc_time_iou", f"WITH {Q.METRICS} SELECT b.session_key, round(greatest((epoch(least(b.end_ts, s.end_ts)) - epoch(greatest(b.start_ts, s.start_ts))) / 60 + 1, 0) / ((epoch(greatest(b.end_ts, s.end_ts)) - epoch(least(b.start_ts, s.start_ts))) / 60 + 1), 6) AS iou FROM bestscan b JOIN scan s USING (run_id, broad_no)")
def _(spark, d):
    """The interval of the smallest p against that of the largest score, by the clock."""
    from .telemetry import zed

    a = found(spark, d).select("session_key", F.col("start_ts").alias("sa"), F.col("end_ts").alias("ea"))
    b = scan.best_intervals(zed(spark, d), telemetry.GAP_MINUTES).select("session_key", "start_ts", "end_ts")
    return a.join(b, "session_key").select("session_key", F.round(S.time_iou(F.col("sa"), F.col("ea"), F.col("start_ts"), F.col("end_ts")), 6).alias("iou"))
