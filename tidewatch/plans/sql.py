"""Common parts of the SQL that the queries are held against."""

from __future__ import annotations

import math

from ..functions.scalar import rank_z_sql
from ..operators.evidence import ANOMALY, FAMILIES, MISMATCH, PROFILE, REASONS
from ..operators.scan import MEANS, PRIME
from ..operators.state import SIGNALS

EVENTS = """
ev AS (SELECT *, CAST(strftime(ts, '%Y%m%d') AS INT) AS run_id, user_id % 20 AS broad_no, date_trunc('hour', ts) AS minute_ts FROM events),
click AS (SELECT *, props AS message FROM ev WHERE event_type = 'click'),
shot AS (SELECT * FROM ev WHERE event_type <> 'click')"""

MINUTE = (
    EVENTS
    + """,
cbase AS (SELECT run_id, broad_no, minute_ts, count(message) AS chat_count, count(DISTINCT user_id) AS unique_chatters, avg(length(coalesce(message, ''))) AS avg_msg_len, min(ts) AS first_ts FROM click GROUP BY ALL),
said AS (SELECT run_id, broad_no, minute_ts, coalesce(message, '__NULL__') AS m, count(*) AS c FROM click GROUP BY ALL),
reps AS (SELECT run_id, broad_no, minute_ts, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS repeat_msg_ratio FROM said GROUP BY ALL),
usr AS (SELECT run_id, broad_no, minute_ts, user_id FROM click WHERE user_id IS NOT NULL GROUP BY ALL),
ent AS (SELECT run_id, broad_no, user_id, min(ts) AS entry FROM click GROUP BY ALL),
newc AS (SELECT run_id, broad_no, minute_ts, avg(CASE WHEN entry >= first_ts THEN 1.0 ELSE 0.0 END) AS new_chatter_ratio FROM usr JOIN ent USING (run_id, broad_no, user_id) JOIN cbase USING (run_id, broad_no, minute_ts) GROUP BY ALL),
chat AS (SELECT run_id, broad_no, minute_ts, chat_count, unique_chatters, avg_msg_len, repeat_msg_ratio, coalesce(new_chatter_ratio, 0) AS new_chatter_ratio FROM cbase LEFT JOIN reps USING (run_id, broad_no, minute_ts) LEFT JOIN newc USING (run_id, broad_no, minute_ts)),
snap AS (SELECT run_id, broad_no, minute_ts, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS viewer_count_last, arg_max(event_type, (ts, event_id)) AS category_id FROM shot GROUP BY ALL),
minute AS (
  SELECT run_id, broad_no, minute_ts, viewer_count_last, category_id, coalesce(chat_count, 0)::BIGINT AS chat_count, coalesce(unique_chatters, 0)::BIGINT AS unique_chatters,
    avg_msg_len, repeat_msg_ratio, new_chatter_ratio, run_id || '_' || broad_no AS session_key
  FROM snap FULL JOIN chat USING (run_id, broad_no, minute_ts))"""
)

STATE = (
    MINUTE
    + """,
st0 AS (SELECT *, coalesce(viewer_count_last <= 0, true) AS v_miss, CASE WHEN viewer_count_last > 0 THEN viewer_count_last END AS v0, row_number() OVER w AS minute_idx FROM minute WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts)),
st1 AS (SELECT *, last_value(v0 IGNORE NULLS) OVER b AS vp, first_value(v0 IGNORE NULLS) OVER a AS vn, last_value(CASE WHEN v0 IS NOT NULL THEN minute_idx END IGNORE NULLS) OVER b AS ip, first_value(CASE WHEN v0 IS NOT NULL THEN minute_idx END IGNORE NULLS) OVER a AS nx
  FROM st0 WINDOW b AS (PARTITION BY run_id, broad_no ORDER BY minute_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run_id, broad_no ORDER BY minute_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
st2 AS (SELECT * EXCLUDE (vp, vn, ip, nx, v0), coalesce(v0, CASE WHEN nx > ip THEN vp + (vn - vp) * (minute_idx - ip) / (nx - ip) END, vp, vn) AS viewer FROM st1),
st3 AS (SELECT *, ln(1 + viewer) AS log_viewer, ln(1 + chat_count) AS log_chat, ln(1 + unique_chatters) AS log_unique, chat_count = 0 AS zero_chat, max(chat_count) OVER (PARTITION BY run_id, broad_no) = 0 AS all_zero,
  (epoch(minute_ts) - epoch(lag(minute_ts) OVER w)) / 60 AS gap FROM st2 WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts)),
st4 AS (SELECT *, sum(CASE WHEN coalesce(zero_chat <> plag OR gap > 66, true) THEN 1 ELSE 0 END) OVER w AS isl, sum(CASE WHEN coalesce(zero_chat <> plag, true) THEN 1 ELSE 0 END) OVER w AS isl_plain
  FROM (SELECT *, lag(zero_chat) OVER (PARTITION BY run_id, broad_no ORDER BY minute_ts) AS plag FROM st3) WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts)),
st5 AS (SELECT *, CASE WHEN zero_chat THEN row_number() OVER (PARTITION BY run_id, broad_no, isl ORDER BY minute_ts) ELSE 0 END AS zero_run_len, CASE WHEN zero_chat THEN row_number() OVER (PARTITION BY run_id, broad_no, isl_plain ORDER BY minute_ts) ELSE 0 END AS zero_run_plain FROM st4),
edges AS (SELECT quantile_cont(viewer, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM st5 WHERE NOT all_zero),
st6 AS (SELECT st5.*, CASE WHEN viewer IS NOT NULL THEN len([x for x in e if x < viewer]) END AS viewer_bin FROM st5, edges),
bins AS (SELECT viewer_bin, quantile_cont(log_chat, 0.5) AS bc, quantile_cont(log_unique, 0.5) AS bu FROM st6 WHERE NOT all_zero GROUP BY viewer_bin),
overall AS (SELECT quantile_cont(log_chat, 0.5) AS gc, quantile_cont(log_unique, 0.5) AS gu FROM st6 WHERE NOT all_zero),
st7 AS (SELECT st6.*, coalesce(bc, gc) - log_chat AS chat_deficit, coalesce(bu, gu) - log_unique AS unique_deficit FROM st6 LEFT JOIN bins USING (viewer_bin), overall),
state AS (SELECT *, avg(chat_deficit) OVER w5 AS rolling_chat_deficit_5m, avg(unique_deficit) OVER w5 AS rolling_unique_deficit_5m, avg(zero_chat::INT) OVER w5 AS rolling_zero_rate_5m, sum(chat_count) OVER w5 AS rolling_chat_sum_5m,
  avg(chat_deficit) OVER w10 AS rolling_chat_deficit_10m, avg(zero_chat::INT) OVER w10 AS rolling_zero_rate_10m
  FROM st7 WINDOW w5 AS (PARTITION BY run_id, broad_no ORDER BY minute_ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY run_id, broad_no ORDER BY minute_ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
)


def pct(column: str, partition: str = "") -> str:
    """Average percentile rank as SQL windows."""
    x, by = f"round({column}::DOUBLE, 9)", f"PARTITION BY {partition} " if partition else ""
    return f"CASE WHEN {column} IS NOT NULL THEN (rank() OVER ({by}ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {partition + ', ' if partition else ''}{x}) - 1) / 2.0) / count({column}) OVER ({by.strip()}) END"


def mean_of(columns: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in columns)
    return f"CASE WHEN {n} > 0 THEN ({total}) / ({n}) END"


_R = [f"r_{s}" for s in SIGNALS]
SCORES = (
    STATE
    + f""",
sc0 AS (SELECT *, {", ".join(f"{pct(s)} AS r_{s}" for s in SIGNALS)} FROM state),
sc1 AS (SELECT *, round({mean_of(_R)}, 12) AS minute_mismatch_score, CASE WHEN greatest({", ".join(_R)}) IS NULL THEN 'insufficient_signal' {" ".join(f"WHEN r_{s} = greatest({', '.join(_R)}) THEN '{s}'" for s in SIGNALS)} ELSE 'insufficient_signal' END AS reason FROM sc0),
scores AS (SELECT *, {pct("minute_mismatch_score")} AS minute_mismatch_rank FROM sc1)"""
)

SESSIONS = (
    STATE
    + """,
sess0 AS (SELECT run_id, broad_no, session_key, count(*) AS n, min(minute_ts) AS start_ts, max(minute_ts) AS end_ts, quantile_cont(viewer, 0.5) AS viewer_median, max(viewer) AS viewer_max, sum(chat_count)::BIGINT AS chat_sum, avg(chat_count) AS chat_mean,
  sum(unique_chatters)::BIGINT AS unique_sum, avg(zero_chat::INT) AS zero_rate, max(zero_run_len) AS zrun_max, quantile_cont(log_viewer - log_chat, 0.5) AS gap_med, bool_and(zero_chat) AS all_zero, avg(v_miss::INT) AS v_miss_rate,
  arg_min(category_id, minute_ts) FILTER (category_id IS NOT NULL) AS category_id FROM state GROUP BY ALL),
sess AS (SELECT *, n >= 10 AND NOT all_zero AS eligible, CASE WHEN n < 10 AND all_zero THEN 'short_session;all_zero_chat' WHEN n < 10 THEN 'short_session' WHEN all_zero THEN 'all_zero_chat' ELSE 'eligible' END AS eligibility_reason FROM sess0)"""
)

RULES = (
    SESSIONS
    + f""",
ru0 AS (SELECT *, -chat_mean AS nc, -unique_sum / n AS nu FROM sess WHERE eligible),
ru1 AS (SELECT *, {pct("zero_rate")} AS p1, {pct("gap_med")} AS p2, {pct("zrun_max")} AS p3, {pct("nc")} AS p4, {pct("nu")} AS p5 FROM ru0),
ru2 AS (SELECT *, round({mean_of(["p1", "p2", "p3", "p4", "p5"])}, 9) AS rule_score FROM ru1),
rules AS (SELECT *, row_number() OVER (ORDER BY rule_score DESC, session_key) AS review_order FROM ru2)"""
)

def _fifth(x: str) -> str:
    square = f"({x} * {x} % {PRIME})"
    return f"({square} * {square} % {PRIME} * {x} % {PRIME})"


#: Rows with z in whole billionths, their blocks, places and running sums.
BLOCKS = (
    SCORES
    + f""",
zb AS (SELECT *, {rank_z_sql("minute_mismatch_rank", "total")} AS z0 FROM (SELECT *, count(*) OVER () AS total FROM scores)),
bl1 AS (SELECT *, CAST(round(z0 * 1e9) AS BIGINT) AS z, sum(CASE WHEN coalesce(gap > 66, true) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, broad_no ORDER BY minute_ts) AS block FROM zb),
bl2 AS (SELECT *, row_number() OVER w AS i, sum(z) OVER w AS c FROM bl1 WINDOW w AS (PARTITION BY run_id, broad_no, block ORDER BY minute_ts))"""
)

SCAN = (
    BLOCKS
    + """,
pairs AS (SELECT s.run_id, s.broad_no, s.session_key, s.block, s.i AS si, e.i AS ei, s.minute_idx AS start_idx, e.minute_idx AS end_idx, s.minute_ts AS start_ts, e.minute_ts AS end_ts, (e.c - (s.c - s.z))::DOUBLE / (1e9 * sqrt((e.i - s.i + 1)::DOUBLE)) AS scan_z
  FROM bl2 s JOIN bl2 e ON s.run_id = e.run_id AND s.broad_no = e.broad_no AND s.block = e.block AND e.i >= s.i),
scan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, broad_no ORDER BY scan_z DESC, block, si, ei) AS k FROM pairs) WHERE k = 1)"""
)

#: Permutations of the null that the SQL repeats.
N_PERM = 19
BEST = (
    SCAN
    + f""",
blk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, broad_no, block ORDER BY scan_z DESC, si, ei) AS kb, max(ei) OVER (PARTITION BY run_id, broad_no, block) AS n_rows FROM pairs) WHERE kb = 1),
pm0 AS (SELECT run_id, broad_no, block, t.k, z, ((('0x' || substr(md5(session_key), 1, 7))::BIGINT + 7919 * block::BIGINT + 104729 * t.k + 15485863 * i) % {PRIME})::BIGINT AS x FROM bl2, (SELECT unnest(range(1, {N_PERM + 1})) AS k) t),
pm1 AS (SELECT *, (({_fifth("x")} + 12345) % {PRIME})::BIGINT AS y FROM pm0),
pm2 AS (SELECT run_id, broad_no, block, k, row_number() OVER w AS i, z, sum(z) OVER w AS c FROM (SELECT *, {_fifth("y")} AS o FROM pm1) WINDOW w AS (PARTITION BY run_id, broad_no, block, k ORDER BY o)),
pm3 AS (SELECT s.run_id, s.broad_no, s.block, s.k, max((e.c - (s.c - s.z))::DOUBLE / (1e9 * sqrt((e.i - s.i + 1)::DOUBLE))) AS m FROM pm2 s JOIN pm2 e ON s.run_id = e.run_id AND s.broad_no = e.broad_no AND s.block = e.block AND s.k = e.k AND e.i >= s.i GROUP BY ALL),
pm4 AS (SELECT blk.*, p.* EXCLUDE (run_id, broad_no, block) FROM blk LEFT JOIN (SELECT pm3.run_id, pm3.broad_no, pm3.block, avg(m) AS null_mean, quantile_cont(m, 0.95) AS null_p95, (1 + count(*) FILTER (m >= blk.scan_z)) / (1.0 + count(*)) AS p0 FROM pm3 JOIN blk USING (run_id, broad_no, block) GROUP BY ALL) p USING (run_id, broad_no, block)),
bestscan AS (SELECT * EXCLUDE (kb, p0), CASE WHEN n_rows > 1 THEN p0 END AS empirical_p, end_idx - start_idx + 1 AS duration FROM pm4
  QUALIFY row_number() OVER (PARTITION BY run_id, broad_no ORDER BY CASE WHEN n_rows > 1 THEN p0 END NULLS LAST, scan_z DESC, block) = 1)"""
)

_PROFILE = ", ".join(f"quantile_cont({c}, {q})::DOUBLE AS {name}" for name, (c, q) in PROFILE.items())
#: Minute rows with their cluster (audience half by silence), its profile and rank, and the expected response.
CLUSTERS = (
    BEST
    + f""",
mc AS (SELECT *, (2 * coalesce(viewer_bin >= 5, false)::INT + zero_chat::INT)::INT AS minute_cluster, run_id % 5 AS fold, viewer_bin * 4 + hour(minute_ts) // 6 AS cell FROM scores),
prof0 AS (SELECT minute_cluster AS cluster_id, count(*) AS n, count(*) / (SELECT count(*) FROM mc) AS share, avg(zero_chat::INT) AS zero_rate, avg(rolling_zero_rate_5m) AS rolling_zero_mean, {_PROFILE} FROM mc GROUP BY 1),
prof1 AS (SELECT *, {mean_of([f"({pct(c)})" for c in MISMATCH])} AS cluster_mismatch_rank FROM prof0),
prof AS (SELECT *, CASE WHEN cluster_mismatch_rank = max(cluster_mismatch_rank) OVER () THEN 'mismatch' WHEN chat_med >= quantile_cont(chat_med, 0.5) OVER () AND unique_med >= quantile_cont(unique_med, 0.5) OVER () AND chat_deficit_med <= 0 THEN 'active'
  WHEN viewer_med <= quantile_cont(viewer_med, 0.5) OVER () AND chat_med <= quantile_cont(chat_med, 0.5) OVER () THEN 'quiet' ELSE 'mixed' END AS interpretation FROM prof1),
oof AS (SELECT f.f, cell, quantile_cont(log_chat, 0.5) AS ec, quantile_cont(log_unique, 0.5) AS eu FROM mc, (SELECT unnest(range(5)) AS f) f WHERE fold <> f.f AND NOT all_zero GROUP BY ALL),
marked AS (SELECT mc.*, coalesce(ec, gc) - log_chat AS model_chat_deficit, coalesce(eu, gu) - log_unique AS model_unique_deficit, cluster_mismatch_rank, (minute_cluster = (SELECT cluster_id FROM prof ORDER BY cluster_mismatch_rank DESC, cluster_id LIMIT 1))::INT::DOUBLE AS mismatch_state
  FROM mc LEFT JOIN oof ON oof.f = mc.fold AND oof.cell IS NOT DISTINCT FROM mc.cell LEFT JOIN prof ON cluster_id = minute_cluster, overall)"""
)

METRICS = (
    CLUSTERS
    + f""",
metrics AS (SELECT b.run_id, b.broad_no, b.session_key, any_value(b.duration)::BIGINT AS duration, any_value(scan_z) AS scan_z, any_value(empirical_p) AS empirical_p, count(*) AS minutes, quantile_cont(minute_mismatch_rank, 0.95) AS rank_p95, avg(zero_chat::INT) AS zero_rate, max(zero_run_len) AS max_zero_run,
  {", ".join(f"avg({c}) AS {name}" for name, c in MEANS.items())}, count(*) FILTER (minute_idx > start_idx AND gap > 66) AS clock_gaps, coalesce(max(gap) FILTER (minute_idx > start_idx), 0)::DOUBLE AS max_clock_gap
  FROM marked m JOIN bestscan b ON m.run_id = b.run_id AND m.broad_no = b.broad_no AND minute_idx BETWEEN start_idx AND end_idx GROUP BY ALL)"""
)

DWELL = (
    CLUSTERS
    + """,
dw0 AS (SELECT *, mismatch_state = 1 AS m, minute_cluster <> lag(minute_cluster) OVER w AS ch FROM marked WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts)),
dw1 AS (SELECT *, sum(CASE WHEN coalesce(m <> pm, true) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, broad_no ORDER BY minute_ts) AS run FROM (SELECT *, lag(m) OVER (PARTITION BY run_id, broad_no ORDER BY minute_ts) AS pm FROM dw0)),
dw2 AS (SELECT run_id, broad_no, session_key, run, bool_or(m) AS m, count(*) AS len, coalesce(sum(ch::INT), 0) AS changes FROM dw1 GROUP BY ALL),
dwell AS (SELECT run_id, broad_no, session_key, sum(len)::BIGINT AS minutes, coalesce(sum(len) FILTER (m), 0)::BIGINT AS mismatch_minutes, count(*) FILTER (m) AS mismatch_runs, coalesce(max(len) FILTER (m), 0)::BIGINT AS mismatch_max_run, coalesce(sum(len) FILTER (m), 0)::BIGINT AS mismatch_total_run,
  coalesce(avg(len) FILTER (m), 0) AS mismatch_mean_run, coalesce(max(len) FILTER (NOT m), 0)::BIGINT AS active_max_run, sum(changes)::BIGINT AS transitions, coalesce(sum(len) FILTER (m), 0) / sum(len) AS mismatch_rate FROM dw2 GROUP BY ALL)"""
)

_AN = ANOMALY


def _dwell_only() -> str:
    return DWELL[len(CLUSTERS) :]


ANOMALIES = (
    METRICS
    + _dwell_only()
    + f""",
an0 AS (SELECT session_key, {", ".join(f"coalesce(round({c}::DOUBLE, 9), (SELECT quantile_cont(round({c}::DOUBLE, 9), 0.5) FROM metrics), 0) AS {c}" for c in _AN)} FROM metrics),
an1 AS (SELECT count(*) AS n, {", ".join(f"(avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) AS s_{c}" for c in _AN)} FROM an0),
an2 AS (SELECT session_key, an1.*, {", ".join(f"-ln(count(*) OVER (ORDER BY {c} RANGE UNBOUNDED PRECEDING) / n) AS l_{c}, -ln(count(*) OVER (ORDER BY {c} DESC RANGE UNBOUNDED PRECEDING) / n) AS r_{c}" for c in _AN)} FROM an0, an1),
an3 AS (SELECT session_key, greatest({" + ".join(f"l_{c}" for c in _AN)}, {" + ".join(f"r_{c}" for c in _AN)}, {" + ".join(f"CASE WHEN s_{c} < 0 THEN l_{c} ELSE r_{c} END" for c in _AN)}) AS ecod FROM an2),
an4 AS (SELECT metrics.*, ecod, {mean_of([f"({pct(c)})" for c in ("chat_deficit_mean", "unique_deficit_mean", "zero_rate", "state_rate")])} AS weight, {pct("ecod")} AS ecod_rank FROM metrics JOIN an3 USING (session_key)),
anomalies AS (SELECT *, ecod_rank * weight AS anomaly FROM an4),
rs0 AS (SELECT session_key, unnest([{", ".join(repr(r) for r in REASONS)}]) AS reason, unnest([{", ".join(f"round({c}::DOUBLE, 9)" for c in REASONS.values())}]) AS value FROM anomalies),
rs1 AS (SELECT session_key, reason, value, {pct("value", "reason")} AS support FROM rs0 WHERE value IS NOT NULL),
reasons AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY support DESC, value DESC, reason) AS place FROM rs1)"""
)


def place(name: str, metrics: dict[str, bool]) -> str:
    """Places by metrics (column -> ascending), ties by session_key; none where all are null."""
    known = " OR ".join(f"{m} IS NOT NULL" for m in metrics)
    order = ", ".join(f"round({m}::DOUBLE, 9) {'ASC' if up else 'DESC'} NULLS LAST" for m, up in metrics.items())
    return f"CASE WHEN {known} THEN row_number() OVER (ORDER BY CASE WHEN {known} THEN 0 ELSE 1 END, {order}, session_key) END AS {name}"


def rra(ranks: list[str]) -> str:
    """Robust rank aggregation p over places among n sessions, a missing one as 1."""
    m, v = len(ranks), "list_sort([" + ", ".join(f"coalesce(least(1, {r} / (n + 1)), 1)" for r in ranks) + "])"
    tails = ["(" + " + ".join(f"{math.comb(m, j)} * pow(v[{i}], {j}) * pow(1 - v[{i}], {m - j})" for j in range(i, m + 1)) + ")" for i in range(1, m + 1)]
    return f"(SELECT greatest(0, least(1, {m} * least({', '.join(tails)}))) FROM (SELECT {v} AS v))"


FAMILY = (
    ANOMALIES
    + f""",
fm0 AS (SELECT a.*, d.mismatch_max_run, d.mismatch_total_run, d.mismatch_rate, d.transitions, r.reason_rank_max, r.reason_value_max FROM anomalies a JOIN dwell d USING (run_id, broad_no) LEFT JOIN (SELECT session_key, max(support) AS reason_rank_max, max(value) AS reason_value_max FROM reasons GROUP BY 1) r ON r.session_key = a.session_key),
fm1 AS (SELECT *, count(*) OVER () AS n, {mean_of([f"({pct(c)})" for c in ("duration", "mismatch_max_run", "mismatch_total_run")])} AS persistence_metric, {mean_of([f"({pct(c)})" for c in ("state_rate", "mismatch_rate")])} AS minute_state_metric, greatest(model_chat_mean, model_unique_mean) AS expected_metric FROM fm0),
family AS (SELECT *, {place("scan_rank", {"empirical_p": True, "scan_z": False})}, {", ".join(place(f"{f}_rank", {m: False}) for f, m in (("persistence", "persistence_metric"), ("expected", "expected_metric"), ("minute_state", "minute_state_metric"), ("anomaly", "anomaly")))}, {place("reason_rank", {"reason_rank_max": False, "reason_value_max": False})} FROM fm1)"""
)


def _tail(long: str, short: str) -> str:
    return long[len(short) :]


REVIEW = (
    FAMILY
    + _tail(RULES, STATE)
    + f""",
rv0 AS (SELECT f.*, coalesce(s.eligible, false) AS eligible, {", ".join(f"greatest(0, least(1, 1 - {x}_rank / (f.n + 1))) AS {x}_strength" for x in FAMILIES)} FROM family f LEFT JOIN sess s USING (run_id, broad_no)),
rv1 AS (SELECT *, round(({" + ".join(f"coalesce({x}_strength, 0)" for x in FAMILIES)}) / {len(FAMILIES)}, 9) AS consensus, round({rra([f"{x}_rank" for x in FAMILIES])}, 12) AS rra_p FROM rv0),
rv2 AS (SELECT *, rra_p * n / count(*) OVER (ORDER BY rra_p RANGE UNBOUNDED PRECEDING) AS raw_q FROM rv1),
rv3 AS (SELECT *, round(least(1, min(raw_q) OVER (ORDER BY rra_p DESC RANGE UNBOUNDED PRECEDING)), 12) AS rra_q FROM rv2),
review_all AS (SELECT *, row_number() OVER (ORDER BY eligible DESC, consensus DESC, rra_q, rra_p, persistence_rank NULLS LAST, scan_rank NULLS LAST, session_key) AS review_all_order FROM rv3),
review AS (SELECT *, review_all_order AS review_order FROM review_all WHERE eligible)"""
)
