"""Intervals, families, reasons, audits, comparisons and checks around the review order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evidence, models, ranks, review, state, synthetic, windows
from ..sources import telemetry
from ..sources.steps import written
from . import sql as Q
from .telemetry import _RS, ID, dwelt, marked, metrics, query, r6, r6s, ranked, read, reviewed, reviewed_all, ruled, scored, sessions, stated, supported

FAM = evidence.FAMILIES
i8 = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
l8 = lambda *names: ", ".join(f"{c}::BIGINT AS {c}" for c in names)
_MET = ("rank_mean", "rank_p95", "chat_deficit_mean", "unique_deficit_mean", "model_chat_mean", "model_unique_mean", "zero_rate", "state_rate", "rolling_chat_mean", "rolling_zero_mean")


@query("r4_interval_features", f"WITH {Q.METRICS} SELECT session_key, {r6s(*_MET)}, max_zero_run FROM metrics")
def _(spark, d):
    return metrics(spark, d).select("session_key", *r6(*_MET), *i8("max_zero_run"))


_RMAP = {"high_chat_deficit": "chat_deficit_mean", "high_unique_deficit": "unique_deficit_mean", "high_rolling_zero_rate": "zero_rate", "long_zero_run": "max_zero_run", "mismatch_cluster_state": "state_rate"}


@query("r5_interval_reason", f"WITH {Q.METRICS}, k AS (SELECT session_key, {', '.join(f'{Q.pct(c)} AS r_{n}' for n, c in _RMAP.items())} FROM metrics) SELECT session_key, CASE WHEN greatest({', '.join(f'r_{n}' for n in _RMAP)}) IS NULL THEN 'insufficient_signal' {' '.join(f'WHEN r_{n} = greatest({", ".join(f"r_{x}" for x in _RMAP)}) THEN {n!r}' for n in _RMAP)} END AS dominant_reason FROM k")
def _(spark, d):
    return evidence.interval_reason(metrics(spark, d)).select("session_key", "dominant_reason")


@query("r7_fit_metrics", f"WITH {Q.CLUSTERS}, m AS (SELECT avg(abs(model_chat_deficit)) AS mae, avg(abs((SELECT gc FROM overall) - log_chat)) AS base FROM marked WHERE NOT all_zero) SELECT round(mae, 6) AS mae, round(mae / 2, 6) AS pinball, round(base, 6) AS base_mae, round(1 - mae / base, 6) AS skill FROM m")
def _(spark, d):
    from ..operators import learn

    m = marked(spark, d).filter("not all_zero").withColumn("expected", F.col("model_chat_deficit") + F.col("log_chat"))
    return learn.fit_metrics(m, "log_chat").select(*r6("mae", "pinball", "base_mae", "skill"))


@query("r9_interval_anomaly", f"WITH {Q.ANOMALIES} SELECT session_key, {r6s('weight', 'ecod', 'anomaly')} FROM anomalies")
def _(spark, d):
    return metrics(spark, d).select("session_key", *r6("weight", "ecod", "anomaly"))


@query("r9_interval_anomaly_forest_lof")
def _(spark, d):
    """ECOD, isolation forest and local outlier factor together."""
    from ..operators import learn, outliers

    m = metrics(spark, d)
    x = models.robust_scale(models.median_impute(m.select("session_key", *evidence.ANOMALY), evidence.ANOMALY), evidence.ANOMALY)
    forest = learn.isolation_forest(x, evidence.ANOMALY, "session_key", "forest").select("session_key", "forest")
    lof = outliers.local_outlier_factor(x, evidence.ANOMALY, "session_key", 20).select("session_key", "lof")
    out = evidence.more_detectors(m.join(forest, "session_key").join(lof, "session_key"), {"forest": "forest", "lof": "lof"})
    return out.select("session_key", *r6("weight", "ecod_dir", "forest_dir", "lof_dir", "anomaly"))


@query("r10_family_ranks", f"WITH {Q.FAMILY} SELECT session_key, {l8(*[f'{f}_rank' for f in FAM], 'reason_rank')} FROM family")
def _(spark, d):
    return ranked(spark, d).select("session_key", *i8(*[f"{f}_rank" for f in FAM], "reason_rank"))


@query("r10_raw_evidence", f"WITH {Q.FAMILY}, w AS (SELECT session_key, n, {', '.join(Q.place(k, m) for k, m in evidence.RAW.items())} FROM family) SELECT session_key, {l8(*evidence.RAW)}, round({Q.rra(list(evidence.RAW))}, 9) AS raw_rra_p, round({Q.mean_of([f'(CASE WHEN {k} IS NOT NULL THEN greatest(0, least(1, 1 - {k} / (n + 1))) END)' for k in evidence.RAW])}, 6) AS raw_strength, ({' + '.join(f'({k} IS NOT NULL)::INT' for k in evidence.RAW)})::INT AS raw_count FROM w")
def _(spark, d):
    r = ranked(spark, d)
    return evidence.raw_evidence(r, r.count()).select("session_key", *i8(*evidence.RAW), F.round("raw_rra_p", 9).alias("raw_rra_p"), *r6("raw_strength"), "raw_count")


@query("r11_strengths", f"WITH {Q.REVIEW} SELECT session_key, eligible, {r6s(*[f'{f}_strength' for f in FAM])} FROM review_all")
def _(spark, d):
    return reviewed_all(spark, d).select("session_key", "eligible", *r6(*[f"{f}_strength" for f in FAM]))


@query("r15_all_sessions_order", f"WITH {Q.REVIEW} SELECT session_key, eligible, {r6s('consensus')}, round(rra_p, 9) AS rra_p, review_all_order FROM review_all")
def _(spark, d):
    return reviewed_all(spark, d).select("session_key", "eligible", *r6("consensus"), F.round("rra_p", 9).alias("rra_p"), "review_all_order")


@query("r16_seven_reasons", f"WITH {Q.ANOMALIES} SELECT session_key, reason, {r6s('value', 'support')}, place, place <= 3 AS included FROM reasons")
def _(spark, d):
    return supported(spark, d).select("session_key", "reason", *r6("value", "support"), *i8("place"), (F.col("place") <= 3).alias("included"))


@query("a13_seven_reason_patterns", f"WITH {Q.ANOMALIES}, p AS (SELECT session_key, string_agg(reason, ';' ORDER BY reason) AS pattern FROM reasons WHERE place <= 3 GROUP BY 1) SELECT pattern, count(*) AS sessions, array_to_string(list(session_key ORDER BY session_key)[1:5], ';') AS examples, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM p GROUP BY 1")
def _(spark, d):
    return review.reason_patterns(supported(spark, d).filter("place <= 3"))


@query("r17_rank_audit", f"WITH {Q.REVIEW}, a AS (SELECT session_key, review_order AS o FROM rules WHERE review_order <= 300), b AS (SELECT session_key, review_order AS w FROM review) SELECT session_key, o AS old_place, w AS new_place, o IS DISTINCT FROM w AS changed, CASE WHEN o IS NULL AND w IS NOT NULL THEN 'new' WHEN o IS DISTINCT FROM w THEN 'changed' ELSE 'same' END AS note FROM a FULL JOIN b USING (session_key)")
def _(spark, d):
    old = ruled(spark, d).filter("review_order <= 300").select("session_key", F.col("review_order").cast("long").alias("place"))
    return evidence.rank_audit(old, reviewed(spark, d).select("session_key", F.col("review_order").alias("place")))


@query("r17_transition_audit", f"WITH {Q.DWELL} SELECT session_key, minutes - 1 AS stored, transitions AS recount, minutes - 1 <> transitions AS mismatch FROM dwell")
def _(spark, d):
    """Counts stored as rows less one, against a recount."""
    stored = dwelt(spark, d).select("session_key", (F.col("minutes") - 1).alias("transitions"))
    return evidence.transition_audit(stored, marked(spark, d))


_VAR = {"consensus": "consensus DESC", "rra": "rra_p", "both": "rra_p, consensus DESC", "median": "round(list_median(s), 9) DESC", "trimmed": "round(list_sum(s[2:4]) / 3, 9) DESC", "no_anomaly": "round((scan_strength + persistence_strength + expected_strength + minute_state_strength) / 4, 9) DESC"}


@query("r24_order_variants", f"WITH {Q.REVIEW}, v AS (SELECT *, list_sort([{', '.join(f'{f}_strength' for f in FAM)}]) AS s FROM review), o AS (SELECT session_key, review_order, unnest([{', '.join(repr(k) for k in _VAR)}]) AS variant, unnest([{', '.join(f'row_number() OVER (ORDER BY {o}, session_key)' for o in _VAR.values())}]) AS place FROM v) SELECT variant, count(*) FILTER (review_order <= 100 AND place <= 100) AS overlap, round(corr(review_order, place), 6) AS spearman, quantile_cont(abs(review_order - place), 0.5) FILTER (review_order <= 100)::DOUBLE AS median_shift FROM o GROUP BY 1")
def _(spark, d):
    return review.order_variants(reviewed(spark, d), list(FAM), 100)


@query("r26_signal_weights", f"WITH {Q.SCORES}, w AS (SELECT session_key, minute_idx, minute_mismatch_rank, " + ", ".join(f"round(({' + '.join(f'{w} * coalesce(r_{s}, 0)' for s, w in zip(state.SIGNALS, ws))}) / {sum(ws)}, 9) AS v_{n}" for n, ws in (("equal", (1, 1, 1, 1, 1, 1)), ("chat", (2, 1, 2, 1, 1, 1)), ("unique", (1, 2, 1, 2, 1, 1)), ("rolling", (1, 1, 2, 2, 2, 1)), ("zero", (1, 1, 1, 1, 2, 2)), ("point", (2, 2, 1, 1, 1, 1)))) + " FROM scores) SELECT unnest(['equal', 'chat', 'unique', 'rolling', 'zero', 'point']) AS variant, unnest([" + ", ".join(f"round(corr(minute_mismatch_rank, v_{n}), 6)" for n in ("equal", "chat", "unique", "rolling", "zero", "point")) + "]) AS r FROM w")
def _(spark, d):
    return review.weight_variants(scored(spark, d), state.SIGNALS)


@query("r26_signal_ablation")
def _(spark, d):
    """Each signal left out: the scores, their scan and the hundred first sessions, against all signals."""
    from ..operators import scan
    from .telemetry import with_z, zed

    base = written(scan.best_intervals(zed(spark, d), telemetry.GAP_MINUTES), "base")  # read once a signal
    rows, n = stated(spark, d), scored(spark, d).count()
    out = None
    for left in state.SIGNALS:
        s = with_z(state.mismatch_scores(rows, tuple(x for x in state.SIGNALS if x != left)), n)
        row = review.scan_overlap(base, scan.best_intervals(s, telemetry.GAP_MINUTES), 100).withColumn("left_out", F.lit(left))
        out = row if out is None else out.unionByName(row)
    return out


@query("r31_model_consensus", f"WITH {Q.RULES}, c AS (SELECT session_key, round((p1 + p2 + p3) / 3, 9) AS c FROM rules), q AS (SELECT quantile_cont(c, 0.9) AS q90, quantile_cont(c, 0.95) AS q95 FROM c) SELECT session_key, round(c, 6) AS consensus, CASE WHEN c >= q95 THEN 'confirmed' WHEN c >= q90 THEN 'candidate' ELSE 'normal' END AS review_group FROM c, q")
def _(spark, d):
    s = ruled(spark, d).select("session_key", F.round(S.row_mean([F.col(f"p_{c}") for c in ("zero_rate", "gap_med", "zrun_max")]), 9).alias("consensus"))
    return review.quantile_groups(s, "consensus").select("session_key", *r6("consensus"), "review_group")


_HID = "0.35 * p1 + 0.35 * p2 + 0.2 * p3 + 0.1 * p4"


@query("r32_hidden_candidates", f"WITH {Q.RULES}, h AS (SELECT *, round({_HID}, 9) AS hidden FROM rules), q AS (SELECT quantile_cont(hidden, 0.9) AS q FROM h) SELECT session_key, round(hidden, 6) AS hidden, CASE WHEN hidden >= q AND review_order > 50 THEN 'hidden' WHEN hidden >= q THEN 'known' WHEN review_order <= 50 THEN 'rule_only' ELSE 'other' END AS discovery_group, concat_ws('|', CASE WHEN p1 >= 0.9 THEN 'zero_rate' END, CASE WHEN p2 >= 0.9 THEN 'gap' END, CASE WHEN p3 >= 0.9 THEN 'zero_run' END, CASE WHEN p4 >= 0.9 THEN 'low_chat' END) AS codes FROM h, q")
def _(spark, d):
    s = review.hidden_candidates(ruled(spark, d), {"p_zero_rate": 0.35, "p_gap_med": 0.35, "p_zrun_max": 0.2, "p_nc": 0.1}, {"zero_rate": "p_zero_rate", "gap": "p_gap_med", "zero_run": "p_zrun_max", "low_chat": "p_nc"}, 50)
    return s.select("session_key", *r6("hidden"), "discovery_group", "codes")


@query("a32_discovery_groups", f"WITH {Q.RULES}, h AS (SELECT *, round({_HID}, 9) AS hidden FROM rules), q AS (SELECT quantile_cont(hidden, 0.9) AS q FROM h), g AS (SELECT *, CASE WHEN hidden >= q AND review_order > 50 THEN 'hidden' WHEN hidden >= q THEN 'known' WHEN review_order <= 50 THEN 'rule_only' ELSE 'other' END AS discovery_group FROM h, q) SELECT discovery_group, count(*) AS n, round(avg(hidden), 6) AS hidden_mean, round(avg(zero_rate), 6) AS zero_rate_mean, min(review_order) AS first_place FROM g GROUP BY 1")
def _(spark, d):
    s = review.hidden_candidates(ruled(spark, d), {"p_zero_rate": 0.35, "p_gap_med": 0.35, "p_zrun_max": 0.2, "p_nc": 0.1}, {}, 50)
    return s.groupBy("discovery_group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hidden"), 6).alias("hidden_mean"), F.round(F.avg("zero_rate"), 6).alias("zero_rate_mean"), F.min("review_order").cast("long").alias("first_place"))


@query("r33_reliable_negative", f"WITH {Q.RULES}, q AS (SELECT quantile_cont(zero_rate, 0.5) AS a, quantile_cont(gap_med, 0.5) AS b, quantile_cont(zrun_max, 0.5) AS c, quantile_cont(chat_mean, 0.5) AS e, quantile_cont(viewer_median, 0.25) AS v FROM rules) SELECT session_key, round(1 - (p1 + p2 + p3 + p4 + p5) / 5, 6) AS negative_score, zero_rate <= a AND gap_med <= b AND zrun_max <= c AND chat_mean >= e AND viewer_median >= v AS seed FROM rules, q")
def _(spark, d):
    s = ruled(spark, d)
    q = ranks.quantile_row(s, ["zero_rate", "gap_med", "zrun_max", "chat_mean"], (0.5,)) | ranks.quantile_row(s, ["viewer_median"], (0.25,))
    low = (F.col("zero_rate") <= q["zero_rate"][0]) & (F.col("gap_med") <= q["gap_med"][0]) & (F.col("zrun_max") <= q["zrun_max"][0])
    seed = low & (F.col("chat_mean") >= q["chat_mean"][0]) & (F.col("viewer_median") >= q["viewer_median"][0])
    return s.select("session_key", F.round(1 - S.row_mean([F.col(f"p_{c}") for c in ("zero_rate", "gap_med", "zrun_max", "nc", "nu")]), 6).alias("negative_score"), seed.alias("seed"))


@query("r34_flagged_precision", f"WITH {Q.REVIEW}, f AS (SELECT session_key FROM rules WHERE p1 >= 0.9 OR p2 >= 0.9), c AS (SELECT count(*) AS k FROM f), t AS (SELECT session_key FROM review WHERE review_order <= (SELECT k FROM c)) SELECT (SELECT k FROM c) AS flagged, count(*) AS both_n, round(count(*) / (SELECT k FROM c), 6) AS precision FROM t JOIN f USING (session_key)")
def _(spark, d):
    return review.flagged_precision(ruled(spark, d).filter("p_zero_rate >= 0.9 or p_gap_med >= 0.9").select("session_key"), reviewed(spark, d))


@query("r34_misses", f"WITH {Q.REVIEW} SELECT r.session_key, w.review_order AS evidence_order, r.review_order AS rule_order FROM rules r JOIN review w USING (session_key) WHERE r.review_order <= 100 AND w.review_order > 200")
def _(spark, d):
    r = ruled(spark, d).select("session_key", F.col("review_order").cast("long").alias("rule_order"))
    return r.filter("rule_order <= 100").join(reviewed(spark, d).select("session_key", F.col("review_order").alias("evidence_order")), "session_key").filter("evidence_order > 200")


@query("r35_spearman", f"WITH {Q.STATE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) AS r FROM (SELECT {Q.pct(a)} AS x, {Q.pct(b)} AS y FROM state WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in (("viewer", "chat_count"), ("viewer", "unique_chatters"), ("chat_count", "unique_chatters"))))
def _(spark, d):
    s, out = stated(spark, d), None
    for a, b in (("viewer", "chat_count"), ("viewer", "unique_chatters"), ("chat_count", "unique_chatters")):
        x = s.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f"{a}|{b}").alias("k"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        out = x if out is None else out.unionByName(x)
    r = models.spearman_by(out, "k", "x", "y")
    return r.select(F.split("k", r"\|")[0].alias("a"), F.split("k", r"\|")[1].alias("b"), *r6("r"))


@query("r36_review_report", f"WITH {Q.REVIEW} SELECT session_key, review_order, round(100.0 * review_order / count(*) OVER (), 6) AS top_pct, CASE WHEN 100.0 * review_order / count(*) OVER () <= 1 THEN 'very_high' WHEN 100.0 * review_order / count(*) OVER () <= 5 THEN 'high' WHEN 100.0 * review_order / count(*) OVER () <= 10 THEN 'elevated' WHEN 100.0 * review_order / count(*) OVER () <= 25 THEN 'watch' ELSE 'normal' END AS level, duration <= 1 AS short_interval FROM review")
def _(spark, d):
    r = reviewed(spark, d)
    top = 100.0 * F.col("review_order") / r.count()
    return r.select("session_key", "review_order", F.round(top, 6).alias("top_pct"), S.level(top).alias("level"), (F.col("duration") <= 1).alias("short_interval"))


@query("r36_blocked", f"WITH {Q.SESSIONS} SELECT eligibility_reason AS reason, count(*) AS n FROM sess WHERE NOT eligible GROUP BY 1")
def _(spark, d):
    return sessions(spark, d).filter("not eligible").groupBy(F.col("eligibility_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a26_family_balance", f"WITH {Q.REVIEW}, s AS (SELECT CASE WHEN review_order <= 20 THEN 'top20' WHEN review_order <= 50 THEN 'top50' WHEN review_order <= 100 THEN 'top100' WHEN review_order <= 200 THEN 'top200' ELSE 'rest' END AS bucket, list_sort([{', '.join(f'{f}_strength' for f in FAM)}]) AS v FROM review), b(bucket) AS (VALUES ('top20'), ('top50'), ('top100'), ('top200'), ('rest')) SELECT b.bucket, count(v) AS n, round(coalesce(avg(list_stddev_pop(v)), 0), 6) AS spread, round(coalesce(avg(list_max(v)), 0), 6) AS top, round(coalesce(avg(len([x for x in v if x >= 0.8])), 0), 6) AS strong FROM b LEFT JOIN s USING (bucket) GROUP BY 1")
def _(spark, d):
    return review.balance(reviewed(spark, d), [f"{f}_strength" for f in FAM])


@query("a30_scorecard", f"WITH {Q.REVIEW} SELECT 'sessions' AS measure, count(*)::DOUBLE AS value FROM review_all UNION ALL SELECT 'eligible_rate', round(avg(eligible::INT), 6) FROM review_all UNION ALL SELECT 'least_consensus', round(min(consensus), 6) FROM review UNION ALL SELECT 'best_rra_q', round(min(rra_q), 6) FROM review UNION ALL SELECT 'short_intervals', round(avg((duration <= 1)::INT), 6) FROM review")
def _(spark, d):
    a = reviewed_all(spark, d)
    e = F.col("eligible")
    row = a.agg(F.count(F.lit(1)).cast("double").alias("a"), F.round(F.avg(e.cast("double")), 6).alias("b"), F.round(F.min(F.when(e, F.col("consensus"))), 6).alias("c"), F.round(F.min(F.when(e, F.col("rra_q"))), 6).alias("q"), F.round(F.avg(F.when(e, (F.col("duration") <= 1).cast("double"))), 6).alias("s"))
    return row.select(F.expr("stack(5, 'sessions', a, 'eligible_rate', b, 'least_consensus', c, 'best_rra_q', q, 'short_intervals', s) as (measure, value)"))


@query("r22_sparse_cluster", f"WITH {Q.SESSIONS}, c AS (SELECT *, (zrun_max > 2)::INT + 2 * (zero_rate > 0.5)::INT AS cluster FROM sess WHERE eligible), p AS (SELECT cluster, avg(zero_rate) AS a, quantile_cont(gap_med, 0.5) AS b, quantile_cont(zrun_max, 0.5) AS c, -avg(chat_mean) AS e, -avg(unique_sum / n) AS f FROM c GROUP BY 1), r AS (SELECT cluster, ({' + '.join(f'({Q.pct(x)})' for x in 'abcef')}) / 5 AS score FROM p) SELECT cluster, round(score, 6) AS score, cluster = (SELECT cluster FROM r ORDER BY round(score, 9) DESC, cluster LIMIT 1) AS sparse FROM r")
def _(spark, d):
    s = sessions(spark, d).filter("eligible").withColumn("cluster", (F.col("zrun_max") > 2).cast("int") + 2 * (F.col("zero_rate") > 0.5).cast("int"))
    return evidence.sparse_cluster(s, "cluster").select("cluster", *r6("score"), "sparse")


@query("x13_session_typing", f"WITH {Q.SESSIONS}, c AS (SELECT *, (zrun_max > 2)::INT + 2 * (zero_rate > 0.5)::INT AS cluster FROM sess WHERE eligible), p AS (SELECT cluster, avg(zero_rate) AS a, quantile_cont(gap_med, 0.5) AS b, quantile_cont(zrun_max, 0.5) AS c, -avg(chat_mean) AS e, -avg(unique_sum / n) AS f FROM c GROUP BY 1), r AS (SELECT cluster, ({' + '.join(f'({Q.pct(x)})' for x in 'abcef')}) / 5 AS score FROM p) SELECT session_key, CASE WHEN cluster = (SELECT cluster FROM r ORDER BY round(score, 9) DESC, cluster LIMIT 1) THEN 'sparse' ELSE 'normal' END AS kind FROM c")
def _(spark, d):
    s = sessions(spark, d).filter("eligible").withColumn("cluster", (F.col("zrun_max") > 2).cast("int") + 2 * (F.col("zero_rate") > 0.5).cast("int"))
    sparse = evidence.sparse_cluster(s, "cluster").filter("sparse").select("cluster", F.lit("sparse").alias("kind"))
    return s.join(F.broadcast(sparse), "cluster", "left").select("session_key", F.coalesce("kind", F.lit("normal")).alias("kind"))


_CHECKS = {
    "chat_not_negative": "chat_count >= 0", "unique_not_negative": "unique_chatters >= 0", "chat_at_least_unique": "chat_count >= unique_chatters", "viewer_positive": "viewer IS NULL OR viewer > 0", "index_from_one": "minute_idx >= 1", "rank_in_unit": "minute_mismatch_rank > 0 AND minute_mismatch_rank <= 1",
    "score_in_unit": "minute_mismatch_score > 0 AND minute_mismatch_score <= 1", "run_only_if_silent": "(zero_run_len > 0) = zero_chat", "run_at_most_index": "zero_run_len <= minute_idx", "zero_flag": "zero_chat = (chat_count = 0)", "log_chat": "abs(log_chat - ln(1 + chat_count)) <= 1e-9", "log_unique": "abs(log_unique - ln(1 + unique_chatters)) <= 1e-9",
    "bin_in_range": "viewer_bin IS NULL OR viewer_bin BETWEEN 0 AND 9", "rolling_rate_in_unit": "rolling_zero_rate_5m BETWEEN 0 AND 1", "rolling_sum_covers": "rolling_chat_sum_5m >= chat_count", "reason_known": f"reason IN ({', '.join(repr(s) for s in state.SIGNALS)}, 'insufficient_signal')",
    "session_key": "session_key = concat_ws('_', run_id, broad_no)", "missing_means_filled": "viewer_count_last > 0 OR v_miss", "all_zero_means_silent": "NOT all_zero OR zero_chat", "ratio_in_unit": "repeat_msg_ratio IS NULL OR repeat_msg_ratio BETWEEN 0 AND 1", "new_ratio_in_unit": "new_chatter_ratio IS NULL OR new_chatter_ratio BETWEEN 0 AND 1", "length_not_negative": "avg_msg_len IS NULL OR avg_msg_len >= 0",
}


@query("v_minute_checks", f"WITH {Q.SCORES} " + " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (NOT coalesce({t}, false)) AS violations, count(*) FILTER (NOT coalesce({t}, false)) = 0 AS ok FROM scores" for n, t in _CHECKS.items()))
def _(spark, d):
    return synthetic.checks(scored(spark, d), {n: F.expr(t) for n, t in _CHECKS.items()})


_RCHECKS = {
    "order_from_one": "review_order >= 1", "consensus_in_unit": "consensus BETWEEN 0 AND 1", "p_in_unit": "rra_p BETWEEN 0 AND 1", "q_at_least_p": "rra_q >= rra_p - 1e-9", "duration_positive": "duration >= 1", "interval_within": "minutes = duration", "p_of_null": "empirical_p IS NULL OR empirical_p > 0", "rates_in_unit": "mismatch_rate BETWEEN 0 AND 1",
    "runs_cover": "mismatch_max_run <= mismatch_total_run", "scan_rank": "scan_rank >= 1", "persistence_rank": "persistence_rank >= 1", "anomaly_not_negative": "anomaly >= 0", "weight_in_unit": "weight BETWEEN 0 AND 1", "run_within": "max_zero_run >= 0", "p95_at_least": "rank_p95 <= 1", "eligible": "eligible",
}


@query("v_review_checks", f"WITH {Q.REVIEW} " + " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (NOT coalesce({t}, false)) AS violations, count(*) FILTER (NOT coalesce({t}, false)) = 0 AS ok FROM review" for n, t in _RCHECKS.items()))
def _(spark, d):
    return synthetic.checks(reviewed(spark, d), {n: F.expr(t) for n, t in _RCHECKS.items()})


@query("v_qc_exclusive", f"WITH {Q.SESSIONS} SELECT 'zero_and_eligible' AS check_name, count(*) FILTER (all_zero AND eligible) AS violations FROM sess UNION ALL SELECT 'transitions_below_minutes', (SELECT count(*) FROM (SELECT session_key FROM sess WHERE n < 1)) UNION ALL SELECT 'key_repeats', count(*) - count(DISTINCT session_key) FROM sess")
def _(spark, d):
    row = sessions(spark, d).agg(F.count_if(F.col("all_zero") & F.col("eligible")).alias("a"), F.count_if(F.col("n") < 1).alias("b"), (F.count(F.lit(1)) - F.count_distinct("session_key")).alias("c"))
    return row.select(F.expr("stack(3, 'zero_and_eligible', a, 'transitions_below_minutes', b, 'key_repeats', c) as (check_name, violations)"))


@query("x1_minute_detectors")
def _(spark, d):
    """Isolation forest, LOF and one-class SVM over minute rows, each weighted by the direction of the deficits."""
    from ..operators import outliers

    return outliers.minute_detectors(stated(spark, d).filter("not all_zero"), list(state.SIGNALS))


@query("x3_grid_projection", f"WITH {Q.SCORES}, cut AS (SELECT unnest([0.90, 0.95, 0.97, 0.99])::DOUBLE AS q, unnest(quantile_cont(minute_mismatch_rank, [0.90, 0.95, 0.97, 0.99])) AS cutoff FROM scores) SELECT q, round(cutoff, 6) AS cutoff, count(*) FILTER (minute_mismatch_rank >= cutoff) AS minutes FROM scores, cut GROUP BY ALL")
def _(spark, d):
    s = scored(spark, d)
    at = (0.90, 0.95, 0.97, 0.99)
    cuts = ranks.quantile_row(s, ["minute_mismatch_rank"], at)["minute_mismatch_rank"]
    row = s.agg(*[F.count_if(F.col("minute_mismatch_rank") >= c).alias(f"n{i}") for i, c in enumerate(cuts)])
    return row.select(F.expr("stack(4, " + ", ".join(f"{q}D, {c!r}D, n{i}" for i, (q, c) in enumerate(zip(at, cuts, strict=True))) + ") as (q, cutoff, minutes)")).select("q", *r6("cutoff"), "minutes")


@query("x4_durations", f"WITH {Q.STATE}, r AS (SELECT session_key, isl, count(*) AS len FROM state WHERE zero_chat GROUP BY ALL) SELECT d.d::BIGINT AS min_duration, count(len) AS runs, count(DISTINCT session_key) AS sessions, coalesce(max(len), 0)::BIGINT AS longest FROM (VALUES (1), (2), (3), (5), (10)) d(d) LEFT JOIN r ON len >= d.d GROUP BY 1")
def _(spark, d):
    s = stated(spark, d)
    w = windows.session_window()
    runs = s.select("session_key", "zero_run_len", F.lead("zero_run_len").over(w).alias("_next")).filter("zero_run_len > 0 and coalesce(_next, 0) <= 1")
    row = runs.agg(*[f for k in (1, 2, 3, 5, 10) for hit in [F.col("zero_run_len") >= k] for f in (F.count_if(hit).alias(f"n{k}"), F.count_distinct(F.when(hit, F.col("session_key"))).alias(f"s{k}"), F.coalesce(F.max(F.when(hit, F.col("zero_run_len"))), F.lit(0)).cast("long").alias(f"m{k}"))])
    return row.select(F.expr("stack(5, " + ", ".join(f"{k}L, n{k}, s{k}, m{k}" for k in (1, 2, 3, 5, 10)) + ") as (min_duration, runs, sessions, longest)"))


@query("x6_example_picks", f"WITH {Q.STATE}, r AS (SELECT session_key, isl, count(*) AS len FROM state WHERE zero_chat GROUP BY ALL), a AS (SELECT session_key, max(len) AS longest, count(*) AS runs FROM r GROUP BY 1), m AS (SELECT quantile_cont(longest, 0.5) AS mid FROM a), p1 AS (SELECT session_key FROM a ORDER BY longest DESC, session_key LIMIT 1), p2 AS (SELECT session_key FROM a WHERE session_key NOT IN (FROM p1) ORDER BY runs DESC, session_key LIMIT 1), p3 AS (SELECT session_key FROM a, m WHERE session_key NOT IN (FROM p1) AND session_key NOT IN (FROM p2) ORDER BY abs(longest - mid), session_key LIMIT 1) SELECT 'longest' AS pick, session_key FROM p1 UNION ALL SELECT 'most', session_key FROM p2 UNION ALL SELECT 'typical', session_key FROM p3")
def _(spark, d):
    s = stated(spark, d)
    w = windows.session_window()
    runs = s.select("session_key", "zero_run_len", F.lead("zero_run_len").over(w).alias("_next")).filter("zero_run_len > 0 and coalesce(_next, 0) <= 1")
    return review.example_picks(runs.groupBy("session_key").agg(F.max("zero_run_len").cast("double").alias("longest"), F.count(F.lit(1)).alias("runs")))


@query("x7_drill_down", f"WITH {Q.METRICS}, t AS (SELECT session_key FROM bestscan ORDER BY scan_z DESC, session_key LIMIT 1) SELECT m.session_key, m.minute_idx::BIGINT AS minute_idx, round(avg(minute_mismatch_score) OVER (PARTITION BY m.session_key ORDER BY m.minute_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling, m.minute_ts BETWEEN b.start_ts AND b.end_ts AS inside FROM marked m JOIN t USING (session_key) JOIN bestscan b ON b.session_key = m.session_key")
def _(spark, d):
    from .telemetry import found

    top = found(spark, d).orderBy(F.desc("scan_z"), "session_key").limit(1).select("session_key", "start_ts", "end_ts")
    m = marked(spark, d).join(F.broadcast(top), "session_key")
    w = Window.partitionBy("session_key").orderBy("minute_idx")
    return m.select("session_key", *i8("minute_idx"), F.round(windows.rolling("minute_mismatch_score", 5, w), 6).alias("rolling"), F.col("minute_ts").between(F.col("start_ts"), F.col("end_ts")).alias("inside"))


@query("x8_window_labels", f"WITH {Q.EVENTS} SELECT run_id, strftime(date_trunc('hour', min(ts) + INTERVAL 30 MINUTE), '%H:%M') || '-' || strftime(date_trunc('hour', max(ts) + INTERVAL 30 MINUTE), '%H:%M') AS label FROM ev GROUP BY 1")
def _(spark, d):
    near = lambda c: F.date_format(F.date_trunc("hour", c + F.expr("interval 30 minutes")), "HH:mm")
    return telemetry.telemetry(read(spark, d, "events")).groupBy("run_id").agg(F.concat_ws("-", near(F.min("ts")), near(F.max("ts"))).alias("label"))


@query("x9_half_day_labels", f"WITH {Q.EVENTS} SELECT run_id, CASE WHEN hour(min(ts)) < 12 THEN 'am ' ELSE 'pm ' END || ((hour(min(ts)) + 11) % 12 + 1) || ' - ' || CASE WHEN hour(max(ts)) < 12 THEN 'am ' ELSE 'pm ' END || ((hour(max(ts)) + 11) % 12 + 1) AS label FROM ev GROUP BY 1")
def _(spark, d):
    half = lambda c: F.concat(F.when(F.hour(c) < 12, "am ").otherwise("pm "), ((F.hour(c) + 11) % 12 + 1).cast("string"))
    return telemetry.telemetry(read(spark, d, "events")).groupBy("run_id").agg(F.concat(half(F.min("ts")), F.lit(" - "), half(F.max("ts"))).alias("label"))


@query("x10_dropped_runs", f"WITH {Q.EVENTS} SELECT event_id FROM ev WHERE run_id NOT IN (SELECT run_id FROM ev GROUP BY 1 ORDER BY count(*), run_id LIMIT 2)")
def _(spark, d):
    e = telemetry.telemetry(read(spark, d, "events"))
    least = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "run_id").limit(2)
    return e.join(F.broadcast(least), "run_id", "left_anti").select("event_id")


@query("x11_null_profile", f"WITH {Q.MINUTE} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS known, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM minute" for c in ("viewer_count_last", "chat_count", "unique_chatters", "avg_msg_len", "repeat_msg_ratio")))
def _(spark, d):
    from .telemetry import minute

    return models.null_profile(minute(spark, d), ["viewer_count_last", "chat_count", "unique_chatters", "avg_msg_len", "repeat_msg_ratio"])


@query("x12_suspects", f"WITH {Q.SESSIONS} SELECT * FROM (SELECT 'zero_rate' AS measure, session_key, row_number() OVER (ORDER BY zero_rate DESC, session_key) AS place FROM sess WHERE viewer_median >= 50) WHERE place <= 5 UNION ALL SELECT * FROM (SELECT 'gap', session_key, row_number() OVER (ORDER BY round(gap_med, 9) DESC, session_key) FROM sess WHERE gap_med IS NOT NULL) t(measure, session_key, place) WHERE place <= 10")
def _(spark, d):
    s = sessions(spark, d)
    first = lambda df, order, k, name: df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select(F.lit(name).alias("measure"), "session_key", "place")
    a = first(s.filter("viewer_median >= 50"), [F.desc("zero_rate"), F.asc("session_key")], 5, "zero_rate")
    return a.unionByName(first(s.filter("gap_med is not null"), [F.desc(F.round("gap_med", 9)), F.asc("session_key")], 10, "gap"))


@query("x14_sample_chats", f"WITH {Q.EVENTS} SELECT event_id, user_id, message FROM click ORDER BY ts, event_id LIMIT 5")
def _(spark, d):
    return telemetry.chat_events(read(spark, d, "events")).orderBy("ts", "event_id").limit(5).select("event_id", "user_id", "message")


@query("x15_top_lives", f"WITH {Q.SESSIONS} SELECT session_key, round(viewer_max, 6) AS viewer_max, row_number() OVER (ORDER BY round(viewer_max, 9) DESC NULLS LAST, session_key) AS place FROM sess QUALIFY place <= 15")
def _(spark, d):
    order = [F.desc_nulls_last(F.round("viewer_max", 9)), F.asc("session_key")]
    return sessions(spark, d).orderBy(*order).limit(15).select("session_key", *r6("viewer_max"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


_S3 = ("p1", "p2", "p3")


@query("x16_score_jaccard", f"WITH {Q.RULES}, t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS score, session_key FROM (SELECT session_key, row_number() OVER (ORDER BY {p} DESC, session_key) AS k FROM rules) WHERE k <= 100" for n, p in zip(("zero_rate", "gap_med", "zrun_max"), _S3, strict=True)) + ") SELECT a.score AS a, b.score AS b, count(*) AS overlap, round(count(*) / (200.0 - count(*)), 6) AS jaccard FROM t a JOIN t b USING (session_key) GROUP BY ALL")
def _(spark, d):
    return review.top_jaccard(ruled(spark, d), {c: f"p_{c}" for c in ("zero_rate", "gap_med", "zrun_max")}, 100)


@query("x16_silver_table", f"WITH {Q.RULES}, y AS (SELECT *, zero_rate >= (SELECT quantile_cont(zero_rate, 0.8) FROM rules) AS y FROM rules) SELECT k.k::BIGINT AS k, count(*) FILTER (y AND review_order <= k.k) AS hits, round(count(*) FILTER (y AND review_order <= k.k) / k.k, 6) AS precision, round(count(*) FILTER (y AND review_order <= k.k) / count(*) FILTER (y), 6) AS recall FROM y, (VALUES (20), (50), (100), (200)) k(k) GROUP BY k.k")
def _(spark, d):
    s = ruled(spark, d)
    y = s.withColumn("y", (F.col("zero_rate") >= ranks.quantile_row(s, ["zero_rate"], (0.8,))["zero_rate"][0]).cast("int")).withColumn("_s", -F.col("review_order"))
    return models.precision_at(y, "_s", "y", "session_key", (20, 50, 100, 200))


@query("t5_best_k", f"WITH {Q.SESSIONS}, k(k) AS (VALUES (2), (3), (4)), l AS (SELECT k, least(floor(zero_rate * k), k - 1)::INT AS label, zero_rate AS x FROM sess, k WHERE eligible), c AS (SELECT k, label, count(*) AS n, avg(x) AS m, quantile_cont(x, 0.5) AS md FROM l GROUP BY ALL), w AS (SELECT l.k, sum(pow(x - m, 2)) AS w, any_value(1) FROM l JOIN c USING (k, label) GROUP BY 1), b AS (SELECT k, sum(n * pow(m - (SELECT avg(zero_rate) FROM sess WHERE eligible), 2)) AS b, sum(n) AS n, count(*) AS g, min(n) / max(n) AS bal FROM c GROUP BY 1), s AS (SELECT a.k, avg(abs(a.md - b.md)) AS sep FROM c a JOIN c b ON a.k = b.k AND a.label < b.label GROUP BY 1), t AS (SELECT k, round((b / (g - 1)) / (w / (n - g)), 6) AS ch, round(bal, 6) AS bal, round(sep, 6) AS sep FROM w JOIN b USING (k) JOIN s USING (k)), r AS (SELECT *, round(({Q.pct('ch')} + {Q.pct('bal')} + {Q.pct('sep')}) / 3, 6) AS score FROM t) SELECT k::BIGINT AS k, ch, bal, sep, score, row_number() OVER (ORDER BY score DESC, k) = 1 AS selected FROM r")
def _(spark, d):
    """Three ways to cut the zero rate, judged by the composite score; the best is selected. A cut that leaves one
    cluster has nothing to separate and is no candidate."""
    s = sessions(spark, d).filter("eligible").select(F.col("zero_rate").alias("x"))
    out = None
    for k in (2, 3, 4):
        l = s.withColumn("label", F.least(F.floor(F.col("x") * k), F.lit(k - 1)).cast("int"))
        row = models.calinski_davies(l, "label", ["x"]).select(F.lit(k).cast("long").alias("k"), F.col("calinski_harabasz").alias("ch"), F.col("size_balance").alias("bal")).withColumn("sep", F.lit(models.median_separation(l, "label", ["x"])).cast("double"))
        out = row if out is None else out.unionByName(row)
    scored_k = models.selection_score(out.filter("sep is not null").withColumn("sep", F.round("sep", 6)), {"ch": True, "bal": True, "sep": True}, "k")
    return scored_k.select("k", "ch", "bal", "sep", F.round("selection_score", 6).alias("score"), "selected")
