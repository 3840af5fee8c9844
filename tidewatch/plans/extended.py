"""More analyses: grids, groups and quantile reviews, injections, checks, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import boosting, classify, clusters, compare, density, evidence, learn, models, outliers, ranks, review, scan, state, synthetic, windows
from ..sources import sinks
from ..sources import telemetry as source
from ..sources.steps import new_path, state_of, step
from . import sql as Q
from .telemetry import _RS, GRID_D, GRID_Q, ID, QUERIES, marked, query, r6, read, ruled, scored, sessions, stated, with_z, zed

_GRID = f"{Q.SCORES}, cut AS (SELECT unnest([0.90, 0.95, 0.97, 0.99])::DOUBLE AS q, unnest(quantile_cont(minute_mismatch_rank, [0.90, 0.95, 0.97, 0.99])) AS cutoff FROM scores), h AS (SELECT run_id, broad_no, q, minute_idx, lag(minute_idx) OVER (PARTITION BY run_id, broad_no, q ORDER BY minute_idx) AS p FROM scores JOIN cut ON minute_mismatch_rank >= cutoff), g AS (SELECT *, sum(CASE WHEN coalesce(minute_idx - p > 2, true) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, broad_no, q ORDER BY minute_idx) AS e FROM h), ep AS (SELECT run_id, broad_no, q, e, max(minute_idx) - min(minute_idx) + 1 AS duration FROM g GROUP BY ALL), d(d) AS (VALUES (1), (2), (3), (5), (10)), k AS (SELECT q, d.d FROM cut, d), epd AS (SELECT ep.*, d.d FROM ep, d WHERE duration >= d.d)"


@query("a15_zero_filled_grid", f"WITH {_GRID} SELECT k.q, k.d::BIGINT AS min_duration, count(duration) AS episodes, coalesce(round(quantile_cont(duration, 0.5), 6), 0) AS median, coalesce(round(quantile_cont(duration, 0.75), 6), 0) AS p75 FROM k LEFT JOIN epd ON k.q = epd.q AND k.d = epd.d GROUP BY ALL")
def _(spark, d):
    g = scan.episode_grid(scored(spark, d), GRID_Q, GRID_D).select(F.col("q").alias("q2"), F.col("min_duration").alias("d2"), "duration")
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in GRID_Q])).alias("q")).select("q", F.explode(F.array(*[F.lit(k) for k in GRID_D])).alias("min_duration"))
    p = lambda q: F.coalesce(F.round(F.percentile("duration", F.lit(q)), 6), F.lit(0.0))
    out = grid.join(g, (F.col("q") == F.col("q2")) & (F.col("min_duration") == F.col("d2")), "left").groupBy("q", F.col("min_duration").cast("long").alias("min_duration"))
    return out.agg(F.count("duration").alias("episodes"), p(0.5).alias("median"), p(0.75).alias("p75"))


@query("w13_normalised_index", f"WITH {Q.STATE} SELECT run_id, broad_no, minute_idx, round(coalesce((minute_idx - 1) / nullif(max(minute_idx) OVER (PARTITION BY run_id, broad_no) - 1, 0), 0), 6) AS norm FROM state")
def _(spark, d):
    most = F.max("minute_idx").over(Window.partitionBy(*ID))
    norm = F.coalesce(F.try_divide(F.col("minute_idx") - 1, most - 1), F.lit(0.0))
    return stated(spark, d).select(*ID, F.col("minute_idx").cast("long").alias("minute_idx"), F.round(norm, 6).alias("norm"))


@query("w21_local_rank", f"WITH r AS (SELECT o_orderkey, {Q.pct('o_totalprice')} AS g, {Q.pct('o_totalprice', 'o_orderpriority, o_orderstatus')} AS l, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM orders) SELECT o_orderkey, round(CASE WHEN n < 100 THEN g ELSE l END, 9) AS pct FROM r")
def _(spark, d):
    keys = ["o_orderpriority", "o_orderstatus"]
    o = ranks.pct_rank(read(spark, d, "orders").select("o_orderkey", "o_totalprice", *keys), "o_totalprice", "g")
    o = ranks.group_pct_ranks(o, keys, "o_totalprice", "l", "n")
    return o.select("o_orderkey", F.round(F.when(F.col("n") < 100, F.col("g")).otherwise(F.col("l")), 9).alias("pct"))


@query("w14_lag_response", f"WITH {Q.STATE}, l AS (SELECT run_id, broad_no, log_viewer, " + ", ".join(f"lead(log_chat, {k}) OVER w AS c{k}" for k in range(4)) + " FROM state WINDOW w AS (PARTITION BY run_id, broad_no ORDER BY minute_ts)) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS lag, count(c{k}) AS n, round(corr(log_viewer, c{k}), 6) AS r FROM l" for k in range(4)))
def _(spark, d):
    w = windows.session_window()
    x = stated(spark, d).select("log_viewer", *[F.lead("log_chat", k).over(w).alias(f"c{k}") for k in range(4)])
    row = x.agg(*[F.count(f"c{k}").alias(f"n{k}") for k in range(4)], *[F.round(F.corr("log_viewer", f"c{k}"), 6).alias(f"r{k}") for k in range(4)])
    return row.select(F.expr("stack(4, " + ", ".join(f"{k}L, n{k}, r{k}" for k in range(4)) + ") as (lag, n, r)"))


@query("r31_quantile_review", f"WITH {Q.RULES}, q AS (SELECT quantile_cont(rule_score, 0.9) AS q90, quantile_cont(rule_score, 0.95) AS q95 FROM rules) SELECT session_key, CASE WHEN rule_score >= q95 THEN 'confirmed' WHEN rule_score >= q90 THEN 'candidate' ELSE 'normal' END AS review_group FROM rules, q")
def _(spark, d):
    s = ruled(spark, d)
    q90, q95 = ranks.quantile_row(s, ["rule_score"], (0.9, 0.95))["rule_score"]
    group = F.when(F.col("rule_score") >= F.lit(q95), "confirmed").when(F.col("rule_score") >= F.lit(q90), "candidate").otherwise("normal")
    return s.select("session_key", group.alias("review_group"))


@query("r33_normal_seed", f"WITH {Q.RULES}, q AS (SELECT quantile_cont(zero_rate, 0.5) AS a, quantile_cont(gap_med, 0.5) AS b, quantile_cont(zrun_max, 0.5) AS c, quantile_cont(chat_mean, 0.5) AS e FROM rules) SELECT session_key FROM rules, q WHERE zero_rate <= a AND gap_med <= b AND zrun_max <= c AND chat_mean >= e")
def _(spark, d):
    s = ruled(spark, d)
    names = ["zero_rate", "gap_med", "zrun_max", "chat_mean"]
    mid = {c: F.lit(q[0]) for c, q in ranks.quantile_row(s, names, (0.5,)).items()}
    low = (F.col("zero_rate") <= mid["zero_rate"]) & (F.col("gap_med") <= mid["gap_med"]) & (F.col("zrun_max") <= mid["zrun_max"])
    return s.filter(low & (F.col("chat_mean") >= mid["chat_mean"])).select("session_key")


_INJ = f"{Q.SCAN}, inj0 AS (SELECT *, ('0x' || substr(md5(session_key), 1, 8))::BIGINT AS h, count(*) OVER (PARTITION BY session_key) AS n FROM state), inj1 AS (SELECT *, ['hi_view_low_chat', 'silent_run', 'view_spike_no_chat'][(h % 3 + 1)::INT] AS injection_type, 3 + h % 3 AS len FROM inj0 WHERE n >= 8), inj2 AS (SELECT *, 1 + (h // 7) % (n - len + 1) AS si FROM inj1), inj AS (SELECT *, si + len - 1 AS ei, minute_idx BETWEEN si AND si + len - 1 AS injected FROM inj2)"


@query("r28_injection", f"WITH {_INJ} SELECT run_id, broad_no, minute_idx, injection_type, injected, round(CASE WHEN injected AND injection_type = 'hi_view_low_chat' THEN viewer * 2 WHEN injected AND injection_type = 'view_spike_no_chat' THEN viewer * 5 ELSE viewer END, 6) AS viewer, (CASE WHEN injected AND injection_type = 'hi_view_low_chat' THEN floor(chat_count * 0.1) WHEN injected THEN 0 ELSE chat_count END)::BIGINT AS chat_count FROM inj")
def _(spark, d):
    return synthetic.inject(stated(spark, d)).select(*ID, F.col("minute_idx").cast("long").alias("minute_idx"), "injection_type", "injected", *r6("viewer"), "chat_count")


@query("j7_recovery", f"WITH {_INJ}, a AS (SELECT DISTINCT run_id, broad_no, injection_type, si, ei FROM inj), r AS (SELECT injection_type, coalesce(greatest(least(ei, end_idx) - greatest(si, start_idx) + 1, 0) / (greatest(ei, end_idx) - least(si, start_idx) + 1), 0) AS iou FROM a LEFT JOIN (SELECT run_id, broad_no, start_idx, end_idx FROM scan) USING (run_id, broad_no)) SELECT injection_type, count(*) AS n, round(quantile_cont(iou, 0.5), 6) AS iou_median, round(avg((iou >= 0.3)::INT), 6) AS rate_30, round(avg((iou >= 0.5)::INT), 6) AS rate_50, round(avg((iou >= 0.7)::INT), 6) AS rate_70 FROM r GROUP BY 1")
def _(spark, d):
    """Planted places against the intervals of the untouched rows: the chance level of recovery."""
    found = synthetic.recovery(synthetic.inject(stated(spark, d)), scan.best_intervals(zed(spark, d), source.GAP_MINUTES), ID)
    return synthetic.recovery_summary(found)


@step
def _injected(spark, d):
    return synthetic.inject(stated(spark, d))


@step
def _injected_state(spark, d):
    return state.injected_state(_injected(spark, d), stated(spark, d), source.GAP_MINUTES)


@step
def _injected_scores(spark, d):
    return state.injected_scores(_injected_state(spark, d), scored(spark, d))


@step
def _injected_zed(spark, d):
    out = state.injected_ranks(_injected_scores(spark, d), scored(spark, d))
    return with_z(out, scored(spark, d).count())


@query("j7_recovery_rescored")
def _(spark, d):
    """Planted places against the intervals that a scan of the changed and rescored rows finds."""
    found = synthetic.recovery(_injected(spark, d), scan.best_intervals(_injected_zed(spark, d), source.GAP_MINUTES), ID)
    return synthetic.recovery_summary(found)


@query("r19_persistence_null")
def _(spark, d):
    s = scored(spark, d)
    cuts = dict(zip(GRID_Q, ranks.quantile_row(s, ["minute_mismatch_rank"], GRID_Q)["minute_mismatch_rank"], strict=True))
    return synthetic.enrichment(synthetic.persistence_null(s, cuts, GRID_D))


@query("r29_synthetic_summary")
def _(spark, d):
    """Injected rows rescored and scanned, with the places of their largest scores as the order."""
    detected = scan.best_intervals(_injected_zed(spark, d), source.GAP_MINUTES)
    order = ranks.places(detected.select(*ID, "scan_z", "session_key"), [F.desc("scan_z"), F.asc("session_key")], "review_order").select(*ID, "review_order")
    return synthetic.sanity_summary(_injected(spark, d), detected, order, ID)


@query("v_integrity_checks", f"WITH {Q.SCORES} SELECT unnest(['chat_not_negative', 'chat_at_least_unique', 'rank_in_unit', 'run_only_if_silent', 'index_from_one']) AS check_name, unnest([count(*) FILTER (NOT chat_count >= 0), count(*) FILTER (NOT chat_count >= unique_chatters), count(*) FILTER (NOT (minute_mismatch_rank > 0 AND minute_mismatch_rank <= 1)), count(*) FILTER ((zero_run_len > 0) <> zero_chat), count(*) FILTER (NOT minute_idx >= 1)]) AS violations, unnest([count(*) FILTER (NOT chat_count >= 0), count(*) FILTER (NOT chat_count >= unique_chatters), count(*) FILTER (NOT (minute_mismatch_rank > 0 AND minute_mismatch_rank <= 1)), count(*) FILTER ((zero_run_len > 0) <> zero_chat), count(*) FILTER (NOT minute_idx >= 1)]) = 0 AS ok FROM scores")
def _(spark, d):
    c = F.col
    tests = {"chat_not_negative": c("chat_count") >= 0, "chat_at_least_unique": c("chat_count") >= c("unique_chatters"), "rank_in_unit": (c("minute_mismatch_rank") > 0) & (c("minute_mismatch_rank") <= 1), "run_only_if_silent": (c("zero_run_len") > 0) == c("zero_chat"), "index_from_one": c("minute_idx") >= 1}
    return synthetic.checks(scored(spark, d), tests)


@query("a10_cluster_profile", f"WITH {Q.SCORES} SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(quantile_cont(viewer, 0.75), 6) AS viewer_p75, round(quantile_cont(viewer, 0.95), 6) AS viewer_p95, round(avg(chat_count), 6) AS chat_mean, round(avg(zero_chat::INT), 6) AS zero_rate FROM scores GROUP BY 1")
def _(spark, d):
    at = ranks.quantiles(scored(spark, d), ["viewer"], (0.75, 0.95), "reason")
    of = spark.createDataFrame([(k, *[float(x) for x in v]) for (k, _), v in at.items()], "_r string, _75 double, _95 double")  # a row per reason
    out = scored(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chat_count"), 6).alias("chat_mean"), F.round(F.avg(F.col("zero_chat").cast("double")), 6).alias("zero_rate"))
    out = out.join(F.broadcast(of), F.col("reason").eqNullSafe(F.col("_r")), "left").select("reason", "n", F.round("_75", 6).alias("viewer_p75"), F.round("_95", 6).alias("viewer_p95"), "chat_mean", "zero_rate")
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("f18_case_picks", f"WITH {Q.RULES} SELECT session_key FROM rules WHERE zrun_max <= 5 AND zero_rate >= 0.4 AND review_order > 50 ORDER BY zero_rate DESC, session_key LIMIT 20")
def _(spark, d):
    return ruled(spark, d).filter("zrun_max <= 5 and zero_rate >= 0.4 and review_order > 50").orderBy(F.desc("zero_rate"), "session_key").limit(20).select("session_key")


@query("a16_stability_by_quarter", f"WITH {Q.SCORES}, t AS (SELECT DISTINCT run_id FROM scores), q AS (SELECT run_id, ntile(4) OVER (ORDER BY run_id) AS quarter FROM t) SELECT quarter::INT AS quarter, count(*) AS minutes, round(avg(minute_mismatch_rank), 6) AS rank_mean, round(avg((minute_mismatch_rank >= 0.95)::INT), 6) AS hot_rate FROM scores JOIN q USING (run_id) GROUP BY 1")
def _(spark, d):
    s = scored(spark, d)
    q = s.select("run_id").distinct().withColumn("quarter", F.ntile(4).over(Window.orderBy("run_id")))  # one row per run
    out = s.join(F.broadcast(q), "run_id").groupBy("quarter")
    return out.agg(F.count(F.lit(1)).alias("minutes"), F.round(F.avg("minute_mismatch_rank"), 6).alias("rank_mean"), F.round(F.avg((F.col("minute_mismatch_rank") >= 0.95).cast("double")), 6).alias("hot_rate"))


@step
def _session_matrix(spark, d):
    s = models.robust_scale(models.median_impute(ruled(spark, d).select("session_key", "rule_score", *_RS), list(_RS)), list(_RS))
    return s.withColumn("y", (F.col("rule_score") >= F.lit(ranks.quantile_row(s, ["rule_score"], (0.9,))["rule_score"][0])).cast("int"))


_TICK = ["run_id", "broad_no", "minute_idx"]
_responses: dict[tuple, boosting.Response] = {}


def _response(spark, d):
    """Five folds by run and all five feature groups; ROUNDS trees of depth 3."""
    key = (spark.sparkContext.applicationId, d, state_of(spark, d))
    if key not in _responses:
        _responses[key] = boosting.expected_response(stated(spark, d).filter("not all_zero"), _TICK, rounds=ROUNDS, depth=3, rate=0.3)
    return _responses[key]


#: Rounds of the expected response in the queries; the operator's own default is 100.
ROUNDS = 8


@query("r6_expected_response")
def _(spark, d):
    """Out-of-fold conditional medians of chat and unique chatters, the deficits as the expected family takes them."""
    return boosting.deficits(_response(spark, d), _TICK)


@query("r6_categories", f"WITH {Q.STATE}, c AS (SELECT coalesce(category_id::VARCHAR, 'UNKNOWN_CAT') AS category, count(*) AS n FROM state WHERE NOT all_zero GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) <= 50 AS own FROM c) SELECT CASE WHEN own THEN category ELSE 'OTHER_CAT' END AS category, sum(n)::BIGINT AS n FROM k GROUP BY 1")
def _(spark, d):
    s = stated(spark, d).filter("not all_zero")
    cat, _ = boosting.category_encoder(s, "category_id")
    return s.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("r7_model_fit")
def _(spark, d):
    """Held-out error of the expected response against that of the global median, for both targets."""
    rows, out = _response(spark, d).rows, None
    for i, t in enumerate(("log_chat", "log_unique")):
        m = learn.fit_metrics(rows.select(F.col("targets")[i].alias(t), F.col("predicted")[i].alias("expected")).filter(F.col(t).isNotNull()), t).select(F.lit(t).alias("target"), *r6("mae", "pinball", "base_mae", "skill"))
        out = m if out is None else out.unionByName(m)
    return out


@query("r8_expected_importance")
def _(spark, d):
    """Rise of the held-out error when a feature group is dealt anew inside its fold; the one-hot columns go together."""
    return boosting.importance(_response(spark, d), _TICK, 1).select("target", "feature", *r6("importance_mae_increase", "importance_std"), "fold_count")


@query("m5_isolation_forest")
def _(spark, d):
    return learn.isolation_forest(_session_matrix(spark, d).select("session_key", *_RS), list(_RS), "session_key").select("session_key", "iforest")


@query("m9_pca_error")
def _(spark, d):
    return learn.pca_error(_session_matrix(spark, d).select("session_key", *_RS), list(_RS), 2).select("session_key", "pca_error")


@query("m10_supervised_scores")
def _(spark, d):
    return learn.supervised(_session_matrix(spark, d), list(_RS), "y", "session_key")


@query("m12_pu_bagging")
def _(spark, d):
    """Four rounds of three models; pu_bagging's own default is the method's 30."""
    return learn.pu_bagging(_session_matrix(spark, d), list(_RS), "y", "session_key", 4)


@query("m2_k_selection")
def _(spark, d):
    return models.choose_k(_session_matrix(spark, d), list(_RS), "session_key", "zero_rate", (2, 3, 4), (42,))[0]


@query("m16_stability")
def _(spark, d):
    return models.kmeans_stability(_session_matrix(spark, d), list(_RS), 2, "session_key", "zero_rate", (42, 43, 44))


@query("m3_gaussian_mixtures")
def _(spark, d):
    return outliers.mixtures(_session_matrix(spark, d), list(_RS), (2, 3))[0]


@query("m3_low_density")
def _(spark, d):
    """Every session under the mixture that BIC selects: component, its probability, density and low-density rank."""
    x = _session_matrix(spark, d).select("session_key", *_RS)
    table, fitted = outliers.mixtures(x, list(_RS), (2, 3))
    best = fitted[table.filter("selected").first()["k"]]
    return outliers.mixture_scores(x, list(_RS), "session_key", best).select("session_key", "component", *r6("responsibility", "log_density", "low_density_rank"))


def _scaled(spark, d):
    """The session matrix in nine digits, so that both engines see the same ties."""
    return _session_matrix(spark, d).select("session_key", *[F.round(c, 9).alias(c) for c in _RS])


_MED = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _RS)
_FILLED = ", ".join(f"coalesce({c}::DOUBLE, m_{c}, 0) AS {c}" for c in _RS)
_QUART = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in _RS)
_ROBUST = ", ".join(f"round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 9) AS {c}" for c in _RS)
_MATRIX = f"{Q.RULES}, mx0 AS (SELECT {_MED} FROM rules), mx1 AS (SELECT session_key, {_FILLED} FROM rules, mx0), mx2 AS (SELECT {_QUART} FROM mx1), mx AS MATERIALIZED (SELECT session_key, {_ROBUST} FROM mx1, mx2)"
_NEAR = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _RS)


@query("m6_local_outlier_factor", f"WITH {_MATRIX}, f AS (SELECT *, min(session_key) OVER (PARTITION BY {', '.join(_RS)}) AS first FROM mx), nb AS MATERIALIZED (SELECT * FROM (SELECT a.session_key AS a, b.session_key AS b, sqrt({_NEAR}) AS d, row_number() OVER (PARTITION BY a.session_key ORDER BY sqrt({_NEAR}), b.first, b.session_key) AS k FROM f AS a JOIN f AS b ON a.session_key <> b.session_key) WHERE k <= 20), kd AS (SELECT a, max(d) AS reach FROM nb GROUP BY 1), de AS MATERIALIZED (SELECT nb.a, 1 / greatest(avg(greatest(kd.reach, nb.d)), 1e-10) AS density FROM nb JOIN kd ON kd.a = nb.b GROUP BY 1) SELECT nb.a AS session_key, round(avg(o.density) / max(s.density), 6) AS lof FROM nb JOIN de AS o ON o.a = nb.b JOIN de AS s ON s.a = nb.a GROUP BY 1")
def _(spark, d):
    """Neighbours among all sessions."""
    return outliers.local_outlier_factor(_scaled(spark, d), list(_RS), "session_key").select("session_key", *r6("lof"))


@step
def density_sizes(spark, d):
    return density.hdbscan_sizes(_scaled(spark, d), list(_RS), "session_key")


@query("m4_hdbscan_selection")
def _(spark, d):
    out = density.size_selection(density_sizes(spark, d), list(_RS), "session_key")
    return out.select("min_cluster_size", "min_samples", "n_clusters", "n_noise", *r6("noise_ratio", "coverage", "silhouette", "balanced_score"), "selected")


@query("m4_hdbscan")
def _(spark, d):
    """Every session's density cluster of the selected size, -1 for noise."""
    best = density.size_selection(density_sizes(spark, d), list(_RS), "session_key").filter("selected").select("min_cluster_size")  # one row
    return density_sizes(spark, d).join(F.broadcast(best), "min_cluster_size").select("session_key", "min_cluster_size", "hdbscan", (F.col("hdbscan") == -1).alias("noise"))


@query("m7_one_class_svm")
def _(spark, d):
    return outliers.one_class_svm(_session_matrix(spark, d).select("session_key", *_RS), list(_RS), "session_key").select("session_key", "ocsvm")


@query("m13_stratified_folds", f"WITH {Q.RULES}, h AS (SELECT review_order <= 100 AS y FROM rules) SELECT y, f.f::INT AS fold, (n - f.f + 4) // 5 AS n FROM (SELECT y::INT AS y, count(*) AS n FROM h GROUP BY 1), (SELECT unnest(range(5)) AS f) f")
def _(spark, d):
    """Folds of nearly equal size in both classes: as many rows as dealing each class in turn gives."""
    s = ruled(spark, d).withColumn("y", (F.col("review_order") <= 100).cast("int"))
    n = learn.stratified_fold(s, "y", "session_key", 5).groupBy("y", "fold").agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("_n"), "fold"))).select("y", (F.col("place") - 1).alias("fold"), F.col("_n").alias("n"))


@query("m17_permutation_importance")
def _(spark, d):
    return learn.permutation_importance(_session_matrix(spark, d), list(_RS), "y", "session_key", folds=2, groups={"silence": ["zero_rate", "zrun_max"], "audience": ["gap_med", "v_miss_rate"]})


@query("x12_metric_quartiles", f"WITH {Q.SESSIONS} SELECT unnest(['zero_rate', 'gap_med', 'viewer_median']) AS metric, unnest([round(quantile_cont(zero_rate, 0.25), 6), round(quantile_cont(gap_med, 0.25), 6), round(quantile_cont(viewer_median, 0.25), 6)]) AS p25, unnest([round(quantile_cont(zero_rate, 0.75), 6), round(quantile_cont(gap_med, 0.75), 6), round(quantile_cont(viewer_median, 0.75), 6)]) AS p75 FROM sess")
def _(spark, d):
    names = ("zero_rate", "gap_med", "viewer_median")
    q = ranks.quantile_row(sessions(spark, d), list(names), (0.25, 0.75))
    return spark.createDataFrame([(c, *q[c]) for c in names], "metric string, p25 double, p75 double").select("metric", *r6("p25", "p75"))


@query("x22_gap_changes", f"WITH {Q.STATE} SELECT session_key, max(zero_run_plain)::BIGINT AS plain, max(zero_run_len)::BIGINT AS with_gaps FROM state GROUP BY 1 HAVING max(zero_run_plain) <> max(zero_run_len)")
def _(spark, d):
    w = windows.session_window()
    s = windows.run_length(stated(spark, d).select(*ID, "session_key", "minute_ts", "zero_chat", "zero_run_len"), "zero_chat", "plain", w)
    return s.groupBy("session_key").agg(F.max("plain").cast("long").alias("plain"), F.max("zero_run_len").cast("long").alias("with_gaps")).filter("plain <> with_gaps")


@query("x17_cv_summary", "SELECT l_shipmode_k AS fold, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std FROM (SELECT l_orderkey % 5 AS l_shipmode_k, l_extendedprice FROM lineitem) GROUP BY 1")
def _(spark, d):
    return read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("std"))


@query("a26_evidence_balance", f"WITH {Q.RULES}, s AS (SELECT CASE WHEN review_order <= 20 THEN 'top20' WHEN review_order <= 50 THEN 'top50' WHEN review_order <= 100 THEN 'top100' WHEN review_order <= 200 THEN 'top200' ELSE 'rest' END AS bucket, list_sort([p1, p2, p3, p4, p5]) AS v FROM rules) SELECT bucket, count(*) AS n, round(avg(list_stddev_pop(v)), 6) AS spread, round(avg(list_max(v)), 6) AS top, round(avg(len([x for x in v if x >= 0.8])), 6) AS strong FROM s GROUP BY 1")
def _(spark, d):
    p = [F.col(f"p_{c}") for c in ("zero_rate", "gap_med", "zrun_max", "nc", "nu")]
    s = ruled(spark, d).select(S.order_bucket(F.col("review_order")).alias("bucket"), S.row_std(p).alias("sd"), F.greatest(*p).alias("top"), S.row_count_at_least(p, 0.8).alias("k"))
    return s.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sd"), 6).alias("spread"), F.round(F.avg("top"), 6).alias("top"), F.round(F.avg("k"), 6).alias("strong"))


#: What minute clusters are fitted on.
_MINUTE = ["log_viewer", "log_chat", "log_unique", "rolling_chat_deficit_5m", "rolling_zero_rate_5m", "zero_run_len"]
_kept: dict[tuple, str] = {}


def _minute_clusters(spark, d):
    """K from 2 to 8 over all minute rows with one seed (fit's own default is three), kept in the shared folder."""
    key = (spark.sparkContext.applicationId, d, state_of(spark, d))
    if key not in _kept:
        rows = zed(spark, d).withColumn("_key", F.concat_ws("-", *_TICK))
        table, fitted = clusters.fit(rows, _MINUTE, "_key", "rolling_zero_rate_5m", seeds=(42,))
        root = new_path(spark, "minute-clusters")
        fitted.save(spark, f"{root}/clusters")
        table.write.parquet(f"{root}/candidates")
        _kept[key] = root
    return _kept[key]


@step
def minute_labelled(spark, d):
    """Minute rows with their fitted cluster, that cluster's mismatch rank, and the state it gives."""
    kept = clusters.load(spark, f"{_minute_clusters(spark, d)}/clusters")
    s = kept.apply(marked(spark, d).drop("minute_cluster", "cluster_mismatch_rank", "mismatch_state"), "minute_cluster")
    return evidence.mark_mismatch(s, evidence.cluster_profiles(s))


@query("m2_minute_k_selection")
def _(spark, d):
    """The candidates for K over all minute rows; the silhouette is the only figure of a sample."""
    return spark.read.parquet(f"{_minute_clusters(spark, d)}/candidates").select("k", *r6("silhouette", "calinski_harabasz", "davies_bouldin", "size_balance", "separation", "selection_score"), "selected")


@query("m2_minute_clusters")
def _(spark, d):
    return minute_labelled(spark, d).select(*_TICK, "minute_cluster", *r6("cluster_mismatch_rank"), "mismatch_state")


@query("r21_fitted_profiles")
def _(spark, d):
    """Profiles, mismatch ranks and interpretations of the fitted minute clusters."""
    return evidence.cluster_profiles(minute_labelled(spark, d).drop("cluster_mismatch_rank")).select("cluster_id", "n", *r6("share", "zero_rate", "rolling_zero_mean", *evidence.PROFILE, "cluster_mismatch_rank"), "interpretation")


@query("r27_injected_clusters")
def _(spark, d):
    """Injected rows and the others of their sessions under the kept clusters: how many stay in their row's cluster."""
    kept = clusters.load(spark, f"{_minute_clusters(spark, d)}/clusters")
    flags = _injected(spark, d).select(*_TICK, "injection_type", "injected")
    new = kept.apply(_injected_state(spark, d), "new_cluster").select(*_TICK, "new_cluster").join(flags, _TICK)
    both = new.join(minute_labelled(spark, d).select(*_TICK, "minute_cluster"), _TICK)
    return both.groupBy("injection_type", "injected").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_cluster") != F.col("minute_cluster")).alias("moved"))


@step
def grid_table(spark, d):
    """Two families, two settings each, 3 folds, 2 repetitions (grid_search's own default: three families, 5 by 3)."""
    return classify.grid_search(_session_matrix(spark, d), list(_RS), "y", "session_key", {"logistic": {"regParam": [0.01, 0.1]}, "tree": {"maxDepth": [2, 4]}}, 3, 2)


@query("m10_grid_search")
def _(spark, d):
    return grid_table(spark, d)


@query("x17_fold_summary")
def _(spark, d):
    """The grid's folds and repetitions by model and parameters, with the selected ones."""
    out = classify.search_summary(grid_table(spark, d))
    return out.select("model", "params", "folds", *r6(*[f"{m}_{s}" for m in classify.METRICS for s in ("mean", "std")]), "selected")


@query("m10_calibrated_scores")
def _(spark, d):
    """The linear SVM's out-of-fold scores through isotonic maps that are fitted inside each fold's training rows."""
    return classify.calibrated_scores(_session_matrix(spark, d), list(_RS), "y", "session_key", folds=3).select("session_key", "y", "model", "fold", *r6("raw", "score"))


_EXPORTED = ("viewer", "log_viewer", "log_chat", "log_unique")


@query("v_rebuild_difference", f"WITH {Q.STATE}, u AS (" + " UNION ALL ".join(f"SELECT 'changed' AS kind, '{c}' AS column_name, {c}::DOUBLE AS a, round({c}::DOUBLE, 3) AS b FROM state" for c in _EXPORTED) + ") SELECT kind, column_name, count(*) AS n FROM u WHERE NOT abs(a - b) <= 1e-9 * greatest(abs(a), abs(b)) GROUP BY ALL")
def _(spark, d):
    """Which columns of the exported minute table don't give the stored one back at a tolerance of 1e-9, and in how
    many rows."""
    stored = stated(spark, d).select(*_TICK, *_EXPORTED)
    return compare.difference(stored, sinks.export(stored), _TICK).groupBy("kind", "column_name").agg(F.count(F.lit(1)).alias("n"))


_DETECTORS, _DENSITY = ["iforest", "lof", "ocsvm", "pca_error"], ["low_density_rank", "ambiguity"]


@step
def fitted_scores(spark, d):
    """Every session with the scores of the fitted models. Forest, one-class SVM and PCA are fitted on the normal seed
    (at most median silence, gap and silent run, at least median chat); the outlier factor takes its neighbours among
    all sessions. flagged: the more silent of two KMeans clusters."""
    key, cols = "session_key", list(_RS)
    x = _session_matrix(spark, d).select(key, *cols)
    s = ruled(spark, d)
    mid = {c: F.lit(q[0]) for c, q in ranks.quantile_row(s, ["zero_rate", "gap_med", "zrun_max", "chat_mean"], (0.5,)).items()}
    seed = s.filter((F.col("zero_rate") <= mid["zero_rate"]) & (F.col("gap_med") <= mid["gap_med"]) & (F.col("zrun_max") <= mid["zrun_max"]) & (F.col("chat_mean") >= mid["chat_mean"])).select(key)
    normal = x.join(seed, key, "left_semi")
    table, fitted = outliers.mixtures(x, cols, (2, 3))
    mixed = outliers.mixture_scores(x, cols, key, fitted[table.filter("selected").first()["k"]])
    parts = [
        learn.isolation_forest(x, cols, key, "iforest", normal).select(key, "iforest"),
        outliers.local_outlier_factor(_scaled(spark, d), cols, key).select(key, "lof"),
        outliers.one_class_svm(x, cols, key, "ocsvm", normal).select(key, "ocsvm"),
        learn.pca_error(x, cols, 2, "pca_error", normal).select(key, "pca_error"),
        mixed.select(key, "low_density_rank", (1 - F.col("responsibility")).alias("ambiguity")),
        QUERIES["m4_hdbscan"](spark, d).select(key, "noise"),
        models.kmeans_labels(x, cols, 2, "zero_rate", (42,)).select(key, (F.col("cluster") == 1).alias("flagged")),
    ]
    y = learn.supervised(_session_matrix(spark, d), cols, "y", key, models=("weighted_logistic", "boosted"))
    parts.append(y.groupBy(key).agg(*[F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in ("weighted_logistic", "boosted")]))
    out = s.select(key, "rule_score", "zero_rate", "gap_med", "chat_mean")
    for part in parts:
        out = out.join(part, key, "left")
    return out


@query("r31_fitted_consensus")
def _(spark, d):
    """Mean rank of the rule and six fitted models: two supervised ones out of fold, four detectors."""
    out = review.model_consensus(fitted_scores(spark, d), ["rule_score", "weighted_logistic", "boosted", *_DETECTORS])
    return out.select("session_key", *r6("consensus"), "review_group")


@step
def fitted_hidden(spark, d):
    return review.fitted_candidates(fitted_scores(spark, d), "rule_score", _DETECTORS, _DENSITY, "noise", "flagged")


@query("r32_fitted_candidates")
def _(spark, d):
    return fitted_hidden(spark, d).select("session_key", *r6("rule_pct", "normal_anomaly_pct", "density_anomaly_pct"), "noise", "flagged", *r6("hidden"), "discovery_group", "priority", "codes")


@query("a32_fitted_groups")
def _(spark, d):
    """The discovery groups of the fitted hidden score."""
    out = fitted_hidden(spark, d).groupBy("discovery_group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in ("hidden", "zero_rate", "gap_med", "chat_mean")])
    return out.select("discovery_group", "n", *r6("hidden_mean", "zero_rate_mean", "gap_med_mean", "chat_mean_mean"))
