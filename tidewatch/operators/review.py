"""Comparisons of rankings, ablations, variants and reasons. Inputs are one row per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, order_bucket, row_count_at_least, row_mean, row_median, row_std, row_trimmed_mean
from ..sources.steps import written
from .ranks import group_pct_ranks, pct_ranks, places, quantile_row


def strength(rank: Column, n: Column) -> Column:
    return clip(1 - rank / (n + 1), 0.0, 1.0)


def variants(df: DataFrame, names: list[str]) -> DataFrame:
    """Other aggregations of the same strengths: mean, median and trimmed mean of what is known."""
    s = [F.col(f"{x}_strength") for x in names]
    return df.select("session_key", F.round(row_mean(s), 9).alias("v_mean"), F.round(row_median(s), 9).alias("v_median"), F.round(row_trimmed_mean(s), 9).alias("v_trimmed"))


def ablation(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """For each family left out: how many of the k first sessions stay, and the rank correlation of the orders."""
    out = None
    for left in names:
        score = F.round(row_mean([F.col(f"{x}_strength") for x in names if x != left]), 9)
        place = places(df.select("session_key", "review_order", score.alias("_s")), [F.desc_nulls_last("_s"), F.asc("session_key")], "other")
        row = place.agg(F.count_if((F.col("review_order") <= k) & (F.col("other") <= k)).alias("overlap"), F.round(F.corr("review_order", "other"), 6).alias("spearman")).select(F.lit(left).alias("family"), "overlap", "spearman")
        out = row if out is None else out.unionByName(row)
    return out


def reasons(df: DataFrame, measures: list[str], top: int = 3) -> DataFrame:
    """The top measures of each session by percentile rank over sessions, nulls aside."""
    long = df.select("session_key", F.expr("stack({}, {}) as (reason, value)".format(len(measures), ", ".join(f"'{m}', cast({m} as double)" for m in measures))))
    ranked = group_pct_ranks(long.filter("value is not null").withColumn("value", F.round("value", 9)), ["reason"], "value", "pct")
    w = Window.partitionBy("session_key").orderBy(F.desc("pct"), "reason")
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def reason_patterns(top: DataFrame) -> DataFrame:
    """How many sessions share each set of top reasons, with up to five examples."""
    sets = top.groupBy("session_key").agg(F.concat_ws(";", F.array_sort(F.collect_set("reason"))).alias("pattern"))
    # the first five keys of each salted part, then of the pattern: no task holds a pattern's sessions
    first = sets.withColumn("_s", F.pmod(F.xxhash64("session_key"), F.lit(64)))
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("pattern", "_s").orderBy("session_key"))).filter("_k <= 5")
    examples = first.groupBy("pattern").agg(F.concat_ws(";", F.slice(F.array_sort(F.collect_list("session_key")), 1, 5)).alias("examples"))  # 320 keys at most
    out = sets.groupBy("pattern").agg(F.count(F.lit(1)).alias("sessions")).join(examples, "pattern")
    return out.withColumn("rate", F.round(F.col("sessions") / F.sum("sessions").over(Window.partitionBy()), 6))


def compare_orders(a: DataFrame, b: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Two rankings (session_key, place) joined on sessions: overlap, Jaccard and recall at each k."""
    both = a.select("session_key", F.col("place").alias("pa")).join(b.select("session_key", F.col("place").alias("pb")), "session_key", "full_outer")
    grid = both.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    x, y = F.coalesce(F.col("pa") <= F.col("k"), F.lit(False)), F.coalesce(F.col("pb") <= F.col("k"), F.lit(False))
    out = grid.groupBy("k").agg(F.count_if(x & y).alias("overlap"), F.count_if(x | y).alias("either"), F.count_if(x).alias("in_a"))
    return out.select(F.col("k").cast("long").alias("k"), "overlap", F.round(F.col("overlap") / F.col("either"), 6).alias("jaccard"), F.round(F.col("overlap") / F.col("in_a"), 6).alias("recall"))


def rank_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("session_key", F.col("place").alias("pa")).join(b.select("session_key", F.col("place").alias("pb")), "session_key")
    j = written(j.withColumn("gap", F.abs(F.col("pa") - F.col("pb")).cast("double")), "rank-gap")
    mid = quantile_row(j, ["gap"], (0.5,))["gap"][0]
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("pa", "pb"), 6).alias("spearman"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.lit(mid).cast("double").alias("median_gap"))


def widen(meta: DataFrame, frames: dict[str, DataFrame], k: int) -> DataFrame:
    """Rankings (session_key, place) side by side, and how many of them have a session among their first k."""
    out = meta
    for name, f in frames.items():
        out = out.join(f.select("session_key", F.col("place").alias(f"{name}_place")), "session_key", "left")
    flags = [F.coalesce((F.col(f"{n}_place") <= k).cast("int"), F.lit(0)) for n in frames]
    return out.withColumn("flags", sum(flags[1:], flags[0]))


def order_variants(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """Six orders of the reviewed sessions against the review order: overlap among the k first, rank correlation, and
    the median shift of the k first."""
    st = [F.col(f"{x}_strength") for x in names]
    flat = df.withColumns({"_median": F.round(row_median(st), 9), "_trimmed": F.round(row_trimmed_mean(st), 9), "_rest": F.round(row_mean(st[:-1]), 9)})
    orders = {"consensus": [F.desc("consensus")], "rra": [F.asc("rra_p")], "both": [F.asc("rra_p"), F.desc("consensus")], "median": [F.desc("_median")], "trimmed": [F.desc("_trimmed")], f"no_{names[-1]}": [F.desc("_rest")]}
    out = None
    for name, order in orders.items():
        p = places(flat, [*order, F.asc("session_key")], "place").select("review_order", "place")
        shift = F.abs(F.col("review_order") - F.col("place"))
        row = p.agg(F.count_if((F.col("review_order") <= k) & (F.col("place") <= k)).alias("overlap"), F.round(F.corr("review_order", "place"), 6).alias("spearman"), F.percentile(F.when(F.col("review_order") <= k, shift), F.lit(0.5)).alias("median_shift"))  # k values
        row = row.select(F.lit(name).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out


#: Weights of the minute signals: two for what a variant's name says, one for the others.
WEIGHTS = {"equal": (1, 1, 1, 1, 1, 1), "chat": (2, 1, 2, 1, 1, 1), "unique": (1, 2, 1, 2, 1, 1), "rolling": (1, 1, 2, 2, 2, 1), "zero": (1, 1, 1, 1, 2, 2), "point": (2, 2, 1, 1, 1, 1)}


def weight_variants(scores: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """Weighted means of the signals' ranks (none counts 0), each correlated with the mismatch rank."""
    value = lambda ws: F.round(sum((w * F.coalesce(f"r_{s}", F.lit(0)) for s, w in zip(signals[1:], ws[1:], strict=True)), ws[0] * F.coalesce(f"r_{signals[0]}", F.lit(0))) / sum(ws), 9)
    row = scores.agg(*[F.round(F.corr("minute_mismatch_rank", value(ws)), 6).alias(n) for n, ws in WEIGHTS.items()])
    return row.select(F.expr("stack({}, {}) as (variant, r)".format(len(WEIGHTS), ", ".join(f"'{n}', {n}" for n in WEIGHTS))))


def scan_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two scans by their largest scores: overlap of the k first sessions, and how many of these keep their interval."""
    first = lambda s, n: s.orderBy(F.desc("scan_z"), "session_key").limit(k).select("session_key", F.struct("start_idx", "end_idx").alias(n))
    j = first(a, "_a").join(first(b, "_b"), "session_key")
    return j.agg(F.count(F.lit(1)).alias("overlap"), F.count_if(F.col("_a") == F.col("_b")).alias("same_interval"))


def quantile_groups(df: DataFrame, column: str) -> DataFrame:
    """Adds review_group: confirmed from the 95 % quantile on, candidate from the 90 % quantile on."""
    q90, q95 = quantile_row(df, [column], (0.9, 0.95))[column]
    return df.withColumn("review_group", F.when(F.col(column) >= F.lit(q95), "confirmed").when(F.col(column) >= F.lit(q90), "candidate").otherwise("normal"))


def hidden_candidates(df: DataFrame, weights: dict[str, float], codes: dict[str, str], k: int) -> DataFrame:
    """Adds the weighted hidden score, the discovery group (the best tenth of it against the first k of the rule
    order), and the codes of the ranks from 0.9 on."""
    parts = [F.lit(w) * F.col(c) for c, w in weights.items()]
    out = df.withColumn("hidden", F.round(sum(parts[1:], parts[0]), 9))
    high, known = F.col("hidden") >= F.lit(quantile_row(out, ["hidden"], (0.9,))["hidden"][0]), F.col("review_order") <= k
    group = F.when(high & ~known, "hidden").when(high, "known").when(known, "rule_only").otherwise("other")
    return out.withColumn("discovery_group", group).withColumn("codes", F.concat_ws("|", *[F.when(F.col(c) >= 0.9, n) for n, c in codes.items()]))


def model_consensus(df: DataFrame, scores: list[str]) -> DataFrame:
    """Adds consensus, the mean of the scores' percentile ranks (null ones left out), and review_group: high_review from
    its 95 % quantile on, medium_review from the 90 % quantile on."""
    out = pct_ranks(df, {f"_p_{c}": c for c in scores}, 9)
    out = out.withColumn("consensus", F.round(row_mean([F.col(f"_p_{c}") for c in scores]), 9)).drop(*[f"_p_{c}" for c in scores])
    q90, q95 = quantile_row(out, ["consensus"], (0.9, 0.95))["consensus"]
    return out.withColumn("review_group", F.when(F.col("consensus") >= F.lit(q95), "high_review").when(F.col("consensus") >= F.lit(q90), "medium_review").otherwise("low_priority"))


#: Weights of the hidden score's parts: fixed values.
HIDDEN = {"rule_pct": 0.35, "normal_anomaly_pct": 0.35, "density_anomaly_pct": 0.2, "noise": 0.1}


def fitted_candidates(df: DataFrame, rule: str, detectors: list[str], density: list[str], noise: str, flagged: str) -> DataFrame:
    """Adds the hidden score of fitted models, the discovery group, the priority and the codes.

    The score weighs the rule's percentile rank, the mean rank of the detectors fitted on normal rows, the mean rank of
    the density scores, and noise (boolean). Groups hold its best tenth against flagged (boolean, the suspicious
    cluster); a null flag counts as not flagged. Codes: ranks from 0.9 on, noise, and zero_rate, gap_med and chat_mean
    beyond their own 90 % (10 %) quantile.
    """
    out = pct_ranks(df, {"rule_pct": rule} | {f"_p_{c}": c for c in [*detectors, *density]}, 9)
    mean = lambda cols: F.round(row_mean([F.col(f"_p_{c}") for c in cols]), 9)
    out = out.withColumns({"normal_anomaly_pct": mean(detectors), "density_anomaly_pct": mean(density)}).drop(*[f"_p_{c}" for c in [*detectors, *density]])
    is_noise, on = F.coalesce(F.col(noise), F.lit(False)), F.coalesce(F.col(flagged), F.lit(False))
    parts = [F.lit(w) * (is_noise.cast("double") if c == "noise" else F.coalesce(F.col(c), F.lit(0.0))) for c, w in HIDDEN.items()]
    out = written(out.withColumn("hidden", F.round(sum(parts[1:], parts[0]), 9)), "hidden-scores")
    q90, q95 = quantile_row(out, ["hidden"], (0.9, 0.95))["hidden"]
    q = quantile_row(out, ["zero_rate", "gap_med", "chat_mean"], (0.1, 0.9))
    high = F.col("hidden") >= F.lit(q90)
    group = F.when(on & high, "confirmed_suspicious").when(high, "hidden_candidate").when(on, "kmeans_only_candidate").otherwise("normal_low_priority")
    codes = {
        "high_rule_mismatch": F.col("rule_pct") >= 0.9, "normal_manifold_outlier": F.col("normal_anomaly_pct") >= 0.9, "low_density_or_ambiguous_cluster": F.col("density_anomaly_pct") >= 0.9, "hdbscan_noise": is_noise,
        "very_high_zero_rate": F.col("zero_rate") >= F.lit(q["zero_rate"][1]), "very_high_gap": F.col("gap_med") >= F.lit(q["gap_med"][1]), "very_low_chat": F.col("chat_mean") <= F.lit(q["chat_mean"][0]),
    }
    text = F.concat_ws("|", *[F.when(test, name) for name, test in codes.items()])
    priority = F.when(F.col("hidden") >= F.lit(q95), "high").when(high, "medium").otherwise("low")
    return out.withColumns({"discovery_group": group, "priority": priority, "codes": F.when(text == "", "none").otherwise(text)})


def flagged_precision(flagged: DataFrame, order: DataFrame) -> DataFrame:
    """Of as many first sessions as are flagged, how many are flagged."""
    n = flagged.count()
    top = order.filter(F.col("review_order") <= n).select("session_key")
    both = top.join(flagged, "session_key", "left_semi").agg(F.count(F.lit(1)).alias("both_n"))
    return both.select(F.lit(n).cast("long").alias("flagged"), "both_n", F.round(F.col("both_n") / F.lit(n), 6).alias("precision"))


def balance(df: DataFrame, strengths: list[str]) -> DataFrame:
    """How evenly evidence supports the sessions of each bucket of the order; buckets without any count 0."""
    v = [F.col(c) for c in strengths]
    s = df.select(order_bucket(F.col("review_order")).alias("bucket"), row_std(v).alias("sd"), F.greatest(*v).alias("top"), row_count_at_least(v, 0.8).alias("k"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in ("top20", "top50", "top100", "top200", "rest")])).alias("bucket"))
    six = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return grid.join(s, "bucket", "left").groupBy("bucket").agg(F.count("sd").alias("n"), six("sd").alias("spread"), six("top").alias("top"), six("k").alias("strong"))


def example_picks(df: DataFrame) -> DataFrame:
    """Three different sessions of (session_key, longest, runs): the longest run, the most runs, the one nearest to
    the median length."""
    one = lambda s, order, name: s.orderBy(*order, "session_key").limit(1).select(F.lit(name).alias("pick"), "session_key")
    mid = quantile_row(df, ["longest"], (0.5,))["longest"][0]
    a = one(df, [F.desc("longest")], "longest")
    rest = df.join(F.broadcast(a), "session_key", "left_anti")
    b = one(rest, [F.desc("runs")], "most")
    rest = rest.join(F.broadcast(b), "session_key", "left_anti")
    return a.unionByName(b).unionByName(one(rest, [F.abs(F.col("longest") - F.lit(mid))], "typical"))


def top_jaccard(df: DataFrame, scores: dict[str, str], k: int) -> DataFrame:
    """Overlap and Jaccard index of the k first sessions of each two scores."""
    out = None
    for name, c in scores.items():
        t = df.orderBy(F.desc(c), "session_key").limit(k).select(F.lit(name).alias("score"), "session_key")
        out = t if out is None else out.unionByName(t)
    a, b = out.withColumnRenamed("score", "a"), out.withColumnRenamed("score", "b")
    return a.join(b, "session_key").groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap")).withColumn("jaccard", F.round(F.col("overlap") / (2.0 * k - F.col("overlap")), 6))
