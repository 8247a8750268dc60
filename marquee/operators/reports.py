"""Warehouse reports over users, items, events, recommendations, explanations, artifacts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(df: DataFrame, ts: str, interval: str, as_of: str) -> DataFrame:
    """Rows of the interval before `as_of`."""
    return df.where(F.col(ts).cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {interval}"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def percent(part: Column, whole: Column, places: int) -> Column:
    """100 * part / whole, null over nothing."""
    return F.round(F.try_divide(100.0 * part, whole), places)


def exact_mean(column: str, places: int = 4) -> Column:
    """Mean of values of up to six decimal places, none negative, rounded half up; in whole numbers, so that ties don't depend on the order of the sum."""
    total, n = F.sum(F.round(F.col(column) * 1_000_000).cast("bigint")), F.count(column)
    step = 10 ** (6 - places)
    return F.when(n > 0, F.floor((2 * total + step * n) / (2 * step * n)) / 10**places).alias(column)


def top_watched(items: DataFrame, events: DataFrame, min_viewers: int = 10, n: int = 10) -> DataFrame:
    done = events.where("event_type = 'watch_complete'").join(items, "doc_id")
    stats = done.groupBy("doc_id", "title", "genres").agg(F.count("event_id").alias("total_watches"), F.round(F.avg("watch_pct"), 3).alias("avg_completion_rate"), F.count_distinct("user_id").alias("unique_viewers"))
    return stats.where(F.col("unique_viewers") >= min_viewers).orderBy(F.desc("total_watches"), "doc_id").limit(n)


def method_ablation(recs: DataFrame, as_of: str, min_searches: int = 100) -> DataFrame:
    stats = recent(recs, "served_at", "7 DAYS", as_of).groupBy("method").agg(
        F.count("rec_id").alias("total_searches"),
        exact_mean("ndcg_at_10").alias("avg_ndcg_at_10"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
        percent(count_where(F.col("cache_hit")), F.count("*"), 1).alias("cache_hit_rate_pct"),
        F.round(F.percentile("latency_ms", 0.95), 1).alias("p95_latency_ms"),
        F.round(F.percentile("latency_ms", 0.99), 1).alias("p99_latency_ms"),
    )
    return stats.where(F.col("total_searches") >= min_searches)


def engagement_funnel(users: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Users to profiles in two steps; users without events in the window drop out, as a filter behind a left join has it."""
    kind = F.col("event_type")
    per_user = users.join(recent(events, "occurred_at", "30 DAYS", as_of), "user_id").groupBy("user_id", "profile_type").agg(
        count_where(kind == "click").alias("clicks"),
        count_where(kind == "watch_complete").alias("completions"),
        count_where(kind == "skip").alias("skips"),
        F.round(F.avg("watch_pct"), 3).alias("avg_watch_pct"),
    )
    return per_user.groupBy("profile_type").agg(
        F.count_distinct("user_id").alias("active_users"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("completions").alias("total_completions"),
        percent(F.sum("completions"), F.sum("clicks"), 2).alias("click_to_complete_pct"),
        F.round(F.avg("avg_watch_pct"), 3).alias("avg_watch_completion"),
        percent(F.sum("skips"), F.sum("clicks"), 2).alias("skip_rate_pct"),
    )


def either_key(pairs: DataFrame) -> DataFrame:
    """Each pair from either side, (doc_id, other_id, ...): an OR-join on both keys becomes one equi-join on this."""
    rest = [c for c in pairs.columns if c not in ("doc_id_a", "doc_id_b")]
    a = pairs.select(F.col("doc_id_a").alias("doc_id"), F.col("doc_id_b").alias("other_id"), *rest)
    return a.unionByName(pairs.select(F.col("doc_id_b").alias("doc_id"), F.col("doc_id_a").alias("other_id"), *rest))


def similar_titles(pairs: DataFrame, items: DataFrame, title: str, min_count: int = 5, n: int = 15) -> DataFrame:
    seeds = items.where(F.col("title").ilike(f"%{title}%")).select("doc_id")
    found = either_key(pairs.where(F.col("co_watch_count") >= min_count)).join(seeds, "doc_id")
    other = items.select(F.col("doc_id").alias("other_id"), F.col("title").alias("similar_title"), F.col("genres").alias("similar_genres"))
    shown = found.join(other, "other_id").select(F.col("doc_id").alias("seed_doc_id"), F.col("other_id").alias("similar_doc_id"), "similar_title", "similar_genres", "co_watch_count", F.round("co_watch_score", 4).alias("co_watch_score"))
    return shown.orderBy(F.desc("co_watch_score"), "seed_doc_id", "similar_doc_id").limit(n)


def term_popularity(recs: DataFrame, users: DataFrame, as_of: str, min_recs: int = 20) -> DataFrame:
    served = recent(recs, "served_at", "30 DAYS", as_of).where("ndcg_at_10 is not null").select("user_id", "rec_id", "ndcg_at_10", F.explode(F.split("query", " ")).alias("genre"))
    stats = served.join(users.select("user_id", "profile_type"), "user_id").groupBy("profile_type", F.trim("genre").alias("genre")).agg(
        F.count_distinct("user_id").alias("users_searched"), F.count("rec_id").alias("total_recommendations"), exact_mean("ndcg_at_10").alias("avg_ndcg")
    )
    return stats.where(F.col("total_recommendations") >= min_recs)


def promotion_audit(artifacts: DataFrame, gates: DataFrame, kind: str = "ltr", n: int = 20) -> DataFrame:
    """Gates of each artifact with the failed ones listed in the order of their names.

    Values are rounded as binary numbers, halves away from 0: 0.00015 is less than its decimals say and gives 0.0001."""
    value = F.col("measured_value")
    nearest = F.signum(value) * F.floor(F.abs(value * 10000) + 0.5) / 10000
    failed = F.when(~F.col("passed"), F.concat("gate_name", F.lit("="), F.format_string("%.4f", F.when(value.isNotNull(), nearest))))
    audit = gates.groupBy("artifact_id").agg(
        F.count("gate_id").alias("total_gates"),
        count_where(F.col("passed")).alias("gates_passed"),
        count_where(~F.col("passed")).alias("gates_failed"),
        F.array_join(F.sort_array(F.collect_list(failed)), ", ").alias("failed_gates"),
    )
    wanted = artifacts.where(F.col("artifact_type") == kind).join(audit, "artifact_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_gates", "gates_passed", "gates_failed")]
    return wanted.select("artifact_id", "run_id", "flow_name", "ndcg_at_10", "is_active", "created_at", *zero, F.coalesce("failed_gates", F.lit("")).alias("failed_gates")).orderBy(F.desc("created_at"), "artifact_id").limit(n)


def ipw_by_position(events: DataFrame, as_of: str, low: float = 0.05, high: float = 0.95, min_rows: int = 50) -> DataFrame:
    kept = recent(events, "occurred_at", "30 DAYS", as_of).where(F.col("propensity").between(low, high))
    reward = F.when(F.col("event_type") == "watch_complete", F.try_divide(F.col("watch_pct"), F.col("propensity"))).otherwise(0.0)
    stats = kept.withColumn("reward", reward).groupBy("position").agg(
        F.count("*").alias("n_impressions"),
        F.round(F.avg("watch_pct"), 3).alias("naive_completion"),
        F.round(F.avg("reward"), 4).alias("ipw_estimated_reward"),
        F.round(F.stddev_samp("reward"), 4).alias("reward_std"),
        F.round(F.avg("propensity"), 4).alias("avg_propensity"),
    )
    return stats.where(F.col("n_impressions") >= min_rows)


def latency_slo(recs: DataFrame, as_of: str, interval: str = "24 HOURS", limit_ms: float = 200.0) -> DataFrame:
    p = F.percentile("latency_ms", [0.5, 0.95, 0.99])
    hours = recent(recs, "served_at", interval, as_of).groupBy(F.date_trunc("hour", F.col("served_at")).alias("hour_bucket"), "method").agg(
        F.count("*").alias("requests"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"), p.alias("p"), percent(count_where(F.col("cache_hit")), F.count("*"), 2).alias("cache_hit_pct")
    )
    return hours.select(
        "hour_bucket", "method", "requests", "avg_ms", *(F.round(F.col("p")[i], 1).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))), F.when(F.col("p")[2] > limit_ms, "SLO_BREACH").otherwise("OK").alias("slo_status"), "cache_hit_pct"
    )


def cold_start_users(users: DataFrame, events: DataFrame, items: DataFrame, as_of: str, n: int = 100) -> DataFrame:
    seen = recent(events, "occurred_at", "7 DAYS", as_of).join(items.select("doc_id", "genres"), "doc_id")
    week = seen.groupBy("user_id").agg(F.count_distinct("genres").alias("genres_explored_7d"), count_where(F.col("event_type") == "watch_complete").alias("watch_count_7d"))
    few = F.col("interaction_count")
    epsilon = F.when(few < 5, "epsilon_0.40").when(few < 20, "epsilon_0.25").otherwise("epsilon_0.15")
    cold = users.where(F.col("cold_start") | (few < 20)).join(week, "user_id", "left")
    return cold.select("user_id", "profile_type", "language", "interaction_count", "cold_start", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("genres_explored_7d", "watch_count_7d")), epsilon.alias("recommended_epsilon")).orderBy("interaction_count", "user_id").limit(n)


def explanation_cost(explanations: DataFrame, as_of: str, usd_per_token: float = 0.0008 / 1000) -> DataFrame:
    """Tokens and cost by day, model, kind and language, with the running cost; rows of a day share the running value."""
    day = recent(explanations, "created_at", "30 DAYS", as_of).groupBy(F.date_trunc("day", F.col("created_at")).alias("day"), "model", "exp_type", "language").agg(
        F.count("*").alias("explanations_generated"), F.sum("tokens_used").alias("total_tokens"), F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms")
    )
    until = day.groupBy("day").agg(F.sum("total_tokens").alias("t")).withColumn("running", F.sum("t").over(Window.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow))).select("day", "running")
    return day.join(F.broadcast(until), "day").select("*", F.round(F.col("total_tokens") * usd_per_token, 4).alias("estimated_cost_usd"), F.round(F.col("running") * usd_per_token, 4).alias("cumulative_cost_usd")).drop("running")


def unit_cost(recs: DataFrame, usd_per_hour: float = 0.5) -> DataFrame:
    """Cost of a query, a day and an active user from mean latency at a price of computing hours."""
    stats = recs.groupBy("method").agg(F.avg("latency_ms").alias("ms"), F.count("*").alias("n_queries"), F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.to_date("served_at")).alias("n_days"))
    query = F.col("ms") / 3_600_000 * usd_per_hour
    return stats.select("method", "n_queries", F.round(query, 9).alias("usd_per_query"), F.round(query * F.col("n_queries") / F.col("n_days"), 6).alias("usd_per_day"), F.round(query * F.col("n_queries") / F.col("n_users"), 6).alias("usd_per_user"))
