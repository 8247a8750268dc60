"""Warehouse reports."""

from marquee.operators import features as B
from marquee.operators import reports as Q
from marquee.plans.behaviour import COWATCH
from marquee.plans.fixtures import AS_OF


def since(column: str, interval: str) -> str:
    return f"{column} >= TIMESTAMP '{AS_OF}' - INTERVAL {interval}"


QUERIES = {
    "q01_top_watched": (
        lambda d: Q.top_watched(d.items, d.watch_events),
        """SELECT i.doc_id, i.title, i.genres, count(event_id) AS total_watches, round(avg(watch_pct), 3) AS avg_completion_rate, count(DISTINCT user_id) AS unique_viewers
        FROM items i JOIN watch_events e ON i.doc_id = e.doc_id AND e.event_type = 'watch_complete' GROUP BY ALL HAVING count(DISTINCT user_id) >= 10 ORDER BY total_watches DESC, i.doc_id LIMIT 10""",
    ),
    "q02_method_ablation": (
        lambda d: Q.method_ablation(d.recommendations, AS_OF),
        f"""SELECT method, count(rec_id) AS total_searches, (2 * sum(CAST(round(ndcg_at_10 * 1000000) AS BIGINT)) + 100 * count(ndcg_at_10)) // (200 * count(ndcg_at_10)) / 10000 AS avg_ndcg_at_10, round(avg(latency_ms), 1) AS avg_latency_ms,
        round(100.0 * count(*) FILTER (cache_hit) / count(*), 1) AS cache_hit_rate_pct, round(quantile_cont(latency_ms, 0.95), 1) AS p95_latency_ms, round(quantile_cont(latency_ms, 0.99), 1) AS p99_latency_ms
        FROM recommendations WHERE {since('served_at', '7 DAY')} GROUP BY method HAVING count(*) >= 100""",
    ),
    "q03_engagement_funnel": (
        lambda d: Q.engagement_funnel(d.users, d.watch_events, AS_OF),
        f"""WITH f AS (SELECT u.user_id, profile_type, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'watch_complete') AS completions,
        count(*) FILTER (event_type = 'skip') AS skips, round(avg(watch_pct), 3) AS avg_watch_pct FROM users u LEFT JOIN watch_events e ON u.user_id = e.user_id WHERE {since('occurred_at', '30 DAY')} GROUP BY 1, 2)
        SELECT profile_type, count(DISTINCT user_id) AS active_users, CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(completions) AS BIGINT) AS total_completions,
        round(100.0 * sum(completions) / nullif(sum(clicks), 0), 2) AS click_to_complete_pct, round(avg(avg_watch_pct), 3) AS avg_watch_completion,
        round(100.0 * sum(skips) / nullif(sum(clicks), 0), 2) AS skip_rate_pct FROM f GROUP BY profile_type""",
    ),
    "q04_similar_titles": (
        lambda d: Q.similar_titles(B.cowatch_scores(B.cowatch_pairs(d.ratings), d.ratings), d.items, "red"),
        f"""WITH {COWATCH}, n AS (SELECT doc_id, count(*) AS n FROM ratings GROUP BY doc_id),
        c AS (SELECT p.*, co_watch_count / sqrt(x.n * y.n) AS s FROM pairs p JOIN n x ON doc_id_a = x.doc_id JOIN n y ON doc_id_b = y.doc_id)
        SELECT i1.doc_id AS seed_doc_id, i2.doc_id AS similar_doc_id, i2.title AS similar_title, i2.genres AS similar_genres, co_watch_count, round(s, 4) AS co_watch_score
        FROM c JOIN items i1 ON doc_id_a = i1.doc_id OR doc_id_b = i1.doc_id JOIN items i2 ON (CASE WHEN doc_id_a = i1.doc_id THEN doc_id_b ELSE doc_id_a END) = i2.doc_id
        WHERE i1.title ILIKE '%red%' ORDER BY co_watch_score DESC, seed_doc_id, similar_doc_id LIMIT 15""",
    ),
    "q05_term_popularity": (
        lambda d: Q.term_popularity(d.recommendations, d.users, AS_OF),
        f"""SELECT profile_type, trim(genre) AS genre, count(DISTINCT user_id) AS users_searched, count(rec_id) AS total_recommendations, (2 * sum(CAST(round(ndcg_at_10 * 1000000) AS BIGINT)) + 100 * count(ndcg_at_10)) // (200 * count(ndcg_at_10)) / 10000 AS avg_ndcg
        FROM (SELECT user_id, rec_id, ndcg_at_10, served_at, unnest(string_split(query, ' ')) AS genre FROM recommendations) r JOIN users USING (user_id)
        WHERE {since('served_at', '30 DAY')} AND ndcg_at_10 IS NOT NULL GROUP BY 1, 2 HAVING count(rec_id) >= 20""",
    ),
    "q06_promotion_audit": (
        lambda d: Q.promotion_audit(d.model_artifacts, d.quality_gates),
        """SELECT a.artifact_id, run_id, flow_name, ndcg_at_10, is_active, created_at, count(gate_id) AS total_gates, count(*) FILTER (passed) AS gates_passed, count(*) FILTER (NOT passed) AS gates_failed,
        coalesce(string_agg(CASE WHEN NOT passed THEN gate_name || '=' || printf('%.4f', round(measured_value, 4)) END, ', ' ORDER BY gate_name || '='), '') AS failed_gates
        FROM model_artifacts a LEFT JOIN quality_gates g ON a.artifact_id = g.artifact_id WHERE artifact_type = 'ltr' GROUP BY ALL ORDER BY created_at DESC LIMIT 20""",
    ),
    "q07_ipw_by_position": (
        lambda d: Q.ipw_by_position(d.watch_events, AS_OF),
        f"""WITH e AS (SELECT *, CASE WHEN event_type = 'watch_complete' THEN watch_pct / nullif(propensity, 0) ELSE 0 END AS r FROM watch_events
        WHERE propensity BETWEEN 0.05 AND 0.95 AND {since('occurred_at', '30 DAY')})
        SELECT position, count(*) AS n_impressions, round(avg(watch_pct), 3) AS naive_completion, round(avg(r), 4) AS ipw_estimated_reward, round(stddev_samp(r), 4) AS reward_std,
        round(avg(propensity), 4) AS avg_propensity FROM e GROUP BY position HAVING count(*) >= 50""",
    ),
    "q08_latency_slo": (
        lambda d: Q.latency_slo(d.recommendations, AS_OF, "72 HOURS"),
        f"""SELECT date_trunc('hour', served_at) AS hour_bucket, method, count(*) AS requests, round(avg(latency_ms), 1) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 1) AS p50_ms,
        round(quantile_cont(latency_ms, 0.95), 1) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 1) AS p99_ms, CASE WHEN quantile_cont(latency_ms, 0.99) > 200 THEN 'SLO_BREACH' ELSE 'OK' END AS slo_status,
        round(100.0 * count(*) FILTER (cache_hit) / count(*), 2) AS cache_hit_pct FROM recommendations WHERE {since('served_at', '72 HOUR')} GROUP BY 1, 2""",
    ),
    "q09_cold_start_users": (
        lambda d: Q.cold_start_users(d.users, d.watch_events, d.items, AS_OF),
        f"""SELECT u.user_id, profile_type, language, interaction_count, cold_start, coalesce(g, 0) AS genres_explored_7d, coalesce(w, 0) AS watch_count_7d,
        CASE WHEN interaction_count < 5 THEN 'epsilon_0.40' WHEN interaction_count < 20 THEN 'epsilon_0.25' ELSE 'epsilon_0.15' END AS recommended_epsilon
        FROM users u LEFT JOIN (SELECT e.user_id, count(DISTINCT genres) AS g, count(*) FILTER (event_type = 'watch_complete') AS w FROM watch_events e JOIN items USING (doc_id)
        WHERE {since('occurred_at', '7 DAY')} GROUP BY 1) r ON u.user_id = r.user_id WHERE cold_start OR interaction_count < 20 ORDER BY interaction_count, u.user_id LIMIT 100""",
    ),
    "q10_explanation_cost": (
        lambda d: Q.explanation_cost(d.explanations, AS_OF),
        f"""SELECT date_trunc('day', created_at) AS day, model, exp_type, language, count(*) AS explanations_generated, CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
        round(sum(tokens_used) * 0.0008 / 1000, 4) AS estimated_cost_usd, round(avg(latency_ms), 1) AS avg_latency_ms,
        round(sum(sum(tokens_used)) OVER (ORDER BY date_trunc('day', created_at)) * 0.0008 / 1000, 4) AS cumulative_cost_usd
        FROM explanations WHERE {since('created_at', '30 DAY')} GROUP BY 1, 2, 3, 4""",
    ),
    "q11_unit_cost": (
        lambda d: Q.unit_cost(d.recommendations),
        """SELECT method, count(*) AS n_queries, round(avg(latency_ms) / 3600000 * 0.5, 9) AS usd_per_query, round(avg(latency_ms) / 3600000 * 0.5 * count(*) / count(DISTINCT CAST(served_at AS DATE)), 6) AS usd_per_day,
        round(avg(latency_ms) / 3600000 * 0.5 * count(*) / count(DISTINCT user_id), 6) AS usd_per_user FROM recommendations GROUP BY method""",
    ),
}
