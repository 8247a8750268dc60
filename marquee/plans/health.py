"""Gates, drift, promotion, freshness and reports on operations."""

from pyspark.sql import functions as F

from marquee.operators import health as V
from marquee.plans.fixtures import AS_OF
from marquee.plans.quality import rounded


def age(column: str) -> str:
    return f"((epoch(TIMESTAMP '{AS_OF}') - epoch({column})) / 86400.0::DOUBLE)"


def by_method(d):
    return d.recommendations.groupBy("method").agg(F.avg("ndcg_at_10").alias("ndcg"), F.percentile("latency_ms", 0.99).alias("p99"))


def metrics(d):
    r = d.recommendations.agg(F.avg("ndcg_at_10").alias("ndcg"), F.avg("latency_ms").alias("latency"), F.avg(F.col("cache_hit").cast("int")).alias("hit_rate"))
    return r.unpivot([], r.columns, "metric", "value")


GATES = [("ndcg", ">=", 0.4), ("latency", "<=", 40.0), ("hit_rate", ">", 0.3), ("recall", ">=", 0.5)]
METRICS = "m AS (SELECT 'ndcg' AS metric, avg(ndcg_at_10) AS value FROM recommendations UNION ALL SELECT 'latency', avg(latency_ms) FROM recommendations UNION ALL SELECT 'hit_rate', avg(cache_hit::INT) FROM recommendations)"
GATE_ROWS = ", ".join(map(str, GATES))
REF = "ref AS (SELECT method, avg(ndcg_at_10) AS ndcg FROM recommendations WHERE rec_id % 3 = 0 GROUP BY 1)"


def reference(d):
    return d.recommendations.where("rec_id % 3 = 0").groupBy("method").agg(F.avg("ndcg_at_10").alias("ndcg"))


QUERIES = {
    "v01_run_gates": (
        lambda d: V.run_gates(metrics(d), d.spark.createDataFrame(GATES, "metric string, op string, threshold double")).select("metric", F.round("value", 6).alias("value"), "passed", "all_pass"),
        f"""WITH {METRICS}, g AS (SELECT * FROM (VALUES {GATE_ROWS}) t(metric, op, threshold)), c AS (SELECT g.metric, value, coalesce(CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold ELSE value < threshold END, false) AS passed FROM g LEFT JOIN m ON g.metric = m.metric)
        SELECT metric, round(value, 6) AS value, passed, bool_and(passed) OVER () AS all_pass FROM c""",
    ),
    "v02_regression_gate": (
        lambda d: rounded(V.regression_gate(by_method(d).select("method", F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value")), reference(d).select(F.upper("method").alias("method"), F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value"))), "value", "reference", "drop_pct"),
        f"WITH {REF}, c AS (SELECT method, avg(ndcg_at_10) AS v FROM recommendations GROUP BY 1) SELECT method, 'ndcg' AS metric, round(v, 6) AS value, round(ndcg, 6) AS reference, round(100 * (ndcg - v) / ndcg, 6) AS drop_pct, v >= 0 AND 100 * (ndcg - v) / ndcg <= 5 AS passed FROM c JOIN ref USING (method)",
    ),
    "v03_validate": (
        lambda d: V.validate(d.corpus, "doc_id", ["doc_id", "title", "text"], text="text", min_length=50),
        """SELECT 'missing_doc_id' AS "check", count(*) FILTER (doc_id IS NULL) AS n_failed FROM corpus UNION ALL SELECT 'missing_title', count(*) FILTER (title IS NULL) FROM corpus UNION ALL SELECT 'missing_text', count(*) FILTER (text IS NULL) FROM corpus
        UNION ALL SELECT 'short_text', count(*) FILTER (length(text) < 50) FROM corpus UNION ALL SELECT 'duplicate_doc_id', count(*) FROM (SELECT doc_id FROM corpus GROUP BY 1 HAVING count(*) > 1)""",
    ),
    "v03_orphans": (lambda d: V.orphans(d.watch_events.select("event_id", "user_id"), d.users, "user_id"), "SELECT user_id, event_id FROM watch_events WHERE user_id NOT IN (SELECT user_id FROM users)"),
    "v04_drift": (
        lambda d: V.drift(by_method(d), reference(d), 0.001, 98.0),
        f"""WITH {REF}, l AS (SELECT method, avg(ndcg_at_10) AS n, quantile_cont(latency_ms, 0.99) AS p FROM recommendations GROUP BY 1)
        SELECT method, concat_ws(',', CASE WHEN ndcg - n >= 0.001 THEN 'ndcg_drop' END, CASE WHEN p > 98 THEN 'latency' END) AS reasons, ndcg - n >= 0.001 OR p > 98 AS retrain FROM l JOIN ref USING (method)""",
    ),
    "v05_diagnose": (
        lambda d: V.diagnose(d.recommendations.groupBy(F.col("method").alias("key")).agg(F.avg("latency_ms").alias("latency_ms"), F.lit(0.1).alias("psi"), F.stddev_samp("ndcg_at_10").alias("drop"))).select("key", "cause", "action"),
        "SELECT method AS key, CASE WHEN avg(latency_ms) > 100 THEN 'infrastructure' WHEN stddev_samp(ndcg_at_10) > 0.05 THEN 'model_decay' ELSE 'healthy' END AS cause, CASE WHEN avg(latency_ms) > 100 THEN 'scale_out' WHEN stddev_samp(ndcg_at_10) > 0.05 THEN 'retrain' ELSE 'none' END AS action FROM recommendations GROUP BY 1",
    ),
    "v06_psi": (
        lambda d: rounded(V.psi(d.events.where("event_id % 2 = 0"), d.events.where("event_id % 2 = 1"), "value", 0.0, 200.0), "psi"),
        """WITH b AS (SELECT event_id % 2 AS s, CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 11 ELSE floor(value / 20)::INT + 1 END AS bin FROM events WHERE value IS NOT NULL),
        c AS (SELECT bin, count(*) FILTER (s = 0) / (SELECT count(*) FROM b WHERE s = 0)::DOUBLE AS p, count(*) FILTER (s = 1) / (SELECT count(*) FROM b WHERE s = 1)::DOUBLE AS q FROM b GROUP BY 1)
        SELECT round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 6) AS psi FROM c""",
    ),
    "v07_promotion": (
        lambda d: rounded(V.promotion(d.shadow_observations, "observed_at", "production_value", "candidate_value", -0.5), "first", "last", "drop", "hours"),
        """WITH o AS (SELECT *, coalesce((candidate_value - production_value) / production_value >= -0.5, false) AS led FROM shadow_observations), f AS (SELECT *, sum((NOT led)::INT) OVER (ORDER BY observed_at DESC) AS f FROM o),
        h AS (SELECT coalesce((max(epoch(observed_at)) - min(epoch(observed_at))) / 3600.0::DOUBLE, 0) AS hours FROM f WHERE f = 0), e AS (SELECT arg_min(production_value, observed_at) AS a, arg_max(production_value, observed_at) AS z FROM o WHERE production_value IS NOT NULL)
        SELECT round(a, 6) AS first, round(z, 6) AS last, round((a - z) / a, 6) AS drop, round(hours, 6) AS hours, CASE WHEN (a - z) / a > 0.05 THEN 'rollback' WHEN hours >= 48 THEN 'promote' ELSE 'hold' END AS action FROM e, h""",
    ),
    "v08_roi_gate": (
        lambda d: rounded(V.roi_gate(d.recommendations.groupBy(F.col("method").alias("key")).agg((F.avg("ndcg_at_10") / 10).alias("lift"))), "lift", "gain", "roi"),
        "SELECT method AS key, round(avg(ndcg_at_10) / 10, 6) AS lift, round(avg(ndcg_at_10) * 100, 6) AS gain, round((avg(ndcg_at_10) * 100 - 10) / 10, 6) AS roi, avg(ndcg_at_10) * 100 > 10 AS passed FROM recommendations GROUP BY 1",
    ),
    "v09_launch_health": (
        lambda d: V.launch_health(d.watch_events, d.content_metadata, AS_OF),
        f"""WITH s AS (SELECT doc_id, count(*) FILTER (event_type = 'impression') AS i, count(*) FILTER (event_type = 'click') AS c FROM watch_events GROUP BY 1)
        SELECT doc_id, i AS impressions, c AS clicks, round(c / nullif(i, 0)::DOUBLE, 6) AS ctr, CASE WHEN i = 0 THEN 'no_data' WHEN c / i::DOUBLE >= CASE WHEN {age('release_ts')} <= 1 THEN 0.02 ELSE 0.05 END THEN 'healthy' ELSE 'weak' END AS health FROM s JOIN content_metadata USING (doc_id)""",
    ),
    "v11_pacing": (
        lambda d: V.pacing(d.creatives.groupBy("advertiser_id").agg(F.sum("cpm_bid_usd").cast("double").alias("spent")), d.nation.select(F.col("n_nationkey").alias("advertiser_id"), F.lit(20.0).alias("daily_budget")), F.lit(0.5)),
        """WITH s AS (SELECT advertiser_id, sum(cpm_bid_usd)::DOUBLE AS s FROM creatives GROUP BY 1) SELECT n_nationkey AS advertiser_id, coalesce(s, 0) AS spent, 20 - coalesce(s, 0) AS remaining,
        CASE WHEN coalesce(s, 0) / 10 > 1.5 THEN 'overspending' WHEN coalesce(s, 0) / 10 < 0.5 THEN 'underspending' ELSE 'on_track' END AS status FROM nation LEFT JOIN s ON n_nationkey = advertiser_id""",
    ),
    "v12_alerts": (
        lambda d: rounded(V.alerts(d.shadow_observations, "observed_at", "production_value", 1, 0.05).select("observed_at", "production_value", "before"), "production_value", "before"),
        "SELECT observed_at, round(production_value, 6) AS production_value, round(b, 6) AS before FROM (SELECT *, lag(production_value) OVER (ORDER BY observed_at) AS b FROM shadow_observations) WHERE (b - production_value) / b > 0.05",
    ),
    "w11_held_drop": (
        lambda d: rounded(V.held_drop(d.events.select("event_type", F.date_trunc("minute", "ts").alias("observed_at"), "value"), "event_type", "observed_at", "value"), "value", "before").withColumn("observed_at", F.col("observed_at").cast("string")),
        """WITH s AS (SELECT event_type, date_trunc('minute', ts) AS m, avg(value) AS v FROM events GROUP BY 1, 2),
        b AS (SELECT *, last_value(v) OVER (PARTITION BY event_type ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS before FROM s),
        f AS (SELECT *, coalesce((before - v) / before > 0.05, false) AS low FROM b), g AS (SELECT *, count(*) FILTER (NOT low) OVER (PARTITION BY event_type ORDER BY m) AS run FROM f)
        SELECT event_type, strftime(m, '%Y-%m-%d %H:%M:%S') AS observed_at, round(v, 6) AS value, round(before, 6) AS before, m - min(m) OVER (PARTITION BY event_type, run) >= INTERVAL 5 MINUTE AS firing FROM g WHERE low""",
    ),
    "v13_service_metrics": (
        lambda d: V.service_metrics(d.recommendations, "served_at", "method"),
        "SELECT date_trunc('hour', served_at) AS window_start, method, count(*) AS requests, count(*) FILTER (cache_hit) AS hits, round(avg(latency_ms), 6) AS latency_ms FROM recommendations GROUP BY 1, 2",
    ),
    "v14_retention": (lambda d: V.retention(d.model_artifacts, "created_at", AS_OF, 10).select("artifact_id", "run_id"), f"SELECT artifact_id, run_id FROM model_artifacts WHERE {age('created_at')} > 10 AND NOT is_active"),
    "v16_feature_status": (
        lambda d: V.feature_status(d.content_metadata.select("doc_id", "market", "rights_expiry_ts"), "doc_id"),
        "SELECT count(*) AS n_entities, count(DISTINCT doc_id) AS n_keys, count(*) FILTER (market IS NULL) AS null_market, count(*) FILTER (rights_expiry_ts IS NULL) AS null_rights_expiry_ts FROM content_metadata",
    ),
    "v17_check_citations": (
        lambda d: V.check_citations(d.conversations.select(F.col("conv_id").alias("id"), F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("]")).alias("answer"), F.lit(2).alias("n_sources"))),
        "SELECT conv_id AS id, CAST(len(regexp_extract_all(text || ' [' || turn || ']', '\\[(\\d+)\\]', 1)) AS INT) AS n_citations, CASE WHEN regexp_matches(lower(text), 'i don''t know|not enough information') THEN 'abstained' WHEN len(list_filter(regexp_extract_all(text || ' [' || turn || ']', '\\[(\\d+)\\]', 1), lambda n: n::INT < 1 OR n::INT > 2)) > 0 THEN 'out_of_range' ELSE 'ok' END AS verdict FROM conversations",
    ),
    "x17_freshness": (
        lambda d: V.freshness(d.content_metadata, AS_OF),
        f"""WITH m AS (SELECT *, live_start_ts IS NOT NULL AND live_end_ts IS NOT NULL AS live, coalesce({age('live_start_ts')} >= 0 AND {age('live_end_ts')} <= 0, false) AS air, {age('release_ts')} AS a, -{age('rights_expiry_ts')} AS l FROM content_metadata)
        SELECT doc_id, CASE WHEN l > 0 AND l <= 14 THEN 'expiring' WHEN air THEN 'live' WHEN NOT live AND a * 24 <= 72 THEN 'launching' WHEN NOT live AND a <= 30 THEN 'recent' ELSE 'catalog' END AS state,
        round(CASE WHEN air THEN 1.0 WHEN live OR a IS NULL THEN 0.1 WHEN a * 24 <= 72 THEN 1 - a * 24 / 72 * 0.2 WHEN a <= 30 THEN pow(0.5, a / 14) * 0.8 ELSE greatest(0.05, pow(0.5, a / 14)) END::DOUBLE, 4) AS freshness,
        CASE WHEN air THEN 5.0 ELSE 1.0 END::DOUBLE AS live_boost, round(CASE WHEN l > 0 AND l <= 14 THEN 1 + (1 - l / 14) * 0.5 ELSE 1 END::DOUBLE, 6) AS urgency_boost FROM m""",
    ),
    "p06_filter_available": (
        lambda d: V.filter_available(d.items.select("doc_id"), d.content_metadata, AS_OF),
        f"""SELECT doc_id FROM items LEFT JOIN content_metadata m USING (doc_id) WHERE m.doc_id IS NULL OR ((market IS NULL OR market = 'US') AND CASE maturity_rating WHEN 'G' THEN 0 WHEN 'PG' THEN 1 WHEN 'PG-13' THEN 2 WHEN 'R' THEN 3 ELSE 4 END <= 2
        AND (rights_expiry_ts IS NULL OR {age('rights_expiry_ts')} <= 0))""",
    ),
    "v18_promotion_decision": (
        lambda d: d.quality_gates.select("gate_id", V.promotion_decision(F.col("passed"), F.col("measured_value") > 0.5, F.col("gate_id") % 2 == 0, F.col("measured_value") < 0).alias("decision")),
        "SELECT gate_id, CASE WHEN measured_value < 0 THEN 'rollback' WHEN passed AND measured_value > 0.5 AND gate_id % 2 = 0 THEN 'promote' WHEN passed AND measured_value > 0.5 THEN 'await_approval' ELSE 'hold' END AS decision FROM quality_gates",
    ),
}
