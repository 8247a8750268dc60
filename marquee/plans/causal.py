"""Experiments and causal estimates."""

from pyspark.sql import functions as F

from marquee.operators import causal as C
from marquee.plans.quality import rounded

ARMS = """
s AS (SELECT experiment, count(*) FILTER (arm = 'control') AS n_c, avg(reward) FILTER (arm = 'control') AS mean_c, var_samp(reward) FILTER (arm = 'control') AS var_c,
  count(*) FILTER (arm = 'treatment') AS n_t, avg(reward) FILTER (arm = 'treatment') AS mean_t, var_samp(reward) FILTER (arm = 'treatment') AS var_t FROM ab_observations GROUP BY 1),
w AS (SELECT *, sqrt(var_c / n_c + var_t / n_t) AS se, pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df FROM s)"""
#: The normal distribution's tails by the same five terms as functions.text.normal_cdf.
VERDICTS = f"""WITH {ARMS[1:]}, z AS (SELECT *, (mean_t - mean_c) / se AS t, 1 / (1 + 0.3275911 * abs((mean_t - mean_c) / se) / sqrt(2)) AS k FROM w),
p AS (SELECT *, k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-t * t / 2) AS p FROM z)
SELECT experiment, round(p, 6) AS p, CASE WHEN p < 0.05 THEN CASE WHEN t > 0 THEN 'better' ELSE 'worse' END WHEN abs(mean_t - mean_c) < 2.8 * se THEN 'underpowered' ELSE 'no difference' END AS verdict FROM p"""
UPLIFT = """
u AS (SELECT doc_id, count(*) FILTER (shown) AS n_t, count(*) FILTER (NOT shown) AS n_c, avg(watched::INT) FILTER (shown) AS p_watch_shown, avg(watched::INT) FILTER (NOT shown) AS p_watch_not_shown,
  avg(CASE WHEN shown THEN watched::INT / propensity ELSE -(watched::INT) / (1 - least(propensity, 1 - 1e-6)) END) AS ipw FROM impression_log GROUP BY 1),
v AS (SELECT *, coalesce(n_t + n_c >= 10 AND n_t > 0 AND n_c > 0, false) AS confident, CASE WHEN n_t + n_c >= 10 AND n_t > 0 AND n_c > 0 THEN (p_watch_shown - p_watch_not_shown) * 0.7 + ipw * 0.3 END AS tau FROM u)"""


def scores(d):
    return d.impression_log.groupBy("doc_id").agg(F.avg("score").alias("score"))


QUERIES = {
    "c01_ab_test": (
        lambda d: rounded(C.ab_test(d.ab_observations).select("experiment", "n_c", "n_t", "mean_c", "mean_t", "se", "df", "t", "lift", "ci_low", "ci_high", "mde"), "mean_c", "mean_t", "se", "df", "t", "lift", "ci_low", "ci_high", "mde"),
        f"""WITH {ARMS[1:]} SELECT experiment, n_c, n_t, round(mean_c, 6) AS mean_c, round(mean_t, 6) AS mean_t, round(se, 6) AS se, round(df, 6) AS df, round((mean_t - mean_c) / se, 6) AS t, round((mean_t - mean_c) / mean_c, 6) AS lift,
        round(mean_t - 1.96 * sqrt(var_t / n_t), 6) AS ci_low, round(mean_t + 1.96 * sqrt(var_t / n_t), 6) AS ci_high, round(2.8 * se, 6) AS mde FROM w""",
    ),
    "c01_ab_verdicts": (lambda d: C.ab_test(d.ab_observations).select("experiment", F.round("p", 6).alias("p"), "verdict"), VERDICTS),
    "c02_guarded_ab": (
        lambda d: C.guarded_ab(C.ab_test(d.ab_observations), d.ab_observations.groupBy("experiment").agg(F.avg("reward").alias("latency_ms"), F.lit(0.005).alias("error_rate"))).select("experiment", "latency_ok", "errors_ok", "n_ok", "lift_ok", "ship"),
        f"""WITH {ARMS[1:]}, g AS (SELECT experiment, avg(reward) AS latency_ms FROM ab_observations GROUP BY 1) SELECT experiment, latency_ms <= 300 AS latency_ok, true AS errors_ok, n_c >= 200 AND n_t >= 200 AS n_ok, mean_t > mean_c AS lift_ok,
        latency_ms <= 300 AND n_c >= 200 AND n_t >= 200 AND mean_t > mean_c AS ship FROM w JOIN g USING (experiment)""",
    ),
    "c03_bootstrap_p": (lambda d: C.bootstrap_p(d.shadow_observations.select(F.unix_timestamp(F.col("observed_at").cast("timestamp")).alias("k"), (F.col("candidate_value") - F.col("production_value")).alias("diff")), "k", "diff"), None),
    "c04_bootstrap_ci": (lambda d: C.bootstrap_ci(d.impression_log.where("shown").select("event_id", F.col("watched").cast("double").alias("y")), "event_id", "y"), None),
    "c05_propensity": (
        lambda d: C.propensity(d.impression_log.select("event_id", "user_id", "score", "position"), "user_id").select("event_id", "propensity"),
        f"""SELECT event_id, round(greatest(0.01, least(0.99, p * list_extract({list(C.EXPOSURE)}::DOUBLE[], least(position, 9) + 1))), 6) AS propensity FROM (
        SELECT event_id, position, exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w AS p FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS m FROM impression_log) WINDOW w AS (PARTITION BY user_id))""",
    ),
    "c06_log_stats": (lambda d: rounded(C.log_stats(d.impression_log), "outcome_rate"), "SELECT count(*) AS n_impressions, count(*) FILTER (watched) AS n_watched, round(avg(watched::INT), 6) AS outcome_rate FROM impression_log"),
    "c07_uplift": (
        lambda d: rounded(C.uplift(d.impression_log), "p_watch_shown", "p_watch_not_shown", "ipw", "tau"),
        f"WITH {UPLIFT[1:]} SELECT doc_id, n_t, n_c, round(p_watch_shown, 6) AS p_watch_shown, round(p_watch_not_shown, 6) AS p_watch_not_shown, round(ipw, 6) AS ipw, round(tau, 6) AS tau, confident FROM v",
    ),
    "c08_uplift_prior": (
        lambda d: rounded(C.uplift_prior(d.impression_log), "tau"),
        "SELECT doc_id, round((1 + count(*) FILTER (shown AND watched)) / (5.0::DOUBLE + count(*) FILTER (shown)) - (1 + count(*) FILTER (NOT shown AND watched)) / (5.0::DOUBLE + count(*) FILTER (NOT shown)), 6) AS tau FROM impression_log GROUP BY 1",
    ),
    "c09_ope_snips": (
        lambda d: rounded(C.ope_snips(d.impression_log, scores(d)), "estimate", "variance", "baseline", "lift"),
        """WITH s AS (SELECT doc_id, avg(score) AS score FROM impression_log GROUP BY 1), p AS (SELECT doc_id, exp(score) / (sum(exp(score)) OVER () + 1e-9) AS pi FROM s),
        r AS (SELECT watched::INT::DOUBLE AS y, shown, least(pi / greatest(1e-6, propensity), 10) AS w FROM impression_log JOIN p USING (doc_id)), e AS (SELECT sum(y * w) / sum(w) AS e, avg(y) FILTER (NOT shown) AS b FROM r)
        SELECT count(*) AS n, round(any_value(e), 6) AS estimate, round(sum(pow(y * w - e, 2)) / (count(*) - 1), 6) AS variance, round(any_value(b), 6) AS baseline, round((any_value(e) - any_value(b)) / greatest(1e-9, any_value(b)), 6) AS lift FROM r, e""",
    ),
    "c10_ipw": (lambda d: rounded(C.ipw(d.impression_log), "value"), "SELECT count(*) AS n, round(avg(watched::INT * least(1 / greatest(1e-6, propensity), 10)), 6) AS value FROM impression_log WHERE shown"),
    "c11_compare_policies": (
        lambda d: rounded(C.compare_policies(d.watch_events.withColumn("arm", F.when(F.col("shown"), "a").otherwise("b")), "arm"), "ctr", "completion", "watch_pct", "reward", "lift"),
        """WITH s AS (SELECT CASE WHEN shown THEN 'a' ELSE 'b' END AS policy, count(*) AS n, avg((event_type = 'click')::INT) AS ctr, avg((event_type = 'watch_complete')::INT) AS completion, avg(watch_pct) AS watch_pct FROM watch_events GROUP BY 1),
        r AS (SELECT *, 0.3 * ctr + 0.7 * completion AS reward FROM s) SELECT policy, n, round(ctr, 6) AS ctr, round(completion, 6) AS completion, round(watch_pct, 6) AS watch_pct, round(reward, 6) AS reward,
        round((reward - (SELECT reward FROM r WHERE policy = 'a')) / (SELECT reward FROM r WHERE policy = 'a'), 6) AS lift FROM r""",
    ),
    "c12_enrich_uplift": (
        lambda d: C.enrich_uplift(d.items.select("doc_id"), C.uplift(d.impression_log)),
        f"WITH {UPLIFT[1:]} SELECT doc_id, coalesce(round(tau, 4), 0) AS incrementality_score, coalesce(round(p_watch_shown, 4), 0) AS p_watch_shown, coalesce(round(p_watch_not_shown, 4), 0) AS p_watch_not_shown, coalesce(confident::INT::DOUBLE, 0) AS uplift_confident FROM items LEFT JOIN v USING (doc_id)",
    ),
    "c13_ad_gate": (
        lambda d: rounded(C.ad_gate(d.watch_events.groupBy(F.col("event_type").alias("surface")).agg(F.avg(F.when(F.col("shown"), F.col("ltr_score"))).alias("organic"), F.avg(F.when(~F.col("shown"), F.col("ltr_score"))).alias("with_ads"))), "organic", "with_ads", "drop"),
        """SELECT surface, round(o, 6) AS organic, round(w, 6) AS with_ads, round((o - w) / o, 6) AS drop, coalesce((o - w) / o <= 0.05, false) AS allowed FROM (
        SELECT event_type AS surface, avg(ltr_score) FILTER (shown) AS o, avg(ltr_score) FILTER (NOT shown) AS w FROM watch_events GROUP BY 1)""",
    ),
}
