"""User state, satisfaction, bandits."""

from pyspark.sql import functions as F

from marquee.operators import people as H
from marquee.operators.features import explode_genres
from marquee.plans.fixtures import AS_OF
from marquee.plans.quality import rounded

AGE = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400.0::DOUBLE"
GENRES = "genres AS (SELECT doc_id, unnest(string_split(genres, '|')) AS genre FROM items)"
WEIGHTED = f"""
neg AS (SELECT user_id, doc_id, arg_max(skipped OR watch_pct < 0.1 OR coalesce(explicit_rating <= 2, false), (ts, event_id)) AS negative FROM interactions GROUP BY 1, 2),
wt AS (SELECT i.*, negative, pow(0.5, {AGE} / 14) AS decay, CASE WHEN negative THEN -2 WHEN skipped OR watch_pct < 0.1 THEN -0.5 WHEN watch_pct > 0.8 THEN 1.5 WHEN watch_pct > 0.5 THEN 1.0 ELSE 0.6 END::DOUBLE * pow(0.5, {AGE} / 14) AS w
  FROM interactions i JOIN neg USING (user_id, doc_id)),
{GENRES},
aff AS (SELECT user_id, genre, sum(w) AS affinity FROM wt JOIN genres USING (doc_id) GROUP BY 1, 2)"""
SIGNAL = "CASE event_type WHEN 'watch_complete' THEN 'completed' WHEN 'watch_start' THEN 'skip_intro' WHEN 'click' THEN 'shared' WHEN 'skip' THEN 'abandoned_10' ELSE 'rewatch' END"
VALUE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in H.SIGNALS.items())
DECAY30 = f"pow(0.5, (epoch(TIMESTAMP '{AS_OF}') - epoch(occurred_at)) / 86400.0::DOUBLE / 30)"
SATISFIED = f"sat AS (SELECT user_id, doc_id, {SIGNAL} AS signal, (CASE {SIGNAL} {VALUE} END)::DOUBLE * {DECAY30} AS s FROM watch_events)"
BANDIT = """bandit AS (SELECT user_id, doc_id, 1 + sum(CASE WHEN event_type = 'watch_complete' OR p > 0.8 THEN 2 WHEN event_type = 'click' OR p > 0.3 THEN 1 ELSE 0 END::DOUBLE) AS alpha,
1 + sum(CASE WHEN event_type IN ('watch_complete', 'click') OR p > 0.3 THEN 0 WHEN event_type = 'skip' OR p < 0.1 THEN 1 WHEN event_type = 'impression' THEN 0.2 ELSE 0 END::DOUBLE) AS beta
FROM (SELECT *, coalesce(watch_pct, 0) AS p FROM watch_events) GROUP BY 1, 2)"""


def signals(d):
    return d.watch_events.selectExpr("user_id", "doc_id", f"{SIGNAL} AS signal", "occurred_at AS ts")


def candidates(d):
    return d.watch_events.selectExpr("user_id", "(doc_id + 1) % 100 AS doc_id").distinct()


def genres(d):
    return explode_genres(d.items)


QUERIES = {
    "h04_user_state": (
        lambda d: H.user_state(d.interactions, genres(d), AS_OF),
        f"""WITH {WEIGHTED[1:]}, top AS (SELECT user_id, string_agg(genre, ',' ORDER BY r) AS dominant_genres FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY round(affinity, 9) DESC, genre) AS r FROM aff) WHERE r <= 3 GROUP BY 1)
        SELECT user_id, count(*) AS interaction_count, count(DISTINCT doc_id) FILTER (negative) AS n_negative, any_value(dominant_genres) AS dominant_genres, round(least(1, greatest(0.1, ln(1 + count(*)) / ln(51))), 3) AS confidence, count(*) < 5 AS cold_start
        FROM wt LEFT JOIN top USING (user_id) GROUP BY user_id""",
    ),
    "h04_genre_affinity": (
        lambda d: rounded(H.genre_affinity(H.weighted_interactions(d.interactions, AS_OF), genres(d)), "affinity"),
        f"WITH {WEIGHTED[1:]} SELECT user_id, genre, round(affinity, 6) AS affinity FROM aff",
    ),
    "h05_state_score": (
        lambda d: H.state_score(candidates(d), H.weighted_interactions(d.interactions, AS_OF), genres(d)).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("state_score").alias("total")),
        f"""WITH {WEIGHTED[1:]}, cand AS (SELECT DISTINCT user_id, (doc_id + 1) % 100 AS doc_id FROM watch_events),
        fit AS (SELECT user_id, doc_id, sum(affinity) * 0.1 AS fit FROM cand JOIN genres USING (doc_id) JOIN aff USING (user_id, genre) GROUP BY 1, 2),
        seen AS (SELECT DISTINCT user_id, doc_id FROM (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM wt) WHERE r <= 20),
        conf AS (SELECT user_id, least(1, greatest(0.1, ln(1 + count(*)) / ln(51))) AS c FROM wt GROUP BY 1)
        SELECT user_id, count(*) AS n, sum(CASE WHEN (user_id, doc_id) IN (SELECT (user_id, doc_id) FROM wt WHERE negative) THEN -10 ELSE
        (coalesce(fit, 0) - CASE WHEN (user_id, doc_id) IN (SELECT (user_id, doc_id) FROM seen) THEN 2 ELSE 0 END) * c END) AS total FROM cand LEFT JOIN fit USING (user_id, doc_id) LEFT JOIN conf USING (user_id) GROUP BY 1""",
    ),
    "w06_drift_score": (
        lambda d: H.drift_score(d.interactions, genres(d)),
        f"""WITH {GENRES}, p AS (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down, count(*) OVER (PARTITION BY user_id) AS n FROM interactions),
        s AS (SELECT user_id, max(n) AS n, list_distinct(coalesce(list(genre) FILTER (up <= 5), [])) AS e, list_distinct(coalesce(list(genre) FILTER (down <= 5), [])) AS l FROM p JOIN genres USING (doc_id) WHERE up <= 5 OR down <= 5 GROUP BY 1)
        SELECT user_id, CASE WHEN n >= 10 THEN round(1 - len(list_intersect(e, l)) / len(list_distinct(e || l))::DOUBLE, 3) ELSE 0 END AS drift FROM s""",
    ),
    "w08_in_silo": (
        lambda d: H.in_silo(d.interactions, genres(d)),
        f"""WITH {GENRES}, r AS (SELECT user_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM interactions) WHERE r <= 10),
        z AS (SELECT user_id, count(*) AS size FROM r GROUP BY 1) SELECT user_id, max(size) >= 10 AND max(n) >= 0.8 * max(size) AS in_silo FROM (SELECT user_id, genre, count(*) AS n FROM r JOIN genres USING (doc_id) GROUP BY 1, 2) JOIN z USING (user_id) GROUP BY 1""",
    ),
    "h08_satisfaction": (lambda d: H.satisfaction(signals(d), AS_OF), f"WITH {SATISFIED} SELECT user_id, doc_id, round(sum(s), 4) AS satisfaction FROM sat GROUP BY 1, 2"),
    "h08_satisfaction_profile": (
        lambda d: H.satisfaction_profile(signals(d), AS_OF),
        f"""WITH {SATISFIED}, n AS (SELECT user_id, signal, count(*) AS n, sum(s) AS s FROM sat GROUP BY 1, 2)
        SELECT user_id, round(sum(s), 4) AS score, max(signal) FILTER (r = 1) AS dominant_signal, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, signal) AS r FROM n) GROUP BY 1""",
    ),
    "h07_contamination": (
        lambda d: H.contamination(*(d.interactions.where(c).select("user_id", "doc_id").join(genres(d), "doc_id").groupBy("user_id", "genre").agg(F.count("*").cast("double").alias("weight")) for c in ("ts >= '2024-01-24'", "ts < '2024-01-24'"))),
        f"""WITH {GENRES}, c AS (SELECT user_id, genre, count(*) FILTER (ts >= '2024-01-24')::DOUBLE AS a, count(*) FILTER (ts < '2024-01-24')::DOUBLE AS b FROM interactions JOIN genres USING (doc_id) GROUP BY 1, 2),
        s AS (SELECT user_id, a / nullif(sum(a) OVER u, 0) AS p, b / nullif(sum(b) OVER u, 0) AS q FROM c WINDOW u AS (PARTITION BY user_id))
        SELECT user_id, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) / 2), 3) ELSE 0 END AS contamination FROM s GROUP BY 1""",
    ),
    "a13_mean_vector": (
        lambda d: H.mean_vector(d.embeddings, "label").select("label", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", 64), 6).alias("last")),
        """WITH p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM p GROUP BY 1)
        SELECT label, round(max(x / n) FILTER (i = 1), 6) AS first, round(max(x / n) FILTER (i = 64), 6) AS last FROM p JOIN n USING (label) GROUP BY 1""",
    ),
    "x15_bandit_state": (lambda d: rounded(H.bandit_state(d.watch_events), "alpha", "beta"), f"WITH {BANDIT} SELECT user_id, doc_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM bandit"),
    "x15_exploration_rate": (lambda d: rounded(H.exploration_rate(H.bandit_state(d.watch_events)), "exploration_rate"), f"WITH {BANDIT} SELECT user_id, round(least(0.5, 0.5 / (1 + sum(alpha + beta - 2) / 50)), 6) AS exploration_rate FROM bandit GROUP BY 1"),
    "a12_max_label": (
        lambda d: H.max_label(d.watch_events.join(d.items.select("doc_id", F.col("title").alias("query")), "doc_id")),
        "SELECT substr(md5(title), 1, 12) AS query_hash, doc_id, CAST(max(CASE event_type WHEN 'watch_complete' THEN 3 WHEN 'watch_start' THEN 2 ELSE 1 END) AS INT) AS label FROM watch_events JOIN items USING (doc_id) WHERE event_type IN ('watch_complete', 'watch_start', 'click') GROUP BY 1, 2",
    ),
}
