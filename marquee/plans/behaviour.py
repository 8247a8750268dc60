"""Behavioural feature jobs."""

from marquee.operators import features as B
from marquee.plans.fixtures import AS_OF

YEAR = "CAST(nullif(regexp_extract(title, '\\((\\d{4})\\)', 1), '') AS INT)"
COWATCH = """
pairs AS (
  SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS co_watch_count, avg(a.rating + b.rating) AS avg_rating_sum
  FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 5
)"""
USER_COLUMNS = ["n_ratings", "avg_rating", "std_rating", "high_ratio", "diversity"]


def flagship(d):
    """Most co-watched pairs with the popularity of both items."""
    f = B.item_features(d.ratings, d.items).select("doc_id", "popularity")
    pairs = B.cowatch_pairs(d.ratings)
    for side in ("a", "b"):
        pairs = pairs.join(f.select(f.doc_id.alias(f"doc_id_{side}"), f.popularity.alias(f"popularity_{side}")), f"doc_id_{side}")
    return pairs


QUERIES = {
    "b00_flagship_cowatch_popularity": (
        flagship,
        f"WITH {COWATCH}, f AS (SELECT doc_id, ln(1 + count(*)) AS popularity FROM ratings GROUP BY doc_id) "
        "SELECT p.*, x.popularity AS popularity_a, y.popularity AS popularity_b FROM pairs p JOIN f x ON doc_id_a = x.doc_id JOIN f y ON doc_id_b = y.doc_id",
    ),
    "b01_user_features": (
        lambda d: B.user_features(d.ratings),
        """SELECT user_id, count(*) AS n_ratings, avg(rating) AS avg_rating, stddev_samp(rating) AS std_rating, min(rating) AS min_rating, max(rating) AS max_rating,
        count(DISTINCT doc_id) AS n_titles, count(*) FILTER (rating >= 4) / (count(*) + 1e-9) AS high_ratio, count(*) FILTER (rating <= 2) / (count(*) + 1e-9) AS low_ratio,
        ln(1 + count(DISTINCT doc_id)) AS diversity, max(rated_at) AS last_active FROM ratings GROUP BY user_id""",
    ),
    "b02_item_features": (
        lambda d: B.item_features(d.ratings, d.items),
        f"""SELECT s.*, title, genres, ln(1 + n_ratings) AS popularity, {YEAR} AS year,
        CASE WHEN {YEAR} >= 2010 THEN 1.0::DOUBLE WHEN {YEAR} >= 2000 THEN 0.7 WHEN {YEAR} >= 1990 THEN 0.4 ELSE 0.2 END AS recency
        FROM (SELECT doc_id, count(*) AS n_ratings, avg(rating) AS sentiment, stddev_samp(rating) AS controversy, count(DISTINCT user_id) AS n_users FROM ratings GROUP BY doc_id) s
        LEFT JOIN items USING (doc_id)""",
    ),
    "b03_cowatch_pairs": (lambda d: B.cowatch_pairs(d.ratings), f"WITH {COWATCH} SELECT * FROM pairs"),
    "b04_cowatch_scores": (
        lambda d: B.cowatch_scores(B.cowatch_pairs(d.ratings), d.ratings),
        f"""WITH {COWATCH}, n AS (SELECT doc_id, count(*) AS n FROM ratings GROUP BY doc_id)
        SELECT p.*, co_watch_count / sqrt(x.n * y.n) AS co_watch_score FROM pairs p JOIN n x ON doc_id_a = x.doc_id JOIN n y ON doc_id_b = y.doc_id""",
    ),
    "b05_genre_stats": (
        lambda d: B.genre_stats(d.ratings, d.items),
        """WITH g AS (SELECT doc_id, unnest(string_split(genres, '|')) AS genre FROM items), s AS (
        SELECT genre, count(*) AS n_ratings, avg(rating) AS avg_rating, count(DISTINCT user_id) AS n_users, count(DISTINCT doc_id) AS n_items FROM ratings JOIN g USING (doc_id) GROUP BY genre)
        SELECT *, CAST(rank() OVER (ORDER BY n_ratings DESC) AS INT) AS popularity_rank FROM s""",
    ),
    "b07_rating_baselines": (
        lambda d: B.rating_baselines(d.ratings),
        """WITH a AS (SELECT rating, avg(rating) OVER () AS mu, avg(rating) OVER (PARTITION BY user_id) AS u, avg(rating) OVER (PARTITION BY doc_id) AS i FROM ratings)
        SELECT 'global_mean' AS model, sqrt(avg((rating - mu) ** 2)) AS rmse FROM a UNION ALL SELECT 'user_mean', sqrt(avg((rating - u) ** 2)) FROM a
        UNION ALL SELECT 'item_mean', sqrt(avg((rating - i) ** 2)) FROM a UNION ALL SELECT 'bias', sqrt(avg((rating - greatest(0.5, least(5, u + i - mu))) ** 2)) FROM a""",
    ),
    "b08_metadata_sparsity": (
        lambda d: B.metadata_sparsity(d.items),
        """SELECT era, count(*) AS n_items, avg(n) AS avg_tags, count(*) FILTER (n < 3) AS n_sparse FROM (
        SELECT CASE WHEN year >= 2010 THEN 'post' ELSE 'pre' END AS era, len(list_filter(string_split(tags, ','), lambda t: trim(t) <> '')) AS n FROM items) GROUP BY era""",
    ),
    "s08_export_user_features": (
        lambda d: B.export_features(B.user_features(d.ratings), "user_id", USER_COLUMNS),
        """SELECT 'user_id:' || user_id AS key, round(count(*)::DOUBLE, 4) AS n_ratings, round(avg(rating), 4) AS avg_rating, round(coalesce(stddev_samp(rating), 0), 4) AS std_rating,
        round(count(*) FILTER (rating >= 4) / (count(*) + 1e-9), 4) AS high_ratio, round(ln(1 + count(DISTINCT doc_id)), 4) AS diversity FROM ratings GROUP BY user_id""",
    ),
    "s09_lookup_features": (
        lambda d: B.lookup_features(d.users.select("user_id"), B.user_features(d.ratings.where("rating >= 4.5")), "user_id", {"n_ratings": 0, "avg_rating": 3.5, "high_ratio": 0.5}),
        """SELECT user_id, coalesce(n::DOUBLE, 0) AS n_ratings, coalesce(a, 3.5) AS avg_rating, coalesce(h, 0.5) AS high_ratio FROM users LEFT JOIN (
        SELECT user_id, count(*) AS n, avg(rating) AS a, count(*) / (count(*) + 1e-9) AS h FROM ratings WHERE rating >= 4.5 GROUP BY user_id) USING (user_id)""",
    ),
    "s10_drop_expired": (
        lambda d: B.drop_expired(d.events, "ts", 168, AS_OF).select("event_id", "user_id"),
        f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR",
    ),
}
