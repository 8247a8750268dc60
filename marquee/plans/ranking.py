"""Ranking features, re-ranking, ads, models."""

from pyspark.sql import functions as F

from marquee.operators import ranking as L
from marquee.operators.people import bandit_state
from marquee.plans.quality import HEAD, ITEMS, items, rounded
from marquee.plans.retrieval import BM25, bm25
from marquee.sources.working import written

MIX = {"en": 0.3, "th": 0.5, "er": 0.8}


def cands(d):
    return bm25(d).select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.lit(0.25).alias("dense_score"), (F.col("score") / 2).alias("hybrid_score"))


def tok(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct({a} || {b}))::DOUBLE ELSE 0 END"


FEATURES = ["bm25_score", "query_len", "doc_len", "title_overlap", "text_overlap", "title_jaccard", "text_jaccard"]


def requests(d):
    return d.watch_events.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 3).alias("key"))


def ads(d):
    return d.creatives.withColumn("key", F.col("creative_id") % 3)


def shows(d):
    return d.watch_events.select("user_id", (F.col("doc_id") % 5).alias("advertiser_id"), F.col("occurred_at").alias("ts"), F.col("event_id").alias("show_id"))


def trained(d):
    """The candidates are searched, and their table made, once: training and ranking read it many times."""
    pairs = ["query_id", "doc_id"]
    found = written(cands(d))
    judged = d.qrels.join(found.select(*pairs), pairs, "left_semi")
    table = written(L.ltr_features(found, d.search_queries, d.corpus).join(judged, pairs, "left").fillna(0, ["relevance"]).withColumn("relevance", F.col("relevance").cast("double")))
    return L.rerank_ltr(table, L.train_ranker(table, FEATURES, iters=20, depth=5))


def vectors(d):
    from pyspark.ml.functions import array_to_vector

    return d.embeddings.select(F.col("vec_id").alias("doc_id"), array_to_vector("embedding").alias("features"))


QUALITY = "0.4 * (cpm_bid_usd * click_through_rate * 1000 / 100) + 0.6 * relevance_score"

QUERIES = {
    "l01_ltr_features": (
        lambda d: rounded(L.ltr_features(cands(d), d.search_queries, d.corpus).select("query_id", "doc_id", "bm25_log1p", "query_len", "query_unique", "doc_len", "doc_unique", "title_len", "title_overlap", "text_overlap", "title_jaccard", "text_jaccard"), "bm25_log1p", "title_jaccard", "text_jaccard"),
        f"""WITH {BM25[1:]}, x AS (SELECT b.query_id, b.doc_id, b.score, {tok('s.text')} AS q, {tok('c.title')} AS t, {tok('c.text')} AS d FROM bm b JOIN search_queries s USING (query_id) JOIN corpus c USING (doc_id)),
        y AS (SELECT *, list_distinct(q) AS qs, list_distinct(t) AS ts, list_distinct(d) AS ds FROM x)
        SELECT query_id, doc_id, round(ln(1 + greatest(score, 0)), 6) AS bm25_log1p, len(q)::DOUBLE AS query_len, len(qs)::DOUBLE AS query_unique, len(d)::DOUBLE AS doc_len, len(ds)::DOUBLE AS doc_unique, len(t)::DOUBLE AS title_len,
        len(list_intersect(qs, ts))::DOUBLE AS title_overlap, len(list_intersect(qs, ds))::DOUBLE AS text_overlap, round({jac('qs', 'ts')}, 6) AS title_jaccard, round({jac('qs', 'ds')}, 6) AS text_jaccard FROM y""",
    ),
    "l03_align_features": (
        lambda d: rounded(L.align_features(cands(d), ["bm25", "dense_score", "missing"], {"bm25": "bm25_score"}), "bm25"),
        f"WITH {BM25[1:]} SELECT query_id, doc_id, round(score, 6) AS bm25, 0.25::DOUBLE AS dense_score, 0.0::DOUBLE AS missing FROM bm",
    ),
    "l13_weak_labels": (
        lambda d: rounded(L.weak_labels(d.search_queries, d.corpus), "score"),
        f"""WITH q AS (SELECT query_id, list_filter(list_distinct({tok('text')}), lambda t: t NOT IN ('the', 'a', 'of', 'and', 'in', 'to')) AS q FROM search_queries), w AS (SELECT doc_id, unnest(list_distinct({tok('text')})) AS w FROM corpus),
        h AS (SELECT query_id, doc_id, count(*) / max(len(q))::DOUBLE AS score FROM (SELECT query_id, q, unnest(q) AS w FROM q) JOIN w USING (w) GROUP BY 1, 2)
        SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM h QUALIFY rank <= 3""",
    ),
    "l14_feedback_qrels": (
        lambda d: L.feedback_qrels(d.watch_events),
        "SELECT user_id, doc_id, CAST(max(CASE event_type WHEN 'watch_complete' THEN 3 WHEN 'watch_start' THEN 2 ELSE 1 END) AS INT) AS relevance FROM watch_events WHERE event_type IN ('watch_complete', 'watch_start', 'click') GROUP BY 1, 2",
    ),
    "l09_confident": (lambda d: L.confident(d.creatives, "relevance_score", 0.5).select("creative_id"), "SELECT creative_id FROM creatives WHERE relevance_score >= 0.5"),
    "x01_mmr_genre": (lambda d: L.mmr_genre(d.ranked_a, items(d)), None),
    "x02_mmr_vector": (lambda d: L.mmr_vector(d.ranked_a, items(d)), None),
    "x04_epsilon_greedy": (lambda d: L.epsilon_greedy(d.ranked_a), None),
    "x07_allocate_ads": (
        lambda d: L.allocate_ads(d.ranked_a, d.ranked_b.where("rank <= 12").select("query_id", F.col("doc_id").alias("creative_id"), "rank")),
        "SELECT query_id, doc_id AS creative_id, 1 + (rank - 1) * 4 AS slot FROM ranked_b JOIN (SELECT query_id, count(*) AS n FROM ranked_a GROUP BY 1) USING (query_id) WHERE rank <= 12 AND rank <= floor(n * 0.2) AND 1 + (rank - 1) * 4 < n",
    ),
    "x08_rank_ads": (
        lambda d: L.rank_ads_by_key(requests(d), ads(d)).select("request_id", "creative_id", "rank"),
        """SELECT request_id, creative_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(0.6 * relevance_score + 0.4 * least(cpm_bid_usd / 10.0::DOUBLE, 1), 9) DESC, creative_id) AS INT) AS rank
        FROM (SELECT event_id AS request_id, user_id % 3 AS key FROM watch_events WHERE event_type = 'click') JOIN (SELECT *, creative_id % 3 AS key FROM creatives) USING (key) QUALIFY rank <= 3""",
    ),
    "x09_frequency_cap": (
        lambda d: L.frequency_cap(shows(d), 2).select("show_id", "seen", "allowed"),
        """SELECT event_id AS show_id, count(*) OVER w AS seen, count(*) OVER w < 2 AS allowed FROM watch_events
        WINDOW w AS (PARTITION BY user_id, doc_id % 5 ORDER BY epoch_us(occurred_at) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)""",
    ),
    "x10_auction": (
        lambda d: L.auction(requests(d), ads(d)),
        f"""WITH b AS (SELECT request_id, creative_id, advertiser_id, cpm_bid_usd, round({QUALITY}, 9) AS q FROM (SELECT event_id AS request_id, user_id % 3 AS key FROM watch_events WHERE event_type = 'click') JOIN (SELECT *, creative_id % 3 AS key FROM creatives WHERE relevance_score >= 0.1) USING (key)),
        r AS (SELECT *, row_number() OVER w AS p, lead(cpm_bid_usd) OVER w AS s FROM b WINDOW w AS (PARTITION BY request_id ORDER BY q DESC, creative_id))
        SELECT request_id, creative_id, advertiser_id, round(q, 6) AS quality, round(greatest(1, coalesce(s + 0.01, 0.8 * cpm_bid_usd))::DOUBLE, 4) AS price_cpm, round(greatest(1, coalesce(s + 0.01, 0.8 * cpm_bid_usd))::DOUBLE / 1000, 6) AS price FROM r WHERE p = 1""",
    ),
    "x12_mixed_row": (
        lambda d: L.mixed_row(d.content_metadata.select("doc_id", "content_type", (F.col("doc_id") * 37 % 101).alias("score")), {"film": 4, "series": 3, "live": 1}).select("doc_id", "content_type", "place"),
        "SELECT doc_id, content_type, CAST(row_number() OVER (PARTITION BY content_type ORDER BY doc_id * 37 % 101 DESC, doc_id) AS INT) AS place FROM content_metadata QUALIFY place <= CASE content_type WHEN 'film' THEN 4 WHEN 'series' THEN 3 WHEN 'live' THEN 1 ELSE 0 END",
    ),
    "x13_intent_rerank": (
        lambda d: L.intent_rerank(bm25(d), d.corpus, MIX).select("query_id", "doc_id", "score"),
        f"""WITH {BM25[1:]} SELECT query_id, doc_id, round(score + ({' + '.join(f"CASE WHEN contains(lower(text || title), '{k}') THEN {v} ELSE 0 END" for k, v in MIX.items())})::DOUBLE * 0.15 / 3, 4) AS score FROM bm JOIN corpus USING (doc_id)""",
    ),
    "x14_thompson": (lambda d: L.thompson(d.ranked_a, bandit_state(d.watch_events)), None),
    "x16_serendipity": (lambda d: L.serendipity(d.ranked_a, items(d)), f"WITH {HEAD}, g AS (SELECT query_id, unnest(genres) AS g FROM h), n AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1) SELECT query_id, n, genres, round(genres / n::DOUBLE, 6) AS serendipity FROM n JOIN (SELECT query_id, count(DISTINCT g) AS genres FROM g GROUP BY 1) USING (query_id)"),
    "x20_format_score": (
        lambda d: L.format_score(d.content_metadata.select("doc_id", "content_type", (F.col("doc_id") % 100 / 100.0).alias("ltr_score"), (F.col("doc_id") % 7 / 7.0).alias("completion"), F.lit(None).cast("double").alias("return"), (F.col("doc_id") % 3 / 3.0).alias("social"))),
        f"""WITH m AS (SELECT doc_id, doc_id % 100 / 100.0::DOUBLE AS s, {' + '.join(f"CASE content_type {' '.join(f'''WHEN '{n}' THEN {w[i]}''' for n, w in L.FORMATS.items())} END::DOUBLE * {e}" for i, e in enumerate(('(doc_id % 7 / 7.0::DOUBLE)', '0.5', '(doc_id % 3 / 3.0::DOUBLE)')))} AS e FROM content_metadata)
        SELECT doc_id, round(e, 6) AS engagement, round(0.7 * s + 0.3 * e, 4) AS format_score FROM m""",
    ),
    "l05_train_and_rerank": (trained, None),
    "l07_calibrate_platt": (lambda d: L.calibrate_platt(d.impression_log.select("event_id", "score", F.col("watched").cast("double").alias("y")), "score", "y"), None),
    "l08_calibrate_isotonic": (lambda d: L.calibrate_isotonic(d.impression_log.select("event_id", "score", F.col("watched").cast("double").alias("y")), "score", "y"), None),
    "l15_als_factors": (lambda d: L.als_factors(d.ratings, rank=64, iters=30).itemFactors, None),
    "l18_tfidf": (lambda d: L.tfidf(d.corpus.select("doc_id", "text"))[0].select("doc_id", F.size(__import__("pyspark.ml.functions", fromlist=["x"]).vector_to_array("tfidf")).alias("n")), None),
    "l20_cluster": (lambda d: L.cluster(vectors(d), [3, 4, 5, 6, 7, 8])[0], None),
}
