"""Boosts, moods, live events, ad reports, feature variants and slices of quality."""

from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators import evaluate as M
from marquee.operators import retrieval as R
from marquee.operators import serving as S
from marquee.plans.fixtures import AS_OF
from marquee.plans.quality import ndcg, rounded
from marquee.plans.retrieval import BM25, NORM, TITLE, K, bm25, title, vectors

#: Every user's items with a score.
UR = "ur AS (SELECT user_id, doc_id, max(ltr_score) AS score FROM watch_events GROUP BY 1, 2)"
KW = "kw AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt' ELSE 'gear' END AS k FROM users)"
#: What stands for the moods of genres here, whose names are sizes and brands.
MOODS = {"large": "epic_grand", "small": "light_and_fun", "promo": "comedic", "brand#7": "romantic", "brand#1": "romantic", "economy": "melancholic"}
ASKED = "CASE user_id % 4 WHEN 0 THEN 'An Epic evening' WHEN 1 THEN 'something funny or sad' WHEN 2 THEN 'feel good romantic' ELSE 'anything' END"
MOOD_OF = "CASE lower({}) " + " ".join(f"WHEN '{g}' THEN '{m}'" for g, m in MOODS.items()) + " END"
TAGGED = f"tagged AS (SELECT doc_id, list_distinct(list_filter([{MOOD_OF.format('''split_part(genres, '|', 1)''')}, {MOOD_OF.format('''split_part(genres, '|', 2)''')}], lambda m: m IS NOT NULL)) AS moods FROM items)"
MOOD_SUM = " + ".join(f"CASE WHEN contains(q, '{w}') THEN len(list_intersect(coalesce(moods, []), {m!r})) ELSE 0 END" for w, m in S.QUERY_MOODS.items())
LIVE = "live AS (SELECT doc_id, live_start_ts + INTERVAL 1 HOUR * (doc_id // 10 % 40 - 20) AS start_ts, live_end_ts + INTERVAL 1 HOUR * (doc_id // 10 % 40 - 20) AS end_ts FROM content_metadata WHERE live_start_ts IS NOT NULL)"
STATE = f"""st AS (SELECT *, a - b AS length, CASE WHEN s <= 0 AND a > 0 THEN 'live' WHEN s > 0 AND s <= 86400 THEN 'countdown' WHEN a <= 0 AND a > -21600 THEN 'replay' ELSE 'none' END AS state FROM (
SELECT doc_id, epoch(start_ts) - epoch(TIMESTAMP '{AS_OF}') AS s, epoch(start_ts) - epoch(TIMESTAMP '{AS_OF}') AS b, epoch(end_ts) - epoch(TIMESTAMP '{AS_OF}') AS a FROM live))"""
SHOWS = "shows AS (SELECT event_id AS request_id, doc_id % 25 AS advertiser_id, (1 + doc_id % 9) / 1000::DOUBLE AS price_usd, event_type = 'click' AS clicked FROM watch_events WHERE shown AND position < 4)"
WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
CAND = TITLE[2:]
KEYS = "keyed AS (SELECT doc_id, lower(trim(unnest(string_split(tags, ',')))) AS key, 2 AS relevance FROM items UNION ALL SELECT doc_id, lower(trim(unnest(string_split(genres, '|')))), 1 FROM items)"
REWRITTEN = "rw AS (SELECT query_id * 10 AS query_id, text FROM search_queries UNION ALL SELECT query_id * 10 + 1, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) FROM search_queries)"


def ur(d):
    return d.watch_events.groupBy("user_id", "doc_id").agg(F.max("ltr_score").alias("score"))


def as_queries(d):
    return ur(d).withColumnRenamed("user_id", "query_id")


def keywords(d):
    return d.users.selectExpr("user_id", "array(CASE user_id % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt' ELSE 'gear' END, 'Large') AS keywords")


def boosted(d):
    watched = d.watch_events.where("watch_pct is not null").select("user_id", "doc_id", F.col("occurred_at").alias("ts"), "event_id")
    return S.embedding_boost(ur(d), watched, vectors(d), S.keyword_boost(ur(d), keywords(d), item_texts(d)))


def item_texts(d):
    return d.items.select("doc_id", "title", F.col("tags").alias("text"))


def tagged(d):
    return S.mood_tags(d.items.select("doc_id", F.split("genres", r"\|").alias("genres")), MOODS)


def live(d):
    return d.content_metadata.where("live_start_ts is not null").selectExpr("doc_id", *(f"live_{c} + make_interval(0, 0, 0, 0, cast(doc_id div 10 % 40 as int) - 20) AS {c}" for c in ("start_ts", "end_ts")))


def shows(d):
    return d.watch_events.where("shown and position < 4").selectExpr("event_id AS request_id", "doc_id % 25 AS advertiser_id", "(1 + doc_id % 9) / 1000 AS price_usd", "event_type = 'click' AS clicked")


def cands(d):
    return title(d).select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.lit(0.0).alias("dense_score"), (F.col("score") / 2).alias("hybrid_score"))


def keyed(d):
    return d.items.select("doc_id", F.split("tags", ",").alias("tags"), F.split("genres", r"\|").alias("genres"))


def rewrites(d):
    q = d.search_queries
    return q.select("query_id", F.lit(0).alias("rewrite_no"), "text").unionByName(q.select("query_id", F.lit(1).alias("rewrite_no"), F.substring_index("text", " ", 2).alias("text")))


def poses(d):
    return d.events.selectExpr("user_id AS scene", "event_id AS frame", "value AS x", "cast(event_id % 97 as double) AS y", "event_id % 7 / 2D AS yaw")


def paths(d):
    at = lambda i, c: F.round(F.element_at("path", i)[c], 5).alias(f"{c}{i}")
    return S.lookahead_path(poses(d)).select("scene", "frame", F.size("path").alias("n"), at(1, "x"), at(1, "y"), at(12, "x"), at(12, "y"))


PATH_SQL = ", ".join(
    f"round(cos(yaw) * ({{x{i}}} - x) + sin(yaw) * ({{y{i}}} - y), 5) AS x{i}, round(cos(yaw) * ({{y{i}}} - y) - sin(yaw) * ({{x{i}}} - x), 5) AS y{i}".format(
        **{f"{c}{i}": f"coalesce(lead({c}, {i}) OVER w, last_value({c}) OVER (PARTITION BY scene ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" for c in "xy"}
    )
    for i in (1, 12)
)
SIM = f"""hist AS (SELECT user_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, event_id) AS r FROM watch_events WHERE watch_pct IS NOT NULL) WHERE r <= 20),
mean AS (SELECT user_id, list(x ORDER BY i) AS u FROM (SELECT user_id, i, avg(embedding[i]::DOUBLE) AS x FROM hist JOIN embeddings ON vec_id = doc_id, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i) GROUP BY 1, 2) GROUP BY 1),
ov AS (SELECT user_id, doc_id, score, coalesce(contains(lower(title || chr(10) || tags), k)::INT + contains(lower(title || chr(10) || tags), 'large')::INT, 0) / 2::DOUBLE AS ov FROM ur LEFT JOIN kw USING (user_id) LEFT JOIN items USING (doc_id)),
sim AS (SELECT user_id, doc_id, score, ov, CASE WHEN n >= 3 THEN list_dot_product(u, embedding::DOUBLE[]) / sqrt(list_dot_product(u, u)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END AS s
FROM ov LEFT JOIN mean USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM hist GROUP BY 1) USING (user_id) LEFT JOIN embeddings ON vec_id = doc_id),
boosted AS (SELECT user_id, doc_id, score AS base, CASE WHEN s IS NULL THEN 0.15::DOUBLE * ov ELSE 0.15::DOUBLE * greatest(s, 0) END AS boost, CASE WHEN s IS NULL THEN 'keyword' ELSE 'embedding' END AS method FROM sim)"""


#: Vectors of words hashed to 64 places, and the fused search over them and BM25.
HASHED = """SELECT {id} AS id, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS place, count(*)::DOUBLE AS x FROM (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {table}) GROUP BY 1, 2"""
CHANNEL = f"""qv AS ({HASHED.format(id='query_id', text='text', table='search_queries')}), tv AS ({HASHED.format(id='doc_id', text='title', table='corpus')}),
dt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT qv.id AS query_id, tv.id AS doc_id, sum(qv.x * tv.x) / any_value(qn) / any_value(tn) AS score
FROM qv JOIN tv USING (place) JOIN (SELECT id, sqrt(sum(x * x)) AS qn FROM qv GROUP BY 1) a ON a.id = qv.id JOIN (SELECT id, sqrt(sum(x * x)) AS tn FROM tv GROUP BY 1) b ON b.id = tv.id GROUP BY 1, 2) QUALIFY rank <= {K})"""
FUSED = f"""se AS (SELECT query_id, doc_id, sum(s) AS score FROM (
SELECT query_id, doc_id, 0.5 * ({NORM}) AS s FROM bm WINDOW q AS (PARTITION BY query_id) UNION ALL SELECT query_id, doc_id, 0.5 * ({NORM}) FROM dt WINDOW q AS (PARTITION BY query_id)) GROUP BY 1, 2)"""
SEEDS = "SELECT query_id * 2 AS query_id, text FROM search_queries UNION ALL SELECT query_id * 2 + 1, text || ' the of' FROM search_queries"
FIRST = "SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM se) WHERE r <= {} GROUP BY 1"


def seeds(d):
    return d.spark.createDataFrame([(0, ""), (1, "the of")], "row_no int, suffix string")


def top(df):
    return df.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


def formatted(d):
    """Every user's items with a format, a surface and an intent."""
    return as_queries(d).join(d.content_metadata.select("doc_id", F.when(F.col("content_type") == "live", "live_event").otherwise(F.col("content_type")).alias("content_type")), "doc_id").withColumns(
        {"surface": F.expr("CASE query_id % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'live' WHEN 2 THEN 'games' ELSE 'elsewhere' END"), "intent": F.expr("CASE query_id % 3 WHEN 0 THEN 'social_watching' WHEN 1 THEN 'background_noise' ELSE '' END")}
    )


def _case(table: dict[str, dict[str, float]], first: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {first} = '{a}' AND kind = '{b}' THEN {v}::DOUBLE" for a, row in table.items() for b, v in row.items()) + f" ELSE {other} END"


def vec_texts(d):
    return d.embeddings.selectExpr("vec_id AS doc_id", "CASE WHEN label % 3 = 0 THEN 'An Original story' ELSE 'story' END AS title", "'' AS text")


def feeds(d):
    rows = ur(d).selectExpr("user_id % 50 AS household_id", "concat('p', user_id % 3) AS profile", "doc_id", "score").groupBy("household_id", "profile", "doc_id").agg(F.max("score").alias("score"))
    return R.topk(rows.withColumn("query_id", F.struct("household_id", "profile"))).drop("query_id")


QUERIES = {
    "x03_multi_objective": (
        lambda d: S.multi_objective(d.ranked_a, d.ranked_b, vec_texts(d)).select("query_id", "doc_id", F.round("score", 6).alias("score")),
        """SELECT query_id, doc_id, round(0.6::DOUBLE * (a.score - min(a.score) OVER q) / greatest(max(a.score) OVER q - min(a.score) OVER q, 1e-9) + 0.25::DOUBLE * coalesce(1 - (b.rank - 1) / greatest(count(*) OVER q, 1)::DOUBLE, 0) + 0.15::DOUBLE * (label % 3 = 0)::INT, 6) AS score
        FROM ranked_a a LEFT JOIN (SELECT query_id, doc_id, rank FROM ranked_b) b USING (query_id, doc_id) JOIN embeddings ON vec_id = doc_id WINDOW q AS (PARTITION BY query_id)""",
    ),
    "x06_merge_household": (lambda d: S.merge_household(feeds(d), 9), None),
    "x11_cross_format": (
        lambda d: S.cross_format(formatted(d)).select("query_id", "doc_id", "format_boost", "score"),
        f"""WITH {UR}, x AS (SELECT user_id AS query_id, doc_id, score, CASE content_type WHEN 'live' THEN 'live_event' ELSE content_type END AS kind, CASE user_id % 4 WHEN 1 THEN 'live' WHEN 2 THEN 'games' ELSE 'home' END AS surface,
        CASE user_id % 3 WHEN 0 THEN 'social_watching' WHEN 1 THEN 'background_noise' ELSE '' END AS intent FROM ur JOIN content_metadata USING (doc_id)), y AS (SELECT *, {_case(S.SURFACE_MIX, 'surface', '0.1::DOUBLE')} * 0.1::DOUBLE + {_case(S.INTENT_FORMATS, 'intent', '1')} * 0.1::DOUBLE * 0.5::DOUBLE AS b FROM x)
        SELECT query_id, doc_id, b AS format_boost, score * (1 + b) AS score FROM y""",
    ),
    "h06_session_summary": (
        lambda d: S.session_summary(d.events.selectExpr("concat(user_id, '_', date(ts)) AS session_id", "ts", "event_id", "event_type AS intent")),
        """WITH e AS (SELECT user_id || '_' || CAST(ts AS DATE) AS session_id, ts, event_id, event_type AS i FROM events), t AS (SELECT *, lag(i, 1) OVER w AS j, lag(i, 2) OVER w AS k, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS back FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
        SELECT session_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 1) AS duration_min, count(*) AS n_queries, coalesce(bool_or(i <> j AND j <> k AND i <> k), false) AS pivot_detected, string_agg(i, ',' ORDER BY back DESC) FILTER (back <= 5) AS intents FROM t GROUP BY 1""",
    ),
    "m16_evaluate_all": (
        lambda d: rounded(S.evaluate_all({"a": (d.ranked_a, d.graded_qrels), "b": (d.ranked_b, d.graded_qrels)}), "mean_ndcg"),
        f"SELECT 'a' AS dataset, count(*) AS n_queries, round(avg(ndcg), 6) AS mean_ndcg FROM ({ndcg('ranked_a')}) UNION ALL SELECT 'b', count(*), round(avg(ndcg), 6) FROM ({ndcg("ranked_b")})",
    ),
    "v15_promote_by_quality": (lambda d: S.promote_by_quality(d.model_artifacts).select("artifact_id", "promoted"), "SELECT artifact_id, coalesce(ndcg_at_10 >= 0.3::DOUBLE, false) AS promoted FROM model_artifacts"),
    "g07_graph_search": (
        lambda d: S.graph_search(d.recommendations.groupBy(F.col("query").alias("text")).agg(F.min("rec_id").alias("query_id")), item_texts(d), graph_edges(d)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "hops"),
        None,
    ),
    "r15_search": (
        lambda d: S.search(d.search_queries, d.corpus).select("query_id", "doc_id", F.round("score", 6).alias("score")),
        f"WITH {BM25[1:]}, {CHANNEL}, {FUSED} SELECT query_id, doc_id, round(score, 6) AS score FROM se QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10",
    ),
    "r15_search_boosted": (lambda d: top(S.search(d.search_queries, d.corpus, boosted=title(d).where("rank <= 5"))), f"WITH {BM25[1:]}{TITLE}, {CHANNEL}, {FUSED.replace('se AS', 'sf AS')}, se AS (SELECT query_id, doc_id, score * CASE WHEN (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM ti WHERE rank <= 5) THEN 1.15::DOUBLE ELSE 1 END AS score FROM sf) {FIRST.format(10)}"),
    "r14_rescore_pairs": (
        lambda d: S.rescore_pairs(title(d), d.search_queries, d.corpus).select("query_id", "doc_id", F.round("score", 6).alias("score")),
        f"""WITH {CAND} SELECT query_id, doc_id, round((len(list_intersect(q, {WORDS.format('title')})) + 0.5::DOUBLE * len(list_intersect(q, {WORDS.format('body')}))) / greatest(len(q), 1), 6) AS score
        FROM (SELECT query_id, doc_id, {WORDS.format('q.text')} AS q, title, c.text AS body FROM ti JOIN search_queries q USING (query_id) JOIN corpus c USING (doc_id))""",
    ),
    "r16_feed": (
        lambda d: S.feed(d.search_queries.select(F.col("query_id").alias("profile_id"), F.col("text").alias("taste")), seeds(d), d.corpus).groupBy("profile_id", "row_no").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best")),
        f"""WITH sd AS ({SEEDS}), {BM25[1:].replace('search_queries', 'sd')}, {CHANNEL.replace('search_queries', 'sd')}, {FUSED}, f AS ({FIRST.format(5)}) SELECT query_id // 2 AS profile_id, CAST(query_id % 2 AS INT) AS row_no, n, best FROM f""",
    ),
    "r17_cold_start_neighbors": (
        lambda d: top(S.cold_start_neighbors(d.search_queries.select("query_id", F.col("text").alias("title"), F.lit("the").alias("genres")), d.corpus)),
        f"WITH sd AS (SELECT query_id, text || ' the' AS text FROM search_queries), {BM25[1:].replace('search_queries', 'sd')}, {CHANNEL.replace('search_queries', 'sd')}, {FUSED} {FIRST.format(5)}",
    ),
    "r25_three_way": (
        lambda d: R.fuse({"text": bm25(d), "title": title(d), "dense": S.hashed_search(d.search_queries, d.corpus, K)}, {"text": 0.5, "title": 0.2, "dense": 0.3}).select("query_id", "doc_id", F.round("score", 6).alias("score")),
        f"""WITH {BM25[1:]}{TITLE}, {CHANNEL} SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, 0.5::DOUBLE * ({NORM}) AS s FROM bm WINDOW q AS (PARTITION BY query_id)
        UNION ALL SELECT query_id, doc_id, 0.2::DOUBLE * ({NORM}) FROM ti WINDOW q AS (PARTITION BY query_id) UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE * ({NORM}) FROM dt WINDOW q AS (PARTITION BY query_id)) GROUP BY 1, 2""",
    ),
    "h01_keyword_boost": (
        lambda d: S.keyword_boost(ur(d), keywords(d), item_texts(d)).select("user_id", "doc_id", F.round("overlap", 6).alias("overlap"), F.round("score", 6).alias("score")),
        f"WITH {UR}, {KW}, {SIM} SELECT user_id, doc_id, round(ov, 6) AS overlap, round(score + 0.15::DOUBLE * ov, 6) AS score FROM ov",
    ),
    "h02_embedding_boost": (
        lambda d: boosted(d).select("user_id", "doc_id", "method", F.round("boost", 6).alias("boost"), F.round("score", 6).alias("score")),
        f"WITH {UR}, {KW}, {SIM} SELECT user_id, doc_id, method, round(boost, 6) AS boost, round(base + boost, 6) AS score FROM boosted",
    ),
    "h03_explain_boost": (
        lambda d: S.explain_boost(boosted(d)).groupBy("user_id", "method").agg(F.count("*").alias("n"), F.round(F.avg("lift_pct"), 3).alias("lift_pct")),
        f"WITH {UR}, {KW}, {SIM} SELECT user_id, method, count(*) AS n, round(avg(100 * boost / greatest(abs(base), 1e-9)), 3) AS lift_pct FROM boosted GROUP BY 1, 2",
    ),
    "r20_mood_tags": (
        lambda d: tagged(d).select("doc_id", F.array_join(F.array_sort("mood_tags"), ",").alias("moods"), F.col("style_tags")[0].alias("style")),
        f"WITH {TAGGED} SELECT doc_id, coalesce(array_to_string(list_sort(moods), ','), '') AS moods, 'live_action_modern' AS style FROM tagged",
    ),
    "r21_mood_boost": (
        lambda d: S.mood_boost(as_queries(d), d.users.selectExpr("user_id AS query_id", f"{ASKED} AS text"), tagged(d)).select("query_id", "doc_id", F.round("boost", 6).alias("boost"), "score"),
        f"""WITH {UR}, {TAGGED}, x AS (SELECT user_id AS query_id, doc_id, score, least(0.25::DOUBLE, 0.08::DOUBLE * ({MOOD_SUM})) AS boost FROM ur JOIN (SELECT user_id, lower({ASKED}) AS q FROM users) USING (user_id) LEFT JOIN tagged USING (doc_id))
        SELECT query_id, doc_id, round(boost, 6) AS boost, round(score + boost, 4) AS score FROM x""",
    ),
    "r23_mood_features": (
        lambda d: S.mood_features(tagged(d), ["epic_grand", "romantic"]),
        f"WITH {TAGGED} SELECT doc_id, list_contains(moods, 'epic_grand')::INT AS mood_epic_grand, list_contains(moods, 'romantic')::INT AS mood_romantic FROM tagged",
    ),
    "x18_live_boost": (
        lambda d: S.live_boost(as_queries(d), live(d), AS_OF).drop("rank"),
        f"""WITH {UR}, {LIVE}, {STATE}, x AS (SELECT user_id AS query_id, doc_id, score AS sc, coalesce(state, 'none') AS live_state, 1 - a / greatest(a - s, 1.0::DOUBLE) AS l, greatest(0.1::DOUBLE, 1 - s / 3600 / 24) AS near FROM ur LEFT JOIN st USING (doc_id)),
        y AS (SELECT *, CASE live_state WHEN 'live' THEN l WHEN 'countdown' THEN near * 0.5::DOUBLE WHEN 'replay' THEN 0.1::DOUBLE ELSE 0 END AS u, CASE live_state WHEN 'live' THEN 5 * (1 + l * 0.5::DOUBLE) WHEN 'countdown' THEN 2 * near WHEN 'replay' THEN 1.2::DOUBLE ELSE 1 END AS b FROM x)
        SELECT query_id, doc_id, live_state, round(b, 3) AS live_boost, round(u, 3) AS urgency, round(sc * b + CASE WHEN live_state = 'live' THEN u * 2 ELSE 0 END, 4) AS score FROM y""",
    ),
    "x19_live_rows": (
        lambda d: S.live_rows(live(d), AS_OF),
        f"""WITH {LIVE}, {STATE}, x AS (SELECT CASE state WHEN 'live' THEN 'Live Now' ELSE 'Starting Soon' END AS row_title, CAST(round(CASE state WHEN 'live' THEN a ELSE s END) AS BIGINT) AS seconds, doc_id FROM st WHERE state IN ('live', 'countdown'))
        SELECT row_title, seconds, doc_id, CAST(row_number() OVER (PARTITION BY row_title ORDER BY seconds, doc_id) AS INT) AS position FROM x""",
    ),
    "x21_foundation_score": (
        lambda d: S.foundation_score(d.watch_events.selectExpr("event_id", "ltr_score", "position < 5 AS intent_match", "propensity AS intent_confidence", "position / 10 AS artwork_quality", "0.5D AS novelty")).select("event_id", F.round("intent_align", 6).alias("intent_align"), F.round("combined", 6).alias("combined")),
        """SELECT event_id, round(a, 6) AS intent_align, round(0.5::DOUBLE * ltr_score + 0.25::DOUBLE * a + 0.15::DOUBLE * (position / 10::DOUBLE) + 0.1::DOUBLE * 0.5::DOUBLE, 6) AS combined
        FROM (SELECT *, CASE WHEN position < 5 THEN 1 ELSE 0.3::DOUBLE END * propensity AS a FROM watch_events)""",
    ),
    "v10_ad_report": (
        lambda d: S.ad_report(d.watch_events.select(F.col("event_id").alias("request_id")), shows(d))[0],
        f"""WITH {SHOWS} SELECT (SELECT count(DISTINCT event_id) FROM watch_events) AS n_requests, count(*) AS n_impressions, count(*) FILTER (clicked) AS n_clicks, round(sum(price_usd), 4) AS total_revenue_usd, round(1000 * sum(price_usd) / count(*), 4) AS avg_cpm_usd,
        round(count(DISTINCT request_id) / (SELECT count(DISTINCT event_id) FROM watch_events)::DOUBLE, 4) AS fill_rate, round(count(*) FILTER (clicked) / count(*)::DOUBLE, 4) AS ctr FROM shows""",
    ),
    "v10_top_advertisers": (
        lambda d: S.ad_report(d.watch_events.select(F.col("event_id").alias("request_id")), shows(d))[1],
        f"WITH {SHOWS} SELECT advertiser_id, round(sum(price_usd), 4) AS revenue_usd, count(*) AS shows FROM shows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    "l02_ltr_features_v1": (
        lambda d: rounded(S.ltr_features_v1(cands(d), d.search_queries, d.corpus.select("doc_id", "title", "text", F.col("language").alias("tags"), F.col("title").alias("genres"))), "bm25_score", "title_overlap", "text_overlap", "title_len_log", "text_len_log"),
        f"""WITH {CAND}, x AS (SELECT query_id, doc_id, score, {WORDS.format('q.text')} AS q, {WORDS.format('title')} AS t, {WORDS.format('c.text')} AS w, title, c.text AS body, language FROM ti JOIN search_queries q USING (query_id) JOIN corpus c USING (doc_id))
        SELECT query_id, doc_id, round(score, 6) AS bm25_score, 0::DOUBLE AS dense_score, round(len(list_intersect(q, t)) / greatest(len(q), 1)::DOUBLE, 6) AS title_overlap, round(len(list_intersect(q, w)) / greatest(len(q), 1)::DOUBLE, 6) AS text_overlap,
        round(ln(1 + length(title)), 6) AS title_len_log, round(ln(1 + length(body)), 6) AS text_len_log, (len(list_filter(q, lambda k: contains(lower(language), k))) > 0)::INT::DOUBLE AS tag_match, (len(list_filter(q, lambda k: contains(lower(title), k))) > 0)::INT::DOUBLE AS genre_match FROM x""",
    ),
    "l25_ltr_features_v2": (
        lambda d: rounded(S.ltr_features_v2(cands(d), d.search_queries, d.corpus), "bm25_score", "hybrid_score", "title_overlap", "text_overlap"),
        f"""WITH {CAND}, x AS (SELECT query_id, doc_id, score, q.text AS ask, title, c.text AS body, {WORDS.format('q.text')} AS q FROM ti JOIN search_queries q USING (query_id) JOIN corpus c USING (doc_id))
        SELECT query_id, doc_id, round(score, 6) AS bm25_score, 0::DOUBLE AS dense_score, round(score / 2, 6) AS hybrid_score, CAST(len(regexp_extract_all(lower(ask), '[a-z0-9]+')) AS INT) AS query_len, CAST(len(regexp_extract_all(lower(title), '[a-z0-9]+')) AS INT) AS title_len,
        CAST(len(regexp_extract_all(lower(body), '[a-z0-9]+')) AS INT) AS text_len, round(len(list_intersect(q, {WORDS.format('title')})) / greatest(len(q), 1)::DOUBLE, 6) AS title_overlap, round(len(list_intersect(q, {WORDS.format('body')})) / greatest(len(q), 1)::DOUBLE, 6) AS text_overlap FROM x""",
    ),
    "l04_training_table": (
        lambda d: S.training_table(d.ranked_a, d.graded_qrels, min_rel=2).select("query_id", "doc_id", F.round("score", 6).alias("score"), "label", "split"),
        """SELECT query_id, doc_id, round(score, 6) AS score, CASE WHEN relevance >= 2 THEN relevance ELSE 0 END AS label, CASE WHEN CAST('0x' || substr(md5(query_id::VARCHAR), 1, 6) AS INT) % 100 < 15 THEN 'val' ELSE 'train' END AS split
        FROM ranked_a LEFT JOIN graded_qrels USING (query_id, doc_id) WHERE rank <= 50""",
    ),
    "l11_make_labels": (
        lambda d: S.make_labels(keyed(d), keyed(d).select(F.explode("tags").alias("key")).distinct().select(F.col("key").alias("query_id"), "key")),
        f"""WITH {KEYS}, g AS (SELECT key, doc_id, max(relevance) AS relevance FROM keyed GROUP BY 1, 2), e AS (SELECT key FROM g GROUP BY 1 HAVING count(*) >= 5)
        SELECT t AS query_id, doc_id, relevance FROM (SELECT DISTINCT unnest(string_split(tags, ',')) AS t FROM items) JOIN e ON e.key = lower(trim(t)) JOIN g USING (key)""",
    ),
    "l12_make_key_queries": (
        lambda d: S.make_key_queries(keyed(d), ["{} movies", "best {}"]),
        f"""WITH {KEYS}, k AS (SELECT key, count(DISTINCT doc_id) AS n_docs FROM keyed GROUP BY 1 HAVING count(DISTINCT doc_id) BETWEEN 5 AND 5000) SELECT key || ' movies' AS text, key, n_docs FROM k UNION ALL SELECT 'best ' || key, key, n_docs FROM k""",
    ),
    "m22_rmse": (
        lambda d: rounded(M.rmse(d.ratings.join(d.ratings.groupBy("doc_id").agg(F.avg("rating").alias("mean")), "doc_id"), "mean", "rating"), "rmse"),
        "SELECT count(*) AS n, round(sqrt(avg((m - rating) * (m - rating))), 6) AS rmse FROM (SELECT rating, avg(rating) OVER (PARTITION BY doc_id) AS m FROM ratings)",
    ),
    "m25_near_reference": (
        lambda d: rounded(M.near_reference(M.macro_average(M.ndcg(d.ranked_b, d.graded_qrels), "ndcg").select(F.col("mean_ndcg").alias("value")), 0.3), "value", "delta"),
        f"SELECT round(v, 6) AS value, round(v - 0.3::DOUBLE, 6) AS delta, abs(v - 0.3::DOUBLE) <= 0.3::DOUBLE * 0.05::DOUBLE AS within FROM (SELECT avg(ndcg) AS v FROM ({ndcg('ranked_b')}))",
    ),
    "m27_cold_gap": (
        lambda d: rounded(S.cold_gap(M.ndcg(d.ranked_a, d.graded_qrels), d.query_vectors.selectExpr("query_id", "query_id div 50 % 30 AS watches")), "mean"),
        f"SELECT CASE WHEN query_id // 50 % 30 < 5 THEN 'cold' ELSE 'warm' END AS slice, count(*) AS n, round(avg(ndcg), 6) AS mean FROM ({ndcg('ranked_a')}) WHERE query_id // 50 % 30 < 5 OR query_id // 50 % 30 >= 20 GROUP BY 1",
    ),
    "m28_temporal_gap": (
        lambda d: rounded(S.temporal_gap(M.ndcg(d.ranked_a, d.graded_qrels), d.graded_qrels, d.items), "mean"),
        f"""WITH o AS (SELECT query_id, CASE WHEN avg((year < 2010)::INT) > 0.5 THEN 'old' ELSE 'new' END AS slice FROM graded_qrels JOIN items USING (doc_id) WHERE relevance > 0 GROUP BY 1)
        SELECT slice, count(*) AS n, round(avg(ndcg), 6) AS mean FROM ({ndcg('ranked_a')}) JOIN o USING (query_id) GROUP BY 1""",
    ),
    "q12_answer_quality": (
        lambda d: rounded(S.answer_quality_by_language(M.answer_scores(quality_turns(d)).withColumn("language", F.concat(F.lit("lang"), F.col("id") % 4))), "faithfulness", "relevance", "context_recall"),
        """WITH t AS (SELECT conv_id AS id, list_distinct(regexp_extract_all(lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '')), '[a-z0-9]+')) AS q,
        list_distinct(regexp_extract_all(lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '')), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn)), '[a-z0-9]+')) AS s FROM conversations GROUP BY 1)
        SELECT 'lang' || (id % 4) AS language, count(*) AS n, round(avg(CASE WHEN len(a) > 0 THEN len(list_intersect(a, s)) / len(a)::DOUBLE ELSE 0 END), 6) AS faithfulness, round(avg(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q)::DOUBLE ELSE 0 END), 6) AS relevance,
        round(avg(CASE WHEN len(q) > 0 THEN len(list_intersect(q, s)) / len(q)::DOUBLE ELSE 0 END), 6) AS context_recall FROM t GROUP BY 1 HAVING count(*) >= 5""",
    ),
    "r27_search_rewrites": (
        lambda d: R.search_rewrites(rewrites(d), d.corpus, 20).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best")),
        f"""WITH {REWRITTEN}, {BM25[1:].replace('search_queries', 'rw')}, x AS (SELECT query_id // 10 AS query_id, doc_id, max(score) AS score FROM bm GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM x)
        SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM y WHERE r <= 20 GROUP BY 1""",
    ),
    "r19_zero_shot_tags": (
        lambda d: R.zero_shot_tags(vectors(d), d.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.concat(F.lit("t"), "label").alias("tag"), "embedding")).select("doc_id", "tag", F.round("score", 5).alias("score")),
        """WITH p AS (SELECT 't' || label AS tag, arg_min(embedding, vec_id)::DOUBLE[] AS pe FROM embeddings GROUP BY label),
        c AS (SELECT vec_id AS doc_id, tag, list_dot_product(embedding::DOUBLE[], pe) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(pe, pe)) AS cos FROM embeddings, p),
        e AS (SELECT *, exp((cos - max(cos) OVER (PARTITION BY doc_id)) / 0.1::DOUBLE) AS e FROM c), s AS (SELECT doc_id, tag, e / sum(e) OVER (PARTITION BY doc_id) AS score FROM e)
        SELECT doc_id, tag, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, tag) AS r FROM s) WHERE r <= 3 AND score > 0.15""",
    ),
    "w15_lookahead_path": (
        paths,
        f"""WITH p AS (SELECT user_id AS scene, event_id AS frame, value AS x, (event_id % 97)::DOUBLE AS y, event_id % 7 / 2::DOUBLE AS yaw FROM events) SELECT scene, frame, 12 AS n, {PATH_SQL} FROM p WINDOW w AS (PARTITION BY scene ORDER BY frame)""",
    ),
    "f11_replace_terms": (
        lambda d: d.items.select("doc_id", X.replace_terms(F.col("title"), {"ring": "band", "large": "big", "band": "hoop"}).alias("title")),
        "SELECT doc_id, replace(replace(replace(title, 'ring', 'band'), 'large', 'big'), 'band', 'hoop') AS title FROM items",
    ),
    "f15_parse_log": (
        lambda d: d.events.select("event_id", X.parse_log(F.col("props"), "k bigint, missing string").alias("f")).select("event_id", "f.k", F.col("f.missing").isNull().alias("missing")),
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS missing FROM events",
    ),
    "a02_distinct_count": (
        lambda d: d.events.groupBy("event_type").agg(X.distinct_count("user_id").alias("n"), (F.abs(X.distinct_count("user_id", approx=True) / X.distinct_count("user_id") - 1) < 0.2).alias("near")),
        "SELECT event_type, count(DISTINCT user_id) AS n, true AS near FROM events GROUP BY 1",
    ),
}


def graph_edges(d):
    from marquee.operators.graphs import genre_edges
    from marquee.plans.graphs import items

    return genre_edges(items(d))


def quality_turns(d):
    from marquee.plans.quality import turns

    return turns(d)
