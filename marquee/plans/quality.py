"""Offline evaluation of two rankings of the same queries."""

from pyspark.sql import functions as F

from marquee.operators import evaluate as M

#: Items of vectors: genres as an array, and popularity as a share.
ITEMS = "SELECT vec_id AS doc_id, ['g' || (vec_id % 7), 'g' || (vec_id % 3), 'h' || label] AS genres, (1 + vec_id % 97) / 100.0::DOUBLE AS popularity FROM embeddings"
GAIN = "(pow(2, relevance) - 1)"


def items(d):
    return d.embeddings.selectExpr("vec_id AS doc_id", "array('g' || vec_id % 7, 'g' || vec_id % 3, 'h' || label) AS genres", "(1 + vec_id % 97) / 100.0D AS popularity", "embedding")


def rated(name: str) -> str:
    return f"(SELECT r.query_id, r.doc_id, r.rank, coalesce(q.relevance, 0) AS relevance FROM {name} r LEFT JOIN graded_qrels q USING (query_id, doc_id))"


def ndcg(name: str, k: int = 10, gain: str = GAIN, pool: str = "graded_qrels") -> str:
    return f"""SELECT query_id, CASE WHEN i > 0 THEN g / i ELSE 0 END AS ndcg FROM (SELECT query_id, sum(CASE WHEN rank <= {k} THEN {gain} / log2(rank + 1) ELSE 0 END) AS g FROM {rated(name)} GROUP BY 1)
    LEFT JOIN (SELECT query_id, sum({gain} / log2(p + 1)) AS i FROM (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS p FROM {pool}) WHERE p <= {k} GROUP BY 1) USING (query_id)"""


def rounded(df, *columns):
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


NREL = "(SELECT query_id, count(*) AS n FROM graded_qrels GROUP BY 1)"
RECALL = f"SELECT query_id, coalesce(h / n::DOUBLE, 0) AS recall FROM (SELECT query_id, count(*) FILTER (relevance >= 1 AND rank <= 50) AS h FROM {rated('ranked_a')} GROUP BY 1) LEFT JOIN {NREL} USING (query_id)"
AP = f"""SELECT query_id, coalesce(s / n, 0) AS ap FROM (SELECT query_id, sum(CASE WHEN relevance >= 1 THEN c / rank::DOUBLE ELSE 0 END) AS s FROM (
SELECT *, count(*) FILTER (relevance >= 1) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM {rated('ranked_a')} WHERE rank <= 10) GROUP BY 1) LEFT JOIN {NREL} USING (query_id)"""
RR = f"SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (relevance >= 1), 0) AS rr FROM {rated('ranked_a')} GROUP BY 1"
AGREE = """
x AS (SELECT a.query_id, a.doc_id, a.rank AS ra, b.rank AS rb FROM ranked_a a JOIN ranked_b b USING (query_id, doc_id) WHERE a.rank <= 10 AND b.rank <= 10),
t AS (SELECT p.query_id, avg(sign(q.rb - p.rb)) AS tau FROM x p JOIN x q ON p.query_id = q.query_id AND p.ra < q.ra GROUP BY 1),
g AS (SELECT query_id, coalesce(any_value(o), 0) AS overlap, coalesce(any_value(t.tau), 0) AS tau, coalesce(any_value(gap), 0) AS avg_position_diff, coalesce(any_value(t1), false) AS top1_agreement
  FROM (SELECT DISTINCT query_id FROM ranked_a) LEFT JOIN (SELECT query_id, count(*) AS o, avg(abs(ra - rb)) AS gap, bool_or(ra = 1 AND rb = 1) AS t1 FROM x GROUP BY 1) USING (query_id) LEFT JOIN t USING (query_id) GROUP BY 1)"""
JAC = "(1 - len(list_intersect(a.genres, b.genres)) / len(list_distinct(a.genres || b.genres))::DOUBLE)"
HEAD = f"h AS (SELECT query_id, rank, list_distinct(genres) AS genres, popularity, doc_id FROM ranked_a JOIN ({ITEMS}) USING (doc_id) WHERE rank <= 10)"
SLICES = "SELECT query_id, 'parity' AS dimension, CAST(query_id % 2 AS STRING) AS slice FROM query_vectors UNION ALL SELECT query_id, 'third', CAST(query_id % 3 AS STRING) FROM query_vectors"


def slices(d):
    q = d.query_vectors.select("query_id")
    return q.select("query_id", F.lit("parity").alias("dimension"), (F.col("query_id") % 2).cast("string").alias("slice")).unionByName(q.select("query_id", F.lit("third").alias("dimension"), (F.col("query_id") % 3).cast("string").alias("slice")))


QUERIES = {
    "m01_ndcg": (lambda d: rounded(M.ndcg(d.ranked_a, d.graded_qrels), "ndcg"), f"SELECT query_id, round(ndcg, 6) AS ndcg FROM ({ndcg('ranked_a')})"),
    "m02_ndcg_retrieved": (lambda d: rounded(M.ndcg(d.ranked_a, d.graded_qrels, ideal="retrieved"), "ndcg"), f"SELECT query_id, round(ndcg, 6) AS ndcg FROM ({ndcg('ranked_a', pool=rated('ranked_a'))})"),
    "m03_ndcg_binary": (lambda d: rounded(M.ndcg(d.ranked_a, d.graded_qrels, kind="binary"), "ndcg"), f"SELECT query_id, round(ndcg, 6) AS ndcg FROM ({ndcg('ranked_a', gain='CAST(relevance > 0 AS DOUBLE)')})"),
    "m04_recall": (lambda d: rounded(M.recall(d.ranked_a, d.graded_qrels, 50), "recall"), f"SELECT query_id, round(recall, 6) AS recall FROM ({RECALL})"),
    "m05_precision": (lambda d: M.precision(d.ranked_a, d.graded_qrels), f"SELECT query_id, count(*) FILTER (relevance >= 1) / 10.0::DOUBLE AS precision FROM {rated('ranked_a')} WHERE rank <= 10 GROUP BY 1"),
    "m06_average_precision": (lambda d: rounded(M.average_precision(d.ranked_a, d.graded_qrels), "ap"), f"SELECT query_id, round(ap, 6) AS ap FROM ({AP})"),
    "m07_reciprocal_rank": (lambda d: rounded(M.reciprocal_rank(d.ranked_a, d.graded_qrels), "rr"), f"SELECT query_id, round(rr, 6) AS rr FROM ({RR})"),
    "m08_oracle_ndcg": (
        lambda d: rounded(M.oracle_ndcg(d.ranked_a, d.graded_qrels), "ndcg"),
        f"""SELECT query_id, round(CASE WHEN i > 0 THEN coalesce(g, 0) / i ELSE 0 END, 6) AS ndcg FROM (SELECT query_id, sum({GAIN} / log2(p + 1)) FILTER (p <= 10) AS g FROM (
        SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS p FROM {rated('ranked_a')}) GROUP BY 1)
        LEFT JOIN (SELECT query_id, sum({GAIN} / log2(p + 1)) AS i FROM (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS p FROM graded_qrels) WHERE p <= 10 GROUP BY 1) USING (query_id)""",
    ),
    "m09_diversity": (lambda d: rounded(M.diversity(d.ranked_a, items(d)), "diversity"), f"WITH {HEAD} SELECT a.query_id, round(avg({JAC}), 6) AS diversity FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY 1"),
    "m10_vector_diversity": (
        lambda d: rounded(M.vector_diversity(d.ranked_a, items(d)), "diversity"),
        """WITH h AS (SELECT query_id, rank, embedding::DOUBLE[] AS e FROM ranked_a JOIN embeddings ON vec_id = doc_id WHERE rank <= 10)
        SELECT a.query_id, round(avg(1 - list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))), 6) AS diversity FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY 1""",
    ),
    "m11_novelty": (lambda d: rounded(M.novelty(d.ranked_a, items(d)), "novelty"), f"WITH {HEAD} SELECT query_id, round(avg(-log2(popularity)), 6) AS novelty FROM h GROUP BY 1"),
    "m12_coherence": (
        lambda d: rounded(M.coherence(d.ranked_a, items(d)), "coherence"),
        f"WITH {HEAD} SELECT query_id, round(coalesce(avg(CASE WHEN p IS NULL THEN NULL WHEN list_has_any(genres, p) THEN 1 ELSE 0 END), 1), 6) AS coherence FROM (SELECT query_id, genres, lag(genres) OVER (PARTITION BY query_id ORDER BY rank) AS p FROM h) GROUP BY 1",
    ),
    "m13_latency_percentiles": (lambda d: M.pct_nearest(d.recommendations, "method", "latency_ms", 0.95), "SELECT method, quantile_disc(latency_ms, 0.95) AS p FROM recommendations GROUP BY 1"),
    "a08_rounded_percentile": (
        lambda d: M.pct_rounded(d.recommendations, "method", "latency_ms", 0.95),
        "SELECT method, latency_ms AS p FROM (SELECT method, latency_ms, row_number() OVER (PARTITION BY method ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY method) AS n FROM recommendations) WHERE r - 1 = round_even(0.95 * (n - 1), 0)",
    ),
    "m14_slice_metrics": (
        lambda d: rounded(M.slice_metrics(M.ndcg(d.ranked_a, d.graded_qrels), slices(d), "ndcg"), "mean"),
        f"SELECT dimension, slice, count(*) AS n, round(avg(ndcg), 6) AS mean FROM ({ndcg('ranked_a')}) JOIN ({SLICES}) USING (query_id) GROUP BY 1, 2",
    ),
    "a14_macro_average": (lambda d: rounded(M.macro_average(M.ndcg(d.ranked_b, d.graded_qrels), "ndcg"), "mean_ndcg"), f"SELECT count(*) AS n_queries, round(avg(ndcg), 6) AS mean_ndcg FROM ({ndcg('ranked_b')})"),
    "m15_evaluate": (
        lambda d: rounded(M.evaluate({"a": d.ranked_a, "b": d.ranked_b}, d.graded_qrels).where("metric = 'ndcg@10'"), "value"),
        f"SELECT 'a' AS method, 'ndcg@10' AS metric, round(avg(ndcg), 6) AS value FROM ({ndcg('ranked_a')}) UNION ALL SELECT 'b', 'ndcg@10', round(avg(ndcg), 6) FROM ({ndcg('ranked_b')})",
    ),
    "m17_failure_analysis": (
        lambda d: rounded(M.failure_analysis(d.ranked_a, d.ranked_b, d.graded_qrels), "ndcg_base", "ndcg_cand", "delta").withColumns({c: F.col(c).cast("double") for c in ("first_base", "first_cand")}),
        f"""WITH a AS ({ndcg('ranked_a')}), b AS ({ndcg('ranked_b')}), ra AS (SELECT query_id, count(*) FILTER (rank <= 10 AND relevance > 0) AS relevant_base, min(rank) FILTER (relevance > 0) AS first_base FROM {rated('ranked_a')} GROUP BY 1),
        rb AS (SELECT query_id, count(*) FILTER (rank <= 10 AND relevance > 0) AS relevant_cand, min(rank) FILTER (relevance > 0) AS first_cand FROM {rated('ranked_b')} GROUP BY 1),
        o AS (SELECT query_id, count(*) AS overlap FROM ranked_a x JOIN ranked_b y USING (query_id, doc_id) WHERE x.rank <= 10 AND y.rank <= 10 GROUP BY 1)
        SELECT query_id, round(a.ndcg, 6) AS ndcg_base, round(b.ndcg, 6) AS ndcg_cand, relevant_base, first_base::DOUBLE AS first_base, relevant_cand, first_cand::DOUBLE AS first_cand, coalesce(overlap, 0) AS overlap, round(b.ndcg - a.ndcg, 6) AS delta
        FROM a JOIN b USING (query_id) JOIN ra USING (query_id) JOIN rb USING (query_id) LEFT JOIN o USING (query_id)""",
    ),
    "m18_top_misses": (
        lambda d: M.top_misses(d.ranked_a, d.graded_qrels, 1).withColumn("best_rank", F.col("best_rank").cast("double")),
        f"SELECT query_id, CAST(b AS DOUBLE) AS best_rank FROM (SELECT DISTINCT query_id FROM graded_qrels) LEFT JOIN (SELECT query_id, min(rank) AS b FROM {rated('ranked_a')} WHERE relevance > 0 GROUP BY 1) USING (query_id) WHERE b IS NULL OR b > 1",
    ),
    "m19_rank_agreement": (lambda d: rounded(M.rank_agreement(d.ranked_a, d.ranked_b), "tau", "avg_position_diff"), f"WITH {AGREE} SELECT query_id, overlap, round(tau, 6) AS tau, round(avg_position_diff, 6) AS avg_position_diff, top1_agreement FROM g"),
    "m20_agreement_report": (
        lambda d: rounded(M.agreement_report(M.rank_agreement(d.ranked_a, d.ranked_b)), "avg_overlap", "avg_tau", "top1_rate"),
        f"WITH {AGREE} SELECT count(*) AS total, round(avg(overlap), 6) AS avg_overlap, round(avg(tau), 6) AS avg_tau, round(avg(top1_agreement::INT), 6) AS top1_rate, CASE WHEN avg(overlap) >= 7 AND avg(tau) >= 0.8 THEN 'promote' ELSE 'investigate' END AS recommendation FROM g",
    ),
    "m21_split_integrity": (
        lambda d: M.split_integrity(d.ratings.where("user_id % 5 <> 0"), d.ratings.where("user_id % 5 = 0"), "doc_id"),
        """SELECT count(DISTINCT doc_id) FILTER (user_id % 5 <> 0) AS n_train, count(DISTINCT doc_id) FILTER (user_id % 5 = 0) AS n_test,
        (SELECT count(*) FROM (SELECT doc_id FROM ratings WHERE user_id % 5 <> 0 INTERSECT SELECT doc_id FROM ratings WHERE user_id % 5 = 0)) AS n_overlap FROM ratings""",
    ),
    "m23_lift_table": (
        lambda d: rounded(M.lift_table(M.evaluate({"a": d.ranked_a, "b": d.ranked_b}, d.graded_qrels), "a").where("metric = 'ndcg@10'"), "value", "lift_pct"),
        f"""WITH m AS (SELECT 'a' AS method, avg(ndcg) AS value FROM ({ndcg('ranked_a')}) UNION ALL SELECT 'b', avg(ndcg) FROM ({ndcg('ranked_b')}))
        SELECT method, 'ndcg@10' AS metric, round(value, 6) AS value, round(100 * (value - (SELECT value FROM m WHERE method = 'a')) / (SELECT value FROM m WHERE method = 'a'), 6) AS lift_pct FROM m""",
    ),
    "m24_answer_scores": (
        lambda d: rounded(M.answer_scores(turns(d)), "faithfulness", "relevance", "context_recall"),
        """WITH t AS (SELECT conv_id AS id, list_distinct(regexp_extract_all(lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '')), '[a-z0-9]+')) AS q,
        list_distinct(regexp_extract_all(lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '')), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn)), '[a-z0-9]+')) AS s FROM conversations GROUP BY 1)
        SELECT id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, s)) / len(a)::DOUBLE ELSE 0 END, 6) AS faithfulness, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q)::DOUBLE ELSE 0 END, 6) AS relevance,
        round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, s)) / len(q)::DOUBLE ELSE 0 END, 6) AS context_recall FROM t""",
    ),
    "m26_popularity_bias": (
        lambda d: rounded(M.popularity_bias(d.ranked_a, items(d)), "head_share", "tail_coverage"),
        f"""WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY popularity DESC, doc_id) <= floor(count(*) OVER () * 0.1) AS head FROM ({ITEMS})), c AS (SELECT doc_id, count(*) AS c FROM ranked_a GROUP BY 1)
        SELECT round(sum(c) FILTER (head) / sum(c), 6) AS head_share, round(count(*) FILTER (NOT head AND c IS NOT NULL) / count(*) FILTER (NOT head)::DOUBLE, 6) AS tail_coverage, coalesce(sum(c) FILTER (head) / sum(c) > 0.5, false) AS biased FROM f LEFT JOIN c USING (doc_id)""",
    ),
}


def turns(d):
    """A conversation as a query (what users said), an answer (what assistants said) and a source (all turns)."""
    c = d.conversations
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")) if role else F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return c.groupBy(F.col("conv_id").alias("id")).agg(said("user").alias("query"), said("assistant").alias("answer"), said("").alias("source"))
