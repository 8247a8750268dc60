"""Views that give the given tables the shapes the operators need, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.relational import words_between_blanks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The moment that stands for now.
AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, str] = {
    "ratings": """
SELECT o_custkey AS user_id, l_partkey AS doc_id, max(ceil(l_quantity / 5) / 2) AS rating, max(l_shipdate) AS rated_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
""",
    "items": """
SELECT p_partkey AS doc_id, p_name || ' (' || CAST(1985 + p_size % 40 AS STRING) || ')' AS title,
       CAST(1985 + p_size % 40 AS INT) AS year, p_type || '|' || p_brand AS genres, replace(p_name, ' ', ',') AS tags
FROM part
""",
    "users": """
SELECT c_custkey AS user_id, c_name AS profile_name, c_mktsegment AS profile_type, n_name AS language,
       coalesce(n, 0) AS interaction_count, coalesce(n, 0) < 5 AS cold_start
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT user_id AS uid, count(*) AS n FROM events GROUP BY user_id) e ON c_custkey = uid
""",
    "watch_events": """
SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS doc_id,
       CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'watch_start'
                       WHEN 'purchase' THEN 'watch_complete' ELSE 'skip' END AS event_type,
       CAST(event_id % 10 AS INT) AS position, value / 500 AS ltr_score,
       (1 + event_id % 97) / CAST(100 AS DOUBLE) AS propensity,
       CASE WHEN event_type IN ('signup', 'purchase') THEN least(value / 200, CAST(1 AS DOUBLE)) END AS watch_pct,
       event_id % 2 = 0 AS shown, ts AS occurred_at
FROM events
""",
    "recommendations": """
SELECT event_id AS rec_id, user_id, p_name AS query,
       CASE event_id % 4 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' WHEN 2 THEN 'hybrid' ELSE 'hybrid_ltr' END AS method,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / CAST(100 AS DOUBLE) AS ndcg_at_10,
       value AS latency_ms, event_id % 3 = 0 AS cache_hit, ts AS served_at
FROM events JOIN part ON p_partkey = CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)
""",
    "explanations": """
SELECT conv_id * 100 + turn AS exp_id, conv_id % 100 AS doc_id,
       CASE turn % 3 WHEN 0 THEN 'why_this' WHEN 1 THEN 'rag' ELSE 'vlm' END AS exp_type,
       'lang' || CAST(conv_id % 4 AS STRING) AS language, 'model' || CAST(conv_id % 3 AS STRING) AS model,
       CAST(floor(length(text) / 4) AS BIGINT) AS tokens_used, CAST(50 + (conv_id * 37 + turn * 11) % 900 AS BIGINT) AS latency_ms,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(conv_id % 30 AS INT) AS created_at
FROM conversations WHERE role = 'assistant'
""",
    "model_artifacts": """
SELECT CAST(n_nationkey AS BIGINT) AS artifact_id, 'run_' || CAST(n_nationkey AS STRING) AS run_id, 'flow_' || CAST(n_regionkey AS STRING) AS flow_name,
       CASE WHEN n_nationkey % 2 = 0 THEN 'ltr' ELSE 'bm25' END AS artifact_type, n_nationkey / CAST(25 AS DOUBLE) AS ndcg_at_10,
       n_nationkey % 3 = 0 AS is_active,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(n_nationkey AS INT) AS created_at
FROM nation
""",
    "quality_gates": """
SELECT s_suppkey AS gate_id, CAST(s_nationkey AS BIGINT) AS artifact_id, 'gate_' || CAST(s_suppkey AS STRING) AS gate_name,
       CAST(0.3 AS DOUBLE) AS threshold, s_acctbal / 10000 AS measured_value, s_acctbal / 10000 >= 0.3 AS passed
FROM supplier
""",
    "corpus": """
SELECT doc_id, substring(text, 1, 60) AS title, text, lang AS language FROM documents
""",
    "search_queries": """
SELECT item_id AS query_id,
       lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)) AS text
FROM benchmark
""",
    "qrels": """
SELECT * FROM (
  SELECT item_id AS query_id, doc_id,
         CAST(contains(lower(d.text), ' ' || lower(split_part(b.text, ' ', 2)) || ' ') AS INT)
       + CAST(contains(lower(d.text), ' ' || lower(split_part(b.text, ' ', 3)) || ' ') AS INT) AS relevance
  FROM benchmark b CROSS JOIN documents d) x
WHERE relevance > 0
""",
    "query_vectors": """
SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0
""",
    "vector_qrels": """
SELECT q.vec_id AS query_id, d.vec_id AS doc_id, 1 AS relevance
FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
""",
    "content_metadata": """
SELECT p_partkey AS doc_id, p_name AS title,
       TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' DAY * p_size AS release_ts,
       CASE WHEN p_partkey % 10 = 0 THEN TIMESTAMP '2024-01-30 23:00:00' END AS live_start_ts,
       CASE WHEN p_partkey % 10 = 0 THEN TIMESTAMP '2024-01-31 02:00:00' END AS live_end_ts,
       CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '2024-01-26 00:00:00' + INTERVAL '1' DAY * CAST(p_partkey % 40 AS INT) END AS rights_expiry_ts,
       CASE p_partkey % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'PG' WHEN 2 THEN 'PG-13' WHEN 3 THEN 'R' ELSE 'TV-MA' END AS maturity_rating,
       CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'FR' END AS market,
       CASE p_partkey % 5 WHEN 0 THEN 'film' WHEN 1 THEN 'series' WHEN 2 THEN 'live' WHEN 3 THEN 'podcast' ELSE 'game' END AS content_type
FROM part
""",
    "creatives": """
SELECT s_suppkey AS creative_id, s_nationkey AS advertiser_id, s_suppkey AS target_doc_id, 1 + s_suppkey % 9 AS cpm_bid_usd,
       CAST(0.02 AS DOUBLE) AS click_through_rate, s_acctbal / 10000 AS relevance_score, 3 AS frequency_cap
FROM supplier
""",
    "shadow_observations": """
SELECT date_trunc('hour', ts) AS observed_at,
       avg(CASE WHEN event_id % 2 = 0 THEN value END) AS production_value,
       avg(CASE WHEN event_id % 2 = 1 THEN value END) AS candidate_value, count(*) AS n_queries
FROM events GROUP BY date_trunc('hour', ts)
""",
    "ab_observations": """
SELECT event_type AS experiment, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, value AS reward FROM events
""",
    # two rankings of all vectors for the stated queries, and graded judgements
    "ranked_a": """
SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
    SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
           CAST((d.vec_id * 7919 + q.vec_id * 104729) % 1009 AS DOUBLE) / 1009 + CASE WHEN q.label = d.label THEN 0.1 ELSE 0 END AS score
    FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) x) y
WHERE rank <= 50
""",
    "ranked_b": """
SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
    SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
           CAST((d.vec_id * 6367 + q.vec_id * 104729) % 1009 AS DOUBLE) / 1009 + CASE WHEN q.label = d.label THEN 0.3 ELSE 0 END AS score
    FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) x) y
WHERE rank <= 50
""",
    "graded_qrels": """
SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CAST(1 + d.vec_id % 2 AS INT) AS relevance
FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
""",
    # every event as an impression of an item, with what came of it
    "impression_log": """
SELECT event_id, user_id, doc_id, position, ltr_score AS score, propensity, shown, coalesce(watch_pct, 0) >= 0.25 AS watched, occurred_at FROM watch_events
""",
    # interactions of a user with a vector's item
    "interactions": """
SELECT user_id, doc_id, coalesce(watch_pct, 0.05) AS watch_pct, event_type = 'skip' AS skipped, CAST(NULL AS DOUBLE) AS explicit_rating, occurred_at AS ts, event_id FROM watch_events
""",
}


class Data:
    """The tables and views over one folder. Only what a query asks for is read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @property
    def qrels(self) -> DataFrame:
        """The view `qrels` by the words that texts hold, without a row for each benchmark and document."""
        words = self.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.array(*(F.lower(F.split_part("text", F.lit(" "), F.lit(n))) for n in (2, 3)))).alias("word"))
        asked = words.groupBy("query_id", "word").agg(F.count("*").alias("n"))
        held = words_between_blanks(self.documents.select("doc_id", F.lower("text").alias("text")), asked)
        return asked.join(held, "word").groupBy("query_id", "doc_id").agg(F.sum("n").cast("int").alias("relevance"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            for other in (*TABLES, *VIEWS):
                if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                    getattr(self, other).createOrReplaceTempView(other)
            return self.spark.sql(VIEWS[name])
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """SQL with the views it names, and those they name, in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS (\n{VIEWS[name].strip()}\n)" for name in needed)
    body = sql.strip()
    return f"WITH {views},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views}\n{body}"
