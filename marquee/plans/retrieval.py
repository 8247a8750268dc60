"""Search over the documents and vectors."""

from pyspark.sql import functions as F

from marquee.operators import retrieval as R

K = 20
INDEX = """
tok AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN ['__empty__'] ELSE w END AS w FROM (SELECT doc_id, regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+') AS w FROM corpus)),
docs AS (SELECT doc_id, len(w) AS dl, avg(len(w)) OVER () AS avgdl, count(*) OVER () AS n FROM tok),
postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings JOIN docs USING (doc_id) GROUP BY 1)"""
BM25 = INDEX + f""",
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM search_queries) GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl) + 1e-12)) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN docs USING (doc_id) GROUP BY 1, 2)
  QUALIFY rank <= {K})"""
#: A second channel over the same documents: Jaccard likeness of query and title words.
TITLE = f""",
ti AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, count(DISTINCT a.term) / (any_value(qn) + any_value(tn) - count(DISTINCT a.term))::DOUBLE AS score
  FROM (SELECT query_id, unnest(list_distinct(w)) AS term, len(list_distinct(w)) AS qn FROM (SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM search_queries)) a
  JOIN (SELECT doc_id, unnest(list_distinct(w)) AS term, len(list_distinct(w)) AS tn FROM (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM corpus)) b USING (term) GROUP BY 1, 2) QUALIFY rank <= {K})"""
NORM = """CASE WHEN count(*) OVER q = 1 THEN 1 / (1 + exp(-score)) WHEN max(score) OVER q <= min(score) OVER q THEN 0.5 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END"""
RANKED = "query_id, doc_id, round(score, 6) AS score"


def shown(df):
    """Scores rounded to 6 places; ranks follow unrounded scores, so only rankings without near ties show them."""
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def bm25(d):
    return R.corpus_search(d.search_queries, d.corpus, K)


def bm25_stored(d):
    return R.bm25_search(d.search_queries, R.build_index(d.corpus), K)


def title(d):
    from marquee.functions import text as X

    q = d.search_queries.select("query_id", F.array_distinct(X.tokens(F.col("text"))).alias("q"))
    t = d.corpus.select("doc_id", F.array_distinct(X.tokens(F.col("title"))).alias("t"))
    hits = q.select("*", F.explode("q").alias("w")).join(t.select("*", F.explode("t").alias("w")), "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.first(F.size("q")).alias("qn"), F.first(F.size("t")).alias("tn"))
    return R.topk(hits.select("query_id", "doc_id", (F.col("n") / (F.col("qn") + F.col("tn") - F.col("n"))).alias("score")), K)


def vectors(d):
    return d.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


DENSE = f"""dn AS (SELECT query_id, vec_id AS doc_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS score,
row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM query_vectors q, embeddings e QUALIFY rank <= {K})"""
HYBRID = f"""hy AS (SELECT query_id, doc_id, sum(s) AS score FROM (
  SELECT query_id, doc_id, 0.5 * ({NORM}) AS s FROM bm WINDOW q AS (PARTITION BY query_id) UNION ALL SELECT query_id, doc_id, 0.5 * ({NORM}) FROM ti WINDOW q AS (PARTITION BY query_id)) GROUP BY 1, 2)"""

#: Alphas of the sweep.
GRID = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]

QUERIES = {
    "r01_index_terms": (lambda d: R.build_index(d.corpus).terms, f"WITH {INDEX[1:]} SELECT term, df, idf FROM terms"),
    "r01_index_postings": (lambda d: R.build_index(d.corpus).postings, f"WITH {INDEX[1:]} SELECT * FROM postings"),
    "r02_bm25_search": (lambda d: shown(bm25(d)), f"WITH {BM25[1:]} SELECT {RANKED} FROM bm"),
    "r02_bm25_stored_index": (lambda d: shown(bm25_stored(d)), f"WITH {BM25[1:]} SELECT {RANKED} FROM bm"),
    "r03_bm25_okapi_terms": (
        lambda d: R.build_index(d.corpus, idf="okapi").terms,
        f"""WITH {INDEX[1:]}, raw AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS i FROM terms, (SELECT any_value(n) AS n FROM docs))
        SELECT term, df, CASE WHEN i < 0 THEN 0.25 * avg(i) OVER () ELSE i END AS idf FROM raw""",
    ),
    "r04_index_whitespace": (
        lambda d: R.build_index(d.corpus, tokenizer="space").docs.select("doc_id", "dl"),
        "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(title || ' ' || text), '\\s+'), lambda t: t <> '')) AS INT) AS dl FROM corpus",
    ),
    "r05_dense_search": (lambda d: shown(R.dense_search(d.query_vectors, vectors(d), K)), f"WITH {DENSE} SELECT {RANKED} FROM dn"),
    "r07_hybrid_merge": (lambda d: shown(R.hybrid_merge(bm25(d), title(d), 0.5)), f"WITH {BM25[1:]}{TITLE}, {HYBRID} SELECT {RANKED} FROM hy"),
    "r08_hybrid_train": (
        lambda d: shown(R.hybrid_merge(bm25(d), title(d), 0.3, mode="train")),
        f"""WITH {BM25[1:]}{TITLE} SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (
        SELECT query_id, doc_id, 0.3 * CASE WHEN max(score) OVER q <= min(score) OVER q THEN 1 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END AS s FROM bm WINDOW q AS (PARTITION BY query_id)
        UNION ALL SELECT query_id, doc_id, 0.7 * CASE WHEN max(score) OVER q <= min(score) OVER q THEN 1 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END FROM ti WINDOW q AS (PARTITION BY query_id)) GROUP BY 1, 2""",
    ),
    "r09_rrf_merge": (lambda d: shown(R.rrf_merge(bm25(d), title(d))), f"WITH {BM25[1:]}{TITLE} SELECT query_id, doc_id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ti) GROUP BY 1, 2"),
    "r10_sweep_alpha": (
        lambda d: R.sweep_alpha(bm25(d), title(d), [0.2, 0.5, 0.8]).groupBy("alpha").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")),
        f"""WITH {BM25[1:]}{TITLE}, x AS (SELECT query_id, doc_id, sum(b) AS b, sum(t) AS t FROM (SELECT query_id, doc_id, {NORM} AS b, 0 AS t FROM bm WINDOW q AS (PARTITION BY query_id)
        UNION ALL SELECT query_id, doc_id, 0, {NORM} FROM ti WINDOW q AS (PARTITION BY query_id)) GROUP BY 1, 2)
        SELECT alpha, count(*) AS n, round(avg((1 - alpha) * b + alpha * t), 6) AS mean_score FROM x, (SELECT unnest([0.2::DOUBLE, 0.5, 0.8]) AS alpha) GROUP BY alpha""",
    ),
    "r10_pick_alpha": (
        lambda d: R.pick_alpha(R.sweep_alpha(bm25(d), title(d), GRID), d.qrels),
        f"""WITH {BM25[1:]}{TITLE}, x AS (SELECT query_id, doc_id, sum(b) AS b, sum(t) AS t FROM (SELECT query_id, doc_id, {NORM} AS b, 0 AS t FROM bm WINDOW q AS (PARTITION BY query_id)
        UNION ALL SELECT query_id, doc_id, 0, {NORM} FROM ti WINDOW q AS (PARTITION BY query_id)) GROUP BY 1, 2), al AS (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in GRID)}]) AS alpha),
        rk AS (SELECT alpha, query_id, doc_id, row_number() OVER (PARTITION BY alpha, query_id ORDER BY (1 - alpha) * b + alpha * t DESC, doc_id) AS rank FROM x, al),
        ideal AS (SELECT query_id, sum((pow(2, relevance) - 1) / log2(p + 1)) AS ideal FROM (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS p FROM qrels) WHERE p <= 10 GROUP BY 1),
        got AS (SELECT alpha, query_id, sum((pow(2, relevance) - 1) / log2(rank + 1)) AS dcg FROM rk JOIN qrels USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1, 2),
        m AS (SELECT alpha, avg(coalesce(dcg, 0) / ideal) AS ndcg FROM al CROSS JOIN ideal LEFT JOIN got USING (alpha, query_id) WHERE ideal > 0 GROUP BY 1)
        SELECT alpha, ndcg, row_number() OVER (ORDER BY round(ndcg, 9) DESC, alpha) = 1 AS best FROM m""",
    ),
    "r11_context_bias": (
        lambda d: shown(R.context_bias(bm25(d), d.corpus)),
        f"""WITH {BM25[1:]} SELECT query_id, doc_id, round(score - least(length(text) / 2000.0::DOUBLE, 1) * 0.05 - least(length(title) / 80.0::DOUBLE, 1) * 0.03, 6) AS score FROM bm JOIN corpus USING (doc_id)""",
    ),
    "r12_entity_boost": (
        lambda d: shown(R.entity_boost(bm25(d), title(d).where("rank <= 5"))),
        f"""WITH {BM25[1:]}{TITLE} SELECT query_id, doc_id, round(score * CASE WHEN (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM ti WHERE rank <= 5) THEN 1.15 ELSE 1 END, 6) AS score FROM bm""",
    ),
    "r13_splice": (
        lambda d: R.splice(title(d).where("rank <= 3"), bm25(d)).select("query_id", "doc_id", "tier"),
        f"""WITH {BM25[1:]}{TITLE} SELECT query_id, doc_id, CAST(tier AS INT) AS tier FROM (SELECT query_id, doc_id, 0 AS tier FROM ti WHERE rank <= 3 UNION ALL
        SELECT query_id, doc_id, 1 FROM bm WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM ti WHERE rank <= 3))""",
    ),
    "r18_rerank_by_vector": (
        lambda d: shown(R.rerank_by_vector(R.dense_search(d.query_vectors, vectors(d), K), d.query_vectors, vectors(d))),
        f"""WITH {DENSE} SELECT {RANKED} FROM dn""",
    ),
    "r24_prf_expand": (
        lambda d: R.prf_expand(d.search_queries, title(d), d.corpus),
        f"""WITH {BM25[1:]}{TITLE}, w AS (SELECT query_id, unnest(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 50)) AS t FROM ti JOIN corpus USING (doc_id) WHERE rank <= 3),
        c AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, t) AS r FROM w WHERE length(t) > 3 AND t NOT IN {R.STOP!r} GROUP BY 1, 2),
        x AS (SELECT query_id, string_agg(t, ' ' ORDER BY r) AS a FROM c WHERE r <= 5 GROUP BY 1) SELECT query_id, concat_ws(' ', text, a) AS text FROM search_queries LEFT JOIN x USING (query_id)""",
    ),
    "r26_title_index": (
        lambda d: R.build_index(d.corpus, fields=("title",)).terms.select("term", "df"),
        "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN ['__empty__'] ELSE w END) AS term FROM (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM corpus)) GROUP BY 1",
    ),
    "r28_explain_rank": (
        lambda d: R.explain_rank(title(d).where("rank <= 2").select("query_id", "doc_id"), bm25(d)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "found"),
        f"WITH {BM25[1:]}{TITLE} SELECT query_id, doc_id, round(b.score, 6) AS score, b.rank IS NOT NULL AS found FROM (SELECT query_id, doc_id FROM ti WHERE rank <= 2) t LEFT JOIN bm b USING (query_id, doc_id)",
    ),
    "r22_compare_rankings": (
        lambda d: R.compare_rankings(bm25(d), title(d), 10).select("query_id", "overlap", "promoted"),
        f"WITH {BM25[1:]}{TITLE} SELECT query_id, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS overlap, count(*) FILTER (a.doc_id IS NULL) AS promoted FROM (SELECT * FROM bm WHERE rank <= 10) a FULL JOIN (SELECT * FROM ti WHERE rank <= 10) b USING (query_id, doc_id) GROUP BY 1",
    ),
    "l17_cosine_neighbors": (
        lambda d: shown(R.cosine_neighbors(vectors(d).withColumn("is_query", F.expr("doc_id % 50 = 0")), 10)),
        """SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
        list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score
        FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10""",
    ),
    "p07_filter_language": (
        lambda d: R.filter_language(bm25(d), d.corpus, "en", 5).select("query_id", "doc_id"),
        f"WITH {BM25[1:]} SELECT query_id, doc_id FROM (SELECT query_id, doc_id, language, count(*) FILTER (language = 'en') OVER (PARTITION BY query_id) AS c FROM bm JOIN corpus USING (doc_id)) WHERE language = 'en' OR c < 5",
    ),
    "p08_suggest": (
        lambda d: R.suggest(d.items.select(F.split("title", " ")[0].alias("prefix")).distinct(), d.items),
        "SELECT prefix, doc_id, title, CAST(row_number() OVER (PARTITION BY prefix ORDER BY doc_id) AS INT) AS rank FROM items, (SELECT DISTINCT split_part(title, ' ', 1) AS prefix FROM items) WHERE contains(lower(title), lower(prefix)) QUALIFY rank <= 5",
    ),
}
