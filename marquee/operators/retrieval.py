"""Ranked retrieval over tables of queries: BM25, dense search, fusion and re-ranking.

Rankings have the shape (query_id, doc_id, score, rank); ties go to the smaller doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators.relational import substring_pairs


def topk(df: DataFrame, k: int | None = None, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """df with `rank` from 1, cut to k rows a key (the limit reaches each task before the shuffle).

    Scores count to 9 places, so that sums taken in another order rank alike."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), tie)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


#: Stands for the document itself among its words; no tokenizer makes it.
MARK = "\x00 document"


@dataclass
class Index:
    """postings(term, doc_id, tf), docs(doc_id, dl) and terms(term, df, idf); avgdl is a column of docs."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame


def build_index(corpus: DataFrame, fields: tuple[str, ...] = ("title", "text"), tokenizer: str = "alnum", idf: str = "plus", epsilon: float = 0.25) -> Index:
    """Inverted index of a corpus. idf "plus" is ln(1 + (N - df + .5) / (df + .5)); "okapi" leaves out the 1 and lifts negative ones to epsilon times the mean.

    A document without words has one, "__empty__"; cut at white space it has none."""
    text = F.concat_ws(" ", *fields)
    words = X.tokens(text, tokenizer)
    if tokenizer != "space":
        words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("__empty__")))
    tokenised = corpus.select("doc_id", words.alias("words"))
    postings = tokenised.select("doc_id", F.explode("words").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    docs = tokenised.select("doc_id", F.size("words").alias("dl"))
    size = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size.select("n")))
    ratio = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    if idf == "plus":
        terms = df.select("term", "df", F.log(1 + ratio).alias("idf"))
    else:
        raw = df.select("term", "df", F.log(ratio).alias("idf"))
        mean = raw.agg((F.avg("idf") * epsilon).alias("floor"))
        terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    return Index(postings, docs.crossJoin(F.broadcast(size.select("avgdl"))), terms)


def bm25_search(queries: DataFrame, index: Index, k: int = 10, k1: float = 1.2, b: float = 0.75, tokenizer: str = "alnum") -> DataFrame:
    """Best k documents of every query(query_id, text); a query's repeated terms count each time."""
    asked = queries.select("query_id", F.explode(X.tokens(F.col("text"), tokenizer)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    hits = asked.join(index.terms, "term").join(index.postings, "term").join(index.docs, "doc_id")
    denominator = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")) + 1e-12
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / denominator).alias("score"))
    return topk(scored, k)


def corpus_search(queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, fields: tuple[str, ...] = ("title", "text"), tokenizer: str = "alnum") -> DataFrame:
    """bm25_search() without a stored index: only the words that queries ask for leave the scan, so neither the other words nor texts are shuffled."""
    found = X.tokens(F.concat_ws(" ", *fields), tokenizer)
    words = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("__empty__")))
    asked = queries.select("query_id", F.explode(X.tokens(F.col("text"), tokenizer)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    # one scan gives all: each document has one more word, MARK, whose rows are the corpus' size; the three uses of tf need the same columns of it, so its shuffle is reused
    mark = queries.sparkSession.range(1).select(F.lit(MARK).alias("term"))
    only = asked.select("term").distinct().union(mark)
    tokenised = corpus.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("dl"), F.explode(F.concat("words", F.array(F.lit(MARK)))).alias("term"))
    tf = tokenised.where("term IS NOT NULL").join(only, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    marked = F.col("term") == MARK
    size = tf.agg(F.sum(F.when(marked, F.col("tf"))).alias("n"), (F.sum(F.when(marked, F.col("dl") * F.col("tf"))) / F.sum(F.when(marked, F.col("tf")))).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    ratio = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    terms = asked.join(df, "term").crossJoin(F.broadcast(size)).select("query_id", "term", "qtf", F.log(1 + ratio).alias("idf"), "avgdl")
    denominator = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")) + 1e-12
    scored = terms.join(tf, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / denominator).alias("score"))
    return topk(scored, k)


def _vector_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(ids, data): up to `size` rows at a time with their vectors as one matrix, as bytes; no shuffle."""
    import numpy as np
    import pandas as pd

    def cut(batches):
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                matrix = np.vstack(part["embedding"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"ids": [part[key].to_numpy(np.int64).tobytes()], "data": [matrix.tobytes()]})

    return rows.where("embedding is not null").select(key, "embedding").mapInPandas(cut, "ids binary, data binary")


def dense_search(queries: DataFrame, docs: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """Exact best k by cosine.

    Every block of the query set queries(query_id, embedding) meets every block of documents(doc_id, embedding) in one
    matrix product, which leaves at most k rows a query; neither side passes through the driver. Lengths divide the
    products, the query's first, so vectors of counts give the same numbers whatever the order of their sums, and what
    is equally near has equal scores.
    """
    import numpy as np
    import pandas as pd

    def lengths(matrix):
        return np.maximum(np.linalg.norm(matrix, axis=1), 1e-12)

    def search(batches):
        for batch in batches:
            for ids, data, asked, wanted in zip(batch["ids"], batch["data"], batch["asked"], batch["wanted"]):
                docs_of, queries_of = np.frombuffer(ids, np.int64), np.frombuffer(asked, np.int64)
                d, q = np.frombuffer(data).reshape(len(docs_of), -1), np.frombuffer(wanted).reshape(len(queries_of), -1)
                scores = d @ q.T / lengths(q) / lengths(d)[:, None]
                order = np.lexsort((np.broadcast_to(docs_of[:, None], scores.shape), -np.round(scores, 9)), axis=0)[:k]
                yield pd.DataFrame({"query_id": np.broadcast_to(queries_of, order.shape).ravel(), "doc_id": docs_of[order].ravel(), "score": np.take_along_axis(scores, order, 0).ravel()})

    asked = _vector_blocks(queries, "query_id", 256).select(F.col("ids").alias("asked"), F.col("data").alias("wanted"))
    found = _vector_blocks(docs, "doc_id", block).crossJoin(asked).mapInPandas(search, "query_id long, doc_id long, score double")
    return topk(found, k)


def minmax(df: DataFrame, by: list[str], score: str = "score", equal: float | None = None) -> DataFrame:
    """df with `norm`: min-max by key; a lone row has the sigmoid of its score, equal rows 0.5 (or `equal` for both)."""
    w = Window.partitionBy(*by)
    low, high, n, s = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w), F.col(score)
    scaled = F.try_divide(s - low, high - low)
    if equal is not None:
        return df.withColumn("norm", F.when(high <= low, F.lit(equal)).otherwise(scaled))
    return df.withColumn("norm", F.when(n == 1, 1 / (1 + F.exp(-s))).when(high <= low, F.lit(0.5)).otherwise(scaled))


def fuse(channels: dict[str, DataFrame], weights: dict[str, float], k: int | None = None, equal: float | None = None) -> DataFrame:
    """Weighted sum of min-max normalised channels; a document that a channel lacks has 0 there."""
    parts = None
    for name, ranked in channels.items():
        part = minmax(ranked.select("query_id", "doc_id", "score"), ["query_id"], equal=equal).select("query_id", "doc_id", (F.col("norm") * float(weights[name])).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return topk(parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k)


def hybrid_merge(bm25: DataFrame, dense: DataFrame, alpha: float = 0.5, k: int | None = None, mode: str = "serve") -> DataFrame:
    """(1 - alpha) bm25 + alpha dense; mode "train" weighs the other way round and gives equal scores 1."""
    a = alpha if mode == "serve" else 1 - alpha
    return fuse({"bm25": bm25, "dense": dense}, {"bm25": 1 - a, "dense": a}, k, None if mode == "serve" else 1.0)


def rrf_merge(bm25: DataFrame, dense: DataFrame, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rankings from 1."""
    parts = bm25.select("query_id", "doc_id", (F.lit(weights[0]) / (k + F.col("rank"))).alias("s")).unionByName(dense.select("query_id", "doc_id", (F.lit(weights[1]) / (k + F.col("rank"))).alias("s")))
    return topk(parts.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score")), top)


def sweep_alpha(bm25: DataFrame, dense: DataFrame, grid: list[float]) -> DataFrame:
    """(alpha, query_id, doc_id, score, rank) of the hybrid for every alpha at once."""
    b = minmax(bm25.select("query_id", "doc_id", "score"), ["query_id"]).select("query_id", "doc_id", F.col("norm").alias("b"), F.lit(0.0).alias("d"))
    d = minmax(dense.select("query_id", "doc_id", "score"), ["query_id"]).select("query_id", "doc_id", F.lit(0.0).alias("b"), F.col("norm").alias("d"))
    both = b.unionByName(d).groupBy("query_id", "doc_id").agg(F.sum("b").alias("b"), F.sum("d").alias("d"))
    every = both.select("*", F.explode(F.array(*map(F.lit, grid))).alias("alpha"))
    scored = every.select("alpha", "query_id", "doc_id", ((1 - F.col("alpha")) * F.col("b") + F.col("alpha") * F.col("d")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "doc_id")))


def pick_alpha(swept: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(alpha, ndcg, best) of sweep_alpha()'s rankings: mean nDCG over the queries with judgements, and which alpha has the highest (to nine places, the smallest of equals).

    The judgements are joined once with all alphas' rankings.
    """
    gain = lambda c: F.pow(F.lit(2.0), F.col(c)) - 1
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = qrels.withColumn("p", place).where(F.col("p") <= k).groupBy("query_id").agg(F.sum(gain("relevance") / F.log2(F.col("p") + 1)).alias("ideal")).where("ideal > 0")
    got = swept.where(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"]).groupBy("alpha", "query_id").agg(F.sum(gain("relevance") / F.log2(F.col("rank") + 1)).alias("dcg"))
    each = swept.select("alpha").distinct().crossJoin(ideal).join(got, ["alpha", "query_id"], "left")
    mean = each.groupBy("alpha").agg(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))
    # one row an alpha
    first = mean.agg(F.max_by("alpha", F.struct(F.round("ndcg", 9), -F.col("alpha"))).alias("chosen"))
    return mean.crossJoin(F.broadcast(first)).select("alpha", "ndcg", (F.col("alpha") == F.col("chosen")).alias("best"))


def filter_language(ranked: DataFrame, docs: DataFrame, language: str, min_keep: int = 5) -> DataFrame:
    """Documents of a language, for queries with at least min_keep of them; other queries keep all."""
    known = ranked.join(docs.select("doc_id", "language"), "doc_id", "left")
    fits = F.coalesce(F.col("language") == language, F.lit(False))
    n = F.sum(fits.cast("int")).over(Window.partitionBy("query_id"))
    return known.withColumn("n", n).where(fits | (F.col("n") < min_keep)).drop("n", "language")


def entity_boost(ranked: DataFrame, boosted: DataFrame, factor: float = 1.15) -> DataFrame:
    """Scores times `factor` for (query_id, doc_id) in boosted, ranked again."""
    flag = boosted.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True))
    scored = ranked.drop("rank").join(flag, ["query_id", "doc_id"], "left")
    return topk(scored.select("query_id", "doc_id", (F.col("score") * F.when(F.col("hit"), factor).otherwise(1.0)).alias("score")))


def splice(reranked: DataFrame, merged: DataFrame) -> DataFrame:
    """The re-ranked head, then what else was merged in its old order; ranks run on."""
    tail = merged.join(reranked, ["query_id", "doc_id"], "left_anti")
    both = reranked.select("query_id", "doc_id", "score", F.lit(0).alias("tier"), "rank").unionByName(tail.select("query_id", "doc_id", "score", F.lit(1).alias("tier"), "rank"))
    order = Window.partitionBy("query_id").orderBy("tier", "rank", "doc_id")
    return both.select("query_id", "doc_id", "score", "tier", F.row_number().over(order).alias("rank"))


def rerank_by_vector(ranked: DataFrame, seeds: DataFrame, vectors: DataFrame, alpha: float = 0.2) -> DataFrame:
    """(1 - alpha) score + alpha cosine to the query's vector (seeds(query_id, embedding))."""
    mine = vectors.select("doc_id", F.col("embedding").alias("v"))
    scored = ranked.drop("rank").join(seeds.select("query_id", F.col("embedding").alias("q")), "query_id").join(mine, "doc_id")
    return topk(scored.select("query_id", "doc_id", ((1 - alpha) * F.col("score") + alpha * X.cosine(F.col("q"), F.col("v"))).alias("score")))


#: Words left out of feedback terms.
STOP = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "had", "not", "but", "his", "her", "they", "you", "all")


def prf_expand(queries: DataFrame, ranked: DataFrame, corpus: DataFrame, docs: int = 3, first: int = 50, terms: int = 5) -> DataFrame:
    """Queries with the commonest longer words of their best documents appended (ties in alphabetical order)."""
    best = ranked.where(F.col("rank") <= docs).join(corpus.select("doc_id", F.slice(X.tokens(F.col("text")), 1, first).alias("w")), "doc_id")
    words = best.select("query_id", F.explode("w").alias("t")).where((F.length("t") > 3) & ~F.col("t").isin(*STOP))
    counted = words.groupBy("query_id", "t").agg(F.count("*").alias("n"))
    top = topk(counted, terms, score="n", tie="t").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("x"))
    added = F.array_join(F.transform("x", lambda r: r["t"]), " ")
    return queries.join(top, "query_id", "left").select("query_id", F.concat_ws(" ", "text", added).alias("text"))


def search_rewrites(rewrites: DataFrame, index: Index | DataFrame, k: int = 10) -> DataFrame:
    """Best score of each document over a query's rewrites(query_id, rewrite_no, text), and the rewrite that gave it. index: a stored one, or the corpus."""
    numbered = rewrites.select(F.struct("query_id", "rewrite_no").alias("query_id"), "text")
    search = bm25_search if isinstance(index, Index) else corpus_search
    hits = search(numbered, index, k).select(F.col("query_id.query_id").alias("q"), F.col("query_id.rewrite_no").alias("r"), "doc_id", "score")
    best = hits.groupBy(F.col("q").alias("query_id"), "doc_id").agg(F.max("score").alias("score"), F.max_by("r", F.struct("score", -F.col("r"))).alias("rewrite_no"))
    return topk(best, k)


def explain_rank(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Place and score of given (query_id, doc_id) pairs; found is false outside the ranking."""
    got = pairs.join(ranked.select("query_id", "doc_id", "score", "rank"), ["query_id", "doc_id"], "left")
    return got.select("query_id", "doc_id", "score", "rank", F.col("rank").isNotNull().alias("found"))


def compare_rankings(a: DataFrame, b: DataFrame, k: int = 10, moved: int = 2) -> DataFrame:
    """Per query: documents in both heads, documents that moved at least `moved` places, and documents only in b's head."""
    x = a.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("ra"))
    y = b.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("rb"))
    both = x.join(y, ["query_id", "doc_id"], "full_outer")
    return both.groupBy("query_id").agg(
        F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("overlap"),
        F.count_if(F.abs(F.col("ra") - F.col("rb")) >= moved).alias("moved"),
        F.count_if(F.col("ra").isNull()).alias("promoted"),
    )


def context_bias(ranked: DataFrame, corpus: DataFrame, device: str = "mobile", network: str = "slow") -> DataFrame:
    """Scores less a share of the text's length on slow networks, and of the title's on small screens."""
    c = corpus.select("doc_id", F.length("text").alias("n_text"), F.length("title").alias("n_title"))
    less = F.lit(0.0)
    if network == "slow":
        less = less + F.least(F.col("n_text") / 2000.0, F.lit(1.0)) * 0.05
    if device == "mobile":
        less = less + F.least(F.col("n_title") / 80.0, F.lit(1.0)) * 0.03
    return topk(ranked.drop("rank").join(c, "doc_id").select("query_id", "doc_id", (F.col("score") - less).alias("score")))


def suggest(prefixes: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """First n documents (by doc_id) whose title contains each prefix, without regard to case."""
    low = prefixes.select("prefix", F.lower("prefix").alias("needle"))
    hit = substring_pairs(corpus.select("doc_id", "title", F.lower("title").alias("low")), low, "low").join(low.distinct(), "needle")
    order = Window.partitionBy("prefix").orderBy("doc_id")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("prefix", "doc_id", "title", "rank")


def cosine_neighbors(vectors: DataFrame, k: int = 10) -> DataFrame:
    """Best k other documents by cosine for a stated set of query vectors: vectors(doc_id, embedding, is_query)."""
    asked = vectors.where("is_query").select(F.col("doc_id").alias("query_id"), "embedding")
    found = dense_search(asked, vectors.select("doc_id", "embedding"), k + 1)
    return topk(found.where("query_id <> doc_id").drop("rank"), k)


def zero_shot_tags(items: DataFrame, prompts: DataFrame, k: int = 3, least: float = 0.15, temperature: float = 0.1) -> DataFrame:
    """Best k prompts of each item by softmax over cosines to all prompt vectors, those above `least`. prompts is a small fixed table."""
    pairs = items.select("doc_id", F.col("embedding").alias("v")).crossJoin(F.broadcast(prompts.select("tag", F.col("embedding").alias("p"))))
    cos = pairs.select("doc_id", "tag", X.cosine(F.col("v"), F.col("p")).alias("cos"))
    p = softmax(cos, "doc_id", "cos", temperature).withColumnRenamed("p", "score")
    return topk(p, k, by="doc_id", tie="tag").where(F.col("score") > least).select("doc_id", "tag", "score", "rank")


def softmax(df: DataFrame, by: str, score: str, temperature: float = 1.0) -> DataFrame:
    """df with `p`, the max-shifted softmax of each key's scores."""
    t, w = max(temperature, 0.01), Window.partitionBy(by)
    e: Column = F.exp((F.col(score) - F.max(score).over(w)) / t)
    return df.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")
