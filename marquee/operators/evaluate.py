"""Offline ranking metrics. Rankings are (query_id, doc_id, rank), judgements (query_id, doc_id, relevance).

Every query of the ranking counts; one without judgements has 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as X


def gain(relevance: Column, kind: str = "graded") -> Column:
    return F.pow(F.lit(2.0), relevance) - 1 if kind == "graded" else (relevance > 0).cast("double")


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ranking with relevance, 0 where there is no judgement."""
    both = ranked.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left")
    return both.withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def _dcg(rank: Column, relevance: Column, kind: str) -> Column:
    return F.sum(gain(relevance, kind) / F.log2(rank + 1))


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10, ideal: str = "all", kind: str = "graded") -> DataFrame:
    """(query_id, ndcg): against the best order of all judgements, or of the retrieved documents only ("retrieved")."""
    rated = judged(ranked, qrels)
    got = rated.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("relevance"), kind) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    pool = qrels if ideal == "all" else rated
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance")))
    best = pool.withColumn("p", place).where(F.col("p") <= k).groupBy("query_id").agg(_dcg(F.col("p"), F.col("relevance"), kind).alias("idcg"))
    return got.join(best, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def _hits(ranked: DataFrame, qrels: DataFrame, k: int, min_rel: int) -> DataFrame:
    rated = judged(ranked, qrels).where(F.col("rank") <= k)
    return rated.groupBy("query_id").agg(F.count_if(F.col("relevance") >= min_rel).alias("hits"))


def _relevant(qrels: DataFrame, min_rel: int) -> DataFrame:
    return qrels.where(F.col("relevance") >= min_rel).groupBy("query_id").agg(F.count("*").alias("n_relevant"))


def recall(ranked: DataFrame, qrels: DataFrame, k: int = 100, min_rel: int = 1) -> DataFrame:
    both = _hits(ranked, qrels, k, min_rel).join(_relevant(qrels, min_rel), "query_id", "left")
    return both.select("query_id", F.coalesce(F.col("hits") / F.col("n_relevant"), F.lit(0.0)).alias("recall"))


def precision(ranked: DataFrame, qrels: DataFrame, k: int = 10, min_rel: int = 1) -> DataFrame:
    return _hits(ranked, qrels, k, min_rel).select("query_id", (F.col("hits") / k).alias("precision"))


def average_precision(ranked: DataFrame, qrels: DataFrame, k: int = 10, min_rel: int = 1) -> DataFrame:
    rated = judged(ranked, qrels).where(F.col("rank") <= k).withColumn("hit", (F.col("relevance") >= min_rel).cast("int"))
    running = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = rated.withColumn("seen", running).groupBy("query_id").agg(F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("s"))
    return sums.join(_relevant(qrels, min_rel), "query_id", "left").select("query_id", F.coalesce(F.col("s") / F.col("n_relevant"), F.lit(0.0)).alias("ap"))


def reciprocal_rank(ranked: DataFrame, qrels: DataFrame, min_rel: int = 1) -> DataFrame:
    first = judged(ranked, qrels).groupBy("query_id").agg(F.min(F.when(F.col("relevance") >= min_rel, F.col("rank"))).alias("r"))
    return first.select("query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("rr"))


def oracle_ndcg(candidates: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """nDCG of the candidates in their best order."""
    rated = judged(candidates.drop("rank"), qrels).drop("relevance")
    best = judged(rated, qrels).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))).drop("relevance")
    return ndcg(best, qrels, k)


def _pairs(df: DataFrame, value: str) -> DataFrame:
    """Pairs of rows of a query by rank (i < j); rankings are cut before, so a query has few."""
    a = df.select("query_id", F.col("rank").alias("i"), F.col(value).alias("a"))
    b = df.select("query_id", F.col("rank").alias("j"), F.col(value).alias("b"))
    return a.join(b, "query_id").where("i < j")


def diversity(ranked: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Mean pairwise Jaccard distance of the genres (array) of the first k documents."""
    head = ranked.where(F.col("rank") <= k).join(items.select("doc_id", "genres"), "doc_id")
    return _pairs(head, "genres").groupBy("query_id").agg(F.avg(1 - X.jaccard(F.col("a"), F.col("b"))).alias("diversity"))


def vector_diversity(ranked: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    head = ranked.where(F.col("rank") <= k).join(vectors.select("doc_id", "embedding"), "doc_id")
    return _pairs(head, "embedding").groupBy("query_id").agg(F.avg(1 - X.cosine(F.col("a"), F.col("b"))).alias("diversity"))


def novelty(ranked: DataFrame, popularity: DataFrame, k: int = 10, unknown: float = 0.01) -> DataFrame:
    """Mean -log2 of popularity, a share in (0, 1]."""
    p = F.greatest(F.coalesce("popularity", F.lit(unknown)), F.lit(1e-9))
    head = ranked.where(F.col("rank") <= k).join(popularity.select("doc_id", "popularity"), "doc_id", "left")
    return head.groupBy("query_id").agg(F.avg(-F.log2(p)).alias("novelty"))


def coherence(ranked: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Share of neighbours in the first k that share a genre; 1 for a page of one."""
    head = ranked.where(F.col("rank") <= k).join(items.select("doc_id", "genres"), "doc_id")
    before = F.lag("genres").over(Window.partitionBy("query_id").orderBy("rank"))
    flagged = head.withColumn("same", F.arrays_overlap("genres", before).cast("int"))
    return flagged.groupBy("query_id").agg(F.coalesce(F.avg("same"), F.lit(1.0)).alias("coherence"))


def macro_average(per_query: DataFrame, value: str, by: str | None = None) -> DataFrame:
    grouped = per_query.groupBy(by) if by else per_query.groupBy()
    return grouped.agg(F.count("*").alias("n_queries"), F.avg(value).alias(f"mean_{value}"))


def evaluate(rankings: dict[str, DataFrame], qrels: DataFrame, k: int = 10, recall_k: int = 100) -> DataFrame:
    """(method, metric, value) of every method: nDCG, MAP, recall, MRR."""
    out = None
    for method, ranked in rankings.items():
        parts = ndcg(ranked, qrels, k).join(average_precision(ranked, qrels, k), "query_id").join(recall(ranked, qrels, recall_k), "query_id").join(reciprocal_rank(ranked, qrels), "query_id")
        wide = parts.agg(F.avg("ndcg").alias(f"ndcg@{k}"), F.avg("ap").alias(f"map@{k}"), F.avg("recall").alias(f"recall@{recall_k}"), F.avg("rr").alias("mrr"))
        long = wide.unpivot([], wide.columns, "metric", "value").withColumn("method", F.lit(method))
        out = long if out is None else out.unionByName(long)
    return out.select("method", "metric", "value")


def slice_metrics(per_query: DataFrame, slices: DataFrame, value: str) -> DataFrame:
    """Means by (dimension, slice) of slices(query_id, dimension, slice)."""
    return per_query.join(slices, "query_id").groupBy("dimension", "slice").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def failure_analysis(base: DataFrame, cand: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query: nDCG of both and their difference, relevant documents in both heads, overlap, first relevant rank."""

    def head(ranked: DataFrame, name: str) -> DataFrame:
        rated = judged(ranked, qrels)
        return rated.groupBy("query_id").agg(F.count_if((F.col("rank") <= k) & (F.col("relevance") > 0)).alias(f"relevant_{name}"), F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias(f"first_{name}"))

    both = overlap_at_k(base, cand, k)
    a, b = ndcg(base, qrels, k).withColumnRenamed("ndcg", "ndcg_base"), ndcg(cand, qrels, k).withColumnRenamed("ndcg", "ndcg_cand")
    wide = a.join(b, "query_id").join(head(base, "base"), "query_id").join(head(cand, "cand"), "query_id").join(both, "query_id", "left")
    return wide.withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumn("delta", F.col("ndcg_cand") - F.col("ndcg_base"))


def overlap_at_k(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    x, y = (r.where(F.col("rank") <= k).select("query_id", "doc_id") for r in (a, b))
    return x.join(y, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("overlap"))


def extremes(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The n rows of the largest and of the smallest value."""
    top = df.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("best"))
    return top.unionByName(df.orderBy(F.asc(value), tie).limit(n).withColumn("side", F.lit("worst")))


def top_misses(ranked: DataFrame, qrels: DataFrame, cutoff: int = 50) -> DataFrame:
    """Judged queries whose best relevant document comes after `cutoff` or not at all."""
    best = judged(ranked, qrels).where("relevance > 0").groupBy("query_id").agg(F.min("rank").alias("best_rank"))
    wanted = qrels.where("relevance > 0").select("query_id").distinct()
    return wanted.join(best, "query_id", "left").where(F.col("best_rank").isNull() | (F.col("best_rank") > cutoff))


def rank_agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per query: documents in both heads, Kendall's tau and mean gap of their ranks, and whether the first agrees."""
    x = a.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("ra"))
    y = b.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("rb"))
    common = x.join(y, ["query_id", "doc_id"])
    left = common.select("query_id", F.col("ra").alias("ra1"), F.col("rb").alias("rb1"))
    right = common.select("query_id", F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    signs = left.join(right, "query_id").where("ra1 < ra2").groupBy("query_id").agg(F.avg(F.signum((F.col("rb2") - F.col("rb1")).cast("double"))).alias("tau"))
    stats = common.groupBy("query_id").agg(F.count("*").alias("overlap"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("gap"), F.max(((F.col("ra") == 1) & (F.col("rb") == 1)).cast("int")).alias("top1"))
    queries = x.select("query_id").distinct()
    wide = queries.join(stats, "query_id", "left").join(signs, "query_id", "left")
    return wide.select("query_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("tau", F.lit(0.0)).alias("tau"), F.coalesce("gap", F.lit(0.0)).alias("avg_position_diff"), (F.coalesce("top1", F.lit(0)) == 1).alias("top1_agreement"))


def agreement_report(agreement: DataFrame) -> DataFrame:
    stats = agreement.agg(F.count("*").alias("total"), F.avg("overlap").alias("avg_overlap"), F.avg("tau").alias("avg_tau"), F.avg(F.col("top1_agreement").cast("int")).alias("top1_rate"))
    return stats.withColumn("recommendation", F.when((F.col("avg_overlap") >= 7) & (F.col("avg_tau") >= 0.8), "promote").otherwise("investigate"))


def split_integrity(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides and those in both."""
    a, b = train.select(key).distinct().withColumn("a", F.lit(1)), test.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count("a").alias("n_train"), F.count("b").alias("n_test"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_overlap"))


def rmse(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    d = F.col(predicted) - F.col(actual)
    return rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))


def lift_table(metrics: DataFrame, base: str) -> DataFrame:
    """metrics(method, metric, value) with the lift over a base method in percent."""
    b = metrics.where(F.col("method") == base).select("metric", F.col("value").alias("base"))
    return metrics.join(F.broadcast(b), "metric").select("method", "metric", "value", F.try_divide(100 * (F.col("value") - F.col("base")), F.col("base")).alias("lift_pct"))


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows(id, query, answer, source): shares of answer words in the source, query words in the answer, and query words in the source."""
    q, a, s = (F.array_distinct(X.tokens(F.col(c))) for c in ("query", "answer", "source"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)

    return rows.select("id", share(a, s).alias("faithfulness"), share(q, a).alias("relevance"), share(q, s).alias("context_recall"))


def near_reference(metrics: DataFrame, reference: float, tolerance: float = 0.05) -> DataFrame:
    return metrics.withColumn("delta", F.col("value") - reference).withColumn("within", F.abs(F.col("delta")) <= reference * tolerance)


def popularity_bias(recs: DataFrame, features: DataFrame, share: float = 0.1) -> DataFrame:
    """Share of recommended documents among the most popular `share` of all, and of the long tail that is recommended at all."""
    ranked = features.select("doc_id", F.row_number().over(Window.orderBy(F.desc("popularity"), "doc_id")).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    head = ranked.select("doc_id", (F.col("r") <= F.floor(F.col("n") * share)).alias("head"))
    seen = recs.groupBy("doc_id").agg(F.count("*").alias("c"))
    both = head.join(seen, "doc_id", "left")
    stats = both.agg(
        F.try_divide(F.sum(F.when(F.col("head"), F.col("c"))), F.sum("c")).alias("head_share"),
        F.try_divide(F.count_if(~F.col("head") & F.col("c").isNotNull()).cast("double"), F.count_if(~F.col("head"))).alias("tail_coverage"),
    )
    return stats.withColumn("biased", F.coalesce(F.col("head_share") > 0.5, F.lit(False)))


def pct_nearest(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """Nearest-rank percentile ceil(p * n) - 1 of each key."""
    return df.groupBy(by).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias("p"))


def pct_rounded(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """Percentile at the rounded index p * (n - 1), halves to even, without gathering a key's rows: by window ranks."""
    w = Window.partitionBy(by)
    ranked = df.where(F.col(value).isNotNull()).select(by, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("r") - 1 == F.bround(F.lit(p) * (F.col("n") - 1), 0)).select(by, F.col(value).alias("p"))
