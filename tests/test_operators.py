"""Small tables worked out by hand, and properties."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators import evaluate as M
from marquee.operators import graphs as G
from marquee.operators import health as V
from marquee.operators import querylog as N
from marquee.operators import ranking as L
from marquee.operators import relational as J
from marquee.operators import retrieval as R

RANKED = "query_id long, doc_id long, score double, rank int"
QRELS = "query_id long, doc_id long, relevance int"


def ranking(spark, docs, query=1):
    return spark.createDataFrame([(query, d, 1.0 / (i + 1), i + 1) for i, d in enumerate(docs)], RANKED)


def one(df, column):
    return df.first()[column]


def test_ndcg_of_a_perfect_and_a_worse_ranking(spark):
    qrels = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 0)], QRELS)
    assert one(M.ndcg(ranking(spark, [1, 2, 3]), qrels), "ndcg") == 1.0
    worse = one(M.ndcg(ranking(spark, [3, 2, 1]), qrels), "ndcg")
    assert math.isclose(worse, (1 / math.log2(3) + 3 / 2) / (3 + 1 / math.log2(3)))


def test_metrics_without_judgements_are_zero(spark):
    none = spark.createDataFrame([], QRELS)
    got = ranking(spark, [1, 2])
    for f, c in ((M.ndcg, "ndcg"), (M.recall, "recall"), (M.average_precision, "ap"), (M.reciprocal_rank, "rr"), (M.precision, "precision")):
        assert one(f(got, none), c) == 0.0


def test_empty_tables_give_empty_results(spark):
    none, qrels = spark.createDataFrame([], RANKED), spark.createDataFrame([(1, 1, 1)], QRELS)
    assert M.ndcg(none, qrels).count() == 0
    assert R.rrf_merge(none, none).count() == 0
    assert R.hybrid_merge(none, none).count() == 0
    assert M.rank_agreement(none, none).count() == 0


def test_minmax_of_one_equal_and_spread_scores(spark):
    rows = [(1, 1, 2.0, 1), (2, 1, 5.0, 1), (2, 2, 5.0, 2), (3, 1, 4.0, 1), (3, 2, 2.0, 2), (3, 3, 3.0, 3)]
    got = {(r.query_id, r.doc_id): r.norm for r in R.minmax(spark.createDataFrame(rows, RANKED), ["query_id"]).collect()}
    assert math.isclose(got[1, 1], 1 / (1 + math.exp(-2)))
    assert got[2, 1] == got[2, 2] == 0.5
    assert (got[3, 1], got[3, 2], got[3, 3]) == (1.0, 0.0, 0.5)


def test_splice_keeps_the_head_and_appends_the_rest(spark):
    out = R.splice(ranking(spark, [5, 4]), ranking(spark, [1, 4, 2])).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [5, 4, 1, 2]


def test_ties_go_to_the_smaller_document(spark):
    rows = spark.createDataFrame([(1, d, 1.0, 1) for d in (9, 3, 5)], RANKED).drop("rank")
    assert [r.doc_id for r in R.topk(rows, 2).orderBy("rank").collect()] == [3, 5]


def test_dense_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    docs = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "doc_id long, embedding array<float>")
    queries = docs.where("doc_id < 3").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.rank): r.doc_id for r in R.dense_search(queries, docs, 5, block=7).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(3):
        assert [got[q, r] for r in range(1, 6)] == list(np.argsort(-(n @ n[q]))[:5])


def test_mmr_with_all_weight_on_relevance_is_the_ranking(spark):
    items = spark.createDataFrame([(d, ["a", "b"][d % 2 :]) for d in range(6)], "doc_id long, genres array<string>")
    assert [r.doc_id for r in L.mmr_genre(ranking(spark, [3, 1, 5, 0]), items, lam=1.0).orderBy("rank").collect()] == [3, 1, 5, 0]


def test_expand_takes_the_fewest_hops(spark):
    edges = G.both_ways(spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.3)], "src long, dst long, weight double"))
    got = {r.doc_id: (r.hops, round(r.score, 6)) for r in G.expand(spark.createDataFrame([(7, 1)], "query_id long, doc_id long"), edges).collect()}
    assert got == {2: (1, 0.9), 3: (1, 0.3)}


def test_trailing_run_stops_at_the_latest_failure(spark):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:00:00", ok) for h, ok in enumerate([True, False, True, True, True])], "ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert one(V.trailing_run_hours(rows, "ts", "ok"), "hours") == 2.0
    assert one(V.trailing_run_hours(rows.limit(0), "ts", "ok"), "hours") == 0.0


def test_validate_counts_each_rule(spark):
    rows = spark.createDataFrame([(1, "abc"), (1, None), (2, "x")], "doc_id long, text string")
    got = {r["check"]: r.n_failed for r in V.validate(rows, "doc_id", ["text"], text="text", min_length=2).collect()}
    assert got == {"missing_text": 1, "short_text": 1, "duplicate_doc_id": 1}


def test_asof_takes_the_latest_row_before(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k long, t long, x string")
    right = spark.createDataFrame([(1, 2, 0.2), (1, 5, 0.5), (1, 6, 0.6)], "k long, t long, v double")
    assert {r.x: r.v for r in J.asof_previous(left, right, "k", "t", "v").collect()} == {"a": 0.5, "b": None, "c": None}


def test_person_and_decade(spark):
    q = spark.createDataFrame([(1, "movies with Tom Hanks from the 90s"), (2, "drama 2010s")], "query_id long, text string")
    got = {r.query_id: (r.p, r.decades) for r in N.recognise_entities(q).join(q.select("query_id", N.person(F.col("text")).alias("p")), "query_id").collect()}
    assert got == {1: ("Tom Hanks", "1990"), 2: ("", "2010")}


def test_normal_cdf(spark):
    z = spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "z double").select("z", X.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) < 2e-7 for r in z)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=8))
def test_softmax_sums_to_one(spark, scores):
    rows = spark.createDataFrame([(1, float(s)) for s in scores], "q long, score double")
    assert abs(sum(r.p for r in R.softmax(rows, "q", "score").collect()) - 1) < 1e-9


@settings(max_examples=5, deadline=None)
@given(st.permutations(list(range(6))), st.permutations(list(range(6))))
def test_rank_agreement_is_symmetric(spark, a, b):
    x, y = ranking(spark, a), ranking(spark, b)
    assert one(M.rank_agreement(x, y), "tau") == one(M.rank_agreement(y, x), "tau")


def test_the_alpha_with_the_highest_ndcg_is_picked(spark):
    bm25 = spark.createDataFrame([(1, 1, 9.0, 1), (1, 2, 1.0, 2), (2, 5, 3.0, 1), (2, 6, 1.0, 2)], RANKED)
    dense = spark.createDataFrame([(1, 2, 9.0, 1), (1, 1, 1.0, 2), (2, 6, 3.0, 1), (2, 5, 1.0, 2)], RANKED)
    qrels = spark.createDataFrame([(1, 2, 1), (2, 6, 1), (3, 9, 1)], QRELS)
    got = {r.alpha: r for r in R.pick_alpha(R.sweep_alpha(bm25, dense, [0.2, 0.7, 0.8]), qrels).collect()}
    assert [a for a, r in got.items() if r.best] == [0.7]
    assert math.isclose(got[0.7].ndcg, 2 / 3) and math.isclose(got[0.2].ndcg, 2 / math.log2(3) / 3)
