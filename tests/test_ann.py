"""The inverted file against exact search."""

import numpy as np
from oracle import FOLDER
from pyspark.sql import functions as F

from marquee.operators import ann
from marquee.operators import retrieval as R
from marquee.plans.fixtures import Data
from marquee.plans.retrieval import vectors


def test_recall_at_ten_of_the_given_vectors(spark):
    d = Data(spark, FOLDER)
    index = ann.build_ivf(vectors(d), n_lists=32)
    exact = R.dense_search(d.query_vectors, vectors(d), 10)
    got = {r.nprobe: r for r in ann.recall_by_nprobe(d.query_vectors, vectors(d), index, exact, grid=(1, 4, 16)).collect()}
    assert got[1].queries == 10
    assert got[1].recall <= got[4].recall <= got[16].recall
    assert got[16].recall >= 0.9, got
    # every vector is filed once
    assert index.blocks.agg(F.sum("n")).first()[0] == vectors(d).count()
    filed = np.concatenate([np.frombuffer(r.ids, np.int64) for r in index.blocks.collect()])
    assert sorted(filed.tolist()) == sorted(r.doc_id for r in vectors(d).collect())


def test_probing_and_refining_everything_is_exact(spark):
    d = Data(spark, FOLDER)
    index = ann.build_ivf(vectors(d), n_lists=4)
    exact = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in R.dense_search(d.query_vectors, vectors(d), 5).collect()}
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in ann.ivf_search(d.query_vectors, vectors(d), index, 5, nprobe=4, refine=100).collect()}
    assert got == exact


def test_a_hot_list_is_split_and_odd_rows_are_filed(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(1)
    rows = [(n, [1.0, 0.5, *[0.0] * 14]) for n in range(200)] + [(200 + n, rng.normal(size=16).tolist()) for n in range(100)] + [(300, [0.0] * 16), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    index = ann.build_ivf(docs, n_lists=8)
    sizes = index.blocks.groupBy("list").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
    assert sum(r.n for r in sizes) == 301 and max(r.parts for r in sizes) >= 4
    asked = docs.where("doc_id in (0, 250, 301)").withColumnRenamed("doc_id", "query_id")
    got = ann.ivf_search(asked, docs, index, 3, nprobe=8).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(0, 1), (0, 2), (0, 3), (250, 1), (250, 2), (250, 3)]
    assert {r.doc_id for r in got if r.query_id == 250 and r["rank"] == 1} == {250}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "doc_id long, embedding array<double>")
    index = ann.build_ivf(none)
    assert ann.ivf_search(none.withColumnRenamed("doc_id", "query_id"), none, index).count() == 0


def test_codes_are_near_what_they_stand_for(spark):
    d = Data(spark, FOLDER)
    index = ann.build_ivf(vectors(d))
    approximate = ann.coarse_search(d.query_vectors, index, 20, 16)
    exact = R.dense_search(d.query_vectors, vectors(d), 500).select("query_id", "doc_id", F.col("score").alias("true"))
    gap = approximate.join(exact, ["query_id", "doc_id"]).agg(F.max(F.abs(F.col("score") - F.col("true"))).alias("gap"), F.count("*").alias("n")).first()
    assert gap.n == 200 and gap.gap < 0.35
