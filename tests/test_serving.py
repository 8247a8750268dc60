"""Hand-worked tables of operators that SQL doesn't state."""

from marquee.operators import serving as S


def test_household_takes_turns(spark):
    rows = [(1, "a", d, 1.0 / r, r) for r, d in enumerate("xyz", 1)] + [(1, "b", d, 1.0 / r, r) for r, d in enumerate("xwv", 1)] + [(2, "c", "q", 0.5, 1)]
    feeds = spark.createDataFrame(rows, "household_id long, profile string, doc_id string, score double, rank int")
    got = sorted((r.household_id, r.position, r.profile, r.doc_id) for r in S.merge_household(feeds, 4).collect())
    assert got == [(1, 1, "a", "x"), (1, 2, "b", "w"), (1, 3, "a", "y"), (1, 4, "b", "v"), (2, 1, "c", "q")]
    uneven = sorted((r.position, r.profile) for r in S.merge_household(feeds.where("household_id = 1"), 4, {"a": 3.0, "b": 1.0}).collect())
    assert uneven == [(1, "a"), (2, "b"), (3, "a"), (4, "a")]


def test_graph_search_leaves_out_its_seeds(spark):
    corpus = spark.createDataFrame([(1, "red ring", "red ring"), (2, "blue bolt", "blue bolt"), (3, "green gear", "green gear")], "doc_id long, title string, text string")
    edges = spark.createDataFrame([(1, 2, 0.5, "genre"), (2, 1, 0.5, "genre"), (2, 3, 0.5, "genre"), (3, 2, 0.5, "genre")], "src long, dst long, weight double, edge_type string")
    queries = spark.createDataFrame([(7, "red ring")], "query_id long, text string")
    got = {(r.doc_id, r.hops) for r in S.graph_search(queries, corpus, edges, seeds=1).collect()}
    assert got == {(2, 1), (3, 2)}


def test_scores_of_counts_are_exact(spark):
    """what SQL computes by whole numbers, to the last bit, as flat rankings are scaled by what is left of their differences."""
    import math
    import random

    from marquee.operators.retrieval import dense_search

    rng = random.Random(3)
    made = {n: [float(rng.randrange(4)) for _ in range(63)] + [1.0] for n in range(90)}
    rows = spark.createDataFrame(list(made.items()), "doc_id long, embedding array<double>")
    got = dense_search(rows.where("doc_id < 7").withColumnRenamed("doc_id", "query_id"), rows, 90).collect()
    size = {n: math.sqrt(sum(x * x for x in v)) for n, v in made.items()}
    assert len(got) == 7 * 90
    assert all(r.score == sum(x * y for x, y in zip(made[r.query_id], made[r.doc_id])) / size[r.query_id] / size[r.doc_id] for r in got)


def test_a_query_without_words_finds_nothing(spark):
    """documents that share no word's place with a query are no hits, however few others there are."""
    corpus = spark.createDataFrame([(n, f"red ring {n}", "text") for n in range(30)], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(1, "¿¿ ñ"), (2, "red")], "query_id long, text string")
    assert {r.query_id for r in S.search(queries, corpus).collect()} == {2}
    assert S.hashed_search(queries.where("query_id = 1"), corpus).count() == 0
