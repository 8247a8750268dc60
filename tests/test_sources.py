"""Files written and read back."""

from marquee.sources import files as S


def test_ratings_under_other_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,2,4.5,0\n1,3,,5\n,4,3.0,1\n")
    got = S.read_ratings(spark, str(tmp_path / "r.csv")).orderBy("doc_id").collect()
    assert [(r.user_id, r.doc_id, r.rating) for r in got] == [(1, 2, 4.5), (1, 3, 3.5)]


def test_judgements(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"q1": {"d1": 2, "d2": 0}, "q2": {"d3": 1}}')
    assert sorted(map(tuple, S.read_qrels_map(spark, str(tmp_path / "m.json")).collect())) == [("q1", "d1", 2), ("q1", "d2", 0), ("q2", "d3", 1)]
    (tmp_path / "q.jsonl").write_text('{"query_id": "q1", "doc_id": "d1"}\n\n{"query_id": "q1", "doc_id": "d2", "relevance": 3}\n')
    assert sorted(map(tuple, S.read_qrels_jsonl(spark, str(tmp_path / "q.jsonl")).collect())) == [("q1", "d1", 1), ("q1", "d2", 3)]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\nq2\td3\tx\nq3\t0\td4\t1\n")
    assert sorted(map(tuple, S.read_qrels_tsv(spark, str(tmp_path / "q.tsv")).collect())) == [("q1", "d1", 2), ("q2", "d3", 1), ("q3", "d4", 1)]


def test_splits_and_graphs(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 60 AS query_id", "id AS doc_id")
    S.write_split(rows, "query_id", str(tmp_path / "s"), 0.2, 0.2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 300 and back.select("query_id", "split").distinct().count() == 60
    S.save_graph(rows, rows, str(tmp_path / "g"))
    assert [t.count() for t in S.load_graph(spark, str(tmp_path / "g"))] == [300, 300]
