"""Views that Spark reaches by another way than their SQL have the rows of that SQL."""

from marquee.plans.fixtures import VIEWS, Data


def test_judgements_by_words_equal_the_view(spark, tmp_path):
    """no row for each benchmark and document is made, also for blanks side by side, repeated words and texts at their ends."""
    asked = [(0, "Se que que osllra"), (1, "a b"), (2, "x  y"), (3, "one"), (4, ""), (5, "q Ábc É z"), (6, "q a b"), (7, None)]
    texts = [(0, "say QUE que more"), (1, "b a b"), (2, "x  y a z"), (3, ""), (4, " a "), (5, "ábc ábc é \u0130 é"), (6, None), (7, "a\nb a b\n a"), (8, "   ")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(n, t, "en", "s", 1) for n, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    d = Data(spark, str(tmp_path))
    got = d.qrels
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    for name in ("benchmark", "documents"):
        getattr(d, name).createOrReplaceTempView(name)
    want = spark.sql(VIEWS["qrels"])
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
