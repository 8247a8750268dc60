"""Rounding and white space as in the SQL of a query, on rows that the given tables have few of."""

from datetime import datetime

from oracle import assert_same, connect

from marquee.operators import reports
from marquee.operators import retrieval as R
from marquee.plans import registry


def test_gates_are_rounded_as_sql_rounds(spark):
    """F16: halves by their decimals alone, and values that round to nothing."""
    values = [0.00015, 0.00145, 0.12345, 0.2, -0.09935, -0.00003]
    artifacts = spark.createDataFrame([(1, "r", "f", "ltr", 0.5, True, datetime(2024, 1, 1))], "artifact_id long, run_id string, flow_name string, artifact_type string, ndcg_at_10 double, is_active boolean, created_at timestamp")
    gates = spark.createDataFrame([(n, 1, f"g{n}", v, False) for n, v in enumerate(values)], "gate_id long, artifact_id long, gate_name string, measured_value double, passed boolean")
    con = connect()
    for name, rows in (("model_artifacts", artifacts), ("quality_gates", gates)):
        con.register(f"{name}_rows", rows.toPandas())
    sql = registry.families()["q06_promotion_audit"][1]
    want = con.execute(sql.replace("model_artifacts", "model_artifacts_rows").replace("quality_gates", "quality_gates_rows")).df()
    got = reports.promotion_audit(artifacts, gates).toPandas()
    assert "g0=0.0001, g1=0.0014" in got["failed_gates"][0]
    assert_same(got, want)


def test_white_space_as_sql_cuts_it(spark):
    """empty documents have no words, and a vertical tab is part of one."""
    rows = [(1, "", ""), (2, "a\x0bb", "c"), (3, " \t", "\n\r\f "), (4, "one two", " three\u00a0four"), (5, "\u0130x", "y\x1cz\x85")]
    corpus = spark.createDataFrame(rows, "doc_id long, title string, text string")
    con = connect()
    con.register("rows", corpus.toPandas())
    want = con.execute(registry.families()["r04_index_whitespace"][1].replace("FROM corpus", "FROM rows")).df()
    index = R.build_index(corpus, tokenizer="space")
    assert_same(index.docs.select("doc_id", "dl").toPandas(), want)
    assert index.terms.where("term = '__empty__'").count() == 0
