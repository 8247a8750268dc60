"""The pipeline's stages: what goes, what stays, and that nothing else changes."""

import corpus_pipeline as P
from common_rows import awkward
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert tuple(out.columns) == P.COLUMNS, name
        n = out.count()
        assert 0 < n <= docs.count(), name
        if name in ("line_dedup", "secrets"):
            assert n == docs.count()
        docs = out
    packed = P.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_dedup_keeps_the_smallest_of_each_group(spark):
    docs = awkward(spark)
    kept = {r.doc_id for r in P.near_dedup(spark, docs, FOLDER).collect()}
    assert 1 in kept and 2 not in kept and 4 in kept and 6 not in kept and None in kept


def test_secrets_are_gone_afterwards(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = P.secrets(spark, docs, FOLDER).where(F.col("text").rlike("AKIA[A-Z0-9]{16,}"))
    assert left.count() == 0


def test_run_on_awkward_rows(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
