"""Helpers shared by the corpus operators: tables kept in the cluster's shared folder, per-document Arrow maps, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Whether Spark deletes an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="marquee-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives the loss of any executor.

    Once the table is written nothing reads the shuffle files behind it, so Spark is asked to delete them then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marquee/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose Python workers find this package where the driver found it, unless their path names it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, *paths) if x)
    return df.mapInArrow(run, schema)


def text_rows(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text of `documents` (and further columns) alone, so that extra columns of any name can't clash; null text counts as empty."""
    return df.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


def map_texts(df: DataFrame, maker: Callable[[], Callable[[list[str]], list[list]]], fields: str) -> DataFrame:
    """doc_id and one set of values per text of df(doc_id, text).

    maker() runs once per task and returns a function from the texts of an Arrow batch to columns, in the order of
    `fields` (a DDL string without doc_id). Batches are bounded by spark.sql.execution.arrow.maxBytesPerBatch.
    """
    out = T.StructType.fromDDL(f"doc_id bigint, {fields}")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = maker()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = work(texts)
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=f.type) for c, f in zip(made, list(arrow)[1:], strict=True))], schema=arrow)

    return map_arrow(df.select("doc_id", "text"), run, out)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(src, dst), component = the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change. Each step is
    two grouped minima and two equi-joins; every round is written to the shared folder, so that lineage stays short.
    """
    spark = edges.sparkSession
    now = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        step = materialise(small.union(lowest.select("hi", F.col("m").alias("lo"))).distinct())
        discard(now)
        now = step
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
