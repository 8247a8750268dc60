"""Working tables: results written to the folder that all executors share, and read back."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="marquee-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder that nothing else uses."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a stored table: what reads it several times computes it once, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Asks Spark to delete an execution's shuffle files when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_in_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """One stored table of all parts, written one after the other; the shuffle files of each go before the next begins."""
    path, schema = None, None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or new_folder(spark, "tables")
        before = spark.conf.get(CLEAN_UP, None)
        spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, unless their path names it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, *paths) if x)
