"""Files in and out: ratings, catalogue text, judgements, splits and graphs, with explicit schemas and no inference pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which ratings' columns come.
ALIASES = {"user_id": ("user_id", "userId", "user"), "doc_id": ("doc_id", "movieId", "item_id", "item"), "rating": ("rating", "score", "stars"), "ts": ("ts", "timestamp")}


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: userId, movieId, rating, timestamp in seconds."""
    rows = spark.read.schema("userId bigint, movieId bigint, rating double, timestamp bigint").csv(path, header=True)
    return normalize_ratings(rows)


def normalize_ratings(df: DataFrame, default: float = 3.5) -> DataFrame:
    """(user_id, doc_id, rating, rated_at) from columns under any known name; a missing rating is `default`, rows without both ids go."""
    found = {name: next((c for c in names if c in df.columns), None) for name, names in ALIASES.items()}
    if not found["user_id"] or not found["doc_id"]:
        raise ValueError(f"no user or item column among {df.columns}")
    rating = F.coalesce(F.col(found["rating"]).cast("double"), F.lit(default)) if found["rating"] else F.lit(default)
    at = F.timestamp_seconds(F.col(found["ts"])) if found["ts"] else F.lit(None).cast("timestamp")
    rows = df.select(F.col(found["user_id"]).alias("user_id"), F.col(found["doc_id"]).alias("doc_id"), rating.alias("rating"), at.alias("rated_at"))
    return rows.where("trim(cast(user_id as string)) <> '' and trim(cast(doc_id as string)) <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str = "doc_id string, title string, text string") -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(path).where(" or ".join(f"{c.split()[0]} is not null" for c in schema.split(", ")))


def read_qrels_map(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of a JSON object {query: {document: relevance}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
    return whole.select(F.explode("m").alias("query_id", "d")).select("query_id", F.explode("d").alias("doc_id", "relevance"))


def read_qrels_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of judgements; a missing relevance is 1."""
    rows = read_jsonl(spark, path, "query_id string, doc_id string, relevance int")
    return rows.select("query_id", "doc_id", F.coalesce("relevance", F.lit(1)).alias("relevance"))


def read_qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements of three columns, or of four with an unused second; the header goes, a relevance that is no number is 1, only positive ones stay."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    wide = F.size("p") >= 4
    rows = parts.select(F.col("p")[0].alias("query_id"), F.when(wide, F.get("p", F.lit(2))).otherwise(F.col("p")[1]).alias("doc_id"), F.when(wide, F.get("p", F.lit(3))).otherwise(F.col("p")[2]).alias("r"))
    body = rows.where(~F.lower("query_id").isin("query-id", "query_id", "qid"))
    return body.select("query_id", "doc_id", F.coalesce(F.expr("try_cast(r as int)"), F.lit(1)).alias("relevance")).where("relevance > 0")


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, replacing what is there; partitioned by a column on request."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_split(df: DataFrame, key: str, path: str, val: float = 0.1, test: float = 0.1) -> None:
    """Rows partitioned into train, val and test by a hash of a key, so that a key's rows stay together."""
    u = F.pmod(F.xxhash64(key), F.lit(10_000)) / 10_000
    save(df.withColumn("split", F.when(u < val, "val").when(u < val + test, "test").otherwise("train")), path, "split")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    save(nodes, f"{path}/nodes")
    save(edges, f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
