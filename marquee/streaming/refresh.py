"""Features kept up to date as ratings arrive, without reading old ratings again.

Each batch leaves partial aggregates that merge exactly: counts, sums, sums of squared deviations from the batch's own
mean, extremes, and the distinct pairs of user and item. A replayed batch overwrites its own folder, so it counts once.
After every `fold` batches the partials are merged into one base table, which a marker makes valid only when it is whole;
reading merges the base with the batches after it, so a read's work doesn't grow with the number of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.operators.features import EPS, recency_bucket, release_year

#: Partial aggregates of a key: rows, sum, squared deviations from the mean; of users also extremes, high and low ratings and the latest.
MOMENTS = "n bigint, total double, m2 double"
USERS = f"user_id bigint, {MOMENTS}, low double, top double, n_high bigint, n_low bigint, last timestamp"
ITEMS = f"doc_id bigint, {MOMENTS}"
PAIRS = "user_id bigint, doc_id bigint"


def _moments() -> list[Column]:
    n = F.count("*")
    return [n.alias("n"), F.sum("rating").cast("double").alias("total"), (F.coalesce(F.var_samp("rating"), F.lit(0.0)) * (n - 1)).alias("m2")]


def _merged(partials: DataFrame, key: str, *more: Column) -> DataFrame:
    """Partials of one row a key, by the pairwise rule of Chan, Golub and LeVeque: deviations of the parts and of their means."""
    w = Window.partitionBy(key)
    mean = F.sum("total").over(w) / F.sum("n").over(w)
    gap = F.col("total") / F.col("n") - F.col("mean")
    return partials.withColumn("mean", mean).groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"), *more)


def _user_columns() -> list[Column]:
    return [F.min("low").alias("low"), F.max("top").alias("top"), F.sum("n_high").alias("n_high"), F.sum("n_low").alias("n_low"), F.max("last").alias("last")]


class FeatureStore:
    """Partial aggregates of ratings(user_id, doc_id, rating, rated_at) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, fold: int = 16) -> None:
        self.spark, self.folder, self.fold = spark, folder, fold
        self._mark(-1, "ignore")

    def _mark(self, upto: int, mode: str = "overwrite") -> None:
        self.spark.range(1).select(F.lit(upto).alias("n")).coalesce(1).write.mode(mode).parquet(f"{self.folder}/whole/upto={upto}")

    def _upto(self) -> int:
        return self.spark.read.schema("n int, upto int").parquet(f"{self.folder}/whole").agg(F.max("upto")).first()[0]

    def _table(self, name: str, schema: str) -> DataFrame:
        """The base's partials and those of the batches after it."""
        upto = self._upto()
        none = self.spark.createDataFrame([], schema)
        base = self.spark.read.schema(schema).parquet(f"{self.folder}/base/upto={upto}/{name}") if upto >= 0 else none
        later = [n for n in self._batches() if n > upto]
        if not later:
            return base
        return base.unionByName(self.spark.read.schema(schema).parquet(*(f"{self.folder}/batches/batch={n}/{name}" for n in later)))

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batches")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _batches(self) -> list[int]:
        files, path = self._files()
        return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(path)) if files.exists(path) else []

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Add a batch of ratings under its number; the same number again replaces what it left before."""
        out = f"{self.folder}/batches/batch={number}"
        rated = batch.select(F.col("user_id").cast("long").alias("user_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("rating").cast("double").alias("rating"), F.col("rated_at").cast("timestamp").alias("rated_at"))
        users = rated.groupBy("user_id").agg(*_moments(), F.min("rating").alias("low"), F.max("rating").alias("top"), F.count_if(F.col("rating") >= 4).alias("n_high"), F.count_if(F.col("rating") <= 2).alias("n_low"), F.max("rated_at").alias("last"))
        users.write.mode("overwrite").parquet(f"{out}/users")
        rated.groupBy("doc_id").agg(*_moments()).write.mode("overwrite").parquet(f"{out}/items")
        rated.select("user_id", "doc_id").distinct().write.mode("overwrite").parquet(f"{out}/pairs")
        if (number + 1) % self.fold == 0:
            self.merge(number)

    def merge(self, number: int) -> None:
        """Make one base of everything up to a batch, then let the batches before it go; the batch itself may still be replayed."""
        if number <= self._upto():
            return
        base = f"{self.folder}/base/upto={number}"
        _merged(self._table("users", USERS), "user_id", *_user_columns()).write.mode("overwrite").parquet(f"{base}/users")
        _merged(self._table("items", ITEMS), "doc_id").write.mode("overwrite").parquet(f"{base}/items")
        self._table("pairs", PAIRS).distinct().write.mode("overwrite").parquet(f"{base}/pairs")
        self._mark(number)
        files, _ = self._files()
        for n in self._batches():
            if n < number:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batches/batch={n}"), True)

    def users(self) -> DataFrame:
        """The columns of features.user_features() over all ratings absorbed so far."""
        titles = self._table("pairs", PAIRS).distinct().groupBy("user_id").agg(F.count("*").alias("n_titles"))
        n = F.col("n")
        return _merged(self._table("users", USERS), "user_id", *_user_columns()).join(titles, "user_id").select(
            "user_id",
            n.alias("n_ratings"),
            (F.col("total") / n).alias("avg_rating"),
            F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std_rating"),
            F.col("low").alias("min_rating"),
            F.col("top").alias("max_rating"),
            "n_titles",
            (F.col("n_high") / (n + EPS)).alias("high_ratio"),
            (F.col("n_low") / (n + EPS)).alias("low_ratio"),
            F.log1p("n_titles").alias("diversity"),
            F.col("last").alias("last_active"),
        )

    def items(self, items: DataFrame) -> DataFrame:
        """The columns of features.item_features() over all ratings absorbed so far."""
        raters = self._table("pairs", PAIRS).distinct().groupBy("doc_id").agg(F.count("*").alias("n_users"))
        n = F.col("n")
        stats = _merged(self._table("items", ITEMS), "doc_id").join(raters, "doc_id").select(
            "doc_id", n.alias("n_ratings"), (F.col("total") / n).alias("sentiment"), F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("controversy"), "n_users"
        )
        known = stats.join(items.select("doc_id", "title", "genres"), "doc_id", "left")
        return known.select("*", F.log1p("n_ratings").alias("popularity"), release_year(F.col("title")).alias("year")).withColumn("recency", recency_bucket(F.col("year")))


def refresh(sdf: DataFrame, folder: str, fold: int = 16) -> FeatureStore:
    """Absorb what a stream of ratings has now; the store goes on from the folder's checkpoint."""
    store = FeatureStore(sdf.sparkSession, f"{folder}/store", fold)
    query = sdf.writeStream.foreachBatch(store.absorb).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return store
