"""Behavioural features of users, items, genres and pairs of items."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.sources.working import written, written_in_parts

NO_GENRE = "(no genres listed)"
EPS = 1e-9


def user_features(ratings: DataFrame) -> DataFrame:
    """Counts, moments, extremes and shares of high (>= 4) and low (<= 2) ratings of each user, in one pass."""
    n = F.count("*")
    return ratings.groupBy("user_id").agg(
        n.alias("n_ratings"),
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("std_rating"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.count_distinct("doc_id").alias("n_titles"),
        (F.count_if(F.col("rating") >= 4) / (n + EPS)).alias("high_ratio"),
        (F.count_if(F.col("rating") <= 2) / (n + EPS)).alias("low_ratio"),
        F.log1p(F.count_distinct("doc_id")).alias("diversity"),
        F.max("rated_at").alias("last_active"),
    )


def recency_bucket(year: Column) -> Column:
    return F.when(year >= 2010, 1.0).when(year >= 2000, 0.7).when(year >= 1990, 0.4).otherwise(0.2)


def release_year(title: Column) -> Column:
    """The (YYYY) of a title, null without one."""
    return F.nullif(F.regexp_extract(title, r"\((\d{4})\)", 1), F.lit("")).cast("int")


def item_features(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Popularity, sentiment and controversy of each rated item with its release year; items without a row have none."""
    stats = ratings.groupBy("doc_id").agg(
        F.count("*").alias("n_ratings"),
        F.avg("rating").alias("sentiment"),
        F.stddev_samp("rating").alias("controversy"),
        F.count_distinct("user_id").alias("n_users"),
    )
    joined = stats.join(items.select("doc_id", "title", "genres"), "doc_id", "left")
    return joined.select("*", F.log1p("n_ratings").alias("popularity"), release_year(F.col("title")).alias("year")).withColumn("recency", recency_bucket(F.col("year")))


#: Pairs of ratings that are counted at a time.
PAIRS = 250_000_000


def cowatch_pairs(ratings: DataFrame, min_support: int = 5, max_history: int | None = None) -> DataFrame:
    """Pairs of items (a < b) that at least `min_support` users rated, with the mean of the summed ratings.

    max_history keeps each user's latest ratings only, which bounds the pairs of one user by its square. Where all users'
    pairs of ratings are more than PAIRS, they are counted a slice of items a at a time, so that a shuffle holds no more.
    """
    kept = ratings.select("user_id", "doc_id", "rating", "rated_at")
    if max_history:
        kept = last_n(kept, "user_id", "rated_at", max_history, tie="doc_id")
    kept = written(kept.select("user_id", "doc_id", "rating"))
    a = kept.select("user_id", F.col("doc_id").alias("doc_id_a"), F.col("rating").alias("ra"))
    b = kept.select("user_id", F.col("doc_id").alias("doc_id_b"), F.col("rating").alias("rb"))

    def counted(a: DataFrame) -> DataFrame:
        pairs = a.join(b, "user_id").where("doc_id_a < doc_id_b")
        some = pairs.groupBy("doc_id_a", "doc_id_b").agg(F.count("*").alias("co_watch_count"), F.avg(F.col("ra") + F.col("rb")).alias("avg_rating_sum"))
        return some.where(F.col("co_watch_count") >= min_support)

    n = F.col("n").cast("double")
    made = kept.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    slices = max(1, math.ceil(made / PAIRS))
    if slices == 1:
        return counted(a)
    of = F.pmod(F.xxhash64("doc_id_a"), F.lit(slices))
    return written_in_parts(counted(a.where(of == i)) for i in range(slices))


def cowatch_scores(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Pairs with the cosine n_ab / sqrt(n_a * n_b)."""
    n = ratings.groupBy("doc_id").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("doc_id").alias("doc_id_a"), F.col("n").alias("na")), n.select(F.col("doc_id").alias("doc_id_b"), F.col("n").alias("nb"))
    return pairs.join(a, "doc_id_a").join(b, "doc_id_b").withColumn("co_watch_score", F.col("co_watch_count") / F.sqrt(F.col("na") * F.col("nb"))).drop("na", "nb")


def explode_genres(items: DataFrame, sep: str = "|") -> DataFrame:
    """(doc_id, genre), the mark for no genres left out."""
    return items.select("doc_id", F.explode(F.split("genres", f"[{sep}]")).alias("genre")).where((F.col("genre") != NO_GENRE) & (F.col("genre") != ""))


def genre_stats(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings, users, items and means of each genre, ranked by popularity (ties share a rank)."""
    stats = ratings.join(explode_genres(items), "doc_id").groupBy("genre").agg(
        F.count("*").alias("n_ratings"), F.avg("rating").alias("avg_rating"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("doc_id").alias("n_items")
    )
    return with_rank(stats, F.desc("n_ratings"), "popularity_rank")


def with_rank(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """rank() over a table that aggregation has already made small."""
    return df.withColumn(name, F.rank().over(Window.orderBy(order)))


def last_n(df: DataFrame, by: str, ts: str, n: int, tie: str) -> DataFrame:
    """The n latest rows of each key, ties by `tie`; the row limit is applied before the shuffle too."""
    order = Window.partitionBy(by).orderBy(F.desc(ts), tie)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def rating_baselines(ratings: DataFrame) -> DataFrame:
    """RMSE of the global, user and item means and of the sum of biases."""
    overall = ratings.agg(F.avg("rating").alias("mu"))
    users = ratings.groupBy("user_id").agg(F.avg("rating").alias("mu_u"))
    items = ratings.groupBy("doc_id").agg(F.avg("rating").alias("mu_i"))
    all_ = ratings.crossJoin(F.broadcast(overall)).join(users, "user_id").join(items, "doc_id")
    r = F.col("rating")

    def rmse(p: Column) -> Column:
        return F.sqrt(F.avg((r - p) * (r - p)))

    bias = F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.col("mu_u") + F.col("mu_i") - F.col("mu")))
    wide = all_.agg(rmse(F.col("mu")).alias("global_mean"), rmse(F.col("mu_u")).alias("user_mean"), rmse(F.col("mu_i")).alias("item_mean"), rmse(bias).alias("bias"))
    return wide.unpivot([], ["global_mean", "user_mean", "item_mean", "bias"], "model", "rmse")


def metadata_sparsity(items: DataFrame, year: int = 2010, few: int = 3) -> DataFrame:
    """Mean tags of items before and from a year, and how many have fewer than `few`."""
    tags = F.size(F.filter(F.split("tags", ","), lambda t: F.trim(t) != ""))
    era = F.when(F.col("year") >= year, "post").otherwise("pre")
    return items.select(era.alias("era"), tags.alias("n")).groupBy("era").agg(F.count("*").alias("n_items"), F.avg("n").alias("avg_tags"), F.count_if(F.col("n") < few).alias("n_sparse"))


def export_features(features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A keyed record of chosen columns for each entity, nulls 0 and rounded to 4 places; written by the caller, never collected."""
    return features.select(F.concat(F.lit(f"{key}:"), F.col(key).cast("string")).alias("key"), *(F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 4).alias(c) for c in columns))


def lookup_features(keys: DataFrame, features: DataFrame, on: str, defaults: dict[str, float]) -> DataFrame:
    """Features of each key, with defaults for unknown entities."""
    found = keys.join(features.select(on, *defaults), on, "left")
    return found.select(*keys.columns, *(F.coalesce(F.col(c).cast("double"), F.lit(float(v))).alias(c) for c, v in defaults.items()))


def drop_expired(df: DataFrame, ts: str, hours: int, as_of: str) -> DataFrame:
    return df.where(F.col(ts).cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
