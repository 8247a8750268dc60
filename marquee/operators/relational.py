"""Forms of joins, windows, sets and text that the larger operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as X


def left_agg(a: DataFrame, b: DataFrame, on: str, *aggs: Column) -> DataFrame:
    """a with aggregates of b's rows of the same key."""
    return a.join(b.groupBy(on).agg(*aggs), on, "left")


def outer_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, doc_id, a, b): scores of both rankings, 0 where one lacks the document."""
    x, y = a.select("query_id", "doc_id", F.col("score").alias("a")), b.select("query_id", "doc_id", F.col("score").alias("b"))
    return x.join(y, ["query_id", "doc_id"], "full_outer").fillna(0.0, ["a", "b"])


def member_of(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    flag = keys.select(on).distinct().withColumn(name, F.lit(True))
    return df.join(flag, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def impressions_with_outcome(impressions: DataFrame, outcomes: DataFrame, least: float = 0.25) -> DataFrame:
    """Impressions with the latest outcome of the same user and document."""
    last = outcomes.groupBy("user_id", "doc_id").agg(F.max_by("watch_pct", F.struct("outcome_ts", "outcome_id")).alias("watch_pct"))
    return impressions.join(last, ["user_id", "doc_id"], "left").withColumn("watched", F.coalesce(F.col("watch_pct") >= least, F.lit(False)))


def within_window(rows: DataFrame, intervals: DataFrame, ts: str) -> DataFrame:
    """Rows inside intervals(interval_id, start_ts, end_ts); intervals are a small table of schedules."""
    t = F.col(ts).cast("timestamp")
    return rows.join(F.broadcast(intervals), (t >= F.col("start_ts").cast("timestamp")) & (t <= F.col("end_ts").cast("timestamp")))


def asof_previous(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """left(by, ts, ...) with the value of right's latest row of the key at or before each row's time: one union, one window."""
    extra = [c for c in left.columns if c not in (by, ts)]
    l_rows = left.select(by, ts, *extra, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    r_rows = right.select(by, ts, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(by).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return l_rows.unionByName(r_rows).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(by, ts, *extra, F.col("__last").alias(value))


def top_values(df: DataFrame, column: str, n: int, by: str) -> DataFrame:
    counted = df.groupBy(by, column).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), column)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def by_slices(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Count and mean over each dimension and over all rows, by grouping sets."""
    keys = ", ".join(dims)
    sets = ", ".join([f"({d})" for d in dims] + ["()"])
    df.createOrReplaceTempView("__slices")
    return df.sparkSession.sql(f"SELECT {keys}, count(*) AS n, avg({value}) AS mean FROM __slices GROUP BY GROUPING SETS ({sets})")


def running_total(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(value).over(w))


def concat_tiers(*parts: DataFrame) -> DataFrame:
    """Rows of the tables one after another, by `tier`."""
    out = None
    for tier, part in enumerate(parts):
        row = part.withColumn("tier", F.lit(tier))
        out = row if out is None else out.unionByName(row)
    return out


def ordered_distinct(df: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """(by, column, place): each group's distinct values of the column in the order of their first rows, numbered from 1; nulls are no values."""
    first = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(by, column, F.row_number().over(Window.partitionBy(by).orderBy("first", column)).alias("place"))


def substring_pairs(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle") -> DataFrame:
    """Each row of texts beside each different needle that its text contains; an empty needle stands in every text.

    A needle is looked up by the one of its runs of three characters (shorter ones: by itself) that fewest texts have, so only texts that have that run are searched.
    """
    asked = needles.select(needle).where(F.col(needle).isNotNull()).distinct()
    runs = f"transform(sequence(1, greatest(char_length({needle}) - least(3, char_length({needle})) + 1, 1)), i -> substring({needle}, i, least(3, char_length({needle}))))"
    wanted = asked.select(needle, F.explode(F.array_distinct(F.expr(runs))).alias("__run"))
    every = f"array_distinct(flatten(transform(array(0, 1, 2, 3), k -> transform(sequence(1, greatest(char_length({text}) - k + 1, 1)), i -> substring({text}, i, k)))))"
    held = texts.where(F.col(text).isNotNull()).select("*", F.explode(F.expr(every)).alias("__run")).join(wanted.select("__run").distinct(), "__run", "left_semi")
    n = held.groupBy("__run").agg(F.count("*").alias("n"))
    rarest = wanted.join(n, "__run", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "__run"))["__run"].alias("__run"))
    return held.join(rarest, "__run").where(F.contains(text, needle)).drop("__run")


def words_between_blanks(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """Each row of texts beside each different word, without blanks, that stands between two blanks in its text: what a search for " word " finds.

    Texts are cut once for all words, instead of being searched for each."""
    parts = F.split(text, " ")
    inner = F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))
    held = texts.where(F.col(text).isNotNull()).select(*(c for c in texts.columns if c != text), F.explode(inner).alias(word))
    return held.join(words.select(word).distinct(), word, "left_semi")


def parse_catalog(df: DataFrame, column: str = "text") -> DataFrame:
    """Text of the form "Key: value | Key: value" to a map of lower-cased keys; of repeated keys the last counts."""
    parts = F.filter(F.transform(F.split(column, r"\|"), F.trim), lambda p: F.instr(p, ":") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("key"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return df.withColumn("fields", F.map_from_entries(last))


def ablate(df: DataFrame, mode: str, column: str = "text") -> DataFrame:
    """Catalogue text without its genres or tags segment, or without the year in brackets."""
    if mode == "year":
        return df.withColumn(column, F.trim(F.regexp_replace(column, r"\s*\(\d{4}\)", "")))
    kept = F.filter(F.split(column, r"\s*\|\s*"), lambda p: ~F.lower(p).startswith(mode))
    return df.withColumn(column, F.array_join(kept, " | "))


def build_corpus(items: DataFrame, tags: DataFrame, most: int = 8) -> DataFrame:
    """Catalogue text of items(doc_id, title, genres) with the commonest tags of tags(doc_id, tag)."""
    top = top_values(tags, "tag", most, "doc_id").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    both = items.select("doc_id", "title", "genres").join(top, "doc_id", "left")
    return both.select("doc_id", "title", F.concat_ws(" | ", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Genres: "), F.regexp_replace("genres", r"\|", ",")), F.concat(F.lit("Tags: "), "tags")).alias("text"))


def extract_tags(df: DataFrame, words: list[str], column: str = "text") -> DataFrame:
    return df.withColumn("tags", X.keyword_hits(F.lower(column), words))
