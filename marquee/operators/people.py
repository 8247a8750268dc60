"""User state, satisfaction and personalised scores, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators.features import last_n

HALF_LIFE, NEGATIVE, SKIP = 14.0, -2.0, -0.5

#: Weights of satisfaction signals.
SIGNALS = {"completed": 1.5, "binge_next": 2.0, "returned_7d": 1.8, "shared": 1.2, "abandoned_10": -2.0, "thumbs_down": -2.5, "skip_intro": 0.4, "rewatch": 2.2}


def age_days(ts: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86400e6


def _is_negative() -> Column:
    return F.col("skipped") | (F.col("watch_pct") < 0.1) | F.coalesce(F.col("explicit_rating") <= 2, F.lit(False))


def weighted_interactions(ix: DataFrame, as_of: str) -> DataFrame:
    """Interactions with `negative` (the user's latest one with the item is), `w` and `decay`."""
    latest = ix.groupBy("user_id", "doc_id").agg(F.max_by(_is_negative(), F.struct("ts", "event_id")).alias("negative"))
    pct = F.col("watch_pct")
    base = F.when(F.col("negative"), NEGATIVE).when(F.col("skipped") | (pct < 0.1), SKIP).when(pct > 0.8, 1.5).when(pct > 0.5, 1.0).otherwise(0.6)
    rated = F.coalesce((F.col("explicit_rating") - 3) * 0.5 + 1.0, F.lit(1.0))
    d = X.decay(age_days(F.col("ts"), as_of), HALF_LIFE)
    return ix.join(latest, ["user_id", "doc_id"]).withColumn("decay", d).withColumn("w", base * rated * F.col("decay"))


def genre_affinity(weighted: DataFrame, genres: DataFrame) -> DataFrame:
    """(user_id, genre, affinity) over genres(doc_id, genre)."""
    return weighted.select("user_id", "doc_id", "w").join(genres, "doc_id").groupBy("user_id", "genre").agg(F.sum("w").alias("affinity"))


def user_state(ix: DataFrame, genres: DataFrame, as_of: str) -> DataFrame:
    """Counts, confidence, cold start and the three strongest genres of every user."""
    weighted = weighted_interactions(ix, as_of)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("affinity", 9)), "genre"))
    top = genre_affinity(weighted, genres).withColumn("r", place).where("r <= 3").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "genre"))), lambda x: x["genre"]), ",").alias("dominant_genres"))
    stats = weighted.groupBy("user_id").agg(F.count("*").alias("interaction_count"), F.count_distinct(F.when(F.col("negative"), F.col("doc_id"))).alias("n_negative"))
    n = F.col("interaction_count")
    confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.log1p(n) / F.log1p(F.lit(50)))), 3)
    return stats.join(top, "user_id", "left").select("*", confidence.alias("confidence"), (n < 5).alias("cold_start"))


def drift_score(ix: DataFrame, genres: DataFrame, n: int = 5, least: int = 10) -> DataFrame:
    """1 - Jaccard of the genres of each user's first and last n interactions; 0 below `least` interactions."""
    w = Window.partitionBy("user_id")
    placed = ix.select("user_id", "doc_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("up"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("down"), F.count("*").over(w).alias("n"))
    ends = placed.where((F.col("up") <= n) | (F.col("down") <= n)).join(genres, "doc_id")
    sets = ends.groupBy("user_id").agg(F.max("n").alias("n"), F.collect_set(F.when(F.col("up") <= n, F.col("genre"))).alias("early"), F.collect_set(F.when(F.col("down") <= n, F.col("genre"))).alias("late"))
    return sets.select("user_id", F.when(F.col("n") >= least, F.round(1 - X.jaccard(F.col("early"), F.col("late")), 3)).otherwise(0.0).alias("drift"))


def in_silo(ix: DataFrame, genres: DataFrame, window: int = 10, share: float = 0.8) -> DataFrame:
    """Whether one genre has at least `share` of each user's latest `window` interactions."""
    recent = last_n(ix.select("user_id", "doc_id", "ts", "event_id"), "user_id", "ts", window, "event_id")
    counted = recent.join(genres, "doc_id").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    size = recent.groupBy("user_id").agg(F.count("*").alias("size"))
    return counted.groupBy("user_id").agg(F.max("n").alias("n")).join(size, "user_id").select("user_id", ((F.col("size") >= window) & (F.col("n") >= share * F.col("size"))).alias("in_silo"))


def state_score(cands: DataFrame, weighted: DataFrame, genres: DataFrame, recent: int = 20) -> DataFrame:
    """Change of score for cands(user_id, doc_id): -10 for negatives, a tenth of genre affinities, -2 for recent ones, times confidence."""
    affinity = genre_affinity(weighted, genres)
    fit = cands.join(genres, "doc_id").join(affinity, ["user_id", "genre"]).groupBy("user_id", "doc_id").agg((F.sum("affinity") * 0.1).alias("fit"))
    negative = weighted.where("negative").select("user_id", "doc_id").distinct().withColumn("negative", F.lit(True))
    seen = last_n(weighted.select("user_id", "doc_id", "ts", "event_id"), "user_id", "ts", recent, "event_id").select("user_id", "doc_id").distinct().withColumn("recent", F.lit(True))
    n = weighted.groupBy("user_id").agg(F.count("*").alias("n"))
    both = cands.join(fit, ["user_id", "doc_id"], "left").join(negative, ["user_id", "doc_id"], "left").join(seen, ["user_id", "doc_id"], "left").join(n, "user_id", "left")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.log1p(F.coalesce("n", F.lit(0))) / F.log1p(F.lit(50))))
    score = (F.coalesce("fit", F.lit(0.0)) - F.when(F.col("recent"), 2.0).otherwise(0.0)) * confidence
    return both.select("user_id", "doc_id", F.when(F.col("negative"), -10.0).otherwise(score).alias("state_score"))


def satisfaction(events: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """(user_id, doc_id, satisfaction) of events(user_id, doc_id, signal, ts)."""
    weight = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    s = weight[F.col("signal")] * X.decay(age_days(F.col("ts"), as_of), half_life)
    return events.groupBy("user_id", "doc_id").agg(F.round(F.sum(s), 4).alias("satisfaction"))


def satisfaction_profile(events: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """Score, commonest signal (ties in alphabetical order) and number of events of every user."""
    weight = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    s = weight[F.col("signal")] * X.decay(age_days(F.col("ts"), as_of), half_life)
    by_signal = events.groupBy("user_id", "signal").agg(F.count("*").alias("n"), F.sum(s).alias("s"))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "signal"))
    return by_signal.withColumn("r", first).groupBy("user_id").agg(F.round(F.sum("s"), 4).alias("score"), F.max(F.when(F.col("r") == 1, F.col("signal"))).alias("dominant_signal"), F.sum("n").alias("n_events"))


def js_divergence(p: Column, q: Column, both: Column) -> Column:
    """Terms of Jensen and Shannon's divergence of two shares, summed by the caller."""
    m = (p + q) / 2

    def term(a: Column) -> Column:
        return F.when(a > 0, a * F.log(a / m)).otherwise(0.0)

    return F.when(both, (term(p) + term(q)) / 2).otherwise(0.0)


def contamination(recent: DataFrame, history: DataFrame) -> DataFrame:
    """Divergence of (user_id, genre, weight) tables per user, 0 where one side is missing."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = F.sum("weight").over(Window.partitionBy("user_id"))
        return df.select("user_id", "genre", (F.col("weight") / F.greatest(total, F.lit(1e-9))).alias(name))

    both = shares(recent, "p").join(shares(history, "q"), ["user_id", "genre"], "full_outer").fillna(0.0, ["p", "q"])
    sums = both.groupBy("user_id").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(js_divergence(F.col("p"), F.col("q"), F.lit(True))).alias("js"))
    return sums.select("user_id", F.when((F.col("sp") > 0) & (F.col("sq") > 0), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("js"))), 3)).otherwise(0.0).alias("contamination"))


def mean_vector(df: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """(by, vector): L2-normalised mean of each key's vectors, averaged by position."""
    parts = df.select(by, F.posexplode(column).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    length = X.norm(F.col("v"))
    return whole.select(by, F.transform("v", lambda x: F.try_divide(x, length)).alias("vector"))


def bandit_state(events: DataFrame) -> DataFrame:
    """Beta parameters of (user_id, doc_id) from what happened: the first rule that holds counts."""
    kind, pct = F.col("event_type"), F.coalesce(F.col("watch_pct"), F.lit(0.0))
    strong, weak = (kind == "watch_complete") | (pct > 0.8), (kind == "click") | (pct > 0.3)
    bad, shown = (kind == "skip") | (pct < 0.1), kind == "impression"
    up = F.when(strong, 2.0).when(weak, 1.0).otherwise(0.0)
    down = F.when(strong | weak, 0.0).when(bad, 1.0).when(shown, 0.2).otherwise(0.0)
    return events.groupBy("user_id", "doc_id").agg((1 + F.sum(up)).alias("alpha"), (1 + F.sum(down)).alias("beta"))


def exploration_rate(state: DataFrame) -> DataFrame:
    total = F.sum(F.col("alpha") + F.col("beta") - 2)
    return state.groupBy("user_id").agg(F.least(F.lit(0.5), 0.5 / (1 + total / 50)).alias("exploration_rate"))


def max_label(events: DataFrame) -> DataFrame:
    """Best label of (query, doc_id) by a short hash of the query: complete 3, start 2, click 1; others leave no row."""
    label = F.create_map(*[F.lit(x) for kv in {"watch_complete": 3, "watch_start": 2, "click": 1}.items() for x in kv])[F.col("event_type")]
    best = events.select(X.short_hash(F.col("query")).alias("query_hash"), "doc_id", label.alias("label")).where("label is not null")
    return best.groupBy("query_hash", "doc_id").agg(F.max("label").alias("label"))
