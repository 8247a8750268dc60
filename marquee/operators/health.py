"""Gates, drift, promotion, freshness, costs and alerts over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.people import age_days


def run_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """metrics(metric, value) against gates(metric, op, threshold); a missing metric fails."""
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    holds = F.when(op == ">=", v >= t).when(op == "<=", v <= t).when(op == ">", v > t).when(op == "<", v < t)
    checked = gates.join(metrics, "metric", "left").withColumn("passed", F.coalesce(holds, F.lit(False)))
    return checked.withColumn("all_pass", F.min("passed").over(Window.partitionBy()))


def regression_gate(current: DataFrame, reference: DataFrame, max_drop_pct: float = 5.0, minimum: float = 0.0) -> DataFrame:
    """Metrics by (method, metric) against a reference run; method names are matched by their letters and digits."""
    key = lambda df: df.withColumn("key", F.regexp_replace(F.lower("method"), "[^a-z0-9]", ""))
    ref = key(reference).select("key", "metric", F.col("value").alias("reference"))
    both = key(current).join(ref, ["key", "metric"], "left")
    drop = F.try_divide(100 * (F.col("reference") - F.col("value")), F.col("reference"))
    return both.select("method", "metric", "value", "reference", drop.alias("drop_pct"), ((F.col("value") >= minimum) & (F.coalesce(drop, F.lit(0.0)) <= max_drop_pct)).alias("passed"))


def validate(df: DataFrame, key: str, required: list[str], text: str | None = None, min_length: int = 1, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(check, n_failed): missing fields, short texts, values out of range, repeated keys, in one pass and one grouping."""
    checks = {f"missing_{c}": F.col(c).isNull() for c in required}
    if text:
        checks[f"short_{text}"] = F.length(text) < min_length
    for c, (low, high) in (ranges or {}).items():
        checks[f"range_{c}"] = ~F.col(c).between(low, high)
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_failed")).select(F.lit(f"duplicate_{key}").alias("check"), "n_failed")
    return counts.unpivot([], list(checks), "check", "n_failed").unionByName(repeated)


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows whose key the parent table lacks."""
    return child.join(parent.select(on).distinct(), on, "left_anti")


def psi(base: DataFrame, current: DataFrame, value: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Population stability index over equal bins, with shares floored at 1e-6."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
        return b.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    both = shares(base, "p").join(shares(current, "q"), "bin", "full_outer")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in ("p", "q"))
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def drift(latest: DataFrame, reference: DataFrame, max_drop: float = 0.03, max_p99: float = 200.0) -> DataFrame:
    """latest(method, ndcg, p99) against reference(method, ndcg): retrain with reasons."""
    both = latest.join(reference.select("method", F.col("ndcg").alias("ref")), "method", "left")
    reasons = F.array_compact(F.array(F.when(F.col("ref") - F.col("ndcg") >= max_drop, "ndcg_drop"), F.when(F.col("p99") > max_p99, "latency")))
    return both.select("method", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("retrain"))


def diagnose(observed: DataFrame) -> DataFrame:
    """observed(key, latency_ms, psi, drop) to the likeliest cause and what to do about it."""
    cause = F.when(F.col("latency_ms") > 100, "infrastructure").when(F.col("psi") > 0.2, "feature_drift").when(F.col("drop") > 0.05, "model_decay").when(F.col("drop") > 0.02, "minor_drift").otherwise("healthy")
    named = observed.withColumn("cause", cause)
    action = F.create_map(*map(F.lit, ("infrastructure", "scale_out", "feature_drift", "refresh_features", "model_decay", "retrain", "minor_drift", "watch", "healthy", "none")))
    return named.withColumn("action", action[F.col("cause")])


def trailing_run_hours(df: DataFrame, ts: str, ok: str) -> DataFrame:
    """Hours from the first of the unbroken run of rows that hold up to the latest row; over one series."""
    w = Window.partitionBy().orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = F.sum(F.when(F.coalesce(F.col(ok), F.lit(False)), 0).otherwise(1)).over(w)
    run = df.select(F.unix_timestamp(F.col(ts).cast("timestamp")).alias("s"), failed.alias("f")).where("f = 0")
    return run.agg(F.coalesce((F.max("s") - F.min("s")) / 3600.0, F.lit(0.0)).alias("hours"))


def first_last(df: DataFrame, ts: str, value: str) -> DataFrame:
    first, last = F.min_by(value, ts), F.max_by(value, ts)
    return df.where(F.col(value).isNotNull()).agg(first.alias("first"), last.alias("last"), F.try_divide(first - last, first).alias("drop"))


def promotion(obs: DataFrame, ts: str, production: str, candidate: str, min_gain: float = 0.02, max_drop: float = 0.05, hours: float = 48.0) -> DataFrame:
    """Roll back if production fell, promote if the candidate led for long enough, hold otherwise."""
    led = obs.withColumn("led", F.try_divide(F.col(candidate) - F.col(production), F.col(production)) >= min_gain)
    both = first_last(obs, ts, production).crossJoin(trailing_run_hours(led, ts, "led"))
    action = F.when(F.col("drop") > max_drop, "rollback").when(F.col("hours") >= hours, "promote").otherwise("hold")
    return both.withColumn("action", action)


def alerts(series: DataFrame, ts: str, value: str, lag_hours: int = 1, max_drop: float = 0.05) -> DataFrame:
    """Rows of an hourly series whose value is more than max_drop under the one `lag_hours` rows before."""
    before = F.lag(value, lag_hours).over(Window.partitionBy().orderBy(ts))
    return series.withColumn("before", before).where(F.try_divide(F.col("before") - F.col(value), F.col("before")) > max_drop)


def held_drop(series: DataFrame, by: str, ts: str, value: str, lag: int = 3600, hold: int = 300, max_drop: float = 0.05) -> DataFrame:
    """Samples of each series that are more than max_drop under the latest sample at least `lag` seconds older; firing where all samples have been so for `hold` seconds.

    A sample without an older one to compare with, or with one of zero, isn't low. Samples of one time count by their mean.
    """
    samples = series.groupBy(by, ts).agg(F.avg(value).alias(value)).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    in_time = Window.partitionBy(by).orderBy("__us")
    before = F.last(value).over(in_time.rangeBetween(Window.unboundedPreceding, -lag * 1_000_000))
    compared = samples.withColumn("before", before).withColumn("__low", F.coalesce(F.try_divide(F.col("before") - F.col(value), F.col("before")) > max_drop, F.lit(False)))
    runs = compared.withColumn("__run", F.count(F.when(~F.col("__low"), 1)).over(in_time.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("__low")
    since = F.min("__us").over(Window.partitionBy(by, "__run"))
    return runs.withColumn("firing", F.col("__us") - since >= hold * 1_000_000).drop("__us", "__low", "__run")


def freshness(meta: DataFrame, as_of: str, half_life: float = 14.0, launch_hours: float = 72.0, live_boost: float = 5.0) -> DataFrame:
    """State, freshness and boosts of each item: live, launching, recent, catalogue, and expiring over all."""
    live = F.col("live_start_ts").isNotNull() & F.col("live_end_ts").isNotNull()
    on_air = live & (age_days(F.col("live_start_ts"), as_of) >= 0) & (age_days(F.col("live_end_ts"), as_of) <= 0)
    age, left = age_days(F.col("release_ts"), as_of), -age_days(F.col("rights_expiry_ts"), as_of)
    dated = ~live & F.col("release_ts").isNotNull()
    fading = F.pow(F.lit(0.5), age / half_life)
    expiring = F.coalesce((left > 0) & (left <= 14), F.lit(False))
    state = F.when(expiring, "expiring").when(on_air, "live").when(dated & (age * 24 <= launch_hours), "launching").when(dated & (age <= 30), "recent").otherwise("catalog")
    fresh = F.when(on_air, 1.0).when(live | ~dated, 0.1).when(age * 24 <= launch_hours, 1 - age * 24 / launch_hours * 0.2).when(age <= 30, fading * 0.8).otherwise(F.greatest(F.lit(0.05), fading))
    return meta.select("doc_id", state.alias("state"), F.round(fresh, 4).alias("freshness"), F.when(on_air, live_boost).otherwise(1.0).alias("live_boost"), F.round(F.when(expiring, 1 + (1 - left / 14) * 0.5).otherwise(1.0), 6).alias("urgency_boost"))


#: Order of maturity ratings.
MATURITY = {"G": 0, "PG": 1, "PG-13": 2, "R": 3, "NC-17": 4, "TV-MA": 4}


def filter_available(cands: DataFrame, meta: DataFrame, as_of: str, market: str = "US", maturity: str = "PG-13") -> DataFrame:
    """Candidates that a viewer may see; items without metadata pass, items without a market are allowed everywhere."""
    level = F.create_map(*[F.lit(x) for kv in MATURITY.items() for x in kv])
    known = meta.select("doc_id", "market", F.coalesce(level[F.col("maturity_rating")], F.lit(2)).alias("level"), "rights_expiry_ts", F.lit(True).alias("known"))
    both = cands.join(known, "doc_id", "left")
    ok = F.col("known").isNull() | ((F.col("market").isNull() | (F.col("market") == market)) & (F.col("level") <= MATURITY.get(maturity, 2)) & (F.col("rights_expiry_ts").isNull() | (age_days(F.col("rights_expiry_ts"), as_of) <= 0)))
    return both.where(ok).select(cands.columns)


def roi_gate(tests: DataFrame, users: int = 1000, value_per_user: float = 1.0, cost: float = 10.0) -> DataFrame:
    """tests(key, lift): worth shipping if the lift's value exceeds its cost."""
    gain = F.col("lift") * users * value_per_user
    return tests.select("*", gain.alias("gain"), F.try_divide(gain - cost, F.lit(cost)).alias("roi"), (gain > cost).alias("passed"))


def launch_health(events: DataFrame, meta: DataFrame, as_of: str) -> DataFrame:
    """Click rate of items against 2 % in their first day and 5 % later."""
    s = events.groupBy("doc_id").agg(F.count_if(F.col("event_type") == "impression").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    both = meta.select("doc_id", age_days(F.col("release_ts"), as_of).alias("age")).join(s, "doc_id")
    ctr = F.try_divide(F.col("clicks"), F.col("impressions"))
    need = F.when(F.col("age") <= 1, 0.02).otherwise(0.05)
    return both.select("doc_id", "impressions", "clicks", F.round(ctr, 6).alias("ctr"), F.when(ctr.isNull(), "no_data").when(ctr >= need, "healthy").otherwise("weak").alias("health"))


def pacing(spend: DataFrame, budgets: DataFrame, elapsed: Column) -> DataFrame:
    """spend(advertiser_id, spent) against budgets(advertiser_id, daily_budget) at a share of the day."""
    both = budgets.join(spend, "advertiser_id", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    target = F.col("daily_budget") * elapsed
    ratio = F.try_divide(F.col("spent"), target)
    return both.select("advertiser_id", "spent", F.round(F.col("daily_budget") - F.col("spent"), 6).alias("remaining"), F.when(ratio > 1.5, "overspending").when(ratio < 0.5, "underspending").otherwise("on_track").alias("status"))


def service_metrics(requests: DataFrame, ts: str, label: str, width: str = "1 hour") -> DataFrame:
    """Requests, hits of the cache and mean latency by label and window."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    s = requests.groupBy(w.alias("w"), label).agg(F.count("*").alias("requests"), F.count_if("cache_hit").alias("hits"), F.avg("latency_ms").alias("latency_ms"))
    return s.select(F.col("w.start").alias("window_start"), label, "requests", "hits", F.round("latency_ms", 6).alias("latency_ms"))


def retention(manifest: DataFrame, ts: str, as_of: str, days: int = 30) -> DataFrame:
    """Artifacts older than `days` that aren't active, to archive."""
    return manifest.where((age_days(F.col(ts), as_of) > days) & ~F.col("is_active"))


def feature_status(features: DataFrame, key: str) -> DataFrame:
    return features.agg(F.count("*").alias("n_entities"), F.count_distinct(key).alias("n_keys"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in features.columns if c != key))


def check_citations(answers: DataFrame) -> DataFrame:
    """answers(id, answer, n_sources): abstained, without citations, or with numbers out of range."""
    found = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))
    bad = F.exists(found, lambda n: (n < 1) | (n > F.col("n_sources")))
    verdict = F.when(F.lower("answer").rlike("i don't know|not enough information"), "abstained").when(F.size(found) == 0, "no_citations").when(bad, "out_of_range").otherwise("ok")
    return answers.select("id", F.size(found).alias("n_citations"), verdict.alias("verdict"))


def promotion_decision(experiment: Column, roi: Column, approved: Column, rollback: Column) -> Column:
    return F.when(rollback, "rollback").when(experiment & roi & approved, "promote").when(experiment & roi, "await_approval").otherwise("hold")
