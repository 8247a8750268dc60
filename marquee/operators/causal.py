"""Experiments and causal estimates over logged events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import normal_cdf

#: How likely each position is seen.
EXPOSURE = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)


def ab_test(obs: DataFrame, by: str = "experiment", arm: str = "arm", reward: str = "reward", z: float = 1.96) -> DataFrame:
    """Welch's test per experiment: moments of both arms, t, degrees of freedom, p by the normal limit, interval, effect that could be detected."""
    control, treated = F.col(arm) == "control", F.col(arm) == "treatment"

    def of(which: Column, name: str) -> list[Column]:
        v = F.when(which, F.col(reward))
        return [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"var_{name}")]

    stats = obs.groupBy(by).agg(*of(control, "c"), *of(treated, "t"))
    vc, vt = F.try_divide(F.col("var_c"), F.col("n_c")), F.try_divide(F.col("var_t"), F.col("n_t"))
    se = F.sqrt(vc + vt)
    df = F.try_divide((vc + vt) * (vc + vt), F.try_divide(vc * vc, F.col("n_c") - 1) + F.try_divide(vt * vt, F.col("n_t") - 1))
    t = F.try_divide(F.col("mean_t") - F.col("mean_c"), se)
    wide = stats.select("*", se.alias("se"), df.alias("df"), t.alias("t"))
    p = 2 * (1 - normal_cdf(F.abs(F.col("t"))))
    mde = F.lit(2.8) * F.col("se")
    verdict = F.when(p < 0.05, F.when(F.col("t") > 0, "better").otherwise("worse")).when(F.abs(F.col("mean_t") - F.col("mean_c")) < mde, "underpowered").otherwise("no difference")
    return wide.select("*", (F.try_divide(F.col("mean_t") - F.col("mean_c"), F.col("mean_c"))).alias("lift"), p.alias("p"), (F.col("mean_t") - z * F.sqrt(vt)).alias("ci_low"), (F.col("mean_t") + z * F.sqrt(vt)).alias("ci_high"), mde.alias("mde"), verdict.alias("verdict"))


def guarded_ab(tests: DataFrame, guards: DataFrame, by: str = "experiment", max_latency: float = 300.0, max_errors: float = 0.01, min_n: int = 200) -> DataFrame:
    """Tests with guards(experiment, latency_ms, error_rate): ship only if every guard holds."""
    both = tests.join(guards, by)
    ok = [F.col("latency_ms") <= max_latency, F.col("error_rate") <= max_errors, (F.col("n_c") >= min_n) & (F.col("n_t") >= min_n), F.col("lift") > 0]
    named = both.select("*", *(c.alias(n) for c, n in zip(ok, ("latency_ok", "errors_ok", "n_ok", "lift_ok"))))
    return named.withColumn("ship", F.col("latency_ok") & F.col("errors_ok") & F.col("n_ok") & F.col("lift_ok"))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _poisson(u: Column, most: int = 15) -> Column:
    """Poisson(1) by inversion, up to `most` (beyond it lie less than 1e-13 of the draws)."""
    p, total, limits = 0.36787944117144233, 0.0, []
    for k in range(most):
        total += p
        limits.append(total)
        p /= k + 1
    out = F.lit(most)
    for k, limit in reversed(list(enumerate(limits))):
        out = F.when(u < limit, k).otherwise(out)
    return out


def bootstrap(rows: DataFrame, key: str, value: str, iters: int = 3000, seed: int = 7) -> DataFrame:
    """(replicate, mean): Poisson bootstrap, each row weighted in each replicate by a hash of its key."""
    every = rows.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("replicate"))
    w = _poisson(_uniform(F.col(key), F.col("replicate"), F.lit(seed)))
    return every.select("replicate", value, w.alias("w")).groupBy("replicate").agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("mean"))


def bootstrap_p(rows: DataFrame, key: str, diff: str, iters: int = 3000, seed: int = 7) -> DataFrame:
    """Share of replicates whose mean difference is 0 or less."""
    return bootstrap(rows, key, diff, iters, seed).agg(F.count("*").alias("iters"), F.avg((F.col("mean") <= 0).cast("double")).alias("p"))


def bootstrap_ci(rows: DataFrame, key: str, value: str, iters: int = 3000, seed: int = 7) -> DataFrame:
    b = bootstrap(rows, key, value, iters, seed)
    return b.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY mean)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY mean)").alias("high"))


def propensity(served: DataFrame, by: str, score: str = "score", position: str = "position", temperature: float = 1.0) -> DataFrame:
    """Softmax of a list's scores times the exposure of the position, clipped to 0.01 to 0.99."""
    w = Window.partitionBy(by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / max(temperature, 0.01))
    seen = F.element_at(F.array(*map(F.lit, EXPOSURE)), F.least(F.col(position), F.lit(len(EXPOSURE) - 1)) + 1)
    soft = served.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w))
    return soft.withColumn("propensity", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("p") * seen)), 6)).drop("e", "p")


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_impressions"), F.count_if("watched").alias("n_watched"), F.avg(F.col("watched").cast("int")).alias("outcome_rate"))


def uplift(log: DataFrame, min_n: int = 10) -> DataFrame:
    """Effect of showing each item: 0.7 naive difference + 0.3 inverse-propensity mean; null without both arms, confident from min_n rows."""
    y, e = F.col("watched").cast("double"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("propensity")))
    shown = F.col("shown")
    stats = log.groupBy("doc_id").agg(
        F.count_if(shown).alias("n_t"),
        F.count_if(~shown).alias("n_c"),
        F.avg(F.when(shown, y)).alias("p_watch_shown"),
        F.avg(F.when(~shown, y)).alias("p_watch_not_shown"),
        F.avg(F.when(shown, y / e).otherwise(-y / (1 - e))).alias("ipw"),
    )
    enough = (F.col("n_t") + F.col("n_c") >= min_n) & (F.col("n_t") > 0) & (F.col("n_c") > 0)
    tau = (F.col("p_watch_shown") - F.col("p_watch_not_shown")) * 0.7 + F.col("ipw") * 0.3
    return stats.select("*", F.when(enough, tau).alias("tau"), enough.alias("confident"))


def uplift_prior(log: DataFrame, alpha: float = 1.0, beta: float = 4.0) -> DataFrame:
    """Difference of the arms' Beta posterior means, what the draws for rare items have on average."""
    y = F.col("watched").cast("int")
    s = log.groupBy("doc_id").agg(*(f.alias(n) for f, n in ((F.count_if("shown"), "n_t"), (F.sum(F.when(F.col("shown"), y).otherwise(0)), "y_t"), (F.count_if(~F.col("shown")), "n_c"), (F.sum(F.when(~F.col("shown"), y).otherwise(0)), "y_c"))))
    mean = lambda y, n: (alpha + F.col(y)) / (alpha + beta + F.col(n))
    return s.select("doc_id", (mean("y_t", "n_t") - mean("y_c", "n_c")).alias("tau"))


def ope_snips(log: DataFrame, scores: DataFrame, clip: float = 10.0) -> DataFrame:
    """Self-normalised value of a softmax policy over scores(doc_id, score), clipped weights, lift over the unshown rows."""
    total = scores.agg((F.sum(F.exp("score")) + 1e-9).alias("total"))
    policy = scores.crossJoin(F.broadcast(total)).select("doc_id", (F.exp("score") / F.col("total")).alias("pi"))
    w = F.least(F.coalesce("pi", F.lit(1e-6)) / F.greatest(F.lit(1e-6), F.col("propensity")), F.lit(clip))
    rows = log.join(policy, "doc_id", "left").select(F.col("watched").cast("double").alias("y"), "shown", w.alias("w"))
    s = rows.agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("w")).alias("yw"), F.sum("w").alias("w"), F.sum(F.pow(F.col("y") * F.col("w"), 2)).alias("yw2"), F.coalesce(F.avg(F.when(~F.col("shown"), F.col("y"))), F.lit(0.1)).alias("baseline"))
    est = F.coalesce(F.try_divide(F.col("yw"), F.col("w")), F.lit(0.0))
    var = (F.col("yw2") - 2 * est * F.col("yw") + F.col("n") * est * est) / F.greatest(F.lit(1), F.col("n") - 1)
    return s.select("n", est.alias("estimate"), var.alias("variance"), "baseline", F.try_divide(est - F.col("baseline"), F.greatest(F.lit(1e-9), F.col("baseline"))).alias("lift"))


def ipw(log: DataFrame, clip: float = 10.0) -> DataFrame:
    w = F.least(1 / F.greatest(F.lit(1e-6), F.col("propensity")), F.lit(clip))
    return log.where("shown").agg(F.count("*").alias("n"), F.avg(F.col("watched").cast("double") * w).alias("value"))


def compare_policies(events: DataFrame, policy: str) -> DataFrame:
    """Click and completion rates, mean watched share and reward of each policy, with lifts over the first by name."""
    kind = F.col("event_type")
    s = events.groupBy(F.col(policy).alias("policy")).agg(F.count("*").alias("n"), F.avg((kind == "click").cast("double")).alias("ctr"), F.avg((kind == "watch_complete").cast("double")).alias("completion"), F.avg("watch_pct").alias("watch_pct"))
    s = s.withColumn("reward", 0.3 * F.col("ctr") + 0.7 * F.col("completion"))
    base = s.orderBy("policy").limit(1).select(F.col("reward").alias("base"))
    return s.crossJoin(F.broadcast(base)).select("policy", "n", "ctr", "completion", "watch_pct", "reward", F.try_divide(F.col("reward") - F.col("base"), F.col("base")).alias("lift"))


def enrich_uplift(features: DataFrame, effects: DataFrame) -> DataFrame:
    known = effects.select("doc_id", F.round("tau", 4).alias("incrementality_score"), F.round("p_watch_shown", 4).alias("p_watch_shown"), F.round("p_watch_not_shown", 4).alias("p_watch_not_shown"), F.col("confident").cast("double").alias("uplift_confident"))
    return features.join(known, "doc_id", "left").fillna(0.0, ["incrementality_score", "p_watch_shown", "p_watch_not_shown", "uplift_confident"])


def ad_gate(metrics: DataFrame, most: float = 0.05) -> DataFrame:
    """metrics(surface, organic, with_ads): allowed while engagement drops by at most `most`."""
    drop = F.try_divide(F.col("organic") - F.col("with_ads"), F.col("organic"))
    return metrics.select("surface", "organic", "with_ads", drop.alias("drop"), F.coalesce(drop <= most, F.lit(False)).alias("allowed"))
