"""Streams over the events, drained and compared with their batch meaning."""

import tempfile
import uuid

from pyspark.sql import functions as F

from marquee.plans.behaviour import QUERIES as FEATURES
from marquee.plans.fixtures import AS_OF, VIEWS
from marquee.streaming import events as Z
from marquee.streaming import refresh as RF
from marquee.streaming import state as ST


def folder(d) -> str:
    base = d.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not d.spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="marquee-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def stream(d, view: str = "watch_events"):
    """A view over a stream of the events table (a pattern, as a file source wants a folder or a pattern)."""
    source = Z.read_files(d.spark, f"{d.folder}/event[s].parquet", d.events.schema)
    source.createOrReplaceTempView("events")
    if "part" in VIEWS[view]:
        d.part.createOrReplaceTempView("part")
    return d.spark.sql(VIEWS[view])


def drained(make, mode: str = "complete", view: str = "watch_events", ts: str = "occurred_at"):
    return lambda d: Z.drain(make(Z.with_event_time(stream(d, view), ts, "10 minutes")), folder(d), mode)


def islands(where: str, keys: str, hours: int) -> str:
    return f"""SELECT {keys}, min(occurred_at) AS start, max(occurred_at) + INTERVAL {hours} HOUR AS "end", count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY occurred_at, event_id) AS island FROM (
      SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY {keys} ORDER BY occurred_at, event_id) < INTERVAL {hours} HOUR THEN 0 ELSE 1 END AS fresh FROM watch_events WHERE {where}))
    GROUP BY {keys}, island"""


def joined(d):
    i = Z.with_event_time(stream(d).where("event_type = 'impression'").select(F.col("event_id").alias("imp_id"), "user_id", "doc_id", F.col("occurred_at").alias("shown_at")), "shown_at", "1 hour")
    o = Z.with_event_time(stream(d).where("event_type = 'watch_complete'").select("user_id", "doc_id", "watch_pct", F.col("occurred_at").alias("done_at")), "done_at", "1 hour")
    return Z.drain(Z.join_outcomes(i, o), folder(d), "append")


def last_ten(d):
    rows = ST.run(ST.last_n(Z.with_event_time(stream(d), "occurred_at", "10 minutes"), "user_id", "occurred_at", "event_id", "doc_id", 10, ttl_days=90), folder(d), "update")
    return ST.latest(rows, "key").select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.col("value").alias("doc_id"), "place")


#: Every start of a film announces a showing six hours later, for three hours; ticks are hours.
SHOWING = "date_trunc('hour', occurred_at) + INTERVAL '6' HOUR AS live_start, date_trunc('hour', occurred_at) + INTERVAL '9' HOUR AS live_end"


def snapshots(d):
    timed = Z.with_event_time(stream(d), "occurred_at", "10 minutes")
    started = F.when(F.col("event_type") == "watch_start", F.date_trunc("hour", "occurred_at"))
    rows = timed.select("doc_id", "occurred_at", (started + F.expr("INTERVAL 6 HOURS")).alias("live_start"), (started + F.expr("INTERVAL 9 HOURS")).alias("live_end"))
    return ST.run(ST.live_snapshots(rows, "occurred_at", "live_start", "live_end", every=3600, lead=4 * 3600), folder(d), "append").drop("batch")


def notices(d):
    timed = Z.with_event_time(stream(d, "recommendations"), "served_at", "10 minutes").withColumn("model", F.concat_ws(":", "method", "query"))
    return ST.run(ST.model_notices(timed, "model", "served_at", "rec_id", "ndcg_at_10"), folder(d), "append").select("model", F.col("id").alias("rec_id"), "old_score", "new_score", "improvement_pct")


def refreshed(d):
    """Features after the ratings came in eight batches, the first six of which were merged on the way."""
    where = folder(d)
    d.ratings.repartition(8).write.parquet(f"{where}/ratings")
    return RF.refresh(Z.read_files(d.spark, f"{where}/ratings", d.ratings.schema, files_a_batch=1), where, fold=3)


def retrain(d):
    where = folder(d)
    Z.retrain_trigger(d.spark, stream(d), where, f"{where}/state").awaitTermination()
    return d.spark.read.schema("trigger_no bigint, total bigint, batch int").parquet(f"{where}/triggers").select("trigger_no")


BANDIT = """SELECT user_id, doc_id, round(1 + sum(CASE WHEN event_type = 'watch_complete' OR p > 0.8 THEN 2 WHEN event_type = 'click' OR p > 0.3 THEN 1 ELSE 0 END::DOUBLE), 6) AS alpha,
round(1 + sum(CASE WHEN event_type IN ('watch_complete', 'click') OR p > 0.3 THEN 0 WHEN event_type = 'skip' OR p < 0.1 THEN 1 WHEN event_type = 'impression' THEN 0.2 ELSE 0 END::DOUBLE), 6) AS beta
FROM (SELECT *, coalesce(watch_pct, 0) AS p FROM watch_events) GROUP BY 1, 2"""

QUERIES = {
    "z01_stream_popularity": (drained(Z.popularity), islands("event_type IN ('click', 'watch_start')", "doc_id", 24)),
    "z02_stream_completions": (drained(Z.completions), islands("event_type = 'watch_complete' AND watch_pct > 0.8", "doc_id", 168)),
    "z03_stream_affinity": (drained(Z.affinity), islands("event_type = 'watch_complete'", "user_id, doc_id", 720).replace(', max(occurred_at) + INTERVAL 720 HOUR AS "end"', "")),
    "z05_stream_dedup": (drained(lambda s: Z.dedup(s.union(s)).select("event_id", "user_id"), "append"), "SELECT DISTINCT event_id, user_id FROM watch_events"),
    "z06_stream_join_outcomes": (joined, "SELECT i.event_id AS imp_id, i.user_id, i.doc_id, i.occurred_at AS shown_at, o.occurred_at AS done_at, o.watch_pct FROM watch_events i JOIN watch_events o ON i.user_id = o.user_id AND i.doc_id = o.doc_id AND o.occurred_at BETWEEN i.occurred_at AND i.occurred_at + INTERVAL 7 DAY WHERE i.event_type = 'impression' AND o.event_type = 'watch_complete'"),
    "z07_stream_sessions": (drained(Z.sessions), "SELECT user_id, 'sess_' || user_id || '_' || CAST(floor(epoch(occurred_at) / 300) AS BIGINT) AS session_id, count(*) AS n FROM watch_events GROUP BY 1, 2"),
    "z08_stream_caps": (
        drained(lambda s: Z.caps(s.withColumn("advertiser_id", F.col("doc_id") % 5), 2)),
        "SELECT user_id, doc_id % 5 AS advertiser_id, date_trunc('day', occurred_at) AS start, count(*) AS n, count(*) >= 2 AS capped FROM watch_events GROUP BY 1, 2, 3",
    ),
    "z10_stream_alerts": (
        drained(Z.alerts, "complete", "recommendations", "served_at"),
        "SELECT date_trunc('hour', served_at) AS start, method, round(avg(latency_ms), 6) AS ms, count(*) AS n, avg(latency_ms) > 90 AS alert FROM recommendations GROUP BY 1, 2",
    ),
    "z12_stream_bandit_state": (lambda d: Z.drain(Z.bandit_state(stream(d)), folder(d)).select("user_id", "doc_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta")), BANDIT),
    "z14_split_late": (
        lambda d: Z.drain(Z.split_late(stream(d), "occurred_at", "7 DAYS", AS_OF).select("event_id", "late"), folder(d), "append"),
        f"SELECT event_id, occurred_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS late FROM watch_events",
    ),
    "z04_stream_retrain_trigger": (retrain, "SELECT unnest(range(1, n // 10000 + 1)) AS trigger_no FROM (SELECT count(*) AS n FROM watch_events)"),
    "z09_stream_last_n": (
        last_ten,
        "SELECT user_id, event_id, doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, event_id DESC) AS INT) AS place FROM watch_events QUALIFY place <= 10",
    ),
    "z11_stream_live_snapshots": (
        snapshots,
        """WITH a AS (SELECT doc_id, occurred_at, date_trunc('hour', occurred_at) + INTERVAL 6 HOUR AS s, date_trunc('hour', occurred_at) + INTERVAL 9 HOUR AS e, lead(occurred_at) OVER (PARTITION BY doc_id ORDER BY occurred_at, event_id) AS until
          FROM watch_events WHERE event_type = 'watch_start'),
        t AS (SELECT doc_id, s, e, unnest(generate_series(greatest(s - INTERVAL 4 HOUR, date_trunc('hour', occurred_at - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR), e - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS tick, until FROM a)
        SELECT doc_id, tick, CASE WHEN tick >= s THEN 'live' ELSE 'countdown' END AS state, epoch(CASE WHEN tick >= s THEN e - tick ELSE s - tick END)::DOUBLE AS seconds
        FROM t WHERE (until IS NULL OR tick < until) AND tick <= (SELECT max(occurred_at) - INTERVAL 10 MINUTE FROM watch_events)""",
    ),
    "z15_stream_model_notices": (
        notices,
        """SELECT model, rec_id, old_score, new_score, 100 * (new_score - old_score) / greatest(old_score, 0.001) AS improvement_pct FROM (
        SELECT method || ':' || query AS model, rec_id, served_at, ndcg_at_10 AS new_score, lag(ndcg_at_10) OVER (PARTITION BY method, query ORDER BY served_at, rec_id) AS old_score FROM recommendations)
        WHERE old_score IS NOT NULL AND served_at < (SELECT max(served_at) - INTERVAL 10 MINUTE FROM recommendations)""",
    ),
    "z13_refreshed_user_features": (lambda d: refreshed(d).users(), FEATURES["b01_user_features"][1]),
    "z13_refreshed_item_features": (lambda d: refreshed(d).items(d.items), FEATURES["b02_item_features"][1]),
}
