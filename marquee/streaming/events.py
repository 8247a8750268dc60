"""Event streams: sources, sinks, counters, sessions, late rows and joins, each with event-time meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Times in JSON keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(path)


def read_topic(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON values of a Kafka topic as columns; needs Spark's Kafka package and a broker."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return topic_values(raw, schema)


def topic_values(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the JSON in `value`; what isn't an object of the schema gives nulls."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema, TIMES).alias("v")).select("v.*")


def topic_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, value): rows as JSON, keyed by a column."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), TIMES).alias("value"))


def write_topic(sdf: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """At-least-once JSON rows keyed by a column."""
    return topic_rows(sdf, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def append_log(sdf: DataFrame, path: str, checkpoint: str):
    """Append rows as JSON lines."""
    return sdf.writeStream.format("json").options(**TIMES).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def with_event_time(sdf: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark on ts, which must be a timestamp with a zone."""
    return sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def popularity(sdf: DataFrame, ts: str = "occurred_at", gap: str = "24 hours") -> DataFrame:
    """Clicks and starts by document and session; a count begins anew after `gap` without events."""
    hot = sdf.where(F.col("event_type").isin("click", "watch_start"))
    return hot.groupBy("doc_id", F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n")).select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def completions(sdf: DataFrame, ts: str = "occurred_at", gap: str = "7 days") -> DataFrame:
    done = sdf.where((F.col("event_type") == "watch_complete") & (F.col("watch_pct") > 0.8))
    return done.groupBy("doc_id", F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n")).select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def affinity(sdf: DataFrame, ts: str = "occurred_at", gap: str = "30 days") -> DataFrame:
    """Completions by user and document; forgotten after `gap` without one."""
    done = sdf.where(F.col("event_type") == "watch_complete")
    return done.groupBy("user_id", "doc_id", F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "doc_id", F.col("w.start").alias("start"), "n")


def sessions(sdf: DataFrame, ts: str = "occurred_at", minutes: int = 5) -> DataFrame:
    """Events of each user in tumbling windows, named sess_<user>_<window number>."""
    seconds = 60 * minutes
    w = F.window(F.col(ts), f"{minutes} minutes")
    counted = sdf.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    number = F.floor(F.unix_timestamp("w.start") / seconds)
    return counted.select("user_id", F.concat(F.lit("sess_"), F.col("user_id").cast("string"), F.lit("_"), number.cast("string")).alias("session_id"), "n")


def dedup(sdf: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key was not seen within the watermark; plain distinct keys on a batch."""
    return sdf.dropDuplicatesWithinWatermark([key]) if sdf.isStreaming else sdf.dropDuplicates([key])


def caps(sdf: DataFrame, cap: int, ts: str = "occurred_at", hours: int = 24) -> DataFrame:
    """Shows of each user and advertiser in windows of `hours`, and whether the cap is reached."""
    w = F.window(F.col(ts), f"{hours} hours")
    return sdf.groupBy("user_id", "advertiser_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", "advertiser_id", F.col("w.start").alias("start"), "n", (F.col("n") >= cap).alias("capped"))


def join_outcomes(impressions: DataFrame, outcomes: DataFrame, delay: str = "7 days") -> DataFrame:
    """Impressions with an outcome of the same user and document up to `delay` later; both sides need watermarks. impressions(imp_id, user_id, doc_id, shown_at), outcomes(user_id, doc_id, watch_pct, done_at)."""
    i, o = impressions.alias("i"), outcomes.alias("o")
    when = F.expr(f"i.user_id = o.user_id AND i.doc_id = o.doc_id AND o.done_at >= i.shown_at AND o.done_at <= i.shown_at + INTERVAL {delay}")
    return i.join(o, when, "inner").select("i.imp_id", "i.user_id", "i.doc_id", "i.shown_at", "o.done_at", "o.watch_pct")


def alerts(sdf: DataFrame, ts: str = "served_at", width: str = "1 hour", limit_ms: float = 90.0) -> DataFrame:
    """Windows whose mean latency is over a limit."""
    s = sdf.groupBy(F.window(F.col(ts), width).alias("w"), "method").agg(F.avg("latency_ms").alias("ms"), F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), "method", F.round("ms", 6).alias("ms"), "n", (F.col("ms") > limit_ms).alias("alert"))


def bandit_state(sdf: DataFrame) -> DataFrame:
    """The batch rule as a streaming aggregate; its sums commute."""
    from marquee.operators.people import bandit_state as batch

    return batch(sdf)


def split_late(sdf: DataFrame, ts: str, delay: str, as_of: str) -> DataFrame:
    """Rows with `late`: behind `as_of` by more than the delay."""
    return sdf.withColumn("late", F.col(ts).cast("timestamp") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {delay}"))


def retrain_trigger(spark: SparkSession, sdf: DataFrame, path: str, checkpoint: str, n: int = 10_000):
    """Count rows batch by batch in a table; a batch that brings the total over another multiple of n leaves a row (trigger_no, total) for each."""

    def step(batch: DataFrame, number: int) -> None:
        # a batch that is replayed overwrites its own folder
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        total = spark.read.parquet(f"{path}/counts").where(F.col("batch") <= number).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("batch") < number, F.col("n"))).alias("before"))
        reached, had = F.floor(F.col("n") / n), F.floor(F.coalesce("before", F.lit(0)) / n)
        crossed = total.where(reached > had).select(F.explode(F.sequence(had + 1, reached)).alias("trigger_no"), F.col("n").alias("total"))
        crossed.write.mode("overwrite").parquet(f"{path}/triggers/batch={number}")

    return sdf.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(sdf: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source has now; the last complete result, or all appended rows, as a table in `folder`."""
    spark = sdf.sparkSession
    out = f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        # a complete result replaces the one before; appended rows get a folder a batch, which a replay overwrites
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = sdf.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out) if mode == "complete" else spark.read.schema(sdf.schema).option("recursiveFileLookup", "true").parquet(out)
