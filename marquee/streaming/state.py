"""Streams with state of their own: last rows of each key, timed snapshots, notices in event time.

State is bounded, and Spark saves it with the checkpoint, so a query goes on after a restart as if it had never stopped.
Snapshots and notices come when the watermark has passed their time, by a timeout of their key's state: they appear
whether or not the key has a new event, and what they say doesn't depend on how rows were cut into batches.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

# what runs in workers travels whole, so that they need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# -- the last n rows of each key


def _merged(kept: list[tuple], batches: Iterator[pd.DataFrame], n: int) -> list[tuple]:
    """The n greatest of kept (at, id, value) and the batches' rows; a row that comes again counts once."""
    for batch in batches:
        known = {r[:2]: r for r in kept}
        known.update({(a, i): (a, i, v) for a, i, v in zip(batch["at"].tolist(), batch["id"].tolist(), batch["value"].tolist())})
        kept = sorted(known.values(), reverse=True)[:n]
    return kept


def last_n(sdf: DataFrame, by: str, ts: str, tie: str, value: str, n: int, ttl_days: int | None = None) -> DataFrame:
    """(key, id, at, value, place) of the n latest rows of each key, each key's whole list anew when it changes (update mode).

    Latest by ts, then by the greater `tie`, a number that names a row: a row that comes again changes nothing. With
    ttl_days, which needs a watermark on ts, a list is forgotten when its latest row is that far behind it. A task holds one list and one Arrow batch of rows at a time.
    """
    rows = sdf.select(F.col(by).alias("key"), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("id"), F.col(value).cast("long").alias("value")).where("at is not null and value is not null")
    ttl = None if ttl_days is None else ttl_days * 86_400_000

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        before = list(zip(*state.get)) if state.exists else []
        kept = _merged(before, batches, n)
        state.update(tuple(list(c) for c in zip(*kept)))
        if ttl is not None:
            state.setTimeoutTimestamp(max(kept[0][0] // 1000 + ttl, max(0, state.getCurrentWatermarkMs()) + 1))
        if kept != before:
            yield pd.DataFrame({"key": [key[0]] * len(kept), "id": [r[1] for r in kept], "at": [r[0] for r in kept], "value": [r[2] for r in kept], "place": range(1, len(kept) + 1)})

    kind = sdf.schema[by].dataType.simpleString()
    state = "at array<bigint>, id array<bigint>, value array<bigint>"
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, id bigint, at bigint, value bigint, place int", state, "update", GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout)


# -- snapshots of live events


def _tick(at: int, every: int) -> int:
    """The first tick from `at` on."""
    return -(-at // every) * every


def due(plans: list[tuple[int, int, int]], tick: int, until: int, every: int, lead: int) -> tuple[list[tuple[int, str, int]], int | None]:
    """(rows of the ticks from `tick` to `until`, the next tick that may have one or None) of plans (announced, start, stop), sorted.

    The plan announced last holds at a tick; ticks that can't have a row are skipped.
    """
    rows, times = [], [p[0] for p in plans]
    while True:
        n = bisect.bisect_right(times, tick) - 1
        after = _tick(times[n + 1], every) if n + 1 < len(times) else None
        if n >= 0:
            _, start, stop = plans[n]
            first = _tick(start - lead, every)
            if first <= tick < stop:
                if tick > until:
                    return rows, tick
                rows.append((tick, "live", stop - tick) if tick >= start else (tick, "countdown", start - tick))
                tick += every
                continue
            if tick < first:
                tick = first if after is None else min(first, after)
                continue
        if after is None:
            return rows, None
        tick = after


def live_snapshots(sdf: DataFrame, ts: str, start: str, stop: str, every: int = 30, lead: int = 86_400) -> DataFrame:
    """(doc_id, tick, state, seconds): every `every` seconds what is live, and what starts within `lead` seconds.

    sdf(doc_id, ts, start, stop) has a watermark on ts; rows without start only move time on. An announcement holds from
    its ts until the document's next one. seconds are those left until the end of what is live, or until the start.
    A tick is written once the watermark has passed it (append mode); plans that no later tick can see are dropped.
    """
    every, lead = every * 1000, lead * 1000

    def step(key, batches, state):
        plans = list(zip(*state.get[:3])) if state.exists else []
        tick = state.get[3] if state.exists else None
        mark = max(0, state.getCurrentWatermarkMs())
        new = [] if state.hasTimedOut else [(int(a), int(s), int(e)) for b in batches for a, s, e in zip(b["at"], b["start"], b["stop"]) if not (pd.isna(s) or pd.isna(e))]
        if new:
            # the watermark's own ticks are written already or due now
            first = _tick(max(min(p[0] for p in new), mark + 1), every)
            tick = first if tick is None else min(tick, first)
            plans = sorted({p[0]: p for p in sorted(plans + new)}.values())
        if tick is None:
            return
        rows, tick = due(plans, tick, mark, every, lead)
        if tick is None:
            state.remove()
        else:
            seen = max(0, bisect.bisect_right([p[0] for p in plans], mark) - 1)
            state.update((*(list(c) for c in zip(*plans[seen:])), tick))
            # a timeout has to lie behind the watermark, and this tick does
            state.setTimeoutTimestamp(tick)
        if rows:
            yield pd.DataFrame({"doc_id": [key[0]] * len(rows), "tick_ms": [r[0] for r in rows], "state": [r[1] for r in rows], "left_ms": [r[2] for r in rows]})

    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = sdf.select("doc_id", F.col(ts), ms(ts).alias("at"), ms(start).alias("start"), ms(stop).alias("stop"))
    state = "at array<bigint>, start array<bigint>, stop array<bigint>, tick bigint"
    made = rows.groupBy("doc_id").applyInPandasWithState(step, "doc_id bigint, tick_ms bigint, state string, left_ms bigint", state, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("doc_id", F.timestamp_millis("tick_ms").alias("tick"), "state", (F.col("left_ms") / 1000).alias("seconds"))


# -- notices of changed models


def model_notices(sdf: DataFrame, model: str, ts: str, tie: str, score: str) -> DataFrame:
    """(model, id, at, old_score, new_score, improvement_pct): each model's scores against the one before, in event time (append mode).

    sdf has a watermark on ts; scores wait in the state until it has passed them. improvement_pct is 100 * (new - old) /
    max(old, 0.001). Rows of one moment go by `tie`; a row that comes again counts once.
    """

    def step(key, batches, state):
        waiting = set(zip(*state.get[:3])) if state.exists else set()
        before = state.get[3] if state.exists else None
        if not state.hasTimedOut:
            waiting.update((a, i, s) for b in batches for a, i, s in zip(b["at"].tolist(), b["id"].tolist(), b["score"].tolist()))
        mark, out = max(0, state.getCurrentWatermarkMs()), []
        passed = sorted(r for r in waiting if r[0] < mark)
        for at, i, now in passed:
            if before is not None:
                out.append((key[0], i, at, before, now))
            before = now
        left = sorted(r for r in waiting if r[0] >= mark)
        state.update((*(list(c) for c in (zip(*left) if left else ((), (), ()))), before))
        if left:
            state.setTimeoutTimestamp(left[0][0] + 1)
        if out:
            yield pd.DataFrame(out, columns=["model", "id", "at", "old_score", "new_score"])

    rows = sdf.select(F.col(model).alias("model"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("id"), F.col(score).cast("double").alias("score")).where("score is not null")
    state = "at array<bigint>, id array<bigint>, score array<double>, before double"
    made = rows.groupBy("model").applyInPandasWithState(step, "model string, id bigint, at bigint, old_score double, new_score double", state, "append", GroupStateTimeout.EventTimeTimeout)
    change = 100 * (F.col("new_score") - F.col("old_score")) / F.greatest(F.col("old_score"), F.lit(0.001))
    return made.select("model", "id", F.timestamp_millis("at").alias("at"), "old_score", "new_score", change.alias("improvement_pct"))


# -- running


def run(sdf: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what its source has now, going on from `folder`'s checkpoint; all rows written so far, with their `batch`."""
    spark, out = sdf.sparkSession, f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is replayed overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = sdf.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*sdf.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of rows written in update mode those of each key's last batch."""
    newest = F.max("batch").over(Window.partitionBy(key))
    return rows.withColumn("__newest", newest).where(F.col("batch") == F.col("__newest")).drop("__newest", "batch")
