"""Streams with state against their batch meaning: batches cut at random, restarts, replays."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from marquee.operators import features as B
from marquee.streaming import events as Z
from marquee.streaming import refresh as RF
from marquee.streaming import state as ST

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "event_id long, user_id long, doc_id long, ts timestamp, start timestamp, stop timestamp, score double"


def made(seed, n=160):
    rng = random.Random(seed)
    rows, at = [], START
    for i in range(n):
        at += timedelta(seconds=rng.randrange(1, 400))
        start = at + timedelta(seconds=rng.randrange(0, 3000)) if rng.random() < 0.3 else None
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(4), at, start, start and start + timedelta(seconds=rng.randrange(60, 2500)), rng.choice([None, rng.random()])))
    return rows


def feed(spark, folder, rows, cuts, first=0):
    """The rows as one file for each stretch between cuts; file names in order."""
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/part={first + n:03d}")


def source(spark, folder):
    return Z.read_files(spark, f"{folder}/*", spark.createDataFrame([], EVENTS).schema, files_a_batch=1)


def test_last_rows_over_batches_and_a_restart(spark, tmp_path):
    rows = made(1)
    shuffled = random.Random(2).sample(rows, len(rows))

    def result():
        out = ST.run(ST.last_n(source(spark, f"{tmp_path}/in"), "user_id", "ts", "event_id", "doc_id", 5), f"{tmp_path}/q", "update")
        return sorted((r.key, r.place, r.id, r.value) for r in ST.latest(out, "key").collect())

    def want(upto):
        found = []
        for user in (1, 2, 3):
            own = sorted((r for r in shuffled[:upto] if r[1] == user), key=lambda r: (r[3], r[0]), reverse=True)[:5]
            found += [(user, n + 1, r[0], r[2]) for n, r in enumerate(own)]
        return found

    feed(spark, f"{tmp_path}/in", shuffled, [0, 30, 70])
    assert result() == want(70)
    # some rows come a second time
    feed(spark, f"{tmp_path}/in", shuffled, [50, 110, 160], 2)
    assert result() == want(160)
    assert result() == want(160)


def snapshots(rows, every, lead):
    """Ticks up to the watermark, from all announcements."""
    mark = max(r[3] for r in rows).timestamp() - 60
    out = []
    for doc in range(4):
        plans = sorted((r[3].timestamp(), r[4].timestamp(), r[5].timestamp()) for r in rows if r[2] == doc and r[4])
        tick = -(-int(START.timestamp()) // every) * every
        while tick <= mark and plans:
            held = [p for p in plans if p[0] <= tick]
            if held:
                _, start, stop = held[-1]
                if start <= tick < stop:
                    out.append((doc, tick, "live", stop - tick))
                elif start - lead <= tick < start:
                    out.append((doc, tick, "countdown", start - tick))
            tick += every
    return sorted(out)


def test_snapshots_come_from_timers_whatever_the_batches(spark, tmp_path):
    for seed, cuts in ((3, [0, 160]), (3, [0, 11, 12, 60, 100, 160]), (4, [0, 50, 90, 160])):
        rows, folder = made(seed), f"{tmp_path}/{seed}-{len(cuts)}"
        feed(spark, f"{folder}/in", rows, cuts)
        timed = Z.with_event_time(source(spark, f"{folder}/in"), "ts", "1 minute")
        got = ST.run(ST.live_snapshots(timed, "ts", "start", "stop", every=30, lead=600), f"{folder}/q", "append")
        assert sorted((r.doc_id, r.t, r.state, r.seconds) for r in got.withColumn("t", F.unix_timestamp("tick")).collect()) == snapshots(rows, 30, 600)


def test_notices_compare_neighbours_in_event_time(spark, tmp_path):
    rows = made(5)
    late_by_a_bit = sorted(rows, key=lambda r: (r[0] // 3, -r[0]))
    feed(spark, f"{tmp_path}/in", late_by_a_bit, [0, 33, 66, 120, 160])
    timed = Z.with_event_time(source(spark, f"{tmp_path}/in"), "ts", "30 minutes").withColumn("model", F.col("doc_id").cast("string"))
    got = ST.run(ST.model_notices(timed, "model", "ts", "event_id", "score"), f"{tmp_path}/q", "append")
    mark = max(r[3] for r in rows) - timedelta(minutes=30)
    want = []
    for doc in range(4):
        own = [r for r in rows if r[2] == doc and r[6] is not None]
        want += [(str(doc), b[0], a[6], b[6], 100 * (b[6] - a[6]) / max(a[6], 0.001)) for a, b in zip(own, own[1:]) if b[3] < mark]
    assert sorted((r.model, r.id, r.old_score, r.new_score, r.improvement_pct) for r in got.collect()) == sorted(want)


def test_a_trigger_for_every_crossing(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", made(6), [0, 7, 95, 160])
    Z.retrain_trigger(spark, source(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", n=20).awaitTermination()
    got = sorted((r.trigger_no, r.total) for r in spark.read.parquet(f"{tmp_path}/out/triggers").collect())
    assert got == [(1, 95), (2, 95), (3, 95), (4, 95), (5, 160), (6, 160), (7, 160), (8, 160)]


RATINGS = "user_id long, doc_id long, rating double, rated_at timestamp"


def test_refreshed_features_equal_all_rows_after_replays_and_merges(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(12), rng.randrange(9), rng.choice([0.5, 1.0, 3.5, 5.0, 1e6 + 0.1]), START + timedelta(hours=rng.randrange(999))) for _ in range(200)]
    ratings = spark.createDataFrame(rows, RATINGS)
    items = spark.createDataFrame([(n, f"T{n} ({1985 + n * 5})", "a|b") for n in range(7)], "doc_id long, title string, genres string")
    store = RF.FeatureStore(spark, f"{tmp_path}/store", fold=3)
    parts = [spark.createDataFrame(rows[a : a + 50], RATINGS) for a in range(0, 200, 50)]
    for number, part in enumerate(parts):
        store.absorb(part, number)
        if number in (0, 2):
            store.absorb(part, number)  # a replay, once before and once after a merge
    again = RF.FeatureStore(spark, f"{tmp_path}/store", fold=3)
    assert again._upto() == 2 and again._batches() == [2, 3]

    def same(got, want, key):
        got, want = ({r[key]: r.asDict() for r in df.collect()} for df in (got, want))
        assert set(got) == set(want)
        for k, row in want.items():
            for column, value in row.items():
                assert got[k][column] == value or abs(got[k][column] - value) <= 1e-9 * max(1, abs(value)), (k, column)

    same(again.users(), B.user_features(ratings), "user_id")
    same(again.items(items), B.item_features(ratings, items), "doc_id")


def test_a_refresh_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [(n % 5, n % 7, 0.5 + n % 9 / 2, START + timedelta(hours=n)) for n in range(60)]
    schema = spark.createDataFrame([], RATINGS).schema
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], RATINGS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={n}")
        store = RF.refresh(Z.read_files(spark, f"{tmp_path}/in/*", schema, files_a_batch=1), str(tmp_path), fold=2)
        got = store.users().agg(F.sum("n_ratings")).first()[0]
        assert got == 20 * (n + 1)
