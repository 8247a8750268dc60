"""Substring lookup, Unicode normalisation, distinct values in order, held drops and topics, against plain Python."""

import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import FOLDER
from pyspark.sql import functions as F

from marquee.functions.text import normalise_unicode
from marquee.operators.health import held_drop
from marquee.operators.relational import ordered_distinct, substring_pairs
from marquee.operators.retrieval import bm25_search, build_index, corpus_search
from marquee.streaming import events as S

WORDS = st.one_of(st.none(), st.text("abA .", max_size=7))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, max_size=8), st.lists(WORDS, max_size=5))
def test_substring_pairs_equal_all_pairs(spark, texts, needles):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = substring_pairs(rows, spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = sorted((i, t, n) for i, t in enumerate(texts) for n in set(needles) if t is not None and n is not None and n in t)
    assert sorted(map(tuple, got.select("id", "text", "needle").collect())) == want


def test_substring_lookup_has_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, "abc")], "id int, text string")
    plan = substring_pairs(rows, rows.select(F.col("text").alias("needle")))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain(text):
    if text is None:
        return None
    kept = re.sub(r"[^a-z0-9\s\-'.]", " ", unicodedata.normalize("NFKC", text).lower(), flags=re.ASCII)
    return re.sub(r"\s+", " ", kept, flags=re.ASCII).strip(" ")


def test_normalised_texts(spark):
    texts = ["ﬁlm ① Café", "Ｆｕｌｌ", "Plain  Text!", "", None, "Ångström", "x²"]
    got = normalise_unicode(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.normalised for r in got} == {t: plain(t) for t in texts}
    assert {r.text: r.normalised for r in got}["Ｆｕｌｌ"] == "full"


def test_normalised_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = normalise_unicode(docs).collect()
    assert len(got) == docs.count() and all(r.normalised == plain(r.text) for r in got)


def test_ordered_distinct(spark):
    rows = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (1, 2, "b"), (1, 2, "a"), (2, 1, None), (2, 2, "c"), (2, 2, "c")], "u int, t int, v string")
    assert sorted(map(tuple, ordered_distinct(rows, "u", ["t"], "v").collect())) == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]


def test_held_drop(spark):
    # an hour at 1.0, then low at minutes 60, 62, 66, back at 67, low again from 68 on
    low = {60: 0.9, 62: 0.8, 66: 0.9, 67: 1.0, 68: 0.9, 72: 0.9}
    rows = [(m, 1.0) for m in range(0, 60, 5)] + list(low.items())
    series = spark.createDataFrame(rows, "m int, v double").select(F.lit("x").alias("by"), F.timestamp_seconds(F.col("m") * 60).alias("ts"), "m", "v")
    got = held_drop(series.drop("m"), "by", "ts", "v").select((F.unix_timestamp("ts") / 60).cast("int"), "before", "firing").collect()
    assert sorted(map(tuple, got)) == [(60, 1.0, False), (62, 1.0, False), (66, 1.0, True), (68, 1.0, False), (72, 1.0, False)]
    assert held_drop(series.drop("m").limit(0), "by", "ts", "v").count() == 0


def test_topic_rows_come_back(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    rows = S.topic_rows(events, "user_id")
    assert rows.columns == ["key", "value"] and dict(rows.dtypes) == {"key": "string", "value": "string"}
    back = S.topic_values(rows.select(F.col("value").cast("binary").alias("value")), events.schema)
    assert back.schema == events.schema
    assert back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0
    wrong = spark.createDataFrame([("not json",), (None,)], "value string")
    assert S.topic_values(wrong, events.schema).where("event_id is null").count() == 2


def test_appended_log_goes_on_after_a_restart(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    want = events.select("event_id", "user_id", "event_type", "ts")
    half = want.where("event_id % 2 = 0")
    for part in (half, want.exceptAll(half), None):
        if part is not None:
            part.write.mode("append").parquet(source)
        S.append_log(S.read_files(spark, source, want.schema, files_a_batch=1), out, checkpoint).awaitTermination()
    back = spark.read.schema(want.schema).options(**S.TIMES).json(out)
    assert back.count() == want.count() and back.exceptAll(want).count() == 0


def test_search_reads_the_corpus_once(spark):
    corpus = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.lit("t").alias("title"), "text")
    queries = corpus.orderBy("doc_id").limit(3).select(F.col("doc_id").alias("query_id"), F.lower(F.substring("text", 1, 30)).alias("text"))
    asked = spark.createDataFrame(queries.collect(), queries.schema)
    found = corpus_search(asked, corpus, 5)
    place = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert place(found) == place(bm25_search(asked, build_index(corpus), 5))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1  # its shuffle is reused, as are those of the asked words
    assert corpus_search(queries, corpus.limit(0), 5).count() == 0
