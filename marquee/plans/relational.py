"""Forms of joins, aggregates, windows, sets and text."""

from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators import relational as J
from marquee.operators.evaluate import overlap_at_k, split_integrity
from marquee.operators.features import last_n
from marquee.operators.retrieval import minmax, softmax
from marquee.plans.quality import rounded
from marquee.plans.retrieval import NORM
from marquee.streaming.events import split_late  # noqa: F401  the batch form of Z14

TAGS = ["red", "green", "blue", "steel", "gold"]


def catalog(d):
    return d.items.select("doc_id", F.concat(F.lit("Title: "), "title", F.lit(" | Genres: "), F.regexp_replace("genres", r"\|", ","), F.lit(" | Tags: "), "tags").alias("text"))


CATALOG = "cat AS (SELECT doc_id, 'Title: ' || title || ' | Genres: ' || replace(genres, '|', ',') || ' | Tags: ' || tags AS text FROM items)"

QUERIES = {
    "j07_left_agg": (
        lambda d: J.left_agg(d.users.select("user_id"), d.watch_events, "user_id", F.count("*").alias("n"), F.max("watch_pct").alias("most")).fillna(0, ["n"]),
        "SELECT user_id, coalesce(n, 0) AS n, most FROM users LEFT JOIN (SELECT user_id, count(*) AS n, max(watch_pct) AS most FROM watch_events GROUP BY 1) USING (user_id)",
    ),
    "j10_outer_scores": (lambda d: rounded(J.outer_scores(d.ranked_a, d.ranked_b), "a", "b"), "SELECT query_id, doc_id, round(coalesce(a.score, 0), 6) AS a, round(coalesce(b.score, 0), 6) AS b FROM ranked_a a FULL JOIN ranked_b b USING (query_id, doc_id)"),
    "j12_member_of": (lambda d: J.member_of(d.ranked_a.select("query_id", "doc_id"), d.graded_qrels, ["query_id", "doc_id"], "relevant"), "SELECT query_id, doc_id, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM graded_qrels) AS relevant FROM ranked_a"),
    "j13_impressions_with_outcome": (
        lambda d: J.impressions_with_outcome(d.watch_events.where("event_type = 'impression'").select("event_id", "user_id", "doc_id"), d.watch_events.where("event_type = 'watch_complete'").select("user_id", "doc_id", "watch_pct", F.col("occurred_at").alias("outcome_ts"), F.col("event_id").alias("outcome_id"))),
        """SELECT event_id, user_id, doc_id, p AS watch_pct, coalesce(p >= 0.25, false) AS watched FROM watch_events LEFT JOIN (SELECT user_id, doc_id, arg_max(watch_pct, (occurred_at, event_id)) AS p FROM watch_events WHERE event_type = 'watch_complete' GROUP BY 1, 2) USING (user_id, doc_id) WHERE event_type = 'impression'""",
    ),
    "j15_within_window": (
        lambda d: J.within_window(d.events.select("event_id", "ts"), d.nation.select(F.col("n_nationkey").alias("interval_id"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * n_nationkey").alias("start_ts"), F.expr("TIMESTAMP '2024-01-01 02:00:00' + INTERVAL '1' DAY * n_nationkey").alias("end_ts")), "ts").select("event_id", "interval_id"),
        "SELECT event_id, n_nationkey AS interval_id FROM events JOIN nation ON ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * n_nationkey AND TIMESTAMP '2024-01-01 02:00:00' + INTERVAL 1 DAY * n_nationkey",
    ),
    "j17_asof_previous": (
        lambda d: rounded(J.asof_previous(d.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), d.events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), "user_id", "ts", "value"), "value"),
        """SELECT p.user_id, p.ts, p.event_id, round(v.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    ),
    "a11_top_values": (
        lambda d: J.top_values(d.watch_events, "event_type", 2, "user_id"),
        "SELECT user_id, event_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS INT) AS rank FROM watch_events GROUP BY 1, 2 QUALIFY rank <= 2",
    ),
    "a15_by_slices": (
        lambda d: rounded(J.by_slices(d.events.select("event_type", (F.col("user_id") % 3).cast("string").alias("third"), "value"), ["event_type", "third"], "value"), "mean"),
        "SELECT event_type, third, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, CAST(user_id % 3 AS STRING) AS third, value FROM events) GROUP BY GROUPING SETS ((event_type), (third), ())",
    ),
    "w02_running_total": (
        lambda d: rounded(J.running_total(d.events.select("user_id", F.to_date("ts").alias("day"), "event_id", "value"), "user_id", "day", "value").select("event_id", "running"), "running"),
        "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)), 6) AS running FROM events",
    ),
    "w03_minmax": (lambda d: rounded(minmax(d.ranked_a, ["query_id"]).select("query_id", "doc_id", "norm"), "norm"), f"SELECT query_id, doc_id, round({NORM}, 6) AS norm FROM ranked_a WINDOW q AS (PARTITION BY query_id)"),
    "w04_softmax": (lambda d: rounded(softmax(d.ranked_a, "query_id", "score", 0.5).select("query_id", "doc_id", "p"), "p"), "SELECT query_id, doc_id, round(exp(score / 0.5) / sum(exp(score / 0.5)) OVER (PARTITION BY query_id), 6) AS p FROM ranked_a"),
    "w05_last_n": (lambda d: last_n(d.events, "user_id", "ts", 3, "event_id").select("user_id", "event_id"), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3"),
    "u02_overlap_at_k": (lambda d: overlap_at_k(d.ranked_a, d.ranked_b, 20), "SELECT query_id, count(*) AS overlap FROM ranked_a a JOIN ranked_b b USING (query_id, doc_id) WHERE a.rank <= 20 AND b.rank <= 20 GROUP BY 1"),
    "u04_concat_tiers": (lambda d: J.concat_tiers(d.ranked_a.where("rank <= 2").select("query_id", "doc_id"), d.ranked_b.where("rank <= 3").select("query_id", "doc_id")), "SELECT query_id, doc_id, 0::INT AS tier FROM ranked_a WHERE rank <= 2 UNION ALL SELECT query_id, doc_id, 1::INT FROM ranked_b WHERE rank <= 3"),
    "u05_ordered_distinct": (
        lambda d: J.ordered_distinct(d.watch_events, "user_id", ["occurred_at", "event_id"], "doc_id"),
        "SELECT user_id, doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min((occurred_at, event_id))) AS INT) AS place FROM watch_events WHERE doc_id IS NOT NULL GROUP BY 1, 2",
    ),
    "u06_overlap_keys": (
        lambda d: split_integrity(d.watch_events.where("event_type = 'click'"), d.watch_events.where("event_type = 'skip'"), "user_id"),
        "SELECT count(DISTINCT user_id) FILTER (event_type = 'click') AS n_train, count(DISTINCT user_id) FILTER (event_type = 'skip') AS n_test, (SELECT count(*) FROM (SELECT user_id FROM watch_events WHERE event_type = 'click' INTERSECT SELECT user_id FROM watch_events WHERE event_type = 'skip')) AS n_overlap FROM watch_events",
    ),
    "p03_title_contains": (lambda d: d.items.where(F.col("title").ilike("%RED%")).select("doc_id", "title"), "SELECT doc_id, title FROM items WHERE title ILIKE '%RED%'"),
    "p09_parse_catalog": (
        lambda d: J.parse_catalog(catalog(d)).select("doc_id", F.col("fields")["title"].alias("title"), F.col("fields")["tags"].alias("tags")),
        "SELECT doc_id, title, tags FROM items",
    ),
    "p10_extract_genres": (
        lambda d: catalog(d).select("doc_id", F.array_join(X.genres(F.col("text")), ";").alias("genres")),
        f"WITH {CATALOG} SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(regexp_split_to_array(regexp_extract(text, '(?i)Genres?:\\s*([^.]+)', 1), '[,|]'), lambda g: lower(trim(g))), lambda g: g <> ''), 1, 4), ';') AS genres FROM cat",
    ),
    "p11_extract_tags": (
        lambda d: J.extract_tags(d.items, TAGS, "title").select("doc_id", F.array_join("tags", ";").alias("tags")),
        f"SELECT doc_id, array_to_string(list_filter({TAGS!r}, lambda t: contains(lower(title), t)), ';') AS tags FROM items",
    ),
    "p12_extract_year": (
        lambda d: d.items.select("doc_id", X.year(F.col("title"), F.col("tags")).alias("year")),
        "SELECT doc_id, CAST(regexp_extract(title, '\\((\\d{4})\\)', 1) AS INT) AS year FROM items",
    ),
    "p13_ablate": (
        lambda d: J.ablate(catalog(d), "genres"),
        f"WITH {CATALOG} SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s*\\|\\s*'), lambda p: NOT starts_with(lower(p), 'genres')), ' | ') AS text FROM cat",
    ),
    "p14_build_corpus": (
        lambda d: J.build_corpus(d.items, d.items.select("doc_id", F.explode(F.split("tags", ",")).alias("tag")), 2),
        """WITH t AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, tag) AS r FROM (SELECT doc_id, unnest(string_split(tags, ',')) AS tag FROM items) GROUP BY 1, 2),
        x AS (SELECT doc_id, string_agg(tag, ',' ORDER BY r) AS tags FROM t WHERE r <= 2 GROUP BY 1) SELECT i.doc_id, title, concat_ws(' | ', 'Title: ' || title, 'Genres: ' || replace(genres, '|', ','), 'Tags: ' || x.tags) AS text FROM items i LEFT JOIN x ON i.doc_id = x.doc_id""",
    ),
    "f02_normalise": (
        lambda d: X.normalise_unicode(d.documents.select("doc_id", "text"), "text").select("doc_id", F.char_length("normalised").alias("n_chars"), F.md5("normalised").alias("normalised_md5")),
        None,
    ),
    "f03_edit_distance": (
        lambda d: d.items.select("doc_id", F.levenshtein(F.split("title", " ")[0], F.split("title", " ")[1]).alias("d")),
        "SELECT doc_id, CAST(levenshtein(split_part(title, ' ', 1), split_part(title, ' ', 2)) AS INT) AS d FROM items",
    ),
    "f09_short_hash": (lambda d: d.items.select("doc_id", X.short_hash(F.col("title")).alias("h")), "SELECT doc_id, substr(md5(title), 1, 12) AS h FROM items"),
}
