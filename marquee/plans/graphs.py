"""Item graph."""

from pyspark.sql import functions as F

from marquee.operators import graphs as G
from marquee.plans.quality import rounded

ITEMS = "it AS (SELECT doc_id, title, string_split(genres, '|') AS genres, list_distinct(string_split(tags, ',')) AS tags FROM items)"
GENRE = f"""{ITEMS}, mem AS (SELECT doc_id, genre FROM (SELECT doc_id, genre, row_number() OVER (PARTITION BY genre ORDER BY doc_id) AS r FROM (SELECT doc_id, unnest(genres) AS genre FROM it)) WHERE r <= 50),
pr AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM mem a JOIN mem b ON a.genre = b.genre AND a.doc_id < b.doc_id),
ge0 AS (SELECT src, dst, len(list_intersect(a.genres, b.genres)) / len(list_distinct(a.genres || b.genres))::DOUBLE AS w FROM pr JOIN it a ON src = a.doc_id JOIN it b ON dst = b.doc_id),
ge AS (SELECT src, dst, round(w, 3) AS weight, 'genre' AS edge_type FROM ge0 WHERE w >= 0.3 UNION ALL SELECT dst, src, round(w, 3), 'genre' FROM ge0 WHERE w >= 0.3)"""
TAG = f"""{GENRE}, tm AS (SELECT doc_id, tag FROM (SELECT doc_id, tag, row_number() OVER (PARTITION BY tag ORDER BY doc_id) AS r FROM (SELECT doc_id, unnest(tags) AS tag FROM it)) WHERE r <= 30),
tp AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM tm a JOIN tm b ON a.tag = b.tag AND a.doc_id <> b.doc_id),
te AS (SELECT src, dst, 0.6::DOUBLE AS weight, 'tag' AS edge_type FROM tp WHERE (src, dst) NOT IN (SELECT (src, dst) FROM ge))"""
EXPAND = f"""{GENRE}, st AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM ge WHERE weight >= 0.3) WHERE r <= 10),
seeds AS (SELECT DISTINCT user_id AS query_id, doc_id FROM watch_events WHERE event_type = 'watch_complete'),
h1 AS (SELECT query_id, dst AS doc_id, max(weight) AS score FROM seeds JOIN st ON doc_id = src GROUP BY 1, 2 HAVING (query_id, dst) NOT IN (SELECT (query_id, doc_id) FROM seeds)),
h2 AS (SELECT query_id, dst AS doc_id, max(score * weight * 0.8) AS score FROM h1 JOIN st ON doc_id = src GROUP BY 1, 2 HAVING (query_id, dst) NOT IN (SELECT (query_id, doc_id) FROM seeds) AND (query_id, dst) NOT IN (SELECT (query_id, doc_id) FROM h1))"""


def items(d):
    return d.items.select("doc_id", "title", F.split("genres", "[|]").alias("genres"), F.array_distinct(F.split("tags", ",")).alias("tags"))


def seeds(d):
    return d.watch_events.where("event_type = 'watch_complete'").select(F.col("user_id").alias("query_id"), "doc_id").distinct()


QUERIES = {
    "g01_genre_edges": (lambda d: G.genre_edges(items(d)), f"WITH {GENRE} SELECT * FROM ge"),
    "g02_tag_edges": (lambda d: G.tag_edges(items(d), G.genre_edges(items(d))), f"WITH {TAG} SELECT * FROM te"),
    "g03_expand": (
        lambda d: rounded(G.expand(seeds(d), G.genre_edges(items(d))), "score"),
        f"WITH {EXPAND}, f AS (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT query_id, doc_id, round(score, 6) AS score, hops, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 20",
    ),
    "g04_neighbors": (lambda d: G.neighbors(G.genre_edges(items(d)), 5), f"WITH {GENRE} SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS rank FROM ge QUALIFY rank <= 5"),
    "g05_find_titles": (
        lambda d: G.find_titles(d.items.select(F.upper("title").alias("title")).unionByName(d.items.select(F.split("title", " ")[0].alias("title"))).distinct(), d.items),
        """WITH t AS (SELECT title, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM (SELECT upper(title) AS title FROM items UNION SELECT split_part(title, ' ', 1) FROM items)),
        i AS (SELECT doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS ik FROM items), e AS (SELECT title, min(doc_id) AS doc_id FROM t JOIN i ON k = ik GROUP BY 1)
        SELECT title, doc_id, 'equal' AS match FROM e UNION ALL SELECT title, min(doc_id), 'contains' FROM t JOIN i ON contains(ik, k) OR contains(k, ik) WHERE title NOT IN (SELECT title FROM e) GROUP BY 1""",
    ),
    "g06_graph_stats": (lambda d: G.graph_stats(items(d), G.genre_edges(items(d))), f"WITH {GENRE} SELECT edge_type, count(*) AS n_edges, count(DISTINCT src) AS n_sources, (SELECT count(*) FROM it) AS n_nodes FROM ge GROUP BY 1"),
}
