"""Item graph from shared genres and tags, and expansion along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators.relational import substring_pairs


def cap_groups(df: DataFrame, by: str, n: int, tie: str = "doc_id") -> DataFrame:
    """The first n rows of each key by `tie`; bounds the pairs that a group makes."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(tie))).where(F.col("__r") <= n).drop("__r")


def _group_pairs(members: DataFrame, by: str) -> DataFrame:
    a, b = members.select(by, F.col("doc_id").alias("src")), members.select(by, F.col("doc_id").alias("dst"))
    return a.join(b, by).where("src < dst").select("src", "dst").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def genre_edges(items: DataFrame, least: float = 0.3, cap: int = 50) -> DataFrame:
    """Edges both ways between items(doc_id, genres array) of a capped genre group whose genres' Jaccard likeness is at least `least`."""
    members = cap_groups(items.select("doc_id", F.explode("genres").alias("genre")), "genre", cap)
    g = items.select("doc_id", "genres")
    pairs = _group_pairs(members, "genre").join(g.select(F.col("doc_id").alias("src"), F.col("genres").alias("ga")), "src").join(g.select(F.col("doc_id").alias("dst"), F.col("genres").alias("gb")), "dst")
    weighted = pairs.select("src", "dst", X.jaccard(F.col("ga"), F.col("gb")).alias("w")).where(F.col("w") >= least)
    return both_ways(weighted.select("src", "dst", F.round("w", 3).alias("weight"), F.lit("genre").alias("edge_type")))


def tag_edges(items: DataFrame, existing: DataFrame, weight: float = 0.6, cap: int = 30) -> DataFrame:
    """Edges both ways between items(doc_id, tags array) that share a tag and have no edge yet."""
    pairs = _group_pairs(cap_groups(items.select("doc_id", F.explode("tags").alias("tag")), "tag", cap), "tag")
    return both_ways(pairs).join(existing.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(weight).alias("weight"), F.lit("tag").alias("edge_type"))


def neighbors(edges: DataFrame, k: int) -> DataFrame:
    """Best k edges of each node by weight, then target."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, k: int = 20, fan: int = 10, least: float = 0.3) -> DataFrame:
    """Documents reached from seeds(query_id, doc_id): score times weight times 0.8 to the hop. The fewest hops count, then the best score."""
    steps = neighbors(edges.where(F.col("weight") >= least), fan).select(F.col("src").alias("doc_id"), "dst", "weight")
    front = seeds.select("query_id", "doc_id", F.lit(1.0).alias("score"))
    seen = seeds.select("query_id", "doc_id")
    found = None
    for hop in range(hops):
        reached = front.join(steps, "doc_id").groupBy("query_id", F.col("dst").alias("doc_id")).agg(F.max(F.col("score") * F.col("weight") * 0.8**hop).alias("score"))
        front = reached.join(seen, ["query_id", "doc_id"], "left_anti")
        seen = seen.unionByName(front.select("query_id", "doc_id"))
        step = front.withColumn("hops", F.lit(hop + 1))
        found = step if found is None else found.unionByName(step)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def graph_stats(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges of each kind."""
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_sources")).crossJoin(F.broadcast(items.agg(F.count("*").alias("n_nodes"))))


def find_titles(titles: DataFrame, items: DataFrame) -> DataFrame:
    """(title, doc_id, match): the item of the same letters and digits, else the first that contains them or is contained."""
    t = titles.select("title", X.title_key(F.col("title")).alias("key")).where("key <> ''")
    i = items.select("doc_id", X.title_key(F.col("title")).alias("item_key"))
    same = t.join(i, t["key"] == i["item_key"]).groupBy("title").agg(F.min("doc_id").alias("doc_id")).withColumn("match", F.lit("equal"))
    rest = t.join(same, "title", "left_anti")
    within = substring_pairs(i, rest, "item_key", "key").select("doc_id", "key").join(rest, "key")
    around = substring_pairs(rest, i.where("item_key <> ''"), "key", "item_key").join(i, "item_key")
    inside = within.select("title", "doc_id").unionByName(around.select("title", "doc_id")).groupBy("title").agg(F.min("doc_id").alias("doc_id")).withColumn("match", F.lit("contains"))
    return same.unionByName(inside)
