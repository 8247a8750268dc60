"""Whole pages of recommendations, chosen item by item for what each adds to those before it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.sources.working import importable

#: Weights of relevance, satisfaction, new genres, uncertainty and new content types, and what a new type is worth.
RELEVANCE, SATISFACTION, DIVERSITY, EXPLORATION, BUSINESS, NEW_TYPE = 0.45, 0.25, 0.15, 0.10, 0.05, 0.5
#: Fixed value: every fifth place is one for diversity.
EVERY = 5

SLATE = "query_id long, place int, doc_id long, slot_type string, gain double, new_genres int, new_type boolean"


def contenders(cands: DataFrame, k: int) -> DataFrame:
    """The rows of cands that a slate of k can contain, with `base`, the part of the gain that other choices don't change.

    What an item adds beyond its base depends on its genres and its content type only. So of items with equal ones the
    better k are enough: a further one is always behind one of them that is still free. The row limit reaches each task
    before the shuffle.
    """
    known = F.array_sort(F.array_distinct("genres"))
    base = RELEVANCE * F.col("score") + SATISFACTION * F.coalesce("satisfaction", F.lit(0.0)) + EXPLORATION * F.coalesce("uncertainty", F.lit(0.5))
    rows = cands.select("query_id", "doc_id", "rank", F.col("genres"), known.alias("kind"), F.coalesce("content_type", F.lit("film")).alias("content_type"), F.coalesce("satisfaction", F.lit(0.0)).alias("satisfaction"), base.alias("base"))
    order = Window.partitionBy("query_id", "kind", F.size("genres"), "content_type").orderBy(F.desc(F.round("base", 9)), "rank", "doc_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n", "kind")


def choose(rows: list[dict], k: int, explore_rate: float) -> list[dict]:
    """Greedy slate of rows(doc_id, rank, genres, content_type, base): in each place the item that adds most, the earlier rank of equals."""
    free = sorted(rows, key=lambda r: (r["rank"], r["doc_id"]))
    covered: set[str] = set()
    types: set[str] = set()
    slate: list[dict] = []

    def gain(row: dict) -> float:
        fresh = len(set(row["genres"]) - covered) / max(1, len(row["genres"]))
        return round(row["base"] + DIVERSITY * fresh + BUSINESS * (NEW_TYPE if row["content_type"] not in types else 0.0), 9)

    while free and len(slate) < k:
        best = max(free, key=gain)
        place = len(slate)
        kind = "explore" if place < int(k * explore_rate) else "diversity" if place % EVERY == EVERY - 1 else "exploit"
        slate.append({"doc_id": best["doc_id"], "place": place + 1, "slot_type": kind, "gain": gain(best), "new_genres": len(set(best["genres"]) - covered), "new_type": best["content_type"] not in types})
        covered |= set(best["genres"])
        types.add(best["content_type"])
        free.remove(best)
    return slate


def optimise_slate(cands: DataFrame, k: int = 12, explore_rate: float = 0.15) -> DataFrame:
    """(query_id, place, doc_id, slot_type, gain, new_genres, new_type) of each query's slate.

    cands(query_id, doc_id, rank, score, genres array, content_type, satisfaction, uncertainty); a missing type counts
    as film, missing satisfaction as 0 and missing uncertainty as one half. A task holds one query's contenders: at most
    k for each combination of genres and type.
    """

    def slate(group: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {"genres": list(r["genres"])} for r in group.to_dict("records")]
        made = pd.DataFrame(choose(rows, k, explore_rate))
        return made.assign(query_id=group["query_id"].iloc[0])[["query_id", "place", "doc_id", "slot_type", "gain", "new_genres", "new_type"]]

    importable(cands.sparkSession)
    kept = contenders(cands.where("genres is not null"), k)
    return kept.select("query_id", "doc_id", "rank", "genres", "content_type", "base").groupBy("query_id").applyInPandas(slate, SLATE)


def slate_scores(slates: DataFrame, cands: DataFrame) -> DataFrame:
    """Per query: items, diversity (genres covered over genres an item), mean satisfaction, places that explore, and coherence (the share of neighbours with a common genre)."""
    rows = slates.select("query_id", "doc_id", "place", "slot_type").join(cands.select("query_id", "doc_id", "genres", F.coalesce("satisfaction", F.lit(0.0)).alias("satisfaction")), ["query_id", "doc_id"])
    before = F.lag("genres").over(Window.partitionBy("query_id").orderBy("place"))
    per = rows.withColumn("tied", F.arrays_overlap("genres", before).cast("int")).groupBy("query_id").agg(
        F.count("*").alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list("genres")))).alias("covered"),
        F.avg(F.size(F.array_distinct("genres"))).alias("each"),
        F.avg("satisfaction").alias("satisfaction_estimate"),
        F.count_if(F.col("slot_type") == "explore").alias("exploration_slots"),
        F.sum(F.coalesce("tied", F.lit(0))).alias("tied"),
    )
    many = F.col("items") >= 2
    return per.select(
        "query_id",
        "items",
        F.when(many, F.col("covered") / F.greatest(F.lit(1.0), F.col("each"))).otherwise(0.0).alias("diversity_score"),
        "satisfaction_estimate",
        "exploration_slots",
        F.when(many, F.col("tied") / (F.col("items") - 1)).otherwise(1.0).alias("page_coherence"),
    )
