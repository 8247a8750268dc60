"""Personal boosts, moods, live events, ad reports and feature variants, over tables of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators.features import last_n
from marquee.operators.retrieval import corpus_search, dense_search, entity_boost, hybrid_merge, splice, topk

#: The mood of a genre, the moods a query's words ask for, and what a matching mood adds at most.
GENRE_MOODS = {
    "horror": "scary_horror", "thriller": "dark_and_gritty", "crime": "dark_and_gritty", "romance": "romantic", "comedy": "comedic", "animation": "light_and_fun", "children": "light_and_fun", "family": "heartwarming",
    "drama": "melancholic", "action": "action_intense", "adventure": "epic_grand", "sci-fi": "mysterious", "mystery": "mysterious", "fantasy": "epic_grand", "documentary": "melancholic",
}
QUERY_MOODS = {
    "scary": ["scary_horror", "dark_and_gritty", "mysterious"], "horror": ["scary_horror", "dark_and_gritty"], "funny": ["comedic", "light_and_fun"], "romantic": ["romantic", "heartwarming"], "action": ["action_intense", "epic_grand"],
    "dark": ["dark_and_gritty", "melancholic", "mysterious"], "feel good": ["heartwarming", "light_and_fun", "comedic"], "sad": ["melancholic"], "epic": ["epic_grand", "action_intense"], "mystery": ["mysterious", "dark_and_gritty"],
}
MOOD_STEP, MOOD_MOST = 0.08, 0.25


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def keyword_boost(ranked: DataFrame, users: DataFrame, corpus: DataFrame, weight: float = 0.15) -> DataFrame:
    """ranked(user_id, doc_id, score) plus weight times the share of the user's keywords (an array) that title or text contains; overlap 0 without keywords."""
    text = corpus.select("doc_id", F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("hay"))
    both = ranked.join(users.select("user_id", "keywords"), "user_id", "left").join(text, "doc_id", "left")
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.col("hay"), F.lower(k))))
    overlap = F.when(F.size("keywords") > 0, F.coalesce(hits, F.lit(0)) / F.size("keywords")).otherwise(0.0)
    return both.select("user_id", "doc_id", F.col("score").alias("base"), overlap.alias("overlap"), (F.col("score") + weight * overlap).alias("score"))


def embedding_boost(ranked: DataFrame, history: DataFrame, vectors: DataFrame, overlaps: DataFrame | None = None, weight: float = 0.15, n: int = 20, least: int = 3) -> DataFrame:
    """ranked(user_id, doc_id, score) plus weight times the cosine, if positive, of the item to the mean of the user's last n watched(user_id, doc_id, ts, event_id).

    Users with fewer than `least` rows of history, and items without a vector, get `weight` times overlaps(user_id, doc_id, overlap) where that is given.
    """
    mine = last_n(history.select("user_id", "doc_id", "ts", "event_id"), "user_id", "ts", n, "event_id")
    known = vectors.select("doc_id", F.col("embedding").alias("v"))
    each = mine.join(known, "doc_id").select("user_id", F.posexplode("v").alias("at", "x")).groupBy("user_id", "at").agg(F.avg("x").alias("x"))
    mean = each.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("u"))
    enough = mine.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("user_id")
    both = ranked.join(mean.join(enough, "user_id"), "user_id", "left").join(known, "doc_id", "left")
    sim = F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), X.cosine(F.col("u"), F.col("v")))
    if overlaps is None:
        both, fallback = both.withColumn("overlap", F.lit(0.0)), F.lit("none")
    else:
        both, fallback = both.join(overlaps.select("user_id", "doc_id", "overlap"), ["user_id", "doc_id"], "left"), F.when(F.col("overlap").isNotNull(), "keyword").otherwise("none")
    boost = F.when(sim.isNotNull(), weight * F.greatest(sim, F.lit(0.0))).otherwise(weight * F.coalesce("overlap", F.lit(0.0)))
    return both.select("user_id", "doc_id", F.col("score").alias("base"), boost.alias("boost"), (F.col("score") + boost).alias("score"), F.when(sim.isNotNull(), "embedding").otherwise(fallback).alias("method"))


def explain_boost(scored: DataFrame) -> DataFrame:
    """Base, boost, personalised score and lift in percent of embedding_boost()'s rows."""
    lift = 100 * F.col("boost") / F.greatest(F.abs("base"), F.lit(1e-9))
    return scored.select("user_id", "doc_id", "method", "base", "boost", F.col("score").alias("personalized"), lift.alias("lift_pct"))


def mood_tags(items: DataFrame, moods: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, mood_tags, style_tags) of items(doc_id, genres: array): up to three moods in the genres' order, and a style."""
    names = F.transform("genres", lambda g: F.lower(g))
    tags = F.slice(F.array_distinct(F.filter(F.transform(names, lambda g: F.try_element_at(literal_map(moods or GENRE_MOODS), g)), lambda m: m.isNotNull())), 1, 3)
    style = F.when(F.arrays_overlap(names, F.array(F.lit("animation"), F.lit("animated"))), "animated").when(F.array_contains(names, "documentary"), "documentary_style").otherwise("live_action_modern")
    return items.select("doc_id", tags.alias("mood_tags"), F.array(style).alias("style_tags"))


def mood_features(tagged: DataFrame, moods: list[str]) -> DataFrame:
    """One 0/1 column for each of the moods."""
    return tagged.select("doc_id", *(F.array_contains("mood_tags", m).cast("int").alias(f"mood_{m}") for m in moods))


def mood_boost(ranked: DataFrame, queries: DataFrame, tagged: DataFrame, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """Scores plus .08 for each mood of a document that each keyword in the query asks for, .25 at most; ranked again."""
    both = ranked.drop("rank").join(queries.select("query_id", F.lower("text").alias("q")), "query_id").join(tagged.select("doc_id", "mood_tags"), "doc_id", "left")
    found = F.lit(0)
    for word, moods in (wanted or QUERY_MOODS).items():
        shared = F.size(F.array_intersect("mood_tags", F.array(*map(F.lit, moods))))
        found = found + F.when(F.contains(F.col("q"), F.lit(word)) & F.col("mood_tags").isNotNull(), shared).otherwise(0)
    boost = F.least(found * MOOD_STEP, F.lit(MOOD_MOST))
    return topk(both.select("query_id", "doc_id", boost.alias("boost"), F.round(F.col("score") + boost, 4).alias("score")))


def live_state(live: DataFrame, as_of: str, countdown_hours: int = 24, replay_hours: int = 6) -> DataFrame:
    """live(doc_id, start_ts, end_ts) with state live, countdown, replay or none, and seconds to the start and to the end."""
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    to_start, to_end = ((F.unix_micros(F.col(c).cast("timestamp")) - now) / 1e6 for c in ("start_ts", "end_ts"))
    state = F.when((to_start <= 0) & (to_end > 0), "live").when((to_start > 0) & (to_start <= 3600 * countdown_hours), "countdown").when((to_end <= 0) & (to_end > -3600 * replay_hours), "replay").otherwise("none")
    return live.withColumns({"to_start": to_start, "to_end": to_end, "length": to_end - to_start, "state": state})


def live_boost(ranked: DataFrame, live: DataFrame, as_of: str, ranking: float = 5.0, countdown: float = 2.0) -> DataFrame:
    """Scores of documents with a live event by its state, with urgency; others keep theirs."""
    known = live_state(live, as_of).select("doc_id", "state", "to_start", "to_end", "length")
    both = ranked.drop("rank").join(known, "doc_id", "left")
    left = 1 - F.col("to_end") / F.greatest("length", F.lit(1.0))
    near = F.greatest(F.lit(0.1), 1 - F.col("to_start") / 3600 / 24)
    state, s = F.col("state"), F.col("score")
    urgency = F.when(state == "live", left).when(state == "countdown", near * 0.5).when(state == "replay", 0.1).otherwise(0.0)
    boost = F.when(state == "live", ranking * (1 + left * 0.5)).when(state == "countdown", countdown * near).when(state == "replay", 1.2).otherwise(1.0)
    final = F.when(state == "live", s * boost + urgency * 2).otherwise(s * boost)
    return topk(both.select("query_id", "doc_id", F.coalesce("state", F.lit("none")).alias("live_state"), F.round(boost, 3).alias("live_boost"), F.round(urgency, 3).alias("urgency"), F.round(final, 4).alias("score")))


def live_rows(live: DataFrame, as_of: str) -> DataFrame:
    """(row_title, position, doc_id, seconds): what is live, soonest end first, and what starts soon, soonest start first."""
    now = live_state(live, as_of).where("state in ('live', 'countdown')")
    title, seconds = F.when(F.col("state") == "live", "Live Now").otherwise("Starting Soon"), F.when(F.col("state") == "live", F.col("to_end")).otherwise(F.col("to_start"))
    rows = now.select(title.alias("row_title"), F.round(seconds).cast("long").alias("seconds"), "doc_id")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("row_title").orderBy("seconds", "doc_id")))


def foundation_score(rows: DataFrame) -> DataFrame:
    """rows(…, ltr_score, intent_match: boolean, intent_confidence, artwork_quality, novelty) with intent_align and combined."""
    align = F.when(F.col("intent_match"), 1.0).otherwise(0.3) * F.col("intent_confidence")
    combined = 0.5 * F.col("ltr_score") + 0.25 * align + 0.15 * F.col("artwork_quality") + 0.1 * F.col("novelty")
    return rows.withColumns({"intent_align": align, "combined": combined})


def ad_report(requests: DataFrame, shows: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, best n advertisers) of shows(request_id, advertiser_id, price_usd, clicked) against requests(request_id); the fill rate counts requests that got an ad."""
    stats = shows.agg(F.count("*").alias("n_impressions"), F.count_if("clicked").alias("n_clicks"), F.sum("price_usd").alias("revenue"), F.count_distinct("request_id").alias("filled"))
    asked = requests.agg(F.count_distinct("request_id").alias("n_requests"))
    totals = asked.join(stats).select(
        "n_requests", "n_impressions", "n_clicks", F.round("revenue", 4).alias("total_revenue_usd"), F.round(F.try_divide(1000 * F.col("revenue"), F.col("n_impressions")), 4).alias("avg_cpm_usd"),
        F.round(F.try_divide(F.col("filled").cast("double"), F.col("n_requests")), 4).alias("fill_rate"), F.round(F.try_divide(F.col("n_clicks").cast("double"), F.col("n_impressions")), 4).alias("ctr"),
    )
    best = shows.groupBy("advertiser_id").agg(F.round(F.sum("price_usd"), 4).alias("revenue_usd"), F.count("*").alias("shows")).orderBy(F.desc("revenue_usd"), "advertiser_id").limit(n)
    return totals, best


def _texts(cands: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    q = queries.select("query_id", X.tokens(F.col("text")).alias("q"))
    return cands.join(q, "query_id").join(corpus, "doc_id")


def ltr_features_v1(cands: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Eight features of cands(query_id, doc_id, bm25_score, dense_score) over corpus(doc_id, title, text, tags, genres): overlaps by the query's size, log lengths, and whether a query word stands in tags or genres."""
    qs = F.array_distinct("q")
    of = lambda c: F.size(F.array_intersect(qs, X.tokens(F.col(c)))) / F.greatest(F.size(qs), F.lit(1))
    stands = lambda c: F.exists(qs, lambda t: F.contains(F.lower(F.col(c)), t)).cast("double")
    size = lambda c: F.log1p(F.char_length(c))
    return _texts(cands, queries, corpus).select(
        "query_id", "doc_id", "bm25_score", "dense_score", of("title").alias("title_overlap"), of("text").alias("text_overlap"), size("title").alias("title_len_log"), size("text").alias("text_len_log"), stands("tags").alias("tag_match"), stands("genres").alias("genre_match")
    )


def ltr_features_v2(cands: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Three scores, three lengths in words and two overlaps by the query's size."""
    qs = F.array_distinct("q")
    of = lambda c: F.size(F.array_intersect(qs, X.tokens(F.col(c)))) / F.greatest(F.size(qs), F.lit(1))
    return _texts(cands, queries, corpus).select(
        "query_id", "doc_id", "bm25_score", "dense_score", "hybrid_score", F.size("q").alias("query_len"), F.size(X.tokens(F.col("title"))).alias("title_len"), F.size(X.tokens(F.col("text"))).alias("text_len"), of("title").alias("title_overlap"), of("text").alias("text_overlap")
    )


def training_table(ranked: DataFrame, qrels: DataFrame, candidates: int = 50, min_rel: int = 1, held_pct: int = 15) -> DataFrame:
    """(query_id, doc_id, score, label, split): the head of each ranking with its judgement from min_rel on, else 0; whole queries are held out by a hash of their id."""
    head = ranked.where(F.col("rank") <= candidates).join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left")
    label = F.when(F.col("relevance") >= min_rel, F.col("relevance")).otherwise(0)
    held = F.conv(F.substring(F.md5(F.col("query_id").cast("string")), 1, 6), 16, 10).cast("int") % 100 < held_pct
    return head.select("query_id", "doc_id", "score", label.alias("label"), F.when(held, "val").otherwise("train").alias("split"))


def make_labels(corpus: DataFrame, templates: DataFrame, least: int = 5) -> DataFrame:
    """(query_id, doc_id, relevance) of templates(query_id, key): 2 for documents with the key among their tags, 1 for those with it among their genres only; queries with at least `least` of them. corpus has tags and genres as arrays."""
    keyed = corpus.select("doc_id", F.explode("tags").alias("key"), F.lit(2).alias("relevance")).unionByName(corpus.select("doc_id", F.explode("genres").alias("key"), F.lit(1).alias("relevance")))
    graded = keyed.withColumn("key", F.lower(F.trim("key"))).groupBy("key", "doc_id").agg(F.max("relevance").alias("relevance"))
    enough = graded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
    return templates.select("query_id", F.lower(F.trim("key")).alias("key")).join(enough, "key").join(graded, "key").select("query_id", "doc_id", "relevance")


def make_key_queries(corpus: DataFrame, patterns: list[str], least: int = 5, most: int = 5000) -> DataFrame:
    """(text, key, n_docs): each pattern (with {}) filled with each tag or genre that least to most documents have."""
    keys = corpus.select("doc_id", F.explode(F.array_distinct(F.concat("tags", "genres"))).alias("key")).groupBy(F.lower(F.trim("key")).alias("key")).agg(F.count_distinct("doc_id").alias("n_docs"))
    fits = keys.where(F.col("n_docs").between(least, most))
    return fits.select(F.explode(F.array(*(F.replace(F.lit(p), F.lit("{}"), F.col("key")) for p in patterns))).alias("text"), "key", "n_docs")


def by_group_gap(per_query: DataFrame, groups: DataFrame, metric: str = "ndcg") -> DataFrame:
    """Mean metric and count of each group(query_id, slice)."""
    return per_query.join(groups, "query_id").groupBy("slice").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))


def cold_gap(per_query: DataFrame, users: DataFrame, cold: int = 5, warm: int = 20) -> DataFrame:
    """by_group_gap() of queries of cold users (fewer watches than `cold`) and warm ones; users(query_id, watches)."""
    side = F.when(F.col("watches") < cold, "cold").when(F.col("watches") >= warm, "warm")
    return by_group_gap(per_query, users.select("query_id", side.alias("slice")).where("slice is not null"))


def temporal_gap(per_query: DataFrame, qrels: DataFrame, items: DataFrame, year: int = 2010) -> DataFrame:
    """by_group_gap() of queries most of whose relevant documents are from before `year`, and of the rest."""
    old = qrels.where("relevance > 0").join(items.select("doc_id", "year"), "doc_id").groupBy("query_id").agg(F.avg((F.col("year") < year).cast("int")).alias("share"))
    return by_group_gap(per_query, old.select("query_id", F.when(F.col("share") > 0.5, "old").otherwise("new").alias("slice")))


def answer_quality_by_language(scored: DataFrame, least: int = 5) -> DataFrame:
    """Mean scores of scored(language, faithfulness, relevance, context_recall) of languages with at least `least` answers."""
    return scored.groupBy("language").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("faithfulness", "relevance", "context_recall"))).where(F.col("n") >= least)


def lookahead_path(poses: DataFrame, horizon: int = 12) -> DataFrame:
    """poses(scene, frame, x, y, yaw) with the next `horizon` places relative to the frame (turned by -yaw); the last place is repeated where frames end."""
    w = Window.partitionBy("scene").orderBy("frame")
    ahead = w.rowsBetween(1, horizon)
    here = poses.withColumn("next", F.collect_list(F.struct("x", "y")).over(ahead)).withColumn("next", F.when(F.size("next") > 0, F.col("next")).otherwise(F.array(F.struct("x", "y"))))
    filled = F.concat("next", F.array_repeat(F.element_at("next", -1), F.lit(horizon) - F.size("next")))
    c, s = F.cos("yaw"), F.sin("yaw")

    def relative(p: Column) -> Column:
        dx, dy = p["x"] - F.col("x"), p["y"] - F.col("y")
        return F.struct((c * dx + s * dy).alias("x"), (c * dy - s * dx).alias("y"))

    return here.select("scene", "frame", F.transform(filled, relative).alias("path"))


def hash_vectors(rows: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, embedding) of each row's words, counted in `size` places that a hash of the word names; a vector channel that needs no model."""
    words = X.tokens(F.col(text))
    place = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % size
    spots = F.transform(words, place)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(spots, lambda p: p == i)).cast("double"))
    return rows.select(key, counts.alias("embedding"))


def hashed_search(queries: DataFrame, corpus: DataFrame, k: int = 20) -> DataFrame:
    """Best k documents of each query by hashed words of their titles; only documents whose title shares a place with the query."""
    return dense_search(hash_vectors(queries, "query_id", "text"), hash_vectors(corpus, "doc_id", "title"), k).where("score > 0")


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, candidates: int = 20, alpha: float = 0.5, boosted: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """The whole search of a table of queries as one plan: BM25 over title and text, hashed vectors over titles, fusion, a boost for boosted(query_id, doc_id), and a new score for the first `head`."""
    words = corpus_search(queries, corpus, candidates)
    merged = hybrid_merge(words, hashed_search(queries, corpus, candidates), alpha)
    if boosted is not None:
        merged = entity_boost(merged, boosted)
    if head:
        merged = splice(rescore_pairs(merged.where(F.col("rank") <= head), queries, corpus), merged)
    return merged.where(F.col("rank") <= k)


def rescore_pairs(ranked: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Joint score of each pair of query and document: the share of the query's words in the title, and half of that in the text; ranked again."""
    rows = ranked.select("query_id", "doc_id").join(queries.select("query_id", F.array_distinct(X.tokens(F.col("text"))).alias("q")), "query_id").join(corpus.select("doc_id", X.tokens(F.col("title")).alias("t"), X.tokens(F.col("text")).alias("d")), "doc_id")
    share = lambda c: F.size(F.array_intersect("q", c)) / F.greatest(F.size("q"), F.lit(1))
    return topk(rows.select("query_id", "doc_id", (share("t") + 0.5 * share("d")).alias("score")))


def feed(profiles: DataFrame, seeds: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """(profile_id, row_no, doc_id, score, rank): one search for each of the profile's seeds(row_no, suffix), asked as one table of queries."""
    asked = profiles.crossJoin(F.broadcast(seeds)).select(F.struct("profile_id", "row_no").alias("key"), F.concat_ws(" ", "taste", "suffix").alias("text"))
    numbered = asked.select(F.xxhash64("key.profile_id", "key.row_no").alias("query_id"), "key", "text")
    hits = search(numbered.select("query_id", "text"), corpus, k)
    return hits.join(numbered.select("query_id", "key"), "query_id").select("key.profile_id", "key.row_no", "doc_id", "score", "rank")


def cold_start_neighbors(new_items: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Nearest known titles of new_items(query_id, title, genres), by a search for title and genres."""
    return search(new_items.select("query_id", F.concat_ws(" ", "title", "genres").alias("text")), corpus, k)


#: The share of each format on a surface, and how much an intent favours a format.
SURFACE_MIX = {
    "home": {"film": 0.5, "series": 0.35, "live_event": 0.1, "podcast": 0.05}, "new_popular": {"film": 0.4, "series": 0.4, "live_event": 0.15, "podcast": 0.05},
    "live": {"live_event": 0.8, "film": 0.2}, "games": {"game": 0.9, "film": 0.1},
}
INTENT_FORMATS = {
    "background_noise": {"series": 1.3, "podcast": 1.2}, "dedicated_viewing": {"film": 1.4, "series": 1.1}, "social_watching": {"live_event": 1.8, "film": 1.2}, "discovery_mode": {"podcast": 1.3, "game": 1.2},
}
BUSINESS_WORDS = ("original", "exclusive", "award")


def _of_pair(table: dict[str, dict[str, float]], first: Column, second: Column, other: Column) -> Column:
    """table[first][second], else `other`."""
    flat = {f"{a}|{b}": v for a, row in table.items() for b, v in row.items()}
    known = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.concat_ws("|", first, second)), other)


def cross_format(ranked: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Scores of ranked(query_id, doc_id, score, content_type, surface, intent) raised by the surface's mix and the intent's formats; unknown surfaces count as home, unknown formats as film."""
    formats = ("film", "series", "live_event", "podcast", "game")
    kind = F.when(F.col("content_type").isin(*formats), F.col("content_type")).otherwise("film")
    surface = F.when(F.col("surface").isin(*SURFACE_MIX), F.col("surface")).otherwise("home")
    by_intent = F.when(F.coalesce(F.col("intent"), F.lit("")) == "", 1.0).otherwise(_of_pair(INTENT_FORMATS, F.col("intent"), kind, F.lit(1.0)))
    boost = _of_pair(SURFACE_MIX, surface, kind, F.lit(0.1)) * alpha + by_intent * alpha * 0.5
    return topk(ranked.select("query_id", "doc_id", boost.alias("format_boost"), (F.col("score") * (1 + boost)).alias("score")))


def multi_objective(ranked: DataFrame, diverse: DataFrame, corpus: DataFrame, k: int | None = None, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), words: tuple[str, ...] = BUSINESS_WORDS) -> DataFrame:
    """Min-max relevance, place in a diverse ranking (rank from 1; 0 beyond it) and whether a business word stands in title or text, weighted and ranked."""
    w = Window.partitionBy("query_id")
    low, n = F.min("score").over(w), F.count("*").over(w)
    span = F.greatest(F.max("score").over(w) - low, F.lit(1e-9))
    scaled = ranked.select("query_id", "doc_id", ((F.col("score") - low) / span).alias("rel"), n.alias("n"))
    both = scaled.join(diverse.select("query_id", "doc_id", F.col("rank").alias("place")), ["query_id", "doc_id"], "left").join(corpus.select("doc_id", F.lower(F.concat_ws(" ", "text", "title")).alias("hay")), "doc_id", "left")
    div = F.coalesce(1 - (F.col("place") - 1) / F.greatest("n", F.lit(1)), F.lit(0.0))
    business = F.coalesce(F.col("hay").rlike("|".join(words)).cast("double"), F.lit(0.0))
    a, b, c = (x / sum(weights) for x in weights)
    return topk(both.select("query_id", "doc_id", (a * F.col("rel") + b * div + c * business).alias("score")), k)


def session_summary(log: DataFrame) -> DataFrame:
    """Minutes, queries, pivot (three neighbouring intents that all differ) and the last five intents of each session of log(session_id, ts, event_id, intent)."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    a, b, c = F.col("intent"), F.lag("intent", 1).over(w), F.lag("intent", 2).over(w)
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = log.select("session_id", "ts", "event_id", "intent", ((a != b) & (b != c) & (a != c)).alias("turn"), back.alias("back"))
    last = F.array_sort(F.collect_list(F.when(F.col("back") <= 5, F.struct((-F.col("back")).alias("at"), "intent"))))
    minutes = F.round((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 60e6, 1)
    return rows.groupBy("session_id").agg(minutes.alias("duration_min"), F.count("*").alias("n_queries"), F.coalesce(F.max("turn"), F.lit(False)).alias("pivot_detected"), F.array_join(F.transform(last, lambda x: x["intent"]), ",").alias("intents"))


def merge_household(feeds: DataFrame, slots: int = 20, balance: dict[str, float] | None = None) -> DataFrame:
    """(household_id, position, profile, doc_id, score): profiles of feeds(household_id, profile, doc_id, score, rank) take turns in the order of their names, each with its share of the slots, no document twice.

    A profile's head of slots * (its household's profiles) documents is enough for that, so a task never holds more of a household.
    """
    import pandas as pd

    shares = balance or {}
    sizes = feeds.groupBy("household_id").agg(F.count_distinct("profile").alias("n"))
    head = feeds.join(sizes, "household_id").where(F.col("rank") <= slots * F.col("n")).drop("n")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["profile", "rank", "doc_id"])
        lists = {p: iter(g[["doc_id", "score"]].itertuples(index=False)) for p, g in rows.groupby("profile", sort=True)}
        weight = {p: shares.get(p, 0.0) if shares else 1.0 for p in lists}
        total = sum(weight.values()) or 1.0
        left = {p: max(1, round(w / total * slots)) for p, w in weight.items()}
        used: set = set()
        out: list[tuple] = []
        moved = True
        while moved and len(out) < slots:
            moved = False
            for p, rest in lists.items():
                hit = next((r for r in rest if r.doc_id not in used), None) if left[p] > 0 else None
                if hit is not None:
                    used.add(hit.doc_id)
                    left[p] -= 1
                    out.append((rows["household_id"].iloc[0], len(out) + 1, p, hit.doc_id, hit.score))
                    moved = True
        return pd.DataFrame(out[:slots], columns=["household_id", "position", "profile", "doc_id", "score"])

    kinds = dict(feeds.dtypes)
    return head.groupBy("household_id").applyInPandas(one, f"household_id {kinds['household_id']}, position int, profile {kinds['profile']}, doc_id {kinds['doc_id']}, score double")


def evaluate_all(datasets: dict[str, tuple[DataFrame, DataFrame]], k: int = 10) -> DataFrame:
    """(dataset, n_queries, mean_ndcg) of a ranking and its judgements for each data set, in one plan."""
    from marquee.operators import evaluate as M

    parts = [M.macro_average(M.ndcg(ranked, qrels, k), "ndcg").withColumn("dataset", F.lit(name)) for name, (ranked, qrels) in datasets.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def promote_by_quality(runs: DataFrame, least: float = 0.3) -> DataFrame:
    """Runs with `promoted`: their nDCG reaches the gate; none without a value."""
    return runs.withColumn("promoted", F.coalesce(F.col("ndcg_at_10") >= least, F.lit(False)))


def graph_search(queries: DataFrame, corpus: DataFrame, edges: DataFrame, k: int = 20, seeds: int = 5) -> DataFrame:
    """Documents that the graph reaches from the first hits of a search."""
    from marquee.operators.graphs import expand

    return expand(search(queries, corpus, seeds).select("query_id", "doc_id"), edges, k=k)
