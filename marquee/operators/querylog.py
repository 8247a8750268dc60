"""Query understanding as enrichment of a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text as X

#: Genres, moods, common misspellings and the words that reveal an intent.
GENRES = ("action", "adventure", "animation", "biography", "comedy", "crime", "documentary", "drama", "family", "fantasy", "history", "horror", "music", "mystery", "romance", "sci-fi", "sport", "thriller", "war", "western", "noir", "superhero", "heist")
MOODS = ("dark", "gritty", "light", "funny", "scary", "heartwarming", "epic", "intense", "relaxing", "uplifting", "thought-provoking", "mind-bending", "feel-good", "disturbing", "inspiring", "suspenseful")
TYPOS = {"acton": "action", "commedy": "comedy", "horro": "horror", "romace": "romance", "thriler": "thriller", "documentry": "documentary", "scifi": "sci-fi", "sifi": "sci-fi", "animaton": "animation", "adventur": "adventure", "biograpy": "biography"}
SIMILAR = ("like", "similar", "reminds", "remind", "same as", "type of")
PEOPLE = ("with", "starring", "directed by", "by", "featuring", "actor", "director")
EXPLORE = ("something", "anything", "recommend", "suggest", "good", "best", "top")
BUY = ("watch", "play", "show me", "find")
EXPANSIONS = {"sci-fi": ("science fiction", "futuristic"), "noir": ("dark", "crime"), "feel-good": ("uplifting", "heartwarming"), "mind-bending": ("psychological", "twist"), "heist": ("crime", "robbery"), "superhero": ("marvel", "dc")}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def correct_spelling(queries: DataFrame, vocabulary: tuple[str, ...] = GENRES + MOODS) -> DataFrame:
    """(query_id, corrected): known misspellings replaced, other words of over three letters by the one vocabulary word at distance 1 (the first in order)."""
    words = queries.select("query_id", F.posexplode(F.split(X.normalise(F.col("text")), " ")).alias("pos", "word"))
    vocab = F.broadcast(queries.sparkSession.createDataFrame([(w,) for w in sorted(vocabulary)], "vocab string"))
    odd = words.select("word").distinct().where((F.length("word") > 3) & ~F.col("word").isin(*vocabulary) & ~F.col("word").isin(*TYPOS))
    near = odd.join(vocab, F.levenshtein("word", "vocab", 1) >= 0).groupBy("word").agg(F.min("vocab").alias("near"))
    typo = F.create_map(*[F.lit(x) for kv in TYPOS.items() for x in kv])
    fixed = words.join(near, "word", "left").withColumn("fixed", F.coalesce(typo[F.col("word")], "near", "word"))
    return fixed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fixed"))), lambda x: x["fixed"]), " ").alias("corrected"))


def recognise_entities(queries: DataFrame, text: str = "text") -> DataFrame:
    """Genres, moods, years, decades (as four digits) and persons that each query names, comma-joined."""
    low = F.lower(text)
    years = F.regexp_extract_all(low, F.lit(r"\b(19[0-9]{2}|20[0-2][0-9])\b"), F.lit(1))
    decades = F.transform(F.regexp_extract_all(low, F.lit(r"\b((?:19|20)?[0-9]0)s\b"), F.lit(1)), lambda d: F.when(F.length(d) == 2, F.concat(F.when(d < "30", "20").otherwise("19"), d)).otherwise(d))
    lists = {"genres": X.keyword_hits(low, sorted(GENRES)), "moods": X.keyword_hits(low, sorted(MOODS)), "years": years, "decades": decades, "persons": persons(F.col(text))}
    return queries.select("query_id", text, *(F.array_join(v, ",").alias(n) for n, v in lists.items()))


def persons(text: Column) -> Column:
    """For each trigger that a query has, in their order, the capitalised ones of the three words behind its first place, blank-joined."""
    names = []
    for trigger in PEOPLE:
        at = F.instr(F.lower(text), trigger)
        words = F.filter(F.split(F.trim(F.substring(text, at + len(trigger), F.length(text))), r"\s+"), lambda w: w != "")
        names.append(F.when(at > 0, F.array_join(F.filter(F.slice(words, 1, 3), lambda w: w.rlike(r"^\p{Lu}")), " ")).otherwise(""))
    return F.filter(F.array(*names), lambda n: n != "")


def person(text: Column) -> Column:
    """Capitalised words (up to three) behind the first trigger that has some; of the raw query."""
    out = F.lit("")
    for trigger in reversed(PEOPLE):
        after = F.regexp_extract(text, rf"(?i)\b{trigger}\s+((?-i:[A-Z])\S*(?:\s+(?-i:[A-Z])\S*){{0,2}})", 1)
        out = F.when(after != "", after).otherwise(out)
    return out


def classify_intent(queries: DataFrame) -> DataFrame:
    """Intent by the first rule that holds; person and navigational look at the query as typed."""
    q, low = F.col("text"), F.lower("text")
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    intent = (
        F.when(_any(low, SIMILAR), "similarity").when(person(q) != "", "person").when(_any(low, EXPLORE), "exploratory").when(_any(low, BUY), "transactional").when((F.size(words) <= 4) & (capital >= F.size(words) - 1), "navigational").otherwise("unknown")
    )
    return queries.select("query_id", "text", intent.alias("intent"))


def rewrite_queries(intents: DataFrame) -> DataFrame:
    """Up to four rewrites of (query_id, text, intent): expansions of named terms, what stands behind "like", the person; else the query."""
    q, low = F.col("text"), F.lower("text")
    parts = [F.when(F.contains(low, F.lit(t)), F.concat(q, F.lit(" " + " ".join(e)))) for t, e in EXPANSIONS.items()]
    base = F.trim(F.regexp_replace(low, rf".*({'|'.join(SIMILAR)})\s*", ""))
    parts.append(F.when((F.col("intent") == "similarity") & (base != ""), base))
    parts.append(F.when(F.col("intent") == "person", F.concat(F.lit("movies starring "), person(q))))
    found = F.slice(F.array_distinct(F.array_compact(F.array(*parts))), 1, 4)
    return intents.select("query_id", F.array_join(F.when(F.size(found) > 0, found).otherwise(F.array(q)), "|").alias("rewrites"))


def query_filters(entities: DataFrame, corrected: DataFrame) -> DataFrame:
    """Year and genre filters, and confidence 0.9 for queries that needed no correction, else 0.7."""
    year = F.nullif(F.split("years", ",")[0], F.lit("")).cast("int")
    both = entities.join(corrected, "query_id")
    return both.select("query_id", (year - 1).alias("year_min"), (year + 1).alias("year_max"), F.nullif(F.split("genres", ",")[0], F.lit("")).alias("genre"), F.when(F.col("corrected") == X.normalise(F.col("text")), 0.9).otherwise(0.7).alias("confidence"))


def expand_queries(queries: DataFrame, most: int = 4) -> DataFrame:
    """Queries of up to `most` words with the first listed term's expansions appended."""
    low = F.lower("text")
    out = F.col("text")
    for t, e in reversed(list(EXPANSIONS.items())):
        out = F.when(F.contains(low, F.lit(t)), F.concat("text", F.lit(" " + " ".join(e)))).otherwise(out)
    return queries.select("query_id", F.when(F.size(F.split(F.trim("text"), r"\s+")) <= most, out).otherwise(F.col("text")).alias("expanded"))


def needs_rewrite(queries: DataFrame) -> DataFrame:
    """Whether a query is worth a semantic rewrite: three words or more, or an exploratory or similarity word."""
    low = F.lower("text")
    n = F.size(F.split(F.trim("text"), r"\s+"))
    return queries.select("query_id", ((n >= 3) | _any(low, SIMILAR) | _any(low, EXPLORE)).alias("needs_rewrite"))


#: Misspellings and format words that put a query in a slice.
SLICE_TYPOS = ("thrilller", "acton", "movei", "sci fi")
SLICE_FORMATS = ("podcast", "game", "live", "series")


def slice_queries(queries: DataFrame) -> DataFrame:
    """(query_id, dimension, slice): length and script of each query, whether it has a known misspelling, and whether it names another format."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    length = F.when(n <= 2, "short").when(n >= 5, "long").otherwise("medium")
    script = F.when(F.col("text").rlike(r"[^\x00-\x7F]"), "non_ascii").otherwise("ascii")
    typo = F.when(_any(F.col("text"), SLICE_TYPOS), "typo").otherwise("as_typed")
    formats = F.when(_any(F.lower("text"), SLICE_FORMATS), "cross_format").otherwise("film")
    kinds = {"length": length, "script": script, "typo": typo, "format": formats}
    return queries.select("query_id", F.explode(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v)])).alias("dimension", "slice"))


def slice_users(users: DataFrame, n: str = "interaction_count") -> DataFrame:
    return users.select("user_id", F.when(F.col(n) < 5, "cold").when(F.col(n) < 50, "warm").otherwise("hot").alias("slice"))


def session_intent(sessions: DataFrame) -> DataFrame:
    """Intent of sessions(session_id, ts, n_history, device) by hour, weekday, history and device."""
    hour, weekend = F.hour(F.col("ts").cast("timestamp")), F.weekday(F.col("ts").cast("timestamp")) >= 5
    part = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    intent = F.when(F.col("n_history") < 5, "discovery_mode").when((F.col("device") == "tv") & weekend, "social_watching").when(hour < 6, "background_noise").when(hour >= 18, "dedicated_viewing").otherwise("rewatch_comfort")
    return sessions.select("session_id", part.alias("time_of_day"), weekend.alias("weekend"), intent.alias("intent"))


#: Words that tell the mood of artwork.
MOOD_WORDS = {
    "dark_moody": ("dark", "noir", "thriller", "horror", "crime", "mystery"),
    "bright_action": ("action", "adventure", "superhero", "explosion", "mission"),
    "warm_romantic": ("romance", "love", "wedding", "family", "drama"),
    "cold_thriller": ("spy", "assassin", "chase", "conspiracy", "war"),
    "playful_comedy": ("comedy", "funny", "laugh", "cartoon", "animation"),
    "epic_drama": ("epic", "historical", "period", "empire", "saga"),
    "documentary": ("documentary", "true", "real", "story", "based"),
}


def keyword_mood(items: DataFrame) -> DataFrame:
    """(doc_id, mood, hits, confidence): the mood with the most keywords in title and text, the first listed among equals; unknown without any."""
    low = F.lower(F.concat_ws(" ", "title", "text"))
    hits = {m: F.size(X.keyword_hits(low, list(ws))) for m, ws in MOOD_WORDS.items()}
    best = F.greatest(*hits.values())
    out = F.lit("unknown")
    for m, h in reversed(hits.items()):
        out = F.when((h == best) & (best > 0), m).otherwise(out)
    sure = F.when(best > 0, F.least(F.lit(0.95), 0.4 + best * 0.15)).otherwise(0.3)
    return items.select("doc_id", out.alias("mood"), best.alias("hits"), sure.alias("confidence"))


def pivot_flag(log: DataFrame, by: str, ts: str, column: str) -> DataFrame:
    """Whether a key ever had three different neighbouring values."""
    w = Window.partitionBy(by).orderBy(ts, column)
    a, b, c = F.col(column), F.lag(column, 1).over(w), F.lag(column, 2).over(w)
    flagged = log.withColumn("p", (a != b) & (b != c) & (a != c))
    return flagged.groupBy(by).agg(F.coalesce(F.max("p"), F.lit(False)).alias("pivot"))
