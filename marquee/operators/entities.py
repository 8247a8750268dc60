"""Entities of queries by patterns, and names of a catalogue found in any texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.sources.working import importable

#: Genres and their common aliases, words that are no keywords, and what stands before a title or a name.
GENRES = (
    "action", "adventure", "animation", "children", "comedy", "crime", "documentary", "drama", "fantasy", "film-noir", "horror", "musical", "mystery", "romance", "sci-fi",
    "thriller", "war", "western", "animated", "romantic", "scary", "funny", "dark", "light",
)
STOP = ("movies", "films", "show", "watch", "like", "want", "good", "best", "top", "similar", "with", "by", "the", "a", "an")
NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
PATTERNS = {
    "similar_to": r"(?:like|similar to|reminds me of|same as)\s+([A-Z][\w\s]+?)(?:\s*$|\s*[,;.])",
    "directors": rf"(?:by|directed by|from director)\s+{NAME}",
    "actors": rf"(?:with|starring|featuring)\s+{NAME}",
}
DECADE = r"\b((?:19|20)?[0-9]0)s\b"
#: Bytes of names up to which an automaton of all of them is sent to the tasks.
NAME_BYTES = 32 << 20


def full_decade(found: Column) -> Column:
    """90 as 1990s, 10 as 2010s (below 30 the years from 2000), 1980 as 1980s."""
    return F.concat(F.when(F.length(found) == 2, F.concat(F.when(found < "30", "20").otherwise("19"), found)).otherwise(found), F.lit("s"))


def extract_entities(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries(query_id, text) with arrays: genres, decades, similar_to, directors, actors, keywords.

    Genres stand anywhere in the query, in alphabetical order; titles and names are capitalised words behind their
    triggers; keywords are words of over two characters that are no stop words and no part of a genre or decade found.
    Null text has no entities.
    """
    raw, low = F.coalesce(F.col(text), F.lit("")), F.lower(F.coalesce(F.col(text), F.lit("")))
    decades = F.transform(F.regexp_extract_all(low, F.lit(DECADE), F.lit(1)), full_decade)
    named = {n: F.transform(F.regexp_extract_all(raw, F.lit(p), F.lit(1)), F.trim) for n, p in PATTERNS.items()}
    found = queries.select("query_id", text, X.keyword_hits(low, sorted(GENRES)).alias("genres"), decades.alias("decades"), *(c.alias(n) for n, c in named.items()))
    known = F.split(F.concat_ws(" ", "genres", "decades"), " ")
    words = F.filter(F.split(F.trim(F.lower(F.coalesce(F.col(text), F.lit("")))), r"\s+"), lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP))
    return found.select("*", F.filter(words, lambda w: ~F.array_contains(known, w)).alias("keywords"))


def _words(text: Column) -> Column:
    return X.tokens(text, "alnum")


def _by_ngrams(texts: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """The matches by joining every stretch of 1 to `longest` words with the names: an exact way for catalogues of any size."""
    words = texts.select("text_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = words.select("text_id", "w", F.posexplode("w").alias("place", "__first"))
    sizes = starts.select("text_id", "place", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("place")))).alias("n"))
    grams = sizes.select("text_id", "place", "n", F.array_join(F.slice("w", F.col("place") + 1, F.col("n")), " ").alias("key"))
    return grams.join(names.select("name_id", "key"), "key").select("text_id", "name_id", "place", "n")


def _by_automaton(texts: DataFrame, listed: list[tuple[int, str]]) -> DataFrame:
    """The matches by one automaton of all names, which each task reads its texts with once."""
    import pandas as pd

    importable(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def scan(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name, key in shared.value:
            padded = f" {key} "
            automaton.add_word(padded, (len(padded), key.count(" ") + 1, [*(automaton.get(padded)[2] if padded in automaton else []), name]))
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            out = []
            for text, words in zip(batch["text_id"], batch["w"]):
                line = " " + " ".join(words) + " "
                before, place = 0, 0
                for end, (size, n, ids) in sorted(automaton.iter(line), key=lambda m: m[0] - m[1][0]) if len(automaton) else ():
                    begin = end + 1 - size
                    place += line.count(" ", before, begin)
                    before = begin
                    out += [(text, name, place, n) for name in ids]
            yield pd.DataFrame(out, columns=["text_id", "name_id", "place", "n"])

    return texts.select("text_id", _words(F.col("text")).alias("w")).mapInPandas(scan, "text_id long, name_id long, place int, n int")


def match_names(texts: DataFrame, names: DataFrame, most_bytes: int = NAME_BYTES) -> DataFrame:
    """(text_id, name_id, place, n): where the words of names(name_id, name) stand one behind the other in texts(text_id, text).

    Words are runs of a-z and 0-9 in lower case; place counts words from 0, n are the name's words. Names without words
    match nothing, overlapping matches all count. Names of up to most_bytes together, which is checked first, travel to
    the tasks as one Aho-Corasick automaton; more of them are joined with the texts' n-grams.
    """
    keyed = names.select("name_id", F.array_join(_words(F.col("name")), " ").alias("key")).where("key <> ''")
    size, longest = keyed.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0)), F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(1))).first()
    if size <= most_bytes:
        return _by_automaton(texts, sorted((r.name_id, r.key) for r in keyed.collect()))
    return _by_ngrams(texts, keyed, longest)
