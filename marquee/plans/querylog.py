"""Query understanding over a log of queries made from the conversations and item titles."""

from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators import entities as E
from marquee.operators import querylog as N

#: Queries: an item's title with a lead-in that reveals an intent, misspelled genres among them.
LOG = """SELECT doc_id AS query_id, CASE doc_id % 6 WHEN 0 THEN 'something funny like ' || title WHEN 1 THEN 'commedy with Tom ' || upper(substring(title, 1, 1)) || 'anks 1994' WHEN 2 THEN 'best thriler from the 90s'
WHEN 3 THEN 'sci-fi noir ' || title WHEN 4 THEN 'watch gritti drama 2010s' ELSE title END AS text FROM items"""


def log(d):
    d.items.createOrReplaceTempView("items")
    return d.spark.sql(LOG)


NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s\\-''.]', ' ', 'g'), '\\s+', ' ', 'g'))"
VOCAB = "[" + ", ".join(repr(w) for w in sorted(N.GENRES + N.MOODS)) + "]"
CORRECT = f"""lg AS ({LOG}), wd AS (SELECT query_id, unnest(string_split({NORM}, ' ')) AS w, generate_subscripts(string_split({NORM}, ' '), 1) AS p FROM lg),
vc AS (SELECT unnest({VOCAB}) AS v), nr AS (SELECT w, min(v) AS near FROM (SELECT DISTINCT w FROM wd WHERE length(w) > 3 AND w NOT IN (SELECT v FROM vc) AND w NOT IN {tuple(N.TYPOS)}) JOIN vc ON levenshtein(w, v) <= 1 GROUP BY 1),
co AS (SELECT query_id, string_agg(coalesce(CASE wd.w {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in N.TYPOS.items())} END, near, wd.w), ' ' ORDER BY p) AS corrected FROM wd LEFT JOIN nr ON wd.w = nr.w GROUP BY 1)"""


def hits(words) -> str:
    return f"list_filter([{', '.join(repr(w) for w in sorted(words))}], lambda x: contains(lower(text), x))"


def named(trigger: str) -> str:
    behind = f"regexp_split_to_array(trim(substring(text, instr(lower(text), '{trigger}') + {len(trigger)})), '\\s+')"
    return f"CASE WHEN instr(lower(text), '{trigger}') > 0 THEN array_to_string(list_filter(list_slice({behind}, 1, 3), lambda x: regexp_matches(x, '^\\p{{Lu}}')), ' ') ELSE '' END"


DECADES = "list_transform(regexp_extract_all(lower(text), '\\b((?:19|20)?[0-9]0)s\\b', 1), lambda x: CASE WHEN length(x) = 2 THEN CASE WHEN x < '30' THEN '20' ELSE '19' END || x ELSE x END)"
ENTITIES = f"""en AS (SELECT query_id, text, array_to_string({hits(N.GENRES)}, ',') AS genres, array_to_string({hits(N.MOODS)}, ',') AS moods,
array_to_string(regexp_extract_all(lower(text), '\\b(19[0-9]{{2}}|20[0-2][0-9])\\b', 1), ',') AS years, array_to_string({DECADES}, ',') AS decades, array_to_string(list_filter([{', '.join(named(t) for t in N.PEOPLE)}], lambda x: x <> ''), ',') AS persons FROM lg)"""
ANY = lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"
WORDS = "len(regexp_split_to_array(trim(text), '\\s+'))"
MOOD = {m: f"len(list_filter([{', '.join(repr(w) for w in ws)}], lambda x: contains(lower(text), x)))" for m, ws in N.MOOD_WORDS.items()}
BEST = f"greatest({', '.join(MOOD.values())})"
#: The log's queries with names and triggers of several kinds.
ASKED = """SELECT doc_id AS query_id, CASE doc_id % 5 WHEN 0 THEN 'Movies like Blue ' || upper(substring(title, 1, 1)) || 'otel, please' WHEN 1 THEN 'crime thriller by Anna ' || upper(substring(title, 1, 1)) || 'ergman from the 1980s'
WHEN 2 THEN 'scary 90s films with Tom Hanks' WHEN 3 THEN 'dark ' || title || ' 2010s starring Uma Thurman' ELSE title END AS text FROM items"""


def asked(d):
    d.items.createOrReplaceTempView("items")
    return d.spark.sql(ASKED)


def joined(df, *columns):
    return df.select(*(F.array_join(c, "|").alias(c) if c in columns else c for c in df.columns))


INTENT = f"""CASE WHEN {ANY(N.SIMILAR)} THEN 'similarity' WHEN query_id % 6 = 1 THEN 'person' ELSE 'other' END"""
PERSON = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i)\\b{t}\\s+((?-i:[A-Z])\\S*(?:\\s+(?-i:[A-Z])\\S*){{0,2}})', 1), '')" for t in N.PEOPLE) + ", '')"
EXPANDED = ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN text || ' {' '.join(e)}' END" for t, e in N.EXPANSIONS.items())
REWRITES = f"""WITH lg AS ({LOG}), i AS (SELECT *, {INTENT} AS intent, trim(regexp_replace(lower(text), '.*({'|'.join(N.SIMILAR)})\\s*', '')) AS base, {PERSON} AS who FROM lg),
r AS (SELECT *, list_slice(list_filter([{EXPANDED}, CASE WHEN intent = 'similarity' AND base <> '' THEN base END, CASE WHEN intent = 'person' THEN 'movies starring ' || who END], lambda x: x IS NOT NULL), 1, 4) AS found FROM i)
SELECT query_id, CASE WHEN len(found) > 0 THEN array_to_string(found, '|') ELSE text END AS rewrites FROM r"""

QUERIES = {
    "n01_correct_spelling": (lambda d: N.correct_spelling(log(d)), f"WITH {CORRECT} SELECT * FROM co"),
    "n02_recognise_entities": (lambda d: N.recognise_entities(log(d)), f"WITH lg AS ({LOG}), {ENTITIES} SELECT * FROM en"),
    "n03_classify_intent": (
        lambda d: N.classify_intent(log(d)).select("query_id", "intent"),
        f"""WITH lg AS ({LOG}) SELECT query_id, CASE WHEN {ANY(N.SIMILAR)} THEN 'similarity' WHEN query_id % 6 = 1 THEN 'person' WHEN {ANY(N.EXPLORE)} THEN 'exploratory' WHEN {ANY(N.BUY)} THEN 'transactional'
        WHEN {WORDS} <= 4 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '^[A-Z]'))) >= {WORDS} - 1 THEN 'navigational' ELSE 'unknown' END AS intent FROM lg""",
    ),
    "n04_rewrite_queries": (lambda d: N.rewrite_queries(N.classify_intent(log(d))), REWRITES),
    "n05_query_filters": (
        lambda d: N.query_filters(N.recognise_entities(log(d)), N.correct_spelling(log(d))).withColumns({c: F.col(c).cast("double") for c in ("year_min", "year_max")}),
        f"""WITH {CORRECT}, {ENTITIES} SELECT query_id, CAST(nullif(split_part(years, ',', 1), '') AS DOUBLE) - 1 AS year_min, CAST(nullif(split_part(years, ',', 1), '') AS DOUBLE) + 1 AS year_max, nullif(split_part(genres, ',', 1), '') AS genre,
        CASE WHEN corrected = {NORM} THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM en JOIN co USING (query_id)""",
    ),
    "n07_expand_queries": (
        lambda d: N.expand_queries(log(d)),
        f"WITH lg AS ({LOG}) SELECT query_id, CASE WHEN {WORDS} > 4 THEN text {' '.join(f'''WHEN contains(lower(text), '{t}') THEN text || ' {' '.join(e)}' ''' for t, e in N.EXPANSIONS.items())} ELSE text END AS expanded FROM lg",
    ),
    "n08_script": (
        lambda d: d.documents.groupBy(X.script_of(F.col("text")).alias("script")).agg(F.count("*").alias("n")),
        "SELECT CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'devanagari' WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'arabic' WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'cyrillic' WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7AF}]') THEN 'hangul' WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'kana' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'han' ELSE 'latin' END AS script, count(*) AS n FROM documents GROUP BY 1",
    ),
    "n09_needs_rewrite": (lambda d: N.needs_rewrite(log(d)), f"WITH lg AS ({LOG}) SELECT query_id, {WORDS} >= 3 OR {ANY(N.SIMILAR)} OR {ANY(N.EXPLORE)} AS needs_rewrite FROM lg"),
    "n10_slice_queries": (
        lambda d: N.slice_queries(log(d)),
        f"WITH lg AS ({LOG}) SELECT query_id, 'length' AS dimension, CASE WHEN {WORDS} <= 2 THEN 'short' WHEN {WORDS} >= 5 THEN 'long' ELSE 'medium' END AS slice FROM lg UNION ALL SELECT query_id, 'script', CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'non_ascii' ELSE 'ascii' END FROM lg UNION ALL SELECT query_id, 'typo', CASE WHEN {' OR '.join(f"contains(text, '{w}')" for w in N.SLICE_TYPOS)} THEN 'typo' ELSE 'as_typed' END FROM lg UNION ALL SELECT query_id, 'format', CASE WHEN {ANY(N.SLICE_FORMATS)} THEN 'cross_format' ELSE 'film' END FROM lg",
    ),
    "n06_extract_entities": (
        lambda d: joined(E.extract_entities(asked(d)), "genres", "decades", "similar_to", "directors", "actors", "keywords").drop("text"),
        f"""WITH lg AS ({ASKED}), x AS (SELECT query_id, text, lower(text) AS low, {hits(E.GENRES)} AS genres, list_transform(regexp_extract_all(lower(text), '{E.DECADE}', 1), lambda x: CASE WHEN length(x) = 2 THEN CASE WHEN x < '30' THEN '20' ELSE '19' END || x ELSE x END || 's') AS decades FROM lg)
        SELECT query_id, array_to_string(genres, '|') AS genres, array_to_string(decades, '|') AS decades, {', '.join(f"array_to_string(list_transform(regexp_extract_all(text, '{p}', 1), lambda x: trim(x)), '|') AS {n}" for n, p in E.PATTERNS.items())},
        array_to_string(list_filter(regexp_split_to_array(trim(low), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {E.STOP} AND NOT list_contains(string_split(array_to_string(genres || decades, ' '), ' '), w)), '|') AS keywords FROM x""",
    ),
    "n06_match_names": (
        lambda d: E.match_names(d.corpus.select(F.col("doc_id").alias("text_id"), "text"), d.search_queries.select(F.col("query_id").alias("name_id"), F.col("text").alias("name"))),
        """WITH w AS (SELECT doc_id AS text_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) - 1 AS place FROM corpus),
        n AS (SELECT query_id AS name_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS key FROM search_queries)
        SELECT text_id, name_id, CAST(place AS INT) AS place, CAST(len(n.key) AS INT) AS n FROM n JOIN (SELECT text_id, place, list(w) OVER (PARTITION BY text_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS key FROM w) g
        ON len(n.key) > 0 AND g.key[1:len(n.key)] = n.key""",
    ),
    "n10_slice_users": (lambda d: N.slice_users(d.users), "SELECT user_id, CASE WHEN interaction_count < 5 THEN 'cold' WHEN interaction_count < 50 THEN 'warm' ELSE 'hot' END AS slice FROM users"),
    "n11_session_intent": (
        lambda d: N.session_intent(d.events.select(F.col("event_id").alias("session_id"), "ts", (F.col("user_id") % 9).alias("n_history"), F.when(F.col("event_id") % 2 == 0, "tv").otherwise("mobile").alias("device"))),
        """SELECT event_id AS session_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day, isodow(ts) >= 6 AS weekend,
        CASE WHEN user_id % 9 < 5 THEN 'discovery_mode' WHEN event_id % 2 = 0 AND isodow(ts) >= 6 THEN 'social_watching' WHEN hour(ts) < 6 THEN 'background_noise' WHEN hour(ts) >= 18 THEN 'dedicated_viewing' ELSE 'rewatch_comfort' END AS intent FROM events""",
    ),
    "n12_keyword_mood": (
        lambda d: N.keyword_mood(d.corpus),
        f"SELECT doc_id, CASE WHEN {BEST} = 0 THEN 'unknown' {' '.join(f'''WHEN {h} = {BEST} THEN '{m}' ''' for m, h in MOOD.items())} END AS mood, CAST({BEST} AS INT) AS hits, CASE WHEN {BEST} > 0 THEN least(0.95, 0.4 + {BEST} * 0.15) ELSE 0.3 END::DOUBLE AS confidence FROM corpus",
    ),
    "w07_pivot_flag": (
        lambda d: N.pivot_flag(d.events, "user_id", "ts", "event_type"),
        "SELECT user_id, coalesce(bool_or(a <> b AND b <> c AND a <> c), false) AS pivot FROM (SELECT user_id, event_type AS a, lag(event_type, 1) OVER w AS b, lag(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)) GROUP BY 1",
    ),
}
