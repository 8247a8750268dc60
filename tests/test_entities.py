"""Entities and names on small tables, against brute force."""

import random
import re

from marquee.operators import entities as E
from marquee.operators import querylog as N


def test_entities_by_hand(spark):
    rows = [(1, "Movies like Blue Hotel, please"), (2, "90s crime thrillers"), (3, "films by Sofia Coppola with Bill Murray"), (4, "best 1980s sci-fi action"), (5, None), (6, "movies similar to Inception")]
    got = {r.query_id: r for r in E.extract_entities(spark.createDataFrame(rows, "query_id long, text string")).collect()}
    assert got[1].similar_to == ["Blue Hotel"] and got[6].similar_to == ["Inception"]
    assert got[2].decades == ["1990s"] and got[2].genres == ["crime", "thriller"] and got[2].keywords == ["90s", "thrillers"]
    assert got[3].directors == ["Sofia Coppola"] and got[3].actors == ["Bill Murray"]
    assert got[4].genres == ["action", "sci-fi"] and got[4].decades == ["1980s"]
    assert got[5].genres == got[5].keywords == got[5].actors == []


def test_persons_behind_every_trigger(spark):
    rows = [(1, "something with Tom Hanks and directed by Nora Ephron"), (2, "with nobody"), (3, "by Ang Lee")]
    got = {r.query_id: r.persons for r in N.recognise_entities(spark.createDataFrame(rows, "query_id long, text string")).collect()}
    assert got == {1: "Tom Hanks,Nora Ephron,Nora Ephron", 2: "", 3: "Ang Lee"}


def test_both_ways_of_matching_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [(n, " ".join(rng.choice(["a", "b", "c", "Ab", "b.", "x-y"]) for _ in range(rng.randrange(0, 30)))) for n in range(60)] + [(60, None), (61, "")]
    names = [(n, " ".join(rng.choice(["a", "b", "AB", "x y"]) for _ in range(rng.randrange(0, 4)))) for n in range(25)]
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    want = sorted((t, n, i, len(words(name))) for t, text in texts for n, name in names for i in range(len(words(text))) if words(name) and words(text)[i : i + len(words(name))] == words(name))
    t, n = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string")
    for most in (1 << 20, 0):
        assert sorted(map(tuple, E.match_names(t, n, most).collect())) == want
    assert E.match_names(t, n.limit(0)).count() == 0


def test_moods_and_slices(spark):
    items = spark.createDataFrame([(1, "Noir", "a dark crime and love"), (2, "x", "nothing"), (3, None, "spy love")], "doc_id long, title string, text string")
    assert [tuple(r) for r in N.keyword_mood(items).orderBy("doc_id").collect()] == [(1, "dark_moody", 3, 0.4 + 3 * 0.15), (2, "unknown", 0, 0.3), (3, "warm_romantic", 1, 0.55)]
    got = {(r.dimension, r.slice) for r in N.slice_queries(spark.createDataFrame([(1, "acton Series")], "query_id long, text string")).collect()}
    assert got == {("length", "short"), ("script", "ascii"), ("typo", "typo"), ("format", "cross_format")}
