"""Likeness of texts and slates on small tables, against brute force."""

import itertools
import math
import random

import pytest

from marquee.operators import content as C
from marquee.operators import slates as S

WEIGHTS = "doc_id long, term string, weight double"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def vectors(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, {})[r.term] = r.weight
    return out


def cosine(a, b):
    return sum(w * b.get(t, 0.0) for t, w in a.items())


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    made = [" ".join(["the", "common", *rng.choices(words, [1 / (i + 1) for i in range(200)], k=rng.randrange(1, 25))]) for _ in range(n)]
    return made + [made[3]] * 6 + [made[5] + " wzz"] * 2 + ["", None, "123 4a", "alone"]


def test_weights_by_hand(spark):
    got = {(r.doc_id, r.term): r for r in C.tfidf_weights(table(spark, ["Red red blue; x2 the", "blue", None]), ("text",)).collect()}
    red, blue = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert set(got) == {(0, "red"), (0, "blue"), (1, "blue")}
    assert got[0, "red"].tf == 2 and math.isclose(got[0, "red"].weight, red / math.hypot(red, blue))
    assert got[1, "blue"].weight == 1.0


def test_the_commonest_terms_stay(spark):
    got = C.tfidf_weights(table(spark, ["bb bb aa cc", "aa dd"]), ("text",), max_terms=2)
    assert sorted((r.doc_id, r.term) for r in got.collect()) == [(0, "aa"), (0, "bb"), (1, "aa")]


@pytest.mark.parametrize("seed, seeds", [(1, 200), (2, 5), (3, 0)])
def test_nearest_equal_brute_force(spark, monkeypatch, seed, seeds):
    monkeypatch.setattr(C, "SEEDS", seeds)
    weights = C.written(C.tfidf_weights(table(spark, texts(seed)), ("text",)))
    known = vectors(weights.collect())
    queries = spark.createDataFrame([(n,) for n in range(0, 130, 3)], "doc_id long")
    got = {}
    for r in C.similar_items(weights, queries, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, pytest.approx(r.score, abs=1e-8)))
    want = {}
    for q in range(0, 130, 3):
        near = sorted((-round(s, 9), d) for d, v in known.items() if q in known and d != q and (s := cosine(known[q], v)) > 0)
        if near:
            want[q] = [(n + 1, d, -s) for n, (s, d) in enumerate(near[:4])]
    assert {q: sorted(v, key=lambda r: r[0]) for q, v in got.items()} == want


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_links_equal_all_pairs(spark, threshold):
    weights = C.written(C.tfidf_weights(table(spark, texts(4)), ("text",)))
    known = vectors(weights.collect())
    got = {r.doc_id: (r.class_id, r.n_links) for r in C.similarity_links(weights, threshold).collect()}
    assert set(got) == set(known)
    for d, v in known.items():
        assert got[d][1] == sum(e != d and round(cosine(v, u), 9) >= threshold for e, u in known.items())
        assert got[d][0] == min(e for e, u in known.items() if u == v)


def test_classes_of_copies_make_no_pairs(spark):
    weights = C.written(C.tfidf_weights(table(spark, ["aa bb cc"] * 50 + ["aa bb dd"]), ("text",)))
    classes = C.vector_classes(weights)
    assert C.similar_pairs(weights, classes, 0.1).count() == 1
    assert {r.n_links for r in C.similarity_links(weights, 0.1).collect()} == {50}


def test_group_matches(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9), (8, 9)], "query_id long, doc_id long")
    groups = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, cluster int")
    assert [tuple(r) for r in C.same_group(pairs, groups).orderBy("query_id", "doc_id").collect()] == [(1, 2, 1), (1, 3, 0), (1, 9, 0), (8, 9, 1)]


CANDS = "query_id long, doc_id long, rank int, score double, genres array<string>, content_type string, satisfaction double, uncertainty double"


def test_a_slate_by_hand(spark):
    rows = [
        (1, 10, 1, 1.0, ["a"], "film", 0.0, 0.0),  # .45 + .15 + .025 = .625
        (1, 11, 2, 0.9, ["a"], "film", 0.0, 0.0),  # then nothing new: .405
        (1, 12, 3, 0.6, ["a", "b"], "series", 0.0, 0.0),  # .27 + .075 + .025 = .37
        (1, 13, 4, 0.6, ["c"], None, None, None),  # .27 + .15 + .05 = .47, as a film
    ]
    cands = spark.createDataFrame(rows, CANDS)
    got = S.optimise_slate(cands, 4, explore_rate=0.3).orderBy("place").collect()
    assert [(r.doc_id, r.slot_type, round(r.gain, 6), r.new_genres, r.new_type) for r in got] == [(10, "explore", 0.625, 1, True), (13, "exploit", 0.47, 1, False), (11, "exploit", 0.405, 0, False), (12, "exploit", 0.37, 1, True)]
    page = S.slate_scores(S.optimise_slate(cands, 4, explore_rate=0.3), cands).first()
    assert (page["items"], page.exploration_slots) == (4, 1)
    assert math.isclose(page.diversity_score, 3 / 1.25) and math.isclose(page.page_coherence, 1 / 3)


def greedy(rows, k):
    left, covered, types, out = list(rows), set(), set(), []
    while left and len(out) < k:
        value = {}
        for r in left:
            _, doc, rank, score, genres, kind, sat, unsure = r
            value[doc] = round(0.45 * score + 0.25 * sat + 0.15 * len(set(genres) - covered) / len(genres) + 0.1 * unsure + 0.05 * (0.5 if kind not in types else 0), 9)
        best = min(left, key=lambda r: (-value[r[1]], r[2], r[1]))
        out.append(best[1])
        covered |= set(best[4])
        types.add(best[5])
        left.remove(best)
    return out


def test_contenders_lose_no_choice(spark):
    rng = random.Random(9)
    rows = []
    for q in range(12):
        for rank in range(1, 90):
            genres = rng.sample("abcd", rng.randrange(1, 4))
            rows.append((q, rank * 7 % 90, rank, rng.choice([0.1, 0.5, rng.random()]), genres, rng.choice(["film", "series"]), rng.choice([0.0, 0.4]), 0.5))
    cands = spark.createDataFrame(rows, CANDS)
    assert S.contenders(cands, 3).count() < len(rows)
    for k in (1, 3, 12):
        got = {}
        for r in S.optimise_slate(cands, k).orderBy("place").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert got == {q: greedy([r for r in rows if r[0] == q], k) for q in range(12)}


def test_no_order_of_a_small_slate_starts_with_more(spark):
    # the first place holds the item that adds most to an empty page
    rows = [(1, n, n, s, g, t, 0.0, 0.5) for n, (s, g, t) in enumerate(itertools.product([0.2, 0.7], [["a"], ["a", "b"]], ["film", "game"]))]
    first = S.optimise_slate(spark.createDataFrame(rows, CANDS), 1).first()
    assert first.doc_id == greedy(rows, 1)[0]


def test_nearest_texts_make_no_pairs(spark, monkeypatch):
    """blocks meet, whatever their size; no join by terms or documents is left."""
    monkeypatch.setattr(C, "SEEDS", 7)
    monkeypatch.setattr(C, "TERMS", 60, raising=False)
    weights = C.written(C.tfidf_weights(table(spark, texts(9)), ("text",)))
    known = vectors(weights.collect())
    asked = [n for n in range(0, 130, 4) if n in known]
    found = C.similar_items(weights, spark.createDataFrame([(n,) for n in asked], "doc_id long"), 3)
    got = {(r.query_id, r["rank"]): (r.doc_id, pytest.approx(r.score, abs=1e-8)) for r in found.collect()}
    want = {}
    for q in asked:
        near = sorted((-round(s, 9), d) for d, v in known.items() if d != q and (s := cosine(known[q], v)) > 0)
        want |= {(q, n + 1): (d, -s) for n, (s, d) in enumerate(near[:3])}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan
