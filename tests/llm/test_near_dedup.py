"""The pipeline's near-duplicates against all pairs by the Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as P
import numpy as np

from marquee.llm import shingles as S
from marquee.llm.simhash import simhash

FOLDER = "/root/testdata/sf0.01"


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_equals_all_pairs_by_jaccard(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source = [(r.doc_id, _shingles(r.text)) for r in docs.collect()]
    root = {d: d for d, _ in source}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unequal = 0
    for i, (a, x) in enumerate(source):
        for b, y in source[:i]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                unequal += x != y
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = {d for d in root if find(d) == d}
    assert unequal > 5
    assert {r.doc_id for r in P.near_dedup(spark, docs, FOLDER).collect()} == want


def test_links_are_found_by_trees_within_the_radius(spark):
    words = [f"w{i}" for i in range(200)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in (20, 90, 150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(words), *near, "something else that stands alone in here"])], "doc_id long, text string")
    kept = lambda **how: {r.doc_id for r in S.keep_one_each(docs, **how).collect()}
    assert kept() == kept(tree=2) == {0, 4}
    # within no bits at all only equal fingerprints meet, whatever the Jaccard similarity
    assert kept(radius=0) == {0, 1, 2, 3, 4}


def test_trees_link_components_within_the_radius_only():
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64), i % 7, i >= 90) for i in range(120)]
    want = {(a, b) for a, x, c, q in rows for b, y, d, r in rows if a < b and c != d and not q and (x ^ y).bit_count() <= 12}
    got = list(S.across_components(rows, 12))
    assert len(got) == len(want) > 50 and {(min(p), max(p)) for p in got} == want


def test_simhash_follows_jaccard_within_the_radius():
    rng = random.Random(5)
    far = 0
    for n in (4, 5, 9, 20, 100, 1000):
        for _ in range(200):
            h = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
            both = h[: max(1, -(-n * 8 // 9))]  # at a similarity of 0.8, 8 of each side's 9 are shared
            x, y = (np.concatenate([both, np.array([rng.getrandbits(64) for _ in range(n - len(both))], np.uint64)]) for _ in "ab")
            if S.jaccard(np.unique(x), np.unique(y)) >= S.SIMILARITY:
                far += (simhash(x) ^ simhash(y)).bit_count() > S.RADIUS
    assert far == 0
