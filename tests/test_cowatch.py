"""Pairs of items that many users rated, counted in slices."""

import random
from collections import Counter

from marquee.operators import features as B


def test_slices_hold_all_pairs(spark, monkeypatch):
    """no execution makes more than about PAIRS rows of ratings, and none is lost."""
    monkeypatch.setattr(B, "PAIRS", 500, raising=False)
    rng = random.Random(1)
    rows = sorted({(u, d) for u in range(60) for d in rng.sample(range(40), rng.randrange(1, 14))})
    ratings = spark.createDataFrame([(u, d, 1.0 + (u + d) % 9 / 2, u * d) for u, d in rows], "user_id long, doc_id long, rating double, rated_at long")
    mine = {}
    for u, d in rows:
        mine.setdefault(u, []).append(d)
    want = Counter((a, b) for ds in mine.values() for a in ds for b in ds if a < b)
    found = B.cowatch_pairs(ratings, 3)
    assert {(r.doc_id_a, r.doc_id_b): r.co_watch_count for r in found.collect()} == {p: n for p, n in want.items() if n >= 3}
    assert found.count() == sum(n >= 3 for n in want.values())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # each slice was stored
    assert B.cowatch_pairs(ratings.where("false")).count() == 0
