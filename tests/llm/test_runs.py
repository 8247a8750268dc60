"""Periodic runs against every lag of every text."""

import hashlib
import random
import re
import zlib

import numpy as np
from common_rows import awkward
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import registry, runs

FOLDER = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(words):
    """(start, length, period) by comparing the words with themselves at every lag."""
    n, known, names = len(words), {}, {}
    ids = np.array([names.setdefault(w, len(names)) for w in words])
    for q in range(1, n // 4 + 1):
        at = 0
        same = ids[:-q] == ids[q:]
        if not same.any():
            continue
        ends = [*np.flatnonzero(~same).tolist(), n - q]
        for end in ends:
            if end > at and end - at + q >= max(6, 4 * q):
                known.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted(((s, m, q) for (s, m), q in known.items()), key=lambda r: (r[0], r[2]))


def expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *row, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(documents):
    every = np.array([w for d in documents for w in d], np.int64)
    got = runs.find_runs(every, [len(d) for d in documents]).tolist()
    return [[tuple(r[1:]) for r in got if r[0] == n] for n in range(len(documents))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=60), max_size=4))
def test_few_letters(documents):
    assert found(documents) == [brute(d) for d in documents]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 90), st.integers(2, 7), st.integers(1, 3))
def test_planted_periods(seed, period, times, letters):
    rng = random.Random(seed)
    documents = []
    for _ in range(3):
        unit = [rng.randrange(letters) for _ in range(period)]
        part = unit * times + unit[: rng.randrange(period)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] += 1
        documents.append([rng.randrange(50) for _ in range(rng.randrange(40))] + part + [rng.randrange(50) for _ in range(rng.randrange(40))])
        # a run inside the unit of a longer one
        inner = ([7] * 9 + [rng.randrange(4) for _ in range(period)]) * 5
        documents.append(inner)
    assert found(documents) == [brute(d) for d in documents]


def test_a_long_document_between_short_ones():
    rng = random.Random(5)
    unit = [rng.randrange(1000) for _ in range(700)]
    long = [rng.randrange(1000) for _ in range(900)] + unit * 6 + unit[:123] + [1] * 5000 + unit[:300] * 5
    documents = [[1, 1, 1, 1, 1], [], [1] * 6, long, [1, 2] * 8, [3]]
    assert found(documents) == [brute(d) for d in documents]
    assert found([unit, unit, unit, unit, unit]) == [[]] * 5


def test_query_equals_brute_force(spark):
    want = sorted(expected(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    got = registry.QUERIES["op11_runs"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_awkward_rows(spark):
    docs = awkward(spark)
    many = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(0, "a b " * 5000, "en", "s", 0, 0, "", 0.0, 0, 0, 0, 0, 0), (20, "x\x1cy\x85z　 " * 9, "en", "s", 0, 0, "", 0.0, 0, 0, 0, 0, 0)], docs.schema))
    want = sorted((expected(r.doc_id, r.text) for r in many.collect()), key=repr)
    assert sorted(map(tuple, runs.run_digests(many).collect()), key=repr) == want


def test_texts_spans_and_collapse(spark):
    docs = spark.createDataFrame([(1, "so  it goes on and on and on and on and on.\nend"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(3, 8, 2)] and got[1].collapsed == "so it goes on and on. end"
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].n_words == 0
