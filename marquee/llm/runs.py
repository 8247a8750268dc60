"""Periodic runs of words, found by minimizers at several scales.

A run is a maximal stretch whose words repeat at a distance, its period. Periods up to SHORT are found by comparing the
words with themselves at each such lag. For longer ones scale k = 16, 32, ... takes care of the periods in (k/2, k]:
every stretch of k words is hashed (a hash of k words comes from two hashes of k/2), and of each k/2 neighbouring
stretches those with the least hash are picked. Inside a run the picks repeat at the distance of its period, and no two
equal stretches of k words can be nearer than that, so the next pick of the same hash is exactly one period away. Each
such pair is a seed, extended to both sides by comparing words. A run of at least four periods always has one: it holds
two windows of stretches that are a period apart. Hashes have 64 bits; a collision can only add a seed that the
comparison rejects, or, for two stretches within one period of each other, hide one.

Documents of a batch are scanned together, and a scale looks only at those long enough for it, so that the work is in
proportion to the words times the logarithm of a document's length, with the same array operations at every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_arrow, text_rows

#: Least length of a run in words and in periods.
WORDS, TIMES = 6, 4
#: Periods up to this one are compared directly; a power of two.
SHORT = 8
#: Words scanned at a time, or one document if that has more.
SCAN = 1 << 20

_MAX = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The numbers scrambled by multiplications and shifts (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """better() over every `width` neighbours, a power of two."""
    step = 1
    while step < width:
        values = better(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some `width` neighbouring ones (all of them, where equals tie)."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((hashes == _sliding(np.concatenate([edge, least, edge]), width, np.maximum)) & (hashes != _MAX))


def _agreeing(words: np.ndarray, at: int, lag: int, until: int, step: int) -> int:
    """How many places from `at` on, going by `step` (1 or -1) up to `until`, equal the word `lag` behind."""
    n, size, most = 0, 32, abs(until - at)
    while n < most:
        size = min(size, most - n)
        if step > 0:
            a = words[at + n : at + n + size], words[at + n + lag : at + n + size + lag]
        else:
            low = at - n - size
            a = words[low + 1 : low + size + 1][::-1], words[low + 1 + lag : low + size + 1 + lag][::-1]
        other = np.flatnonzero(a[0] != a[1])
        if len(other):
            return n + int(other[0])
        n += size
        size *= 2
    return n


def find_runs(words: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    words: a number for each word, equal where the words are, documents one behind the other; sizes: words of each.
    """
    sizes_of = np.asarray(sizes, np.int64)
    begins = np.cumsum(sizes_of) - sizes_of
    of = np.repeat(np.arange(len(sizes_of)), sizes_of)
    place = np.arange(len(words)) - begins[of]
    left = sizes_of[of] - place
    found = []
    for lag in range(1, SHORT + 1):
        if len(words) <= lag:
            break
        same = np.zeros(len(words) - lag + 2, np.int8)
        same[1:-1] = (words[:-lag] == words[lag:]) & (left[:-lag] > lag)
        turns = np.flatnonzero(np.diff(same))
        start, length = turns[::2], turns[1::2] - turns[::2] + lag
        keep = length >= max(WORDS, TIMES * lag)
        start, length = start[keep], length[keep]
        found.append(np.stack([of[start], place[start], length, np.full(len(start), lag)], 1))
    hashes, k = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while True:
        if k >= SHORT:
            # the next scale's shortest run has four periods of k + 1 words
            keep = sizes_of[of] >= TIMES * (k + 1)
            if not keep.any():
                break
            if not keep.all():
                words, hashes, of, place, left = words[keep], hashes[keep], of[keep], place[keep], left[keep]
        if len(words) <= k:
            break
        joined = np.full(len(words), _MAX)
        joined[:-k] = _mixed(hashes[:-k] * np.uint64(0x9E3779B97F4A7C15) + (hashes[k:] ^ (hashes[k:] >> np.uint64(29))))
        k *= 2
        joined[left < k] = _MAX
        hashes = joined
        if k <= SHORT:
            continue
        picks = minimizers(hashes, k // 2)
        picks = picks[np.argsort(hashes[picks], kind="stable")]
        lag = np.diff(picks)
        pair = np.flatnonzero((hashes[picks[1:]] == hashes[picks[:-1]]) & (lag > k // 2) & (lag <= k))
        at, lag = picks[pair], lag[pair]
        inside = left[at] >= lag + k
        at, lag = at[inside], lag[inside]
        order = np.lexsort((at, lag))
        before, reached = 0, 0
        for i, q in zip(at[order].tolist(), lag[order].tolist()):
            if q == before and i < reached:
                continue
            begin = i - int(place[i])
            reached = i + _agreeing(words, i, q, i + int(left[i]) - q, 1)
            start = i - _agreeing(words, i - 1, q, begin - 1, -1)
            before = q
            if reached - start + q >= TIMES * q:
                found.append(np.array([[of[i], place[start], reached - start + q, q]]))
    every = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    # the same stretch is found under multiples of its period too
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :3] != every[:-1, :3]).any(1)
    every = every[first]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


Edit = Callable[[int | None, int], np.ndarray | None]


def _scanned(texts: list[bytes], docs: list[int | None], edit: Edit | None) -> Iterator[tuple[int, list, bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    split = []
    for doc, text in zip(docs, texts):
        # bytes.split() knows the six white-space characters of ASCII and no other
        words = text.split()
        order = edit(doc, len(words)) if edit else None
        split.append(words if order is None else [words[i] for i in order])
    sizes = [len(w) for w in split]
    every = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    runs = find_runs(every, sizes)
    bounds = np.searchsorted(runs[:, 0], np.arange(len(sizes) + 1))
    for n, words in enumerate(split):
        own = runs[bounds[n] : bounds[n + 1], 1:]
        if len(own):
            kept = np.zeros(len(words) + 1, np.int64)
            np.add.at(kept, own[:, 0] + own[:, 2], 1)
            np.add.at(kept, own[:, 0] + own[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(kept[:-1]) == 0)]
        yield sizes[n], [dict(zip(("start", "length", "period"), r)) for r in own.tolist()], b" ".join(words)


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every text, one row for each row of docs.

    Words are what stands between white space of ASCII; runs count words from 0 and go by start, then period. collapsed
    has the words outside all runs and of each run the first period, with one space between. Null and empty texts have
    no words and collapse to ''. edit(doc_id, number of words), where given, names the words to scan instead of all in
    their order. A task holds SCAN words or one document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
        for batch in batches:
            size = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            part = np.concatenate([[0], np.cumsum(size) // (4 * SCAN)])
            cuts = [0, *(np.flatnonzero(np.diff(part[:-1])) + 1).tolist(), len(size)] if len(size) else [0]
            for a, b in zip(cuts, cuts[1:]):
                ids = batch.column("doc_id").slice(a, b - a)
                texts = batch.column("text").slice(a, b - a).cast(pa.binary()).to_pylist()
                n, runs, kept = zip(*_scanned(texts, ids.to_pylist(), edit))
                columns = [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(text_rows(docs), run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """The words of the registered query's edit: a tenth of the documents, by crc32 of their doc_id, end in a repetition."""
    if doc is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(str(doc).encode()), 10)
    if tenth:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods, compared exactly; the first of equals. Null where there is none."""
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), better))


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the edited texts."""
    best = F.col("best")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return periodic_runs(docs, planted).withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
