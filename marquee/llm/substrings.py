"""Exact substring deduplication with suffix arrays built by induced sorting.

Every 100-byte string is filed under the smallest hash among its 24-byte strings, so equal strings are filed alike
wherever they stand; a run of neighbouring strings filed under one place makes a block of 100 to 176 bytes. Blocks
filed under a hash that occurs once can't repeat and go no further; blocks equal as wholes are kept once, at their
first place. The rest meet by hash in shards. A shard's suffix array is built by induced sorting (types of suffixes,
leftmost-smaller substrings sorted and named, their order induced to all suffixes), permuted common prefixes up to 100
bytes then part it into groups of equal strings, and in each group all but the first place in the corpus are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import map_arrow, materialise

LENGTH = 100
GRAM = 24
#: Bytes of blocks that one suffix array takes, and blocks under one hash beyond which they are filed anew.
SHARD, MANY = 1 << 19, 5_000
#: Bytes of a text that are worked on at a time.
PART = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = (1 << 63) - 1


# -- where strings are filed -------------------------------------------------------------------------------------------------


@lru_cache(4)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, `size` of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    return tuple(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables that reach exponent n at least."""
    return _power_table(1 << max(16, n.bit_length()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def blocks(raw: bytes, seed: int = 0, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, whole, at, first, n) of each run of 100-byte strings of a text of at most PART bytes.

    hash is that of the smallest gram of all n strings that start at `first` and after, `at` its place, and whole a
    hash of the bytes first to first + n + 99.
    """
    n = len(raw)
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    powers, inverses = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1 + 2 * seed)) * powers[:n], out=total[1:])
    h = _mix((total[gram:] - total[:-gram]) * inverses[: n - gram + 1])
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, span, least = LENGTH - gram + 1, 1, key
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[wide - span :][: n - LENGTH + 1])
    at = (least & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    many = np.diff(np.concatenate([first, [len(at)]]))
    end = first + many + LENGTH - 1
    whole = _mix((total[end] - total[first]) * inverses[first] + (end - first).astype(np.uint64) * np.uint64(_BASE))
    return h[at[first]], whole, at[first], first, many


def _filed(docs: DataFrame) -> DataFrame:
    """(filed, whole, doc, place) of every block; place packs the hash's place, the strings before it, their number and a tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, tag, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode("utf-8", "replace")
                for start in range(0, max(len(raw) - LENGTH + 1, 0), PART - LENGTH + 1):
                    filed, whole, at, first, many = blocks(raw[start : start + PART])
                    place = (at + start) << 32 | (at - first) << 24 | many << 16 | tag
                    parts.append((filed.view(np.int64), whole.view(np.int64), np.full(len(at), doc, np.int64), place))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["filed", "whole", "doc", "place"])

    return map_arrow(docs.select("doc", "tag", "text"), run, "filed bigint, whole bigint, doc bigint, place bigint")


# -- suffix arrays -----------------------------------------------------------------------------------------------------------


def _appended(chars: np.ndarray, pointer: np.ndarray, step: int) -> np.ndarray:
    """Where a batch goes: behind the pointer of each one's bucket, in order; moves the pointers."""
    order = np.argsort(chars, kind="stable")
    kinds, start, counts = np.unique(chars[order], return_index=True, return_counts=True)
    rank = np.empty(len(chars), np.int64)
    rank[order] = np.arange(len(chars)) - np.repeat(start, counts)
    where = pointer[chars] + step * rank
    pointer[kinds] += step * counts
    return where


def _induced(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of t from the order of some leftmost-smaller ones, a bucket (first symbol) at a time.

    smaller: suffixes less than their right neighbour; ends: where each bucket ends.
    """
    n, symbols = len(t), len(ends)
    order = np.full(n, -1, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    tail = ends - 1
    back = seeds[::-1]
    order[_appended(t[back], tail, -1)] = back
    seeded = tail + 1
    head = begins.copy()
    if not smaller[n - 1]:  # the last suffix starts the scan: it is less than all others of its bucket
        order[head[t[n - 1]]] = n - 1
        head[t[n - 1]] += 1
    for c in range(symbols):  # larger suffixes, from the left
        done = begins[c]
        while True:
            batch = order[done : head[c]]
            if not len(batch):
                break
            done = head[c]
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                order[_appended(t[before], head, 1)] = before
        batch = order[seeded[c] : ends[c]]
        before = batch[batch > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            order[_appended(t[before], head, 1)] = before
    tail = ends - 1
    for c in range(symbols - 1, -1, -1):  # smaller suffixes, from the right
        done = ends[c] - 1
        while True:
            batch = order[tail[c] + 1 : done + 1][::-1]
            if not len(batch):
                break
            done = tail[c]
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            if len(before):
                order[_appended(t[before], tail, -1)] = before
        batch = order[begins[c] : head[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[smaller[before]]
        if len(before):
            order[_appended(t[before], tail, -1)] = before
    return order


def _ranked(names: np.ndarray, upto: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first `upto` names: ranks of 1, 2, 4, ... names."""
    rank, span, n = names, 1, len(names)
    while True:
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:] + 1
        both = rank * (int(rank.max()) + 2) + after
        order = np.argsort(both, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
        span *= 2
        if span >= upto or span >= n or rank[order[-1]] == n - 1:
            return order


def suffix_array(t: np.ndarray, upto: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes of symbols t in the order of their first `upto` symbols at least (equal ones in any order)."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    # a suffix is smaller than its neighbour if the next other symbol is larger; the last one is larger
    differs = np.append(np.flatnonzero(t[:-1] != t[1:]), n - 1)
    up = np.append(t[:-1] < t[1:], False)
    smaller = up[differs[np.searchsorted(differs, np.arange(n))]]
    least = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(t, minlength=int(t.max()) + 1))
    if not len(least):
        return _induced(t, smaller, least, ends)
    rough = _induced(t, smaller, least, ends)
    chosen = np.zeros(n, bool)
    chosen[least] = True
    by_substring = rough[chosen[rough]]
    # name leftmost-smaller substrings: alike if as long and of the same hash
    stop = np.full(n, n, np.int64)
    stop[least[:-1]] = least[1:] + 1
    powers, inverses = _powers(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * powers[:n])])
    digest = (total[stop[by_substring]] - total[by_substring]) * inverses[by_substring]
    size = stop[by_substring] - by_substring
    name = np.empty(n, np.int64)
    name[by_substring] = np.concatenate([[0], np.cumsum((np.diff(digest) != 0) | (np.diff(size) != 0))])
    if name[by_substring[-1]] == len(least) - 1:
        sorted_least = by_substring
    else:
        sorted_least = least[_ranked(name[least], upto)]
    return _induced(t, smaller, sorted_least, ends)


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """By suffix: symbols in common with the suffix before it in the order, up to `most`; 0 for the first."""
    n = len(t)
    packed = np.zeros(n + most + 8, np.uint64)
    longer = np.zeros(n + most + 16, np.uint64)
    longer[:n] = t
    for i in range(4):
        packed |= longer[i : i + len(packed)] << np.uint64(16 * i)
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for at in range(0, most, 4):
        if not len(a):
            break
        x = packed[a + at] ^ packed[b + at]
        out = x != 0
        low = x[out] & (~x[out] + np.uint64(1))
        common[b[out]] += np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48], np.uint64), low, side="right")
        a, b = a[~out], b[~out]
        common[b] += 4
    # suffixes end where t does
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    return np.minimum(np.minimum(common, most), np.minimum(n - np.arange(n), n - before))


def repeated_starts(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """For each block the starts of its 100-byte strings that also stand in a block of lower rank."""
    sizes = np.array([len(x) for x in texts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    t[begin + sizes] = 0  # ends of blocks are less than any byte
    order = suffix_array(t)
    common = permuted_common_prefixes(t, order)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(t)) - begin[owner]
    group = np.cumsum(common[order] < LENGTH)
    whole = inside[order] + LENGTH <= sizes[owner[order]]
    at, group = order[whole], group[whole]
    if not len(at):
        return [np.zeros(0, np.int64)] * len(texts)
    start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    least = np.minimum.reduceat(ranks[owner[at]], start)
    lost = np.sort(at[ranks[owner[at]] > np.repeat(least, np.diff(np.concatenate([start, [len(at)]])))])
    return np.split(inside[lost], np.searchsorted(owner[lost], np.arange(1, len(texts))))


def _spans(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Bytes covered by 100-byte strings at sorted starts, as begins and ends."""
    if not len(starts):
        return [], []
    gaps = np.flatnonzero(np.diff(starts) > LENGTH)
    return starts[np.concatenate([[0], gaps + 1])].tolist(), (starts[np.concatenate([gaps, [len(starts) - 1]])] + LENGTH).tolist()


# -- the corpus --------------------------------------------------------------------------------------------------------------


def _sorted_shards(found: DataFrame) -> DataFrame:
    """Rows (shard, filed, whole, doc, place, shift, bytes) sorted by shard to (filed, whole, begins, ends) of what first places lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def solved() -> pa.RecordBatch:
            rank = np.empty(len(rows), np.int64)
            rank[sorted(range(len(rows)), key=lambda i: rows[i][3:5])] = np.arange(len(rows))
            lost = repeated_starts([r[6] for r in rows], rank) if rows else []
            out = [(r[1], r[2], *_spans(s + r[5])) for r, s in zip(rows, lost) if len(s)]
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], names=["filed", "whole", "begins", "ends"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "filed", "whole", "doc", "place", "shift", "bytes"))):
                if size >= SHARD and row[0] != rows[-1][0]:
                    yield solved()
                    size = 0
                rows.append(row)
                size += len(row[6])
        yield solved()

    return map_arrow(found, run, "filed bigint, whole bigint, begins array<int>, ends array<int>")


def _with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc, tag, blocks) with each block's bytes; blocks under a crowded hash are filed anew under two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 5, pa.int32(), pa.binary())
        names = ["shard", "filed", "whole", "doc", "place", "shift", "bytes"]
        for batch in batches:
            rows = []

            def drain() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)
                rows.clear()
                return made

            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "blocks"))):
                raw = text.encode("utf-8", "replace")
                for b in found:
                    place = b["place"]
                    at, left, many = place >> 32, place >> 24 & 255, place >> 16 & 255
                    block = raw[at - left : at - left + many + LENGTH - 1]
                    if not b["crowded"]:
                        rows.append((b["filed"], b["filed"], b["whole"], doc, place, 0, block))
                        continue
                    for h, _, _, first, n in zip(*(x.tolist() for x in blocks(block, seed=1, gram=16))):
                        shard = (h * 31 + b["filed"]) & NO_ID
                        rows.append((shard, b["filed"], b["whole"], doc, place, first, block[first : first + n + LENGTH - 1]))
                if len(rows) > 20_000:
                    yield drain()
            yield drain()

    both = docs.select("doc", "tag", "text").join(wanted, ["doc", "tag"])
    return map_arrow(both.select("doc", "text", "blocks"), run, "shard bigint, filed bigint, whole bigint, doc bigint, place bigint, shift int, bytes binary")


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc, tag, spans array<struct<b, e>>) of the bytes that documents(doc, tag, text) lose; spans may overlap."""
    same = Window.partitionBy("filed")
    repeated = materialise(_filed(docs).withColumn("n", F.count("*").over(same)).where("n > 1").drop("n"))
    # blocks equal as wholes: the first place stands for all; alone under their hash, there is nothing to sort
    kinds = repeated.groupBy("filed", "whole").agg(F.min(F.struct("doc", "place")).alias("first"))
    several = kinds.groupBy("filed").agg(F.count("*").alias("n")).where("n > 1")
    open_ = kinds.join(several, "filed").select("filed", "whole", "first", (F.col("n") > MANY).alias("crowded"))
    tag = F.col("first.place").bitwiseAND(F.lit(0xFFFF))
    wanted = open_.groupBy(F.col("first.doc").alias("doc"), tag.alias("tag")).agg(F.collect_list(F.struct("filed", "whole", F.col("first.place").alias("place"), "crowded")).alias("blocks"))
    parts = _with_bytes(docs, wanted)
    lost = _sorted_shards(parts.repartition("shard").sortWithinPartitions("shard"))
    lost = lost.groupBy("filed", "whole").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    named = kinds.join(materialise(lost), ["filed", "whole"], "left")
    places = repeated.join(named, ["filed", "whole"])
    start = F.shiftright("place", 32) - F.shiftright("place", 24).bitwiseAND(F.lit(255))
    many = F.shiftright("place", 16).bitwiseAND(F.lit(255))
    own = F.zip_with("begins", "ends", lambda b, e: F.struct((start + b).alias("b"), (start + e).alias("e")))
    copy = F.array(F.struct(start.alias("b"), (start + many + LENGTH - 1).alias("e")))
    spans = F.when(F.struct("doc", "place").eqNullSafe(F.col("first")), own).otherwise(copy)
    gone = places.select("doc", F.col("place").bitwiseAND(F.lit(0xFFFF)).alias("tag"), spans.alias("s")).where("s is not null")
    return gone.groupBy("doc", "tag").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that spans cover; spans that touch make one run."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(begins[1:] > ends[:-1])
    return begins[np.concatenate([[0], cut + 1])], ends[np.concatenate([cut, [len(ends) - 1]])]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.pmod(F.xxhash64(text), F.lit(1 << 16)).alias("tag"), text.alias("text"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row of docs.

    A byte goes if a 100-byte string over it also starts earlier: in a document of smaller doc_id, or further left in
    the same. Null text counts as empty. Rows of the same doc_id and text are one document and keep the same bytes;
    rows of the same doc_id with other texts follow each other in the order of a hash of their place. Rows without
    doc_id come last.
    """
    keyed = _keyed(docs)
    both = keyed.join(removed_spans(keyed), ["doc", "tag"], "left").select("doc", "text", F.col("spans.b").alias("b"), F.col("spans.e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, b, e in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "b", "e"))):
                raw = text.encode("utf-8", "replace")
                begins, ends = merged(np.array(b or [], np.int64), np.array(e or [], np.int64))
                kept = b"".join(raw[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(raw)]))
                rows.append((None if doc == NO_ID else doc, len(raw), int((ends - begins).sum()), len(begins), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_arrow(both, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
