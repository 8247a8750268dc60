"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A paragraph is what stands between line breaks or after the end of a sentence. Every occurrence has a 64-bit digest
(of the paragraph and of how many equal ones stand before it) that is added to one cell in each of three rows: a
count, the XOR of digests and the XOR of their checks. Sketches of two versions subtract cell by cell; what is left
are the paragraphs in only one of them, and peeling cells that hold a single one recovers their digests. Where
peeling stalls the sketches are built again, larger.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_arrow

#: Cells of a row in the fingerprint that is returned, and in which differences are first sought.
CELLS = 5
ROWS = 3
#: Ranges of doc_id that are worked on side by side.
RANGES = 256
BOUNDARY = re.compile(r"\n+|(?<=[.!?])\s+")
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_ROW = np.arange(ROWS, dtype=np.uint64)[:, None]


def paragraphs(text: str) -> list[str]:
    return [p for p in BOUNDARY.split(text) if p]


def digests(text: str) -> np.ndarray:
    """One digest for each occurrence of each paragraph."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, -1) + 1
        out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "replace"), n))
    return np.unique(np.array(out, np.uint64))


def _mixed(keys: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(31))) * salt
    return x ^ (x >> np.uint64(29))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each row, rows one after another."""
    x = (keys ^ (keys >> np.uint64(31)))[None, :] * _SALTS[:, None]
    x = ((x ^ (x >> np.uint64(29))) >> np.uint64(20)) % np.uint64(cells) + _ROW * np.uint64(cells)
    return x.astype(np.int64).reshape(-1)


class Sketch:
    """count, key and check of ROWS rows of `cells` cells."""

    def __init__(self, keys: np.ndarray, cells: int) -> None:
        self.cells = cells
        self.key = np.zeros(ROWS * cells, np.uint64)
        self.check = np.zeros(ROWS * cells, np.uint64)
        at = _places(keys, cells)
        self.count = np.bincount(at, minlength=ROWS * cells)
        np.bitwise_xor.at(self.key, at, np.tile(keys, ROWS))
        np.bitwise_xor.at(self.check, at, np.tile(_mixed(keys, np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40), ROWS))

    def text(self) -> str:
        """The cells, 13 bytes each, in base 64."""
        cells = np.zeros((ROWS * self.cells, 13), np.uint8)
        cells[:, :2] = (self.count & 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
        cells[:, 2:10] = self.key.astype("<u8").view(np.uint8).reshape(-1, 8)
        cells[:, 10:] = self.check.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
        return base64.b64encode(cells.tobytes()).decode()


def peel(a: Sketch, b: Sketch) -> tuple[list[int], list[int]] | None:
    """Digests only in a and only in b, or None if the difference doesn't come apart."""
    cells = a.cells
    count, key, check = ((x - y if i == 0 else x ^ y).tolist() for i, (x, y) in enumerate(((a.count, b.count), (a.key, b.key), (a.check, b.check))))
    mask, only_a, only_b = (1 << 64) - 1, [], []

    def mixed(k: int, salt: int) -> int:
        x = ((k ^ (k >> 31)) * salt) & mask
        return x ^ (x >> 29)

    salts = [int(s) for s in _SALTS]
    queue = [i for i, n in enumerate(count) if n in (1, -1)]
    steps = 20 * len(count)  # cells that only look pure could otherwise be undone and redone
    while queue and steps:
        i, steps = queue.pop(), steps - 1
        n, k = count[i], key[i]
        if n not in (1, -1) or mixed(k, 0xD6E8FEB86659FD93) >> 40 != check[i]:
            continue
        (only_a if n == 1 else only_b).append(k)
        c = check[i]
        x = k ^ (k >> 31)
        for r, salt in enumerate(salts):
            y = (x * salt) & mask
            at = ((y ^ (y >> 29)) >> 20) % cells + r * cells
            count[at] -= n
            key[at] ^= k
            check[at] ^= c
            if count[at] in (1, -1):
                queue.append(at)
    return None if any(count) or any(key) or any(check) else (only_a, only_b)


def difference(a: np.ndarray, b: np.ndarray, small: tuple[Sketch, Sketch] | None = None) -> tuple[list[int], list[int]]:
    """Digests in only one of two texts: from the small sketches if their difference comes apart, else from ones with
    room for all digests of both, else from twice as large ones until it does."""
    one, two = small or (Sketch(a, CELLS), Sketch(b, CELLS))
    found = peel(one, two) if np.count_nonzero(one.count - two.count) < len(one.count) else None
    cells = max(2 * one.cells, (len(a) + len(b)) // 2 + 3)
    while found is None:
        found = peel(Sketch(a, cells), Sketch(b, cells))
        cells *= 2
    return found


def likeness(a: np.ndarray, b: np.ndarray, small: tuple[Sketch, Sketch] | None = None) -> float:
    """Share of paragraphs in both texts among those in either; 1 for two texts without any."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    differing = sum(map(len, difference(a, b, small)))
    return (total - differing) / (total + differing)


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down, in code points) replaced by the first as many of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, last, doc_id, text): each document in its range of doc_id, and as the last of the range before (descending)
    each range's first document, so that every range shows the successors of all its documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [(i + 1) / ranges for i in range(ranges)]
    found = rows.select("doc_id").agg(F.percentile_approx("doc_id", shares).alias("b"), F.max("doc_id").alias("m")).first()
    bounds = sorted({*(found["b"] or []), *([] if found["m"] is None else [found["m"]])})
    if not bounds:
        return rows.select(F.lit(0).alias("range"), F.lit(False).alias("last"), "doc_id", "text")
    every = F.array(*map(F.lit, bounds))
    own = F.coalesce(F.size(F.filter(every, lambda b: b < F.col("doc_id"))), F.lit(0))
    is_bound = F.coalesce(F.array_contains(every, F.col("doc_id")), F.lit(False))
    above = F.when(F.col("doc_id") == bounds[-1], 0).otherwise(own + 1)
    places = F.when(is_bound, F.array(F.struct(own.alias("range"), F.lit(False).alias("last")), F.struct(above.alias("range"), F.lit(True).alias("last")))).otherwise(F.array(F.struct(own.alias("range"), F.lit(False).alias("last"))))
    return rows.select(F.explode(places).alias("p"), "doc_id", "text").select("p.range", "p.last", "doc_id", "text")


def fingerprints(docs: DataFrame, cells: int = CELLS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The next document is the one with the next smaller doc_id, for the smallest the one with the largest. Rows of the
    same doc_id follow each other in the order of their text's hash; rows without one come last. Null text counts as
    empty; a lone document is its own next one. Up to `ranges` ranges of doc_id, cut at quantiles, are read in order
    side by side, a text and its successor at a time.
    """
    ordered = _in_ranges(docs, ranges).repartition(ranges, "range").sortWithinPartitions("range", "last", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (range, doc_id, text, digests, sketch) that waits for its successor
        first: tuple | None = None
        rows: list[tuple] = []

        def done(one: tuple, after: tuple) -> None:
            _, doc, text, own, sketch = one
            new = edited(text, after[2])
            changed = digests(new)
            other = Sketch(changed, cells)
            near = likeness(own, changed, (sketch, other)), likeness(own, after[3], (sketch, after[4]))
            rows.append((doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), sketch.text(), other.text(), *near))

        def drain() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for place, last, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "last", "doc_id", "text"))):
                own = digests(text)
                now = (place, doc, text, own, Sketch(own, cells))
                if held and held[0] == place:
                    done(held, now)
                elif held:  # a range without a last row: there is no doc_id at all
                    done(held, first)
                if not held or held[0] != place:
                    first = now
                held = None if last else now
                if last:
                    first = None
            yield drain()
        if held:
            done(held, first)
        yield drain()

    return map_arrow(ordered, run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
