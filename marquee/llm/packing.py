"""Packing of documents into sequences by a configuration linear program.

A document's ids, then id 0, make one piece, or several of exactly `capacity` behind a possibly shorter first one. Only
the histogram of piece lengths, at most `capacity` numbers, reaches the driver. There the linear program "cover every
length's count by configurations (how many pieces of which lengths share a sequence), using as few as possible" is
solved by multiplicative weights on both sides: a length's price rises by a factor where the configurations in use fall
short of its count and falls where they exceed it, and a configuration's amount rises by a factor where its pieces'
prices come to more than one sequence and falls where they come to less. A knapsack dynamic program over the prices finds
the configurations to add, and its best value makes the prices a lower bound (a feasible dual). Steps end when the
amounts, which cover every length's count, are within GAP of that bound. Amounts are then rounded to whole ones in the
order of their configurations, so that what one rounds down its neighbours make up for, and what is left of the
histogram goes by best fit decreasing; the rounding that takes fewest sequences counts, and rounding everything to zero
is one of those tried, so the result never has more sequences than best fit decreasing. Each piece then finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.bpe import byte_alphabet
from marquee.llm.common import map_arrow, materialise, text_rows

CAPACITY = 2048
#: Words whose ids a task keeps at a time.
TABLE = 300_000
#: Ranks within a length are counted in parts of about so many pieces, so that no length lands in one task.
PART_ROWS = 100_000
#: The multiplicative weights end when cover and lower bound are this near to each other, at the latest after so many calls of the knapsack.
GAP, ROUNDS = 0.003, 300
#: Steps of prices and amounts between two calls, how strongly both react (their product must stay below 1), and the factor's logarithm at most.
STEPS, REACT, LIMIT = 60, 0.7, 0.3
#: A configuration is added when its pieces' prices come to nearly as much as the best one's, at first with this share of its length's count.
SLACK, ADDED = 0.02, 0.002
#: Configurations with less than this share of the mean amount are taken for out of use.
UNUSED = 1e-4
#: Shares of the amounts that the roundings tried keep.
PARTS = (1.0, 0.98, 0.95, 0.9, 0.7, 0.4, 0.0)
#: The splitting expression of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """Ids of a byte-level vocabulary file of the tokenizers library, as four little-endian bytes each."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.table: dict[str, bytes] = {}
        #: The splitting expression for texts of ASCII, Latin-1 and Latin Extended-A, whose classes can be listed.
        space, letter, number = r"\t-\r \x85\xa0", "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.odd = re.compile("[^\x00-ſ]")

    def _word(self, word: str) -> bytes:
        if len(self.table) >= TABLE:
            self.table.clear()
        self.table[word] = ids = np.asarray(self.coder.encode_ordinary(word), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if self.odd.search(text) or any(s in text for s in self.special):
            return np.asarray(self.coder.encode(text, allowed_special="all"), "<u4").tobytes()
        get, make = self.table.get, self._word
        return b"".join([get(w) or make(w) for w in self.plain.findall(text)])

    def encode_plain(self, text: str) -> bytes:
        """encode(), the names of special tokens being ordinary text."""
        if self.odd.search(text):
            return np.asarray(self.coder.encode_ordinary(text), "<u4").tobytes()
        get, make = self.table.get, self._word
        return b"".join([get(w) or make(w) for w in self.plain.findall(text)])


@lru_cache(2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null or empty text is the one id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = coder.encode(text) + b"\0\0\0\0"
                total = len(ids) // 4
                start, n = 0, (total - 1) % capacity + 1
                piece = 0
                while start < total:
                    rows.append((doc, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start, n, piece = start + n, capacity, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(text_rows(docs), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


Configuration = tuple[tuple[int, int], ...]


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to capacity the highest total price of pieces that fit it, and the length to take next (0: none), the longest of equals. price: by length, 0 to capacity."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    backward = price[::-1].copy()
    for room in range(1, capacity + 1):
        total = best[:room] + backward[capacity - room : capacity]
        i = int(total.argmax())
        best[room] = best[room - 1]
        if total[i] > best[room]:
            best[room], took[room] = total[i], room - i
    return best, took


def _filled(room: int, took: np.ndarray, first: int = 0) -> Configuration:
    """The configuration that the knapsack's steps give, beside a piece of length `first`."""
    found = {first: 1} if first else {}
    while room > 0:
        if step := int(took[room]):
            found[step] = found.get(step, 0) + 1
            room -= step
        else:
            room -= 1
    return tuple(sorted(found.items(), reverse=True))


class _Columns:
    """Configurations in use, in flat arrays (column, row of the length, pieces), and their amounts."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.row = {int(x): i for i, x in enumerate(lengths)}
        self.found: dict[Configuration, int] = {}
        self.flat: list[tuple[int, int, int]] = []
        self.amount = np.zeros(0)

    def add(self, made: list[tuple[Configuration, float]]) -> None:
        amounts = []
        for configuration, amount in made:
            if configuration not in self.found:
                self.found[configuration] = len(self.found)
                self.flat += [(len(self.found) - 1, self.row[x], n) for x, n in configuration]
                amounts.append(amount)
        self.amount = np.concatenate([self.amount, amounts])

    def drop_below(self, least: float) -> None:
        kept = np.flatnonzero(self.amount >= least)
        number = {int(old): new for new, old in enumerate(kept)}
        self.found = {c: number[k] for c, k in self.found.items() if k in number}
        self.flat = [(number[k], row, n) for k, row, n in self.flat if k in number]
        self.amount = self.amount[kept]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column, row, n = np.array(self.flat, np.int64).T
        return column, row, n.astype(float)


def _merged(configuration: Configuration) -> Configuration:
    total: dict[int, int] = {}
    for length, n in configuration:
        total[length] = total.get(length, 0) + n
    return tuple(sorted(total.items(), reverse=True))


def solve(count: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[Configuration, float], float]:
    """(fractional configurations, lower bound) of the linear program for count[length] pieces of each length.

    The amounts cover each length's count. The bound is on the program's optimum, and so on the sequences of any packing.
    """
    lengths = np.flatnonzero(count)
    if not len(lengths):
        return {}, 0.0
    need, single = count[lengths].astype(float), capacity // lengths
    columns = _Columns(lengths)
    columns.add([(_merged(c), float(times)) for c, times in best_fit(count, capacity)])
    columns.add([(((int(x), int(n)),), ADDED * c) for x, n, c in zip(lengths, single, need)])
    bound, cover, result = 0.0, np.inf, {}
    price = mean = lengths / capacity
    starts = [price] + [(2 * lengths > capacity).astype(float)] * bool(2 * lengths[-1] > capacity)
    for turn in range(ROUNDS):
        column, row, n = columns.arrays()
        amount, k, m = columns.amount, len(columns.amount), len(lengths)
        made = before = np.bincount(row, n * amount[column], m)
        amounts, prices, dearest = np.zeros(k), np.zeros(m), 1.0
        for _ in range(STEPS):
            price = price * np.exp((REACT / dearest * (need - 2 * made + before) / np.maximum(made, need)).clip(-LIMIT, LIMIT))
            worth = np.bincount(column, n * price[row], k)
            dearest = max(1.0, float(worth.max()))
            amount = amount * np.exp((REACT * (worth - 1)).clip(-LIMIT, LIMIT))
            before, made = made, np.bincount(row, n * amount[column], m)
            amounts, prices = amounts + amount, prices + price
        amount, price = amounts / STEPS, prices / STEPS
        # a longer piece is never worth less, so prices that say so are noise
        price = (np.maximum.accumulate(price) + np.minimum.accumulate(price[::-1])[::-1]) / 2
        mean = mean + (price - mean) * (1.0 if turn < 5 else 0.1)
        for tried in (*starts, mean, price):
            by_length = np.zeros(capacity + 1)
            by_length[lengths] = tried
            best, took = knapsack(by_length, capacity)
            bound = max(bound, float(need @ tried) / best[capacity])
        starts = []
        short = np.maximum(0, need - np.bincount(row, n * amount[column], m)) / single
        columns.amount = amount
        if amount.sum() + short.sum() < cover:
            cover = float(amount.sum() + short.sum())
            result = {c: float(a) for c, a in zip(columns.found, amount) if a > 0}
            for x, each, a in zip(lengths[short > 0], single[short > 0], short[short > 0]):
                alone = ((int(x), int(each)),)
                result[alone] = result.get(alone, 0.0) + float(a)
        if cover <= (1 + GAP) * bound:
            break
        value = (price + best[capacity - lengths]) / best[capacity]
        price = price / best[capacity]
        if turn % 10 == 9:  # those out of use are found again when prices ask for them
            columns.drop_below(UNUSED * float(amount.sum()) / k)
        columns.add([(_filled(capacity - int(lengths[i]), took, int(lengths[i])), ADDED * need[i]) for i in np.flatnonzero(value > 1 - SLACK)])
    return result, bound


def best_fit(left: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Configuration, int]]:
    """Best fit decreasing of left[length] pieces of each length, as (configuration, times); equal sequences are filled at once."""
    rooms: list[dict[Configuration, int]] = [{} for _ in range(capacity + 1)]

    def put(room: int, configuration: Configuration, times: int) -> None:
        if times:
            rooms[room][configuration] = rooms[room].get(configuration, 0) + times

    for length in map(int, np.flatnonzero(left)[::-1]):
        n = int(left[length])
        for room in range(length, capacity + 1):
            each = room // length
            while n and rooms[room]:
                configuration, times = rooms[room].popitem()
                full = min(times, n // each)
                put(room - each * length, (*configuration, (length, each)), full)
                n -= full * each
                times -= full
                if times and n:
                    put(room - n * length, (*configuration, (length, n)), 1)
                    n, times = 0, times - 1
                put(room, configuration, times)
            if not n:
                break
        each = capacity // length
        put(capacity - each * length, ((length, each),), n // each)
        if n % each:
            put(capacity - n % each * length, ((length, n % each),), 1)
    return [(c, times) for room in rooms for c, times in room.items()]


def _rounded(amounts: dict[Configuration, float], count: np.ndarray, part: float, capacity: int) -> list[tuple[Configuration, int]]:
    """Whole times of the configurations, never beyond what is left; best fit for the rest.

    `part` of the amounts is summed up in the order of the configurations, and each gets the whole sequences that the sum passes with it.
    """
    left, plan, passed = count.copy(), [], 0.0
    for configuration, amount in sorted(amounts.items(), reverse=True) if part else ():
        passed += amount * part
        times = min([int(passed), *(int(left[length]) // n for length, n in configuration)])
        passed -= int(passed)
        if times:
            plan.append((configuration, times))
            for length, n in configuration:
                left[length] -= n * times
    return plan + best_fit(left, capacity)


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Configuration, int]], int]:
    """((configuration, times) that together use every piece of the histogram exactly once, lower bound on their number)."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    whole, count[capacity] = int(count[capacity]), 0
    amounts, bound = solve(count, capacity)
    plans = [_rounded(amounts, count, part, capacity) for part in PARTS]
    plan = min(plans, key=lambda p: sum(times for _, times in p))
    return [(((capacity, 1),), whole)] * (whole > 0) + plan, whole + int(np.ceil(bound - 1e-6))


def _places(plan: list[tuple[Configuration, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of ranks, and for the run its pieces a sequence, first sequence and first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    reached: dict[int, int] = {}
    sequence = 0
    for found, times in plan:
        offset = 0
        for length, n in found:
            rows.setdefault(length, []).append((reached.get(length, 0), n, sequence, offset))
            reached[length] = reached.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in rows.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    path: the vocabulary file; by default the public byte-level one. Null and empty texts are one piece of one id;
    repeated rows are packed each; an empty table gives an empty result. The plan that tasks hold has the rounded
    configurations and those of best_fit(), which depend on the lengths that occur, not on the number of documents.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    cut = materialise(pieces(docs, path, capacity))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(histogram.values()) // PART_ROWS))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    places = _places(configurations(histogram, capacity)[0])
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = (
        cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(before, ["length", "part"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, per, base, start = places[int(length)]
                i = np.searchsorted(first, ranks[at], side="right") - 1
                k = ranks[at] - first[i]
                sequence[at], offset[at] = base[i] + k // per[i], start[i] + k % per[i] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
