"""Alignment of two tokenizers' ids over the same bytes.

Every text is tokenised in full by a byte-level vocabulary (A) and a sentence-piece vocabulary (B). Where a token of both
begins with a space at the same byte, the tokens before it end together: such an anchor, verified by the byte counts of
all tokens before it, cuts both id sequences. The windows between anchors are mostly one or two words long and repeat, so
each distinct pair of id tuples among the texts that a task holds is aligned once, and its alignment is kept for all
windows with the same ids.

Two tokens that end at the same byte share their last bytes, so the shorter one is a suffix of the other. That bounds
the pairs of ids that can ever be linked by the vocabularies alone (each token has one suffix of each length), however
large the corpus is. All those pairs are numbered once; documents keep their links as such numbers, counts of all
documents are grouped in Spark, and the counted table, never longer than the numbered pairs, is broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.bpe import byte_alphabet
from marquee.llm.common import map_arrow, materialise, text_rows
from marquee.llm.packing import byte_bpe

#: Bytes of text, about, that are aligned together, or one text if that is longer.
TOGETHER = 1 << 19
#: An odd factor and its inverse modulo 2^64, of the hash that groups equal windows.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _taken(values: np.ndarray, cuts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the chosen stretches between cuts one behind the other, their cuts)."""
    n = np.diff(cuts)[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(cuts[which] - ends[:-1], n) + np.arange(ends[-1])], ends


class Aligner:
    """Tokenises texts with both vocabularies and links their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = byte_bpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes_a = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes_b.append(b"" if self.b.is_control(i) or self.b.is_unknown(i) else raw)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in v]) for v in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(v), np.uint8) for v in (self.bytes_a, self.bytes_b))
        self.begins_a, self.begins_b = (np.cumsum(n) - n for n in (self.size_a, self.size_b))
        numbers = [str(i).encode() + b"," for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits, self.digits_size = np.frombuffer(b"".join(numbers), np.uint8), np.array([len(x) for x in numbers], np.int64)
        self.digits_at = np.cumsum(self.digits_size) - self.digits_size
        self.pairs = self._possible()

    def _possible(self) -> np.ndarray:
        """a * (size of B) + b of every pair of ids of which one's bytes are a suffix of the other's, sorted."""
        at_a: dict[bytes, list[int]] = {}
        at_b: dict[bytes, list[int]] = {}
        for tokens, at in ((self.bytes_a, at_a), (self.bytes_b, at_b)):
            for i, raw in enumerate(tokens):
                if raw:
                    at.setdefault(raw, []).append(i)
        found = set()
        many = len(self.bytes_b)
        for raw, ids in at_a.items():
            for k in range(len(raw)):
                for b in at_b.get(raw[k:], ()):
                    found.update(a * many + b for a in ids)
        for raw, ids in at_b.items():
            for k in range(len(raw)):
                for a in at_a.get(raw[k:], ()):
                    found.update(a * many + b for b in ids)
        return np.array(sorted(found), np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pairs given as a * (size of B) + b."""
        return np.searchsorted(self.pairs, keys).astype(np.int32)

    def b_of(self) -> np.ndarray:
        """The B id of each numbered pair."""
        return self.pairs % len(self.bytes_b)

    def windows(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(groups as text, its cuts, keys of the linked pairs, their cuts) of windows of ids that cover the same bytes, aligned together.

        A group ends where a token of each side ends at the same byte. Its text is written token by token: A's ids, B's
        ids, and behind each id a comma, behind the last of A a bar and behind the last of B a semicolon.
        """
        _, last_a, last_b = np.intersect1d(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), assume_unique=True, return_indices=True)
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[place_a[last_a]], sign[place_b[last_b]] = ord("|"), ord(";")
        text = self._bytes(self.digits, self.digits_at, self.digits_size, ids)
        ends = np.concatenate([[0], np.cumsum(self.digits_size[ids])])
        text[ends[1:] - 1] = sign
        return text, ends[cuts_a + cuts_b], a[last_a] * len(self.bytes_b) + b[last_b], np.searchsorted(last_a, cuts_a)

    def _bytes(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens one behind the other."""
        n = sizes[ids]
        return flat[np.repeat(begins[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _given_back(self, raws: list[bytes], a: list[np.ndarray], b: list[np.ndarray]) -> list[bool]:
        """Of each text, whether both vocabularies' tokens are its bytes."""
        good = [int(self.size_a[x].sum()) == int(self.size_b[y].sum()) == len(r) for r, x, y in zip(raws, a, b)]
        kept = [n for n, g in enumerate(good) if g]
        if kept:
            whole = np.frombuffer(b"".join(raws[n] for n in kept), np.uint8)
            begins = np.cumsum([0, *(len(raws[n]) for n in kept)])
            for ids, flat, at, sizes in ((a, self.flat_a, self.begins_a, self.size_a), (b, self.flat_b, self.begins_b, self.size_b)):
                other = np.flatnonzero(self._bytes(flat, at, sizes, np.concatenate([ids[n] for n in kept])) != whole)
                for n in np.unique(np.searchsorted(begins, other, side="right") - 1).tolist():
                    good[kept[n]] = False
        return good

    def _alike(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of each kind, kind of each window) of the windows between cuts: windows are of one kind if their ids are equal.

        Windows are grouped by a hash of their ids and then compared with the first of their group; those that differ from
        it, which a hash of 64 bits makes all but impossible, are kinds of their own.
        """
        hashes = np.zeros(len(cuts_a) - 1, np.uint64)
        for ids, cuts in ((a, cuts_a), (b, cuts_b)):
            power = np.cumprod(np.full(len(ids), _FACTOR))
            back = np.cumprod(np.full(len(ids) + 1, _INVERSE))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids + np.uint64(1)) * power)])
            part = (total[cuts[1:]] - total[cuts[:-1]]) * back[cuts[:-1]]
            hashes = (hashes ^ (hashes >> np.uint64(29))) * _FACTOR + part + np.diff(cuts).astype(np.uint64)
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        differs = np.zeros(len(hashes), bool)
        for ids, cuts in ((a, cuts_a), (b, cuts_b)):
            n, like = np.diff(cuts), first[kind]
            differs |= n != n[like]
            here = np.where(differs, 0, n)
            at = np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
            unequal = ids[np.repeat(cuts[:-1], here) + at] != ids[np.repeat(cuts[:-1][like], here) + at]
            differs[np.repeat(np.arange(len(n)), here)[unequal]] = True
        odd = np.flatnonzero(differs)
        kind[odd] = len(first) + np.arange(len(odd))
        return np.concatenate([first, odd]), kind

    def rows(self, texts: list[str]) -> list[tuple[int, int, bytes, np.ndarray]]:
        """(ids of A, ids of B, groups as text, keys of the linked pairs) of each text; nothing where there are no tokens."""
        found: list[tuple[int, int, bytes, np.ndarray]] = [(0, 0, b"", np.zeros(0, np.int64))] * len(texts)
        asked = [n for n, t in enumerate(texts) if t]
        raws = [b" " + texts[n].encode() for n in asked]
        all_a = [np.frombuffer(self.a.encode_plain(" " + texts[n]), "<u4").astype(np.int64) for n in asked]
        all_b = [np.array(self.b.encode(texts[n]), np.int64) for n in asked]
        kept = [k for k, good in enumerate(self._given_back(raws, all_a, all_b)) if good]
        if not kept:
            return found
        a, b = np.concatenate([all_a[k] for k in kept]), np.concatenate([all_b[k] for k in kept])
        # both sides' tokens cover the same bytes, so places of one text are places of all texts behind each other; a text's first tokens begin with its space
        begin_a, begin_b = (np.cumsum(n) - n for n in (self.size_a[a], self.size_b[b]))
        marked_a, marked_b = np.flatnonzero(self.space_a[a]), np.flatnonzero(self.space_b[b])
        anchors, at_a, at_b = np.intersect1d(begin_a[marked_a], begin_b[marked_b], assume_unique=True, return_indices=True)
        cuts_a, cuts_b = np.append(marked_a[at_a], len(a)), np.append(marked_b[at_b], len(b))
        first, kind = self._alike(a.astype(np.uint64), b.astype(np.uint64), cuts_a, cuts_b)
        # each distinct window is aligned once, and every window takes its kind's alignment
        kind_a, own_a = _taken(a, cuts_a, first)
        kind_b, own_b = _taken(b, cuts_b, first)
        text, text_cuts, keys, key_cuts = self.windows(kind_a, kind_b, own_a, own_b)
        written, ends = _taken(text, text_cuts, kind)
        links, link_ends = _taken(keys, key_cuts, kind)
        begins = np.cumsum([0, *(len(raws[k]) for k in kept)])
        bounds = np.searchsorted(anchors, begins)
        for n, k in enumerate(kept):
            i, j = bounds[n], bounds[n + 1]
            # the last group's semicolon stands between windows only
            found[asked[k]] = (len(all_a[k]), len(all_b[k]), written[ends[i] : ends[j] - 1].tobytes(), links[link_ends[i] : link_ends[j]])
        return found


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


FIELDS = "doc_id bigint, n_a bigint, n_b bigint, groups_sha256 string, links array<int>"


def groups(docs: DataFrame, path_a: str, path_b: str, written: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, groups_sha256, links array<int>, groups string) of every text, one row for each row of docs.

    groups lists ids as `a1,a2|b1;a3|b2,b3`, left out unless `written`; links numbers the linked pairs of ids in order.
    Null and empty texts, and those that a vocabulary's tokens don't give back byte for byte, have no tokens.
    """

    def table(work: Aligner, ids: list, rows: list[tuple]) -> pa.RecordBatch:
        n_a, n_b, texts, digests, links = zip(*rows)
        ends = pa.array(np.cumsum([0, *map(len, links)]).astype(np.int32))
        listed = pa.ListArray.from_arrays(ends, pa.array(work.numbers(np.concatenate(links))))
        columns = {"doc_id": pa.array(ids, pa.int64()), "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()), "groups_sha256": pa.array(digests, pa.string()), "links": listed}
        return pa.RecordBatch.from_pydict(columns | ({"groups": pa.array(texts, pa.string())} if written else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        for batch in batches:
            ends = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).cumsum()
            cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), len(ends)] if len(ends) else [0]
            for a, b in zip(cuts, cuts[1:]):
                rows = [(*r[:2], r[2].decode() if written else None, hashlib.sha256(r[2]).hexdigest() if r[2] else "", r[3]) for r in work.rows(batch.column("text").slice(a, b - a).to_pylist())]
                yield table(work, batch.column("doc_id").slice(a, b - a).to_pylist(), rows)

    return map_arrow(text_rows(docs), run, FIELDS + (", groups string" if written else ""))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(link, n): how many links of all documents hold the pair. Partial counts are made before the shuffle, at most one row a pair and task."""
    return linked.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text.

    A pair's count is taken over all rows of docs, repeated ones included. n_best counts the links whose pair has the
    highest count of its B id, ties included.
    """
    spark = docs.sparkSession
    linked = materialise(groups(docs, path_a, path_b, written=False))
    work = aligner(path_a, path_b)
    count = np.zeros(len(work.pairs), np.int64)
    # at most one row for each numbered pair, whatever the corpus
    counted = pair_counts(linked).toArrow()
    count[counted.column("link").to_numpy()] = counted.column("n").to_numpy()
    of = work.b_of()
    highest = np.zeros(len(work.bytes_b), np.int64)
    np.maximum.at(highest, of, count)
    shared = spark.sparkContext.broadcast((count, count == highest[of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            links = batch.column("links")
            flat = links.flatten().to_numpy(zero_copy_only=False)
            ends = links.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            totals = [np.concatenate([[0], np.cumsum(x[flat], dtype=np.int64)]) for x in (best, counts)]
            n = pa.array(ends - begins, pa.int64())
            columns = [*(batch.column(c) for c in ("doc_id", "n_a", "n_b")), n, n, *(pa.array(t[ends] - t[begins], pa.int64()) for t in totals), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return map_arrow(linked.select("doc_id", "n_a", "n_b", "groups_sha256", "links"), run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
