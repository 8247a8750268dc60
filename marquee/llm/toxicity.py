"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one on ordinary text and passages of toxic text. A
window that compresses to fewer bytes with the second resembles toxic text. A toxic document is mostly ordinary prose,
so the toxic part is trained on those of its passages whose byte strings stand in toxic documents significantly more
often than in ordinary ones (a likelihood-ratio test over all strings of GRAM bytes, each counted once for each
context, so that copies of a document don't count again). Nothing is split into words and no language is known.

A document's features are counts of windows by advantage, against what chance gives a document of its length, and the
largest advantages. A logistic curve turns them into a margin; features that it is fitted on come from dictionaries of
the other half of the rows. The score is 0.5 at the margin that at most ALLOWED of ordinary labelled rows exceed, so the
threshold doesn't depend on the share of toxic rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts, text_rows

#: Bytes of a window and from one window to the next.
WINDOW, STEP = 48, 36
#: Labelled documents of a class that the dictionaries and the curve are fitted on, at most about.
SAMPLE = 2000
#: Bytes of the ordinary dictionary, and (bytes, segment) of the toxic parts that are tried.
ORDINARY, TOXIC = 16_384, ((1024, 16), (2048, 16), (2048, 24))
#: Bytes of the strings that are compared between the classes, and of the context on each side that makes two of their places differ.
GRAM, CONTEXT = 6, 8
#: Probability of a false find among all strings, and how much more frequent in toxic text a string must be.
CHANCE, RATIO = 0.01, 4
#: Share of ordinary labelled rows that may score 0.5 or more.
ALLOWED = 0.01
#: Bytes that a window must save to count.
STEPS = (2, 4, 6, 8)
FOLDS = 5
#: Parts in which contexts are counted, a power of two.
PARTS = 16
LEVEL = 3
#: The repeat offsets that every trained dictionary has right before its content.
REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" "


def windows(text: str) -> list[bytes]:
    """Overlapping windows of the lower-cased text with single blanks; an empty text has one."""
    raw = _plain(text)
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP)]


@lru_cache(4)
def _compressors(toxic: bytes, ordinary: bytes) -> tuple:
    def one(raw: bytes):
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    return one(toxic), one(ordinary)


def advantages(parts: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Bytes that each window saves with the toxic dictionary against the ordinary one."""
    a, b = (c.compress for c in _compressors(toxic, ordinary))
    return np.fromiter((len(b(p)) - len(a(p)) for p in parts), np.float64, len(parts))


def features(saved: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """What the curve sees of a document; usual: the shares of ordinary text's windows that save as many bytes as STEPS says."""
    n = len(saved)
    top = np.zeros(3)
    top[: min(n, 3)] = np.sort(saved)[::-1][:3]
    found = np.array([np.count_nonzero(saved >= t) for t in STEPS])
    return np.concatenate([[top[0], top.sum(), np.log1p(n), np.maximum(saved, 0).mean()], (found - n * usual) / np.sqrt(n * usual + 1)])


def _dictionary(parts: list[bytes], size: int, segment: int = 0) -> bytes:
    """Content of a zstandard dictionary trained on the parts; the parts themselves where they are too few to train on."""
    try:
        trained = zstandard.train_dictionary(size, parts, **({"k": segment, "d": 6} if segment else {})).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:] or b" "
    return trained[trained.index(REPEATS) + len(REPEATS) :] or b" "


def _strings(raw: bytes) -> np.ndarray:
    """The string of GRAM bytes at each place of the text, as a number."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(len(a) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | a[k : k + n]
    return out


def _contexts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each string of the texts, and in how many different contexts it stands; contexts are told apart a part of their hashes at a time, which takes less memory."""
    sizes = [max(len(raw) - GRAM + 1, 0) for raw in raws]
    strings, places = np.zeros(sum(sizes), np.uint64), np.zeros(sum(sizes), np.uint64)
    at = 0
    for raw, n in zip(raws, sizes):
        a = np.frombuffer(bytes(CONTEXT) + raw + bytes(CONTEXT), np.uint8).astype(np.uint64) + np.uint64(1)
        strings[at : at + n] = _strings(raw)
        h = places[at : at + n]
        for k in range(GRAM + 2 * CONTEXT):
            h *= MIX
            h ^= a[k : k + n]
        at += n
    part, once = (places >> np.uint64(32)).astype(np.uint8) & PARTS - 1, []
    for k in range(PARTS):
        here = np.flatnonzero(part == k)
        once.append(strings[here[np.unique(places[here], return_index=True)[1]]])
    del strings, places, part
    return np.unique(np.concatenate(once), return_counts=True)


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([a[1], b[1]]), len(keys)).astype(np.int64)


def distinctive(bad: tuple[np.ndarray, np.ndarray], good: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The strings (sorted) that toxic text has significantly more often; bad, good: strings and their numbers of contexts."""
    keys, n = bad
    if not len(keys) or not len(good[0]):
        return np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(good[0], keys), len(good[0]) - 1)
    m = np.where(good[0][at] == keys, good[1][at], 0)
    of_bad, of_good = n.sum(), good[1].sum()
    share = of_bad / (of_bad + of_good)
    g = 2 * (n * np.log(n / ((n + m) * share)) + np.where(m > 0, m * np.log(np.maximum(m, 1) / ((n + m) * (1 - share))), 0))
    return keys[(g > 2 * np.log(len(keys) / CHANCE)) & (n / of_bad > RATIO * (m + 0.5) / of_good)]


def passages(raws: list[bytes], found: np.ndarray) -> list[bytes]:
    """The runs of the texts that distinctive strings cover, each once."""
    out: set[bytes] = set()
    for raw in raws if len(found) else []:
        own = _strings(raw)
        at = np.minimum(np.searchsorted(found, own), len(found) - 1)
        edges = np.zeros(len(raw) + 2, np.int64)
        hits = np.flatnonzero(found[at] == own)
        np.add.at(edges, hits + 1, 1)
        np.add.at(edges, hits + GRAM + 1, -1)
        turns = np.flatnonzero(np.diff((np.cumsum(edges) > 0).astype(np.int8)))
        out.update(raw[a:b] for a, b in zip(turns[::2], turns[1::2]))
    return sorted(out)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    usual: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def margin(self, saved: np.ndarray) -> float:
        x = (features(saved, np.array(self.usual)) - self.center) / self.scale
        return float(x @ np.array(self.weights) + self.bias)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(advantages(windows(text), self.toxic, self.ordinary)), -30, 30))))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of a logistic fit to weighted rows by Newton steps, and its loss."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model of labelled texts; of the toxic dictionaries tried, the one whose curve fits best. Each class weighs as
    much as the other. Without both classes, or without a string that tells them apart, every text scores the share of toxic labels, 0.49 at most."""
    y = np.array(toxic, float)
    raws = [_plain(t) for t in texts]
    # equal texts are in one half
    half = np.array([xxhash.xxh64_intdigest(r) % 2 for r in raws], int)
    of = {(c, h): sorted({r for r, b, k in zip(raws, y, half) if b == c and k == h}) for c in (0, 1) for h in (0, 1)}
    seen = {k: _contexts(v) for k, v in of.items()}
    bad, good = of[1, 0] + of[1, 1], of[0, 0] + of[0, 1]
    found = distinctive(_added(seen[1, 0], seen[1, 1]), _added(seen[0, 0], seen[0, 1]))
    if not bad or not good or not len(found):
        share = min((y.sum() + 0.5) / (len(y) + 1), 0.49) if len(y) else 0.01
        n = 4 + len(STEPS)
        return Model(b" ", b" ", (0.0,) * len(STEPS), (0.0,) * n, (1.0,) * n, (0.0,) * n, float(np.log(share / (1 - share))))
    ordinary = _dictionary([t[i : i + 256] for t in good for i in range(0, len(t), 256)], ORDINARY)
    of_half = [passages(of[1, h], distinctive(seen[1, h], seen[0, h])) for h in (0, 1)]
    whole = passages(bad, found)
    split = [windows(t) for t in texts]
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    best: tuple[float, Model] | None = None
    for size, segment in TOXIC:
        parts = [ordinary + _dictionary(p, size, segment) for p in of_half]
        saved = [advantages(w, parts[1 - h], ordinary) for w, h in zip(split, half)]
        usual_all = np.concatenate([s for s, b in zip(saved, y) if not b])
        usual = np.array([np.count_nonzero(usual_all >= t) for t in STEPS]) / len(usual_all)
        x = np.array([features(s, usual) for s in saved])
        center = np.average(x, axis=0, weights=weight)
        scale = np.sqrt(np.average((x - center) ** 2, axis=0, weights=weight)) + 1e-9
        w, loss = _curve(np.hstack([(x - center) / scale, np.ones((len(x), 1))]), y, weight)
        if best is None or loss < best[0]:
            toxic_part = ordinary + _dictionary(whole, size, segment)
            best = loss, Model(toxic_part, ordinary, *(tuple(map(float, v)) for v in (usual, center, scale, w[:-1])), 0.0)
    # ordinary rows have no part in the toxic dictionary, so all of them tell how far ordinary text gets with it
    model = best[1]
    margins = np.sort([model.margin(advantages(w, model.toxic, ordinary)) for w, b in zip(split, y) if not b])
    limit = margins[max(int(np.ceil(len(margins) * (1 - ALLOWED))) - 1, 0)]
    return replace(model, bias=-float(limit) - 1e-9)


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label may not be learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most about `sample` labelled documents of each class, drawn by a hash of doc_id, none of them held out.

    The drawn ids, at most about 2 * sample, are broadcast, so that no text is shuffled. Rows without a label, doc_id or
    text aren't learned from; a document labelled twice counts as toxic if one label says so.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~held_out())
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: sample / max(sizes.get(y, 0), sample) for y in (0, 1)}
    share = F.when(F.col("y") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text").collect()
    rows = sorted({(r["doc_id"], r["y"], r["text"]) for r in rows})
    return train([r[2] for r in rows], [r[1] for r in rows])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts are scored as one empty window."""
    return map_texts(text_rows(docs), lambda: lambda texts: [[model.score(t) for t in texts]], "score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, by a model of the labels that are not held out."""
    scored = scores(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under 0.5, unchanged; rows without a doc_id are scored like any other."""
    import pyarrow as pa

    from marquee.llm.common import map_arrow

    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [model.score(t or "") < 0.5 for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
