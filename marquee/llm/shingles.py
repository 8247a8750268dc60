"""Near-duplicate documents by SimHash and BK-trees, with the Jaccard similarity of five-word shingles as the last word.

A text's SimHash here is that of its distinct five-word shingles, so that the bits in which two texts differ follow their
Jaccard similarity: at 0.8 some 10 of 64 bits differ, 12 in the shortest texts. RADIUS is wide enough for both (a pair of
similarity 0.8 lies beyond it once in 30,000 times at most), too wide for blocks of a fingerprint to agree. So the shards
are named by 20 MinHash keys, each of five minimal hashes of the shingles: at a similarity of 0.8 all but about one pair in
3000 share one. Each shard's fingerprints are compared with its smallest first, and what is still in different components
is put into BK-trees, one for each component, which the others query within RADIUS. Links are the pairs so found whose real
similarity, computed from the texts, is 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import connected_components, map_arrow, map_texts, materialise, text_rows
from marquee.llm.simhash import TREE, BKTree, signed, simhash, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of two fingerprints up to which the trees find each other's texts.
RADIUS = 24
BANDS, ROWS = 20, 5
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 12


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of each distinct n-word shingle, sorted; a shorter text is one shingle, a text without words has none."""
    words = words_of(text)
    runs = {b" ".join(words)} if 0 < len(words) < n else set(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in runs), np.uint64, len(runs)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(text: str) -> tuple[int, int, list[int]]:
    """A name of the text's set of shingles, the SimHash of the set, and its shards."""
    h = shingles(text)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), CHUNK):
        least = np.minimum(least, (h[at : at + CHUNK, None] * FACTORS).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return signed(xxhash.xxh64_intdigest(h.tobytes())), signed(simhash(h)), [signed(xxhash.xxh64_intdigest(b.tobytes(), i)) for i, b in enumerate(bands)]


def _rows() -> Callable[[list[str]], list[list]]:
    def work(texts: list[str]) -> list[list]:
        return [list(column) for column in zip(*map(fingerprints, texts))] or [[], [], []]

    return work


def across_components(rows: list[tuple[int, int, int, bool]], radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of names within the radius in different components; rows (name, SimHash, component, query) of one tree's members and queries, members first."""
    trees: dict[int, BKTree] = {}
    named: dict[int, list[list[int]]] = {}
    for name, sim, component, query in rows:
        for other, tree in trees.items():
            if other != component:
                for at in tree.within(sim, radius):
                    yield from ((x, name) for x in named[other][at])
        if not query:
            at = trees.setdefault(component, BKTree()).add(sim)
            held = named.setdefault(component, [])
            held[at].append(name) if at < len(held) else held.append([name])


def _tree_links(members: DataFrame, radius: int, tree: int) -> DataFrame:
    """(a, b) of members(key, fp, sim, component) within the radius of each other in a shard, in different components; larger shards are dealt over several trees."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    trees = F.ceil(F.col("n") / tree).cast("int")
    own = F.pmod(F.xxhash64("fp"), trees).cast("int")
    dealt = members.join(sizes, "key").select("key", "fp", "sim", "component", own.alias("own"), F.explode(F.sequence(own, trees - 1)).alias("tree")).withColumn("query", F.col("tree") != F.col("own"))
    sorted_ = dealt.select("key", "tree", "query", "component", "fp", "sim").repartition("key", "tree").sortWithinPartitions("key", "tree", "query", "component", "fp")
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "tree", "fp", "sim", "component", "query")))

        out: list[tuple[int, int]] = []

        def drain() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out.clear()
            return batch

        for _, shard in groupby(rows(), lambda r: r[:2]):
            for a, b in across_components([(fp, sim & mask, component, query) for _, _, fp, sim, component, query in shard], radius):
                out.append((min(a, b), max(a, b)))
                if len(out) > 50_000:
                    yield drain()
        yield drain()

    return map_arrow(sorted_, run, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of the pairs(a, b) whose texts(fp, text) are similar."""
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(shingles(x), shingles(y)) >= similarity for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "x", "y"), run, "src bigint, dst bigint")


def keep_one_each(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near-duplicates; of repeated rows of that doc_id, and of rows without one, all stay."""
    rows = text_rows(docs)
    fps = materialise(map_texts(rows, _rows, "fp bigint, sim bigint, keys array<bigint>"))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("doc_id").alias("n"), F.first("sim").alias("sim"), F.first("keys").alias("keys")))
    placed = distinct.where("n > 0").select("fp", "sim", "first_doc", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("fp", "sim")).alias("head")).where("m > 1").select("key", F.col("head.fp").alias("head"), F.col("head.sim").alias("head_sim"))
    together = materialise(placed.join(shared, "key").select("key", "head", "head_sim", "fp", "sim", "first_doc"))
    wanted = together.select("fp", F.col("first_doc").alias("doc_id")).distinct()
    # an id may stand on several texts: only the one of this name counts
    held = map_texts(rows.join(wanted.select("doc_id").distinct(), "doc_id"), lambda: lambda texts: [[fingerprints(t)[0] for t in texts], texts], "fp bigint, text string")
    texts = materialise(held.join(wanted, ["doc_id", "fp"], "left_semi").select("fp", "text").dropDuplicates(["fp"]))
    # a shard's smallest is the root of its first tree, and all others are measured against it
    near = F.bit_count(F.col("sim").bitwiseXOR(F.col("head_sim"))) <= radius
    pairs = together.where(F.col("fp") != F.col("head")).where(near).select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()
    star = materialise(_verified(pairs, texts, similarity))
    groups = connected_components(star)
    now = together.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("key", "head", "fp", "sim", F.coalesce("component", "fp").alias("component"))
    mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = materialise(now.where("fp <> head").join(mixed, "key").select("key", "fp", "sim", "component"))
    groups = connected_components(star.union(_verified(_tree_links(open_, radius, tree), texts, similarity)))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_doc").alias("kept"))
    gone = fps.join(named.join(least, "component").select("fp", "kept"), "fp").where("doc_id <> kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
