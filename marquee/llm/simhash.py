"""SimHash near-duplicates with BK-trees.

Every document gets a 64-bit SimHash of its three-word shingles. Two fingerprints that differ in at most two bits agree
on two of four 16-bit blocks at least, so equal pairs of blocks name the shards in which links can be found. Each shard
holds BK-trees (children keyed by their integer Hamming distance to the parent); a query follows only edges within the
radius. Trees are dealt by the shuffle to the task that queries them rather than broadcast, because a broadcast of all
fingerprints would grow with the corpus. A shard leaves at most one spanning edge per fingerprint and tree, never all
pairs, and components are then found across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import connected_components, map_arrow, map_texts, materialise, text_rows

RADIUS = 2
SHINGLE = 3
BLOCK_BITS = 16
#: Fingerprints in one BK-tree; larger shards are dealt out over several trees.
TREE = 4096
CHUNK = 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (both are what bytes.lower and bytes.split do)."""
    return text.encode("utf-8", "replace").lower().split()


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes (unsigned 64-bit); 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, n: int = SHINGLE) -> int:
    """SimHash over the XXH64 (seed 42) of each n-word shingle, repeats included; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n))))
    return simhash(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Distinct 64-bit values under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Place of the value in the tree."""
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                break
            at = below
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of all values at most `radius` bits away."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            stack.extend(below for edge, below in self.children[at].items() if d - radius <= edge <= d + radius)


def shard_edges(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among the members of a tree, and between them and queries from other trees of the shard."""
    tree, edges = BKTree(), []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def link(value: int) -> None:
        for at in tree.within(value, radius):
            a, b = find(value), find(tree.values[at])
            if a != b:
                root[a] = b
                edges.append((value, tree.values[at]))

    for value in members:
        link(value)
        tree.add(value)
    for value in queries:
        link(value)
    return edges


def _edges_of_runs(radius: int):
    """mapInArrow function: rows (shard, tree, query, fp) sorted by (shard, tree, query) to spanning edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        members: list[int] = []
        queries: list[int] = []
        out: list[tuple[int, int]] = []
        mask = (1 << 64) - 1

        def close() -> None:
            if len(members) + len(queries) > 1:
                out.extend((signed(a), signed(b)) for a, b in shard_edges(members, queries, radius))

        def drain() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["src", "dst"])
            out.clear()
            return batch

        for batch in batches:
            for shard, tree, query, fp in zip(*(batch.column(c).to_pylist() for c in ("shard", "tree", "query", "fp"))):
                if (shard, tree) != held:
                    close()
                    held, members, queries = (shard, tree), [], []
                (queries if query else members).append(fp & mask)
            if len(out) > 50_000:
                yield drain()
        close()
        yield drain()

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return map_texts(text_rows(docs), lambda: lambda texts: [[signed(fingerprint(t)) for t in texts]], "fp bigint")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Spanning edges (src, dst) of the graph that links values of distinct(fp) at most `radius` (0 to 2) bits apart."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree for radius 0, 1 or 2 only")
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(4)]
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], BLOCK_BITS)).bitwiseOR(block[j]) for n, (i, j) in enumerate(combinations(range(4), 2))]
    placed = distinct.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree).cast("int")
    own = F.pmod(F.xxhash64("fp"), trees).cast("int")
    dealt = (
        placed.join(sizes, "shard")
        .select("shard", "fp", own.alias("own"), F.explode(F.sequence(own, trees - 1)).alias("tree"))
        .select("shard", "tree", (F.col("tree") != F.col("own")).alias("query"), "fp")
    )
    sorted_ = dealt.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "query")
    return map_arrow(sorted_, _edges_of_runs(radius), "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links. Null and empty texts, and texts of white space only, have
    fingerprint 0 and link like any other; repeated rows give repeated results; an empty table gives an empty one.
    """
    fps = materialise(fingerprints(docs))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    groups = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id names its component; of repeated rows of that doc_id, and of rows without one, all stay."""
    gone = near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
