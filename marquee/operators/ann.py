"""Approximate dense search by an inverted file with product-quantised residuals.

Vectors are L2-normalised and filed under the nearest of `n_lists` coarse centroids. A list keeps, for each vector, one
byte for each of CODES sub-vectors of what the centroid leaves over. A query meets only the lists of its `nprobe`
nearest centroids, by an equi-join; there codes give approximate scores, and the best of those are scored again with
the vectors themselves. Only codes move with the lists.

Centroids and codebooks are fitted on a bounded sample (SAMPLE vectors a list and CODE_ROWS vectors, those of smallest
hash of their id); every vector is filed. Lists of any size are split by a hash of doc_id into parts of about BLOCK rows,
and the queries of a list into blocks too, so a list that holds a third of all vectors is as many tasks as it has parts.
What tasks hold of the model is n_lists + WORDS vectors, never more than MODEL_BYTES.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators.retrieval import topk
from marquee.sources.working import importable, written

#: Vectors a list that centroids are fitted on, vectors that codebooks are fitted on, and rounds of both fits.
SAMPLE, CODE_ROWS, ROUNDS = 256, 65_536, 15
#: Sub-vectors of a code, and words of each codebook.
CODES, WORDS = 16, 256
#: Rows of a part of a list and of a block of queries.
BLOCK, QUERY_BLOCK = 4096, 256
MODEL_BYTES = 512 << 20
#: More lists than this make finding a list slower than scanning one.
MOST_LISTS = 1 << 16


@dataclass
class VectorIndex:
    """blocks(list, part, n, ids, codes) as a stored table, and the model that filed them."""

    blocks: DataFrame
    centroids: np.ndarray
    codebooks: np.ndarray


def _unit(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of length 1; a vector of zeros stays."""
    m = np.vstack(vectors.to_numpy()).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row of x the nearest row of words, the first of equals; a slice of x at a time."""
    half = (words * words).sum(1) / 2
    step = max(1, (1 << 22) // len(words))
    return np.concatenate([(x[a : a + step] @ words.T - half).argmax(1) for a in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k means of the rows of x, starting from k of them; a mean that loses all its rows keeps its place."""
    words = x[np.random.default_rng(seed).permutation(len(x))[:k]].astype(np.float64)
    for _ in range(ROUNDS):
        at = _nearest(x, words.astype(np.float32))
        n = np.bincount(at, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, at, x)
        words[n > 0] = total[n > 0] / n[n > 0, None]
    return words.astype(np.float32)


def _of_smallest_hash(vectors: DataFrame, rows: int) -> DataFrame:
    return vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_centroids(vectors: DataFrame, n_lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of SAMPLE * n_lists vectors at most, by Spark's K-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = written(_of_smallest_hash(vectors, SAMPLE * n_lists).select(array_to_vector(X.unit(F.col("embedding"))).alias("features")))
    model = KMeans(k=n_lists, maxIter=ROUNDS, seed=seed).fit(rows)
    return np.array(model.clusterCenters(), np.float32)


def fit_codebooks(vectors: DataFrame, centroids: np.ndarray, codes: int = CODES, seed: int = 7) -> np.ndarray:
    """(codes, words, size): for each sub-vector of the residuals its means, each fitted in a task of its own on at most CODE_ROWS rows."""
    size = centroids.shape[1] // codes

    def residuals(batches):
        for batch in batches:
            x = _unit(batch["embedding"])
            r = (x - centroids[_nearest(x, centroids)]).reshape(len(x), codes, size)
            yield pd.DataFrame({"code": np.tile(np.arange(codes, dtype=np.int32), len(x)), "part": [p.tobytes() for p in r.reshape(-1, size)]})

    def means(group):
        x = np.frombuffer(b"".join(group["part"].sort_values()), np.float32).reshape(-1, size)
        return pd.DataFrame({"code": group["code"].iloc[:1], "words": [_lloyd(x, min(WORDS, len(x)), seed).tobytes()]})

    parts = _of_smallest_hash(vectors, CODE_ROWS).mapInPandas(residuals, "code int, part binary")
    rows = sorted(parts.groupBy("code").applyInPandas(means, "code int, words binary").collect())
    return np.stack([np.frombuffer(r.words, np.float32).reshape(-1, size) for r in rows])


def build_ivf(vectors: DataFrame, n_lists: int | None = None, codes: int = CODES, seed: int = 7) -> VectorIndex:
    """Index of vectors(doc_id, embedding); rows without a vector are left out. n_lists: by default the root of their number, a power of two."""
    importable(vectors.sparkSession)
    known = vectors.where("embedding is not null").select("doc_id", "embedding")
    head = known.first()
    if head is None:
        return VectorIndex(known.sparkSession.createDataFrame([], "list int, part int, n int, ids binary, codes binary"), np.zeros((0, 0), np.float32), np.zeros((0, 0, 0), np.float32))
    dim = len(head["embedding"])
    if dim % codes:
        raise ValueError(f"vectors of {dim} numbers can't be cut into {codes} equal sub-vectors")
    if n_lists is None:
        n_lists = min(MOST_LISTS, 1 << round(math.log2(math.sqrt(known.count()))))
    if 4 * dim * (n_lists + WORDS) > MODEL_BYTES:
        raise ValueError(f"{n_lists} lists of {dim} numbers are more than a task may hold")
    centroids = fit_centroids(known, n_lists, seed)
    codebooks = fit_codebooks(known, centroids, codes, seed)
    size = dim // codes

    def encode(batches):
        for batch in batches:
            x = _unit(batch["embedding"])
            at = _nearest(x, centroids)
            r = (x - centroids[at]).reshape(len(x), codes, size)
            code = np.stack([_nearest(r[:, m], codebooks[m]) for m in range(codes)], 1).astype(np.uint8)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "list": at.astype(np.int32), "code": [c.tobytes() for c in code]})

    def packed(group):
        group = group.sort_values("doc_id")
        one = {"list": group["list"].iloc[0], "part": group["part"].iloc[0], "n": len(group), "ids": group["doc_id"].to_numpy(np.int64).tobytes(), "codes": b"".join(group["code"])}
        return pd.DataFrame([one])

    filed = written(known.mapInPandas(encode, "doc_id long, list int, code binary"))
    parts = filed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = filed.join(F.broadcast(parts), "list").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) AS int)")).drop("parts")
    blocks = dealt.groupBy("list", "part").applyInPandas(packed, "list int, part int, n int, ids binary, codes binary")
    return VectorIndex(written(blocks), centroids, codebooks)


def probes(queries: DataFrame, index: VectorIndex, nprobe: int) -> DataFrame:
    """(query_id, list, unit): the nprobe nearest lists of every query(query_id, embedding)."""
    centroids = index.centroids

    def near(batches):
        for batch in batches:
            x = _unit(batch["embedding"])
            score = x @ centroids.T - (centroids * centroids).sum(1) / 2
            best = np.argsort(-score, axis=1, kind="stable")[:, :nprobe]
            yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), best.shape[1]), "list": best.ravel().astype(np.int32), "unit": [v.tobytes() for v in np.repeat(x, best.shape[1], axis=0)]})

    return queries.where("embedding is not null").select("query_id", "embedding").mapInPandas(near, "query_id long, list int, unit binary")


def coarse_search(queries: DataFrame, index: VectorIndex, n: int, nprobe: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the n documents of highest approximate score in the nprobe lists of each query."""
    importable(queries.sparkSession)
    centroids, codebooks = index.centroids, index.codebooks
    if not len(centroids):
        return topk(queries.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).where("false"), n)
    codes, _, size = codebooks.shape

    def gathered(group):
        return pd.DataFrame([{"list": group["list"].iloc[0], "asked": group["query_id"].to_numpy(np.int64).tobytes(), "wanted": b"".join(group["unit"])}])

    def scored(batches):
        for batch in batches:
            for at, ids, coded, asked, wanted in zip(*(batch[c] for c in ("list", "ids", "codes", "asked", "wanted"))):
                docs, query = np.frombuffer(ids, np.int64), np.frombuffer(asked, np.int64)
                code = np.frombuffer(coded, np.uint8).reshape(len(docs), codes)
                q = np.frombuffer(wanted, np.float32).reshape(len(query), -1)
                total = np.repeat((q @ centroids[at])[:, None], len(docs), 1)
                for m in range(codes):
                    total += (q[:, m * size : (m + 1) * size] @ codebooks[m].T)[:, code[:, m]]
                best = np.argsort(-total, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"query_id": np.repeat(query, best.shape[1]), "doc_id": docs[best].ravel(), "score": np.take_along_axis(total, best, 1).ravel().astype(np.float64)})

    asked = written(probes(queries, index, nprobe))
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    dealt = asked.join(F.broadcast(parts), "list").withColumn("part", F.expr("pmod(xxhash64(query_id), parts)"))
    blocks = dealt.select("list", "part", "query_id", "unit").groupBy("list", "part").applyInPandas(gathered, "list int, asked binary, wanted binary")
    return topk(blocks.join(index.blocks, "list").mapInPandas(scored, "query_id long, doc_id long, score double"), n)


def ivf_search(queries: DataFrame, vectors: DataFrame, index: VectorIndex, k: int = 10, nprobe: int = 16, refine: int = 8) -> DataFrame:
    """Best k documents of each query by cosine among the refine * k of highest approximate score in its nprobe lists: (query_id, doc_id, score, rank)."""
    found = coarse_search(queries, index, refine * k, nprobe).select("query_id", "doc_id")
    pairs = found.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(vectors.select("doc_id", F.col("embedding").alias("v")), "doc_id")
    return topk(pairs.select("query_id", "doc_id", X.cosine(F.col("q"), F.col("v")).alias("score")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact ranking's documents that were found."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))


def recall_by_nprobe(queries: DataFrame, vectors: DataFrame, index: VectorIndex, exact: DataFrame, k: int = 10, grid: tuple[int, ...] = (1, 4, 16)) -> DataFrame:
    """(nprobe, queries, recall) against an exact ranking, whose first k documents count."""
    truth, out = written(exact.where(F.col("rank") <= k)), None
    for nprobe in grid:
        row = recall(ivf_search(queries, vectors, index, k, nprobe), truth).select(F.lit(nprobe).alias("nprobe"), "queries", "recall")
        out = row if out is None else out.unionByName(row)
    return out
