"""Approximate nearest neighbours in a forest of sorted hash strings.

Method. Each tree turns the direction of a vector, less the mean direction of its block, into a long string of symbols: after a random rotation of its own a
symbol is the axis with the largest coordinate, and its sign (35 bits in 64 dimensions). A tree is its strings, sorted. A query goes down to the longest prefix that it
shares with any string of a tree; then all trees go up together, one bit of prefix at a time, until the ranges that share the prefix
hold enough candidates. Those are compared by inner product in double precision. Candidates are near by angle; a vector at a wider angle than
the k-th nearest of them is among the k best only if it is longer than their k-th best score over that angle's cosine. All vectors
of such length are compared too.

Scale. Equal vectors are one entry with its smallest ids, so a vector that is everywhere costs one comparison. Vectors are
dealt by hash into blocks of ``BLOCK``, each with a forest of its own, and queries into chunks; a task holds one block and one chunk. Every
query meets every block, as its contract says, but compares about a third of it, and of vectors of unequal length the longest besides.

Recall of the 20 nearest is 0.97 on unit vectors without any structure (uniform directions in 64 dimensions), 0.93 and 0.95 where all share a
large or small common offset, and 1.0 with lengths spread log-normally, where a third to two fifths of a block are compared; 1.0 on clusters, where it is under a quarter. See the tests.

Rows. Vectors that are null, zero, or hold null or non-finite components, and null ids, take no part. Vectors of different length never meet.
Rows that agree in id and vector count once. Ties go to the smaller id. An inner product beyond the doubles is infinite. An empty table has no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, SYMBOLS = 64, 5
#: Vectors in a block, queries in a chunk.
BLOCK, CHUNK = 8192, 4096
#: Candidates (counted once for each tree) at which the ascent stops.
CANDIDATES = 2560
#: Lengths that differ by less than this share are equal.
ROUNDING = 1e-6


def rotations(dimensions: int) -> np.ndarray:
    """One random rotation for each symbol of each tree; the same everywhere."""
    rng = np.random.default_rng(dimensions)
    return np.stack([np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0] for _ in range(TREES * SYMBOLS)]).astype(np.float32)


def directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1, however small or large their components are."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def hash_strings(vectors: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, int]:
    """(tree, vector) strings as integers, most significant symbol first, and their length in bits."""
    width = max(1, math.ceil(math.log2(2 * vectors.shape[1])))
    out = np.zeros((TREES, len(vectors)), np.int64)
    for k, turn in enumerate(turns):
        turned = vectors @ turn
        axis = np.abs(turned).argmax(axis=1)
        sign = turned[np.arange(len(vectors)), axis] > 0
        out[k // SYMBOLS] = out[k // SYMBOLS] << width | axis * 2 + sign
    return out, width * SYMBOLS


class Forest:
    """The sorted strings of some vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.longest = np.argsort(-self.norms, kind="stable")
        self.falling = -self.norms[self.longest]
        self.turns = rotations(vectors.shape[1])
        self.centre = directions(vectors).mean(axis=0)
        strings, self.bits = hash_strings(self.centred(vectors), self.turns)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """Directions from the mean direction of the block: what all its vectors share says nothing about which are near."""
        return (directions(vectors) - self.centre).astype(np.float32)

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the positions of the vectors that share the longest prefixes with it."""
        own, _ = hash_strings(self.centred(queries), self.turns)
        low = np.zeros((TREES, len(queries)), np.int64)
        high = np.zeros((TREES, len(queries)), np.int64)
        active = np.arange(len(queries))
        for dropped in range(self.bits + 1):  # bits that the prefix does without
            for t in range(TREES):
                prefix = own[t, active] >> dropped << dropped
                low[t, active] = np.searchsorted(self.strings[t], prefix)
                high[t, active] = np.searchsorted(self.strings[t], prefix + (1 << dropped))
            held = (high[:, active] - low[:, active]).sum(axis=0)
            active = active[held < enough]
            if not len(active):
                break
        for i in range(len(queries)):
            yield np.unique(np.concatenate([self.order[t, low[t, i] : high[t, i]] for t in range(TREES)]))

    def longer(self, found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Positions of the vectors that could be among the k best at a wider angle than the k-th narrowest of ``found``."""
        if len(found) < k:
            return self.longest
        cosine = np.partition(score / self.norms[found], len(found) - k)[len(found) - k]  # times the query's length
        if cosine <= 0:
            return self.longest
        least = np.partition(score, len(found) - k)[len(found) - k] / cosine
        return self.longest[: np.searchsorted(self.falling, -least * (1 + ROUNDING))]

    def nearest(self, queries: np.ndarray, k: int, ids: np.ndarray):
        """Positions and scores of the k best candidates of each query, best first, ties to the smaller id."""
        for query, found in zip(queries, self.candidates(queries, CANDIDATES), strict=True):
            score = self.vectors[found] @ query
            longer = self.longer(found, score, k)
            if len(longer):
                found = np.union1d(found, longer)
                score = self.vectors[found] @ query
            if len(found) > k:
                best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                found, score = found[best], score[best]
            order = np.lexsort((ids[found], -score))[:k]
            yield found[order], score[order]


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part, once each."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('inf')) AND exists(embedding, x -> x <> 0)"
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite}").distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` the k vectors of largest inner product, its own rows left out."""
    vectors, queries = usable(vectors), usable(queries)
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    members = vectors.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    members = members.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))  # k + 1 ids at most
    distinct = members.select(F.element_at("members", 1).alias("id"), "embedding", "members")
    counts = distinct.count(), queries.count()
    blocks, chunks = max(1, -(-counts[0] // BLOCK)), max(1, -(-counts[1] // CHUNK))

    def dealt(rows: DataFrame, own: str, parts: int, other: str, copies: int, query: bool) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return rows.select("id", "embedding", F.size("embedding").alias("width"), "block", "chunk", F.lit(query).alias("query"))

    base = dealt(distinct.select("id", "embedding"), "block", blocks, "chunk", chunks, False)
    asked = dealt(queries.select(F.col("vec_id").alias("id"), "embedding"), "chunk", chunks, "block", blocks, True)
    schema = "query_id bigint, id bigint, score double"

    def search(rows: pa.Table) -> pa.Table:
        is_query = rows["query"].to_numpy()
        query_ids, ids, scores = [], [], []
        if is_query.any() and not is_query.all():
            data, all_ids = _matrix(rows["embedding"]), rows["id"].to_numpy()
            own = all_ids[~is_query]
            forest = Forest(data[~is_query])
            for query_id, (found, score) in zip(all_ids[is_query].tolist(), forest.nearest(data[is_query], k + 1, own), strict=True):
                query_ids += [query_id] * len(found)
                ids += own[found].tolist()
                scores += score.tolist()
        return pa.table({"query_id": pa.array(query_ids, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    found = base.unionByName(asked).groupBy("width", "block", "chunk").applyInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    listed = found.join(distinct.select("id", "members"), "id").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
