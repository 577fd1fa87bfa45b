"""MinHash near-duplicates through an LSH forest.

Method. The sketch of a text is 128 bytes, each from the smallest hash of its shingles under one
function. Every tree of the forest is one sorted order of all sketches, each rotated so that the
tree's own bytes come first. Texts whose rotated sketches share a prefix of at least ``least_depth``
bytes are candidates; where more than ``REGION`` texts share it, the region's depth grows until it
is small, so dense regions are compared among their longest common prefixes. Inside a region the sketches are
compared as a whole, and what looks similar is joined to clusters. In a cluster the links are confirmed on full shingle sets.

Scale. Texts with one and the same shingle set are one class from the start (one row by grouping), so copies cost
nothing. The orders are range-partitioned by tree, sketch and a hash of the id: no prefix, however common, is
one task, and a crowd of equal sketches is cut at another place in every tree. Regions and clusters send
star edges, never pairs. Only texts of clusters are read again; a large cluster is split
into tiles of bounded bytes, and every two tiles meet.

A link is missed if its two texts share no region in any tree, or if fewer than ``least_agreeing`` bytes of their sketches agree. Both
bounds depend on the wanted likeness, of 0.52 or more: at exactly that likeness each loses at most ``LOSS`` (1 in 100,000) of the links by the binomial
distribution, and only where no other path joins the texts. Where a region is split by longer prefixes, more pairs share none.

Rows. Null texts and texts without words have no shingles and link with nothing. Rows with the same ``doc_id`` are one
document for links. A null ``doc_id`` takes no part: its component is null, and it is kept. Repeated rows stay; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.batches import map_arrow, release_shuffles, text_slices
from feedlake.llm.components import components
from feedlake.llm.shingles import mixed, shingle_sets
from feedlake.session import materialise

TREES = 16
TREE_BYTES = 8
MOST_DEPTH = 4
#: Texts that are compared each with each; a region of more is split by longer prefixes.
REGION = 256
#: The share of links at exactly the wanted likeness that either bound on sketches may lose.
LOSS = 1e-5
#: Bytes of text in a tile of a cluster.
TILE_BYTES = 4 << 20
#: Rows of an order in one partition.
ORDER_ROWS = 400_000

_SIZE = TREES * TREE_BYTES
_rng = np.random.default_rng(7919)
_FACTOR = _rng.integers(1, 1 << 63, _SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(1, 1 << 63, _SIZE, dtype=np.uint64)


def _agreement(percent: int) -> float:
    """The probability that a byte of two sketches agrees at this likeness, by the same smallest hash or by chance."""
    return percent / 100 + (1 - percent / 100) / 256


def least_agreeing(percent: int) -> int:
    """So many bytes of their sketches agree in all but ``LOSS`` of the pairs of this likeness."""
    p, below = _agreement(percent), 0.0
    for k in range(_SIZE + 1):
        below += math.comb(_SIZE, k) * p**k * (1 - p) ** (_SIZE - k)
        if below > LOSS:
            return k
    return _SIZE


def least_depth(percent: int) -> int:
    """The longest prefix that all but ``LOSS`` of the pairs of this likeness share in some tree; at least one byte."""
    p = _agreement(percent)
    return next((d for d in range(MOST_DEPTH, 1, -1) if (1 - p**d) ** TREES <= LOSS), 1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a nonempty set of hashes."""
    least = np.full(_SIZE, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 512):
        np.minimum(least, (shingles[low : low + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return (mixed(least) & np.uint64(255)).astype(np.uint8)


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, n_bytes, set_id, sketch``; the last two are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"))
            yield {
                "doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "n_bytes": pa.compute.binary_length(batch.column("text")).fill_null(0),
                "set_id": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], "sketch": [sketch(s).tobytes() if len(s) else None for s in sets],
            }

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, n_bytes bigint, set_id binary, sketch binary")


def _stars(same: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The components of a symmetric matrix, each as its first row and the rest."""
    open_ = np.ones(len(same), bool)
    for i in range(len(same)):
        if not open_[i]:
            continue
        reached = np.zeros(len(same), bool)
        edge = np.zeros(len(same), bool)
        edge[i] = True
        while edge.any():
            reached |= edge
            edge = same[edge].any(axis=0) & ~reached
        open_ &= ~reached
        if reached.sum() > 1:
            yield i, np.flatnonzero(reached)[1:]


def _regions(keys: np.ndarray, low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
    """Parts of the sorted ``keys[low:high]`` that share ``depth`` bytes, or as many more as make them small."""
    if depth < _SIZE:
        cuts = np.flatnonzero((keys[low + 1 : high, :depth] != keys[low : high - 1, :depth]).any(axis=1)) + low + 1
        begins, ends = np.append(low, cuts), np.append(cuts, high)
        many = np.flatnonzero(ends - begins > 1)
        for a, b in zip(begins[many].tolist(), ends[many].tolist(), strict=True):
            if b - a <= REGION:
                yield a, b
            else:
                yield from _regions(keys, a, b, depth + 1)
    else:  # equal sketches: overlapping runs
        for a in range(low, high - 1, REGION - 1):
            yield a, min(high, a + REGION)


def region_edges(classes: DataFrame, percent: int) -> DataFrame:
    """``u, v``: star edges among texts of a region with similar sketches; all of its similar texts are joined."""
    least, depth = least_agreeing(percent), least_depth(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        trees, ids = rows["tree"].to_numpy(), rows["id"].to_numpy()
        keys = np.frombuffer(b"".join(rows["key"].to_pylist()), np.uint8).reshape(-1, _SIZE)
        cuts = np.append(0, np.append(np.flatnonzero(np.diff(trees)) + 1, len(trees)))
        u, v = [], []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            for a, b in _regions(keys, int(low), int(high), depth):
                part = keys[a:b]
                for first, rest in _stars((part[:, None, :] == part[None, :, :]).sum(axis=2) >= least):
                    u += ids[a + rest].tolist()
                    v += [int(ids[a + first])] * len(rest)
        yield {"u": u, "v": v}

    n = classes.count()
    partitions = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * TREES // ORDER_ROWS))
    turned = F.expr(f"concat(substring(sketch, tree * {TREE_BYTES} + 1, {_SIZE}), substring(sketch, 1, tree * {TREE_BYTES}))")
    orders = classes.select("id", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", turned.alias("key"), F.xxhash64("id", "tree").alias("tie"), "id")
    orders = orders.repartitionByRange(partitions, "tree", "key", "tie").sortWithinPartitions("tree", "key", "tie")
    return map_arrow(orders.select("tree", "key", "id"), run, "u bigint, v bigint").distinct()


def linked_sets(sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each set is linked with, directly or not: 100 * intersection >= percent * union.

    The intersections of all pairs are counted over the sets that hold each hash; with ``apart`` (a flag for each
    set), only pairs of unlike flags.
    """
    n = len(sets)
    label = np.arange(n)
    if n < 2:
        return label
    size = np.asarray([len(s) for s in sets])
    bounds = np.append(0, np.cumsum(size))
    owner = np.repeat(label, size)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    holders, ranked = owner[order], hashes[order]
    begins = np.empty(len(order), np.int64)  # of each hash's holders, and the place of the set itself among them
    places = np.empty(len(order), np.int64)
    begins[order] = np.searchsorted(ranked, ranked)
    places[order] = np.arange(len(order))
    for i in range(1, n):
        begin = begins[bounds[i] : bounds[i + 1]]
        counts = places[bounds[i] : bounds[i + 1]] - begin  # sets before this one
        at = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
        common = np.bincount(holders[at], minlength=i)
        able = (common > 0) & (100 * common >= percent * (size[:i] + size[i] - common))
        if apart is not None:
            able &= apart[:i] != apart[i]
        if able.any():
            roots = np.append(np.unique(label[:i][able]), label[i])
            label[np.isin(label, roots)] = roots.min()
    return label


def tile_edges(texts: DataFrame, percent: int) -> DataFrame:
    """``u, v``: star edges of confirmed links among the texts of each tile (``cluster, one, two``)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = rows["id"].to_numpy()
        sets = shingle_sets(rows["text"].combine_chunks())
        crossed = rows["one"][0].as_py() != rows["two"][0].as_py()
        label = linked_sets(sets, percent, rows["slot"].to_numpy() if crossed else None)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": pa.array(ids[moved], pa.int64()), "v": pa.array(ids[label[moved]], pa.int64())})

    return texts.groupBy("cluster", "one", "two").applyInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. The component is the
    smallest ``doc_id`` that a document reaches, and that one is kept.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(sketched(docs), "minhash-sketches")
    able = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = able.groupBy("set_id").agg(F.min(F.struct("doc_id", "sketch", "n_bytes")).alias("least")).select("set_id", F.col("least.doc_id").alias("id"), "least.sketch", "least.n_bytes")
    classes = materialise(classes, "minhash-classes")
    clusters = components(region_edges(classes, percent)).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    release_shuffles(docs.sparkSession)  # of the sorted orders
    members = classes.select("set_id", "id", "n_bytes").join(clusters, "id")
    tiles = members.groupBy("cluster").agg(F.ceil(F.sum("n_bytes") / TILE_BYTES).cast("int").alias("tiles"))
    placed = materialise(members.join(tiles, "cluster").withColumn("slot", F.pmod(F.xxhash64("set_id"), F.greatest("tiles", F.lit(1))).cast("int")), "minhash-clusters")
    # all texts with the id of a class in a cluster; only those are sent on
    texts = docs.join(placed.select(F.col("id").alias("doc_id"), "id", "cluster", "slot", "tiles"), "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.greatest("tiles", F.lit(1)) - 1)).alias("other")
    spread = texts.select("id", "text", "cluster", "slot", other).select("id", "text", "cluster", "slot", F.least("slot", "other").alias("one"), F.greatest("slot", "other").alias("two"))
    links = tile_edges(spread, percent)
    same_id = able.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("doc_id")
    own = able.join(same_id, "doc_id", "left_semi").select("set_id", "doc_id").join(classes.select("set_id", "id"), "set_id")
    links = links.unionByName(own.select(F.col("doc_id").alias("u"), F.col("id").alias("v")))
    joined = components(links)
    named = classes.select("set_id", "id").join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("set_id", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


#: Links of 85 in 100 over the table ``documents``: shingles joined with themselves, components by reachability. Its work grows with the square of a crowd.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS shared
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n + m - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id
), lowest AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""
