"""Resharding by minimum-cost flow.

Method. Rows belong to old shards (a hash of id and text) and within them to blocks (a hash of id, text and place in the
input). From the bytes of the old shards and the capacities of the new ones a minimum-cost flow (staying is free, moving costs its
bytes) says how many bytes go from which shard to which. Whole blocks are then chosen to carry
that flow, and last differences are evened out by moving or swapping single blocks. Only
shards that lose or gain a block are rewritten.

Scale. Only (block, bytes, rows) reaches the driver: ``OLD_SHARDS * BLOCKS`` numbers at most,
whatever the corpus. Texts are scanned once, for their size and checksum, and not shuffled. A slot
is the block's first slot plus the row's number in its block, so no shard is sorted as a whole. Blocks grow with
the corpus: of 100 TB each holds some 4 GB, and a task numbers the ids and sizes of one block.

Rows. Null text has no bytes, so size 1. Rows that agree in id and text lie in one old shard, but in as many of its blocks as
there are, so that any number of them can be parted; which of them goes where follows their place in the input, since nothing
else tells them apart. Null ids are rows like others. Equal texts are not kept together: a group of copies may
be larger than a shard.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.session import materialise

#: Shards of the layout before, and blocks of each.
OLD_SHARDS = 12
BLOCKS = 2048
#: Single moves or swaps that even out the shards at the end.
ROUNDS = 2000


def minimum_cost_flow(sizes: list[int], capacities: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one; old shard i stays where it is as new shard i.

    Successive shortest paths from what is still to be placed to free capacity. A byte that
    stays costs 0 and one that moves costs 1, and a path may take back earlier decisions.
    """
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards are too small")
    m, n = len(sizes), len(capacities)
    flow = [[0] * n for _ in range(m)]
    rest, free = list(sizes), list(capacities)
    while any(rest):
        # shortest distance to every node; old shards are 0..m-1, new ones m..m+n-1
        far = float("inf")
        distance = [0 if i < m and rest[i] else far for i in range(m + n)]
        came: list[int | None] = [None] * (m + n)
        queue = deque(i for i in range(m) if rest[i])
        while queue:
            at = queue.popleft()
            if at < m:
                steps = [(m + j, int(at != j)) for j in range(n)]
            else:
                steps = [(i, -int(i != at - m)) for i in range(m) if flow[i][at - m]]
            for to, cost in steps:
                if distance[at] + cost < distance[to]:
                    distance[to], came[to] = distance[at] + cost, at
                    queue.append(to)
        end = min((j for j in range(n) if free[j]), key=lambda j: (distance[m + j], j)) + m
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(rest[path[0]], free[end - m], *(flow[b][a - m] for a, b in zip(path, path[1:], strict=False) if a >= m))
        for a, b in zip(path, path[1:], strict=False):
            if a < m:
                flow[a][b - m] += amount
            else:
                flow[b][a - m] -= amount
        rest[path[0]] -= amount
        free[end - m] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def place_blocks(old: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The new shard of every block, given its old shard and its bytes."""
    before = int(max(old, default=0)) + 1
    sums = np.bincount(old, size, before).astype(np.int64) if len(old) else np.zeros(before, np.int64)
    flow = minimum_cost_flow(sums.tolist(), equal_capacities(int(sums.sum()), shards))
    placed = old.copy()
    for i in range(before):
        own = np.flatnonzero(old == i)
        own = own[np.argsort(-size[own], kind="stable")]
        free = np.ones(len(own), bool)
        for j in sorted(range(shards), key=lambda j: -flow[i][j]):
            if j == i or not flow[i][j]:
                continue
            wanted = flow[i][j]
            for k in np.flatnonzero(free):
                if size[own[k]] <= wanted:
                    placed[own[k]] = j
                    wanted -= int(size[own[k]])
                    free[k] = False
        if i >= shards and len(own):  # nothing can stay in a shard that is given up
            stay = own[placed[own] == i]
            placed[stay] = max(range(shards), key=lambda j: flow[i][j])
    return _evened(placed, size, shards)


def _evened(placed: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """Moves or swaps single blocks between the fullest and the emptiest shard while that helps."""
    sums = np.bincount(placed, size, shards).astype(np.int64) if len(placed) else np.zeros(shards, np.int64)
    for _ in range(ROUNDS):
        high, low = int(sums.argmax()), int(sums.argmin())
        gap = int(sums[high] - sums[low])
        if gap <= 1:
            break
        give = np.flatnonzero(placed == high)
        take = np.flatnonzero(placed == low)
        back = np.append(0, size[take])  # nothing, or a block in return
        order = np.argsort(back, kind="stable")
        at = np.searchsorted(back[order], size[give] - gap // 2)
        best = None
        for shift in (-1, 0):
            k = np.clip(at + shift, 0, len(back) - 1)
            moved = size[give] - back[order][k]
            after = np.abs(gap - 2 * moved)
            pick = int(after.argmin())
            if 0 < moved[pick] < gap and (best is None or after[pick] < best[0]):
                best = (int(after[pick]), give[pick], int(order[k[pick]]), int(moved[pick]))
        if best is None:
            break
        _, block, other, amount = best
        placed[block] = low
        if other:
            placed[take[other - 1]] = high
        sums[high] -= amount
        sums[low] += amount
    return placed


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _block(old_shards: int, blocks: int) -> Column:
    """The block of a row; it is in old shard ``block div blocks``. Equal rows are told apart by their place in the input."""
    row = (F.col("doc_id").cast("bigint"), F.crc32(_text().cast("binary")))
    old = F.pmod(F.xxhash64(*row), F.lit(old_shards))
    within = F.pmod(F.xxhash64(F.lit("block"), *row, F.monotonically_increasing_id()), F.lit(blocks))
    return (old * blocks + within).cast("int")


def measured(docs: DataFrame, old_shards: int = OLD_SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, size, text_crc32, block`` of every row."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(_text()).cast("bigint") + 1).alias("size"),
        F.crc32(_text().cast("binary")).cast("bigint").alias("text_crc32"),
        _block(old_shards, blocks).alias("block"),
    )


def block_plan(sized: DataFrame, shards: int, blocks: int = BLOCKS) -> DataFrame:
    """``block, shard, old_shard, first_slot``: one row for each block that has rows.

    ``sized`` may say in ``shard`` where a block is now.
    """
    now = F.min("shard") if "shard" in sized.columns else F.expr(f"min(block div {blocks})")
    rows = sized.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), now.alias("old")).toPandas()  # OLD_SHARDS * BLOCKS at most
    rows = rows.sort_values("block").reset_index(drop=True)
    old = rows["old"].to_numpy(np.int64)
    rows["shard"] = place_blocks(old, rows["bytes"].to_numpy(np.int64), shards).astype(np.int32)
    rows["old_shard"] = old.astype(np.int32)
    rows["first_slot"] = rows.groupby("shard")["rows"].cumsum() - rows["rows"]
    spark = sized.sparkSession
    schema = "block int, shard int, old_shard int, first_slot bigint"
    return spark.createDataFrame(rows[["block", "shard", "old_shard", "first_slot"]], schema) if len(rows) else spark.createDataFrame([], schema)


def reshard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` of every row; shard sizes in bytes are near equal."""
    sized = materialise(measured(docs), "reshard-sizes")
    plan = block_plan(sized, shards)
    in_block = Window.partitionBy("block").orderBy("doc_id", "text_crc32")
    return (
        sized.withColumn("n", F.row_number().over(in_block) - 1)
        .join(F.broadcast(plan), "block")  # one row a block
        .select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first_slot") + F.col("n")).alias("slot"))
    )


def write_layout(docs: DataFrame, path: str) -> None:
    """The old layout: the rows of ``docs``, a folder for each old shard."""
    placed = docs.withColumn("block", _block(OLD_SHARDS, BLOCKS)).withColumn("shard", F.expr(f"block div {BLOCKS}").cast("int"))
    placed.write.partitionBy("shard").parquet(path)


def rewrite(spark: SparkSession, path: str, shards: int = 16) -> list[int]:
    """Moves the blocks of a stored layout; rewrites affected shards only, and returns their numbers."""
    stored = spark.read.parquet(path)
    size = F.octet_length(_text()).cast("bigint") + 1
    plan = block_plan(stored.select("block", "shard", size.alias("size")), shards)
    moved = plan.where("shard <> old_shard").select("old_shard", "shard").distinct().collect()  # pairs of shards
    affected = sorted({x for row in moved for x in row})
    if not affected:
        return []
    rows = stored.where(F.col("shard").isin(affected)).drop("shard").join(F.broadcast(plan.select("block", "shard")), "block")
    staged = materialise(rows, "reshard-rows")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    filled = {row[0] for row in plan.select("shard").distinct().collect()}
    for shard in set(affected) - filled:  # given up: its old files would be read again
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return affected
