"""Best-two-fit packing of token sequences.

Method. Documents become pieces of at most ``size`` tokens. Sequences are filled one after the
other: greedily with the longest piece that fits, then the smallest piece of the sequence is
given back if two pieces that are still unpacked fill the gap more tightly. Since a piece counts by its length
alone, this runs over the counts of each length (``size`` numbers, whatever the corpus), with
equal sequences made in one step, and is the same as over all pieces of the corpus one by one.

Scale. Texts are encoded in one pass without a shuffle. A piece gets its rank among those of its length from a count per
task and length; rank and plan give its place. Nothing is gathered: neither the driver nor a task ever holds the
pieces of a length.

Rows. Null text counts as empty, and a document of no tokens is its end id. Only documents of more than ``size`` tokens
are cut, into pieces of ``size`` with the rest first. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.batches import map_arrow, text_slices
from feedlake.llm.words import encoder, ragged_take, split_texts
from feedlake.session import materialise

#: Distinct words whose ids a task remembers; beyond it starts afresh.
REMEMBERED = 400_000


class _Remembering:
    """Ids of texts; those of a word are kept while the task lasts."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each begins."""
        split = split_texts(texts, self.encoder.special_text)
        words = split.words.to_pylist()
        if len(self.place) > REMEMBERED:
            self.clear()
        fresh = [w for w in words if w not in self.place]
        if fresh:
            ids, starts = self.encoder.ragged(fresh)
            for w in fresh:
                self.place[w] = len(self.place)
            self.flat.append(ids)
            self.sizes.append(np.diff(starts))
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        local = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        starts = np.append(0, np.cumsum(self.sizes[0]))
        ids, sizes = ragged_take(self.flat[0], starts, local[split.codes])
        return ids, np.append(0, np.cumsum(sizes))[split.bounds]


def cut_pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """All pieces with length, checksum, and their number among those of that length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memory = _Remembering(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        end = np.asarray([end_id], np.uint32)
        for batch in text_slices(batches):
            ids, starts = memory.texts(batch.column("text").to_pylist())
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "k")}
            for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), starts[:-1], starts[1:], strict=True):
                own = np.concatenate([ids[low:high], end]).astype("<u4")
                count = -(-len(own) // size)
                at = 0
                for piece in range(count):
                    length = len(own) - size * (count - 1) if piece == 0 else size
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(own[at : at + length].tobytes()))
                    out["part"].append(part)
                    out["k"].append(seen[length])
                    seen[length] += 1
                    at += length
            yield out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, k bigint"
    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def best_two_fit(counts: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each) for ``counts[l]`` pieces of length l."""
    left = np.asarray(counts, np.int64).copy()
    plan: list[tuple[int, list[int]]] = []
    while left.any():
        free = left.copy()
        taken: list[int] = []
        gap = size
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            times = min(int(free[longest]), gap // longest)
            taken += [longest] * times
            free[longest] -= times
            gap -= longest * times
        if gap and taken:
            smallest = taken[-1]
            pair = _tightest_pair(free, gap + smallest)
            if pair and sum(pair) > smallest:
                taken[-1:] = pair
        lengths, need = np.unique(taken, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= times * need
        plan.append((times, taken))
    return plan


def _tightest_pair(free: np.ndarray, room: int) -> list[int] | None:
    """Two lengths of ``free`` pieces with the largest sum of at most ``room``."""
    have = np.flatnonzero(free[:room])
    if not len(have):
        return None
    partner = np.searchsorted(have, room - have, side="right") - 1
    # a single piece can't be its own partner: the next shorter one is
    partner -= (partner >= 0) & (have[partner] == have) & (free[have] < 2)
    total = np.where(partner >= 0, have + have[partner], -1)
    best = int(total.argmax())
    return sorted((int(have[best]), int(have[partner[best]])), reverse=True) if total[best] > 0 else None


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, plan: list[tuple[int, list[int]]], size: int):
        found: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, first sequence, copies, first offset
        rank = np.zeros(size + 1, np.int64)
        sequence = 0
        for times, lengths in plan:
            offset = 0
            ordered = sorted(lengths, reverse=True)
            for length in dict.fromkeys(ordered):
                copies = ordered.count(length)
                found.setdefault(length, []).append((int(rank[length]), sequence, copies, offset))
                rank[length] += times * copies
                offset += copies * length
            sequence += times
        self.by_length = {k: np.asarray(v, np.int64).T for k, v in found.items()}
        self.sequences = sequence

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            here = np.flatnonzero(lengths == length)
            first, base, copies, begin = self.by_length[int(length)]
            step = np.searchsorted(first, ranks[here], side="right") - 1
            inside = ranks[here] - first[step]
            sequence[here] = base[step] + inside // copies[step]
            offset[here] = begin[step] + inside % copies[step] * length
        return sequence, offset


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of ``docs`` (``doc_id``, ``text``) with its sequence and the offset in it."""
    pieces = materialise(cut_pieces(docs, path, size, end_id), "packing-pieces")
    per_task = pieces.groupBy("length", "part").agg((F.max("k") + 1).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    places = Places(best_two_fit(counts, size), size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ranks = batch.column("base").to_numpy() + batch.column("k").to_numpy()
            sequence, offset = places.of(batch.column("length").to_numpy(), ranks)
            yield {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return map_arrow(pieces.join(base, ["length", "part"]), run, schema)
