"""SimHash near-duplicates through pivot distance tables.

Method. A fingerprint has 64 bits, each the majority of that bit over the hashes of all word shingles. For every
distinct fingerprint the Hamming distances to many reference fingerprints are computed. By the triangle inequality
two fingerprints within ``NEAR`` bits differ by at most ``NEAR`` in each of these coordinates, so a
pair is discarded by its largest coordinate difference, and only survivors are verified bit by bit.

Which pairs are looked at at all also follows from the table. The references come in families: a random one, and
the same one turned over in one quarter of its bits. Half the difference of the two distances is the distance within that
quarter. Three differing bits leave one of four quarters untouched, so two linked fingerprints agree in all quarter distances of at
least one quarter: rows are dealt by (quarter, those distances), an equi-grouping without loss. Quarter distances to twelve references
tell nearly all contents of 16 bits apart.

Scale. Equal fingerprints are one class from the start, so copies cost nothing. A bucket of over ``BUCKET`` rows is dealt again in the same way by
fourths of the other 48 bits; what is still larger is cut into tiles of that many rows, and every two tiles meet. No task holds a
bucket of unbounded size, only sorted runs stream through it. Buckets send star edges of their components, never all pairs.

Rows. Null texts, and texts without words, have fingerprint zero, which links like any other. Rows of the same ``doc_id`` are one document for
links. A row without ``doc_id`` links others, and gets the smallest ``doc_id`` it reaches (null if none). Repeated rows stay; other columns are not
looked at; empty tables give empty results. A text is hashed in pieces cut at white space, so its length is no bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.batches import map_arrow, text_slices
from feedlake.llm.components import components
from feedlake.session import materialise

WORDS = 3
SEED = 42
#: Differing bits up to which fingerprints are linked; the buckets rest on 3.
NEAR = 3
#: Random reference fingerprints; each comes with 4 + 16 turned-over ones.
REFERENCES = 12
#: Rows compared in one bucket.
BUCKET = 4096
#: Bytes of a text hashed in one piece, and rows of buckets compared in one step.
PIECE_BYTES = 1 << 20
STEP_ROWS = 1 << 18

_BITS = 64
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_REFERENCE = np.random.default_rng(64).integers(0, 1 << 63, REFERENCES, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, REFERENCES, dtype=np.uint64)


def _mask(bits: range | list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


#: The four quarters, and for each quarter the fourths of all other bits.
QUARTERS = [_mask(range(16 * q, 16 * q + 16)) for q in range(4)]
_OTHERS = [[b for b in range(_BITS) if b // 16 != q] for q in range(4)]
FOURTHS = [[_mask(others[12 * k : 12 * k + 12]) for k in range(4)] for others in _OTHERS]


def shingle_hashes(data: bytes) -> Iterator[list[int]]:
    """Hashes of the 3-word shingles, repeats included, in order; a text of fewer words has one, all its words."""
    digest, whole, carry, low = xxhash.xxh64_intdigest, False, [], 0
    while low < len(data):
        high = low + PIECE_BYTES
        if high < len(data):
            space = _SPACE.search(data, high)
            high = space.start() if space else len(data)
        words = carry + data[low:high].lower().split()  # both know ASCII only
        low = high
        if len(words) < WORDS:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.append(0, ends[:-WORDS]).tolist()
        yield [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)]
        whole, carry = True, words[1 - WORDS :]
    if carry and not whole:
        yield [digest(b" ".join(carry), SEED)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The fingerprints of some texts, as unsigned 64-bit numbers."""
    ones, total = np.zeros((len(texts), _BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[int] = []
    begins: list[int] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.asarray(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, owners, np.add.reduceat(bits, begins, axis=0, dtype=np.int64))
            np.add.at(total, owners, np.diff([*begins, len(held)]))
        held.clear(), owners.clear(), begins.clear()

    for i, text in enumerate(texts):
        for hashes in shingle_hashes((text or "").encode()):
            owners.append(i)
            begins.append(len(held))
            held += hashes
            if len(held) >= 1 << 16:
                count()
    count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a bigint) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            yield {"doc_id": batch.column("doc_id"), "fp": fingerprints(batch.column("text").to_pylist()).view(np.int64)}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def distances(fps: np.ndarray, references: np.ndarray = _REFERENCE) -> np.ndarray:
    """The table: Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(fps[:, None] ^ references).astype(np.int8)


def _within(fps: np.ndarray, table: np.ndarray, mask: np.uint64) -> np.ndarray:
    """One number for the distances within ``mask`` to all references, from distances over all bits to two references each."""
    size = int(np.bitwise_count(mask))
    inside = (table + size - distances(fps, _REFERENCE ^ mask)) // 2
    return inside.astype(np.int64) @ ((size + 1) ** np.arange(REFERENCES, dtype=np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def by_quarter(classes: DataFrame) -> DataFrame:
    """``quarter, bucket, first, fp``: every fingerprint in its bucket of each quarter; ``first`` is its first coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fps = _unsigned(batch.column("fp"))
            table = distances(fps)
            for q, mask in enumerate(QUARTERS):
                key = _within(fps, table, mask) * 4 + q  # below 4 * 17**12: no two buckets share a number
                yield {"quarter": np.full(len(fps), q), "bucket": key, "first": table[:, 0], "fp": fps.view(np.int64)}

    return map_arrow(classes.select("fp"), run, "quarter int, bucket bigint, first int, fp bigint")


def by_fourth(rows: DataFrame) -> DataFrame:
    """Rows of large buckets dealt again by the fourths of the bits outside their quarter; the shape stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            quarter = batch.column("quarter").to_numpy()
            for q in np.unique(quarter).tolist():
                part = batch.filter(pa.array(quarter == q))
                fps = _unsigned(part.column("fp"))
                table = distances(fps)
                for k, mask in enumerate(FOURTHS[q]):
                    yield {"outer": part.column("bucket"), "inner": _within(fps, table, mask) * 4 + k, "quarter": part.column("quarter"), "first": part.column("first"), "fp": part.column("fp")}

    dealt = map_arrow(rows.select("quarter", "bucket", "first", "fp"), run, "outer bigint, inner bigint, quarter int, first int, fp bigint")
    # two buckets that share a number by chance are compared together, which loses and adds nothing
    return dealt.select("quarter", F.xxhash64("outer", "inner").alias("bucket"), "first", "fp")


def _large(rows: DataFrame, name: str) -> DataFrame:
    return materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET), name)


def bounded_buckets(rows: DataFrame) -> DataFrame:
    """``bucket, first, fp`` with few rows to a bucket; any two rows of one bucket still meet in some bucket."""
    large = _large(rows, "simhash-large")
    if large.isEmpty():
        return rows.select("bucket", "first", "fp")
    small = rows.join(large, "bucket", "left_anti")
    again = materialise(by_fourth(rows.join(large, "bucket", "left_semi")), "simhash-fourths")
    tiles = F.coalesce(F.ceil(F.col("n") / BUCKET), F.lit(1)).cast("int")
    placed = again.join(_large(again, "simhash-dense"), "bucket", "left").withColumn("tiles", tiles)
    slot = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    met = placed.select("bucket", "first", "fp", slot.alias("slot"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tile = F.xxhash64("bucket", F.least("slot", "other"), F.greatest("slot", "other")).alias("bucket")
    return small.select("bucket", "first", "fp").unionByName(met.select(tile, "first", "fp"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the same components as the edges ``u, v``."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(label)))
            return nodes[moved], nodes[label[moved]]
        label = new


def compared(bucket: np.ndarray, first: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links in rows that are sorted by bucket and first coordinate."""
    table = distances(fps)
    u, v = [fps[:0]], [fps[:0]]
    found, step, active = 0, 0, np.arange(len(fps))
    while len(active):
        step += 1
        active = active[active + step < len(fps)]
        # sorted by the first coordinate: what is too far apart in it now stays so
        active = active[(bucket[active + step] == bucket[active]) & (first[active + step] - first[active] <= NEAR)]
        apart = np.abs(table[active] - table[active + step]).max(axis=1, initial=0)
        able = active[apart <= NEAR]
        able = able[np.bitwise_count(fps[able] ^ fps[able + step]) <= NEAR]
        u.append(fps[able])
        v.append(fps[able + step])
        found += len(able)
        if found > 1 << 20:
            one, two = forest(np.concatenate(u), np.concatenate(v))
            u, v, found = [one], [two], 0
    return forest(np.concatenate(u), np.concatenate(v))


def links(rows: DataFrame) -> DataFrame:
    """``u, v``: star edges of the linked fingerprints (as bigints) in every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def edges(upto: int) -> dict:
            u, v = compared(held[0][:upto], held[1][:upto], held[2][:upto].view(np.uint64))
            held[:] = [x[upto:] for x in held]
            return {"u": u.view(np.int64), "v": v.view(np.int64)}

        for batch in batches:
            held[:] = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, x in enumerate(held)]
            if len(held[0]) >= STEP_ROWS:  # all buckets but the last, which may go on
                yield edges(int(np.searchsorted(held[0], held[0][-1])))
        yield edges(len(held[0]))

    dealt = rows.select("bucket", "first", "fp").repartition("bucket").sortWithinPartitions("bucket", "first")
    return map_arrow(dealt, run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``fingerprint`` is 16 hexadecimal digits. Fingerprints of at most ``NEAR`` differing bits are linked; the component is the smallest
    ``doc_id`` that a document reaches.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(fingerprinted(docs), "simhash-rows")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    buckets = materialise(by_quarter(classes), "simhash-buckets")
    near = links(bounded_buckets(buckets))
    same_id = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    own = rows.join(same_id, "doc_id").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    joined = components(near.unionByName(own)).withColumnRenamed("node", "fp")
    rooted = classes.join(joined, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
