"""Document fingerprints: one-permutation MinHash with optimal densification.

Method. Every shingle of a text (five words) is hashed once; the upper bits of the hash name one of ``BINS`` bins, which keeps its
smallest hash. An empty bin takes the value of the first filled one along its own fixed pseudo-random walk over the bins. The
lowest ``BITS`` bits of each value are packed. Unequal values agree in these bits by chance once in
2**``BITS``; likeness is corrected for that.

Scale. Fingerprints need one pass over the texts. For a text's successor the ids alone are brought in order first, in ranges; then every text is sent
once to its range, and the first one of a range also to the range before. No window over all rows, and nothing but the
ranges' borders reaches the driver.

Rows. Null texts are empty. A text without words has the fingerprint "", like itself (1) and like no other (0). Documents come in
descending ``doc_id``, null last, rows of one id by the checksum of their text; the last one's successor is the first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.batches import append_columns, map_arrow, text_slices
from feedlake.llm.shingles import mixed, shingle_sets
from feedlake.session import materialise

BINS, BITS = 512, 4
#: Bytes of text in a range.
RANGE_BYTES = 16 << 20
_LOWEST = -(1 << 63)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_TRIES = 4096
_WALK = (mixed(np.arange(_TRIES * BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT).astype(np.int16).reshape(_TRIES, BINS)


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """``values`` with every empty bin filled from the first filled bin of its walk."""
    empty = np.flatnonzero(~filled)
    out = values.copy()
    low = 0
    while len(empty) and low < _TRIES:
        hits = filled[_WALK[low : low + 64, empty]]
        found = hits.any(axis=0)
        at = empty[found]
        out[at] = values[_WALK[low + hits[:, found].argmax(axis=0), at]]
        empty = empty[~found]
        low += 64
    out[empty] = values[filled.argmax()]
    return out


def fingerprint(shingles: np.ndarray) -> str:
    """Packed low bits of all bins for a sorted set of hashes, as base64."""
    if not len(shingles):
        return ""
    bins = (shingles >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]] = shingles[first]
    filled[bins[first]] = True
    bits = (mixed(densified(values, filled)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return base64.b64encode((bits[0::2] << 4 | bits[1::2]).tobytes()).decode()


def likeness(one: str, two: str) -> float:
    """Estimated share of common shingles, 0 to 1."""
    if not one or not two:
        return float(one == two)
    a, b = (np.frombuffer(base64.b64decode(x), np.uint8) for x in (one, two))
    differing = a ^ b
    agree = ((differing >> 4) == 0).sum() + ((differing & 15) == 0).sum()
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (agree / BINS - chance) / (1 - chance))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` of its whole ``text``."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"fingerprint": [fingerprint(s) for s in shingle_sets(batch.column(batch.schema.get_field_index("text")))]}

    return append_columns(docs, run, "fingerprint string")


def edited(text: str, successor: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``successor``."""
    third = len(text) // 3
    return text[: len(text) - third] + successor[:third]


def _ranges(keyed: DataFrame, count: int) -> list[tuple[int, int]]:
    """The first key of each of ``count`` ranges at most, in the order of the documents."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                yield {"part": [TaskContext.get().partitionId()], "ord": batch.column("ord")[:1], "crc": batch.column("crc")[:1]}
                return

    order = [F.desc("ord"), F.asc("crc")]
    ranged = keyed.select("ord", "crc").repartitionByRange(count, *order).sortWithinPartitions(*order)
    heads = map_arrow(ranged, first, "part int, ord bigint, crc bigint").collect()  # one row a range
    return [(r["ord"], r["crc"]) for r in sorted(heads, key=lambda r: r["part"])]


def with_successor(docs: DataFrame) -> DataFrame:
    """``doc_id, text, successor`` (the next text), sorted in ranges."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("ord"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))
    spark = docs.sparkSession
    keys = materialise(keyed.select("ord", "crc", F.octet_length("text").alias("n")), "fingerprint-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    heads = _ranges(keys, count)
    # ascending pairs (-ord, crc), as the documents are sorted; ~ord is -ord - 1 without overflow
    ids, sums = np.asarray([~h[0] for h in heads], np.int64), np.asarray([h[1] for h in heads], np.int64)
    pairs = np.rec.fromarrays([ids, sums], names="a,b") if heads else None

    @F.pandas_udf("array<int>")
    def place(ord_: pd.Series, crc: pd.Series) -> pd.Series:
        own = np.rec.fromarrays([~ord_.to_numpy(np.int64), crc.to_numpy(np.int64)], names="a,b")
        at = np.searchsorted(pairs, own, side="right") - 1
        head = (ids[at] == own["a"]) & (sums[at] == own["b"])
        # the first of a range also follows the last one of the range before
        return pd.Series([[i, (i - 1) % len(ids)] if h else [i] for i, h in zip(at.tolist(), head.tolist(), strict=True)])

    if not heads:
        return docs.select("doc_id", "text", F.lit("").alias("successor")).limit(0)
    spread = keyed.withColumn("places", place("ord", "crc")).select("doc_id", "ord", "crc", "text", F.posexplode("places").alias("extra", "place"))
    dealt = spread.repartitionById(count, F.col("place")).sortWithinPartitions("place", "extra", F.desc("ord"), "crc")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        for batch in text_slices(batches):
            rows = held + list(zip(*(batch.column(n).to_pylist() for n in ("place", "extra", "doc_id", "text")), strict=True))
            done = [(a[2], a[3], b[3]) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1]]
            held = rows[-1:]
            yield {n: [d[i] for d in done] for i, n in enumerate(("doc_id", "text", "successor"))}
        if held and not held[0][1]:
            raise ValueError("a range lacks the first document of the next one")

    return map_arrow(dealt.select("place", "extra", "doc_id", "text"), pair, "doc_id bigint, text string, successor string")


def compared(docs: DataFrame) -> DataFrame:
    """Each text, its edited form and its successor, by their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            texts, following = batch.column("text").to_pylist(), batch.column("successor").to_pylist()
            changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
            own, other, nexts = ([fingerprint(s) for s in shingle_sets(pa.array(x, pa.string()))] for x in (texts, changed, following[-1:]))
            nexts = own[1:] + nexts if following[:-1] == texts[1:] else [fingerprint(s) for s in shingle_sets(batch.column("successor"))]
            yield {
                "doc_id": batch.column("doc_id"), "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": own, "edited_fingerprint": other,
                "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=True)], "near_next": [likeness(a, b) for a, b in zip(own, nexts, strict=True)],
            }

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(with_successor(docs), run, schema)
