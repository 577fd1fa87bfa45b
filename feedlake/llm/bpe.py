"""BPE encoding over a table of distinct words, and decoding through the id-to-piece table.

Method. Texts are split into words inside Spark tasks. A task gathers chunks of texts and keeps
for each chunk its distinct words and the texts as positions in that list. The words of all
chunks are dealt by their hash, so each distinct word of the corpus meets itself in one
partition and is encoded there once. The ids return to their chunk and are put back by position.
Decoding joins ids with the vocabulary's piece table (its size is that of the vocabulary file,
never of the corpus) and joins the pieces.

Scale. Texts are read once; what is shuffled are packed positions (about a third of the text's
bytes) and each chunk's distinct words, once there and once back. A word that is in every text is
one entry a chunk. Chunks are bounded in bytes, so nothing depends on how words are spread. The parts into which words are
dealt, hence the tasks that encode, follow the session's shuffle partitions.

Rows. Null text counts as empty: no ids, and the decoded text is empty. Rows are kept one to one, with
their ``doc_id`` (null and repeated ones too); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.batches import map_arrow, text_slices
from feedlake.llm.words import encoder, pieces, ragged_take, split_texts
from feedlake.session import materialise

#: Bytes of text whose distinct words are gathered before they are sent.
CHUNK_BYTES = 48 << 20
#: Parts into which the words of a chunk are dealt by hash, at least; more where the session shuffles into over four times as many.
BUCKETS = 64
#: Distinct words that a task remembers; beyond it starts afresh, and encodes a word that comes again anew.
REMEMBERED = 500_000

#: Positions from here on are kept apart.
_LARGE = 250

_CHUNKS = "chunk string, bucket int, doc_ids array<bigint>, bounds array<int>, codes binary, at binary, words binary, sizes binary"
_IDS = "chunk string, at binary, ids binary, counts binary"


def _packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 9)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packed_codes(codes: np.ndarray) -> bytes:
    """Positions in a list that begins with the most frequent: one byte each, and the larger ones apart."""
    low = zstandard.compress(np.minimum(codes, _LARGE).astype(np.uint8).tobytes(), 9)
    return len(low).to_bytes(4, "little") + low + _packed(codes[codes >= _LARGE])


def _unpacked_codes(data: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    codes = np.frombuffer(zstandard.decompress(data[4:cut]), np.uint8).astype(np.uint32)
    codes[codes == _LARGE] = _unpacked(data[cut:])
    return codes


def bucket_count(spark: SparkSession) -> int:
    """Buckets follow the width of the session's shuffles, which follows the cluster: a fourth of it, so that a chunk's parts stay few."""
    return max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def chunked(docs: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of two kinds: some texts of a chunk as positions, and a part of the chunk's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        special = encoder(path).special_text
        task, number = TaskContext.get().partitionId(), 0
        place: dict[str, int] = {}
        held: list[tuple] = []
        held_bytes = 0

        def chunk() -> Iterator[dict]:
            name = [f"{task}-{number}"]
            counts = np.zeros(len(place), np.int64)
            for _, _, codes in held:
                counts += np.bincount(codes, minlength=len(place))
            by_count = np.argsort(-counts, kind="stable")
            rank = np.empty(len(place), np.uint32)
            rank[by_count] = np.arange(len(place))
            for doc_ids, bounds, codes in held:
                yield {
                    "chunk": name, "bucket": [None], "doc_ids": [doc_ids], "bounds": [bounds],
                    "codes": [_packed_codes(rank[codes])], "at": [None], "words": [None], "sizes": [None],
                }
            listed = list(place)
            listed = [listed[i].encode() for i in by_count]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int64, len(listed))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    raw = [listed[i] for i in at]
                    yield {
                        "chunk": name, "bucket": [b], "doc_ids": [None], "bounds": [None], "codes": [None],
                        "at": [_packed(np.diff(at, prepend=0))], "words": [zstandard.compress(b"".join(raw), 9)],
                        "sizes": [_packed(np.fromiter(map(len, raw), np.int64, len(raw)))],
                    }

        for batch in text_slices(batches):
            texts = batch.column("text")
            split = split_texts(texts.to_pylist(), special)
            local = np.fromiter((place.setdefault(w, len(place)) for w in split.words.to_pylist()), np.int32, len(split.words))
            held.append((batch.column("doc_id").to_pylist(), split.bounds, local[split.codes]))
            held_bytes += texts.nbytes
            if held_bytes >= CHUNK_BYTES:
                yield from chunk()
                place, held, held_bytes, number = {}, [], 0, number + 1
        if held:
            yield from chunk()

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _CHUNKS)


def encoded_words(chunks: DataFrame, path: str, partitions: int) -> DataFrame:
    """The ids of every chunk's words; equal words meet in one partition, where each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[bytes, np.ndarray] = {}
        one = encoder(path)
        for batch in batches:
            for row in batch.to_pylist():
                data, ends = zstandard.decompress(row["words"]), np.cumsum(_unpacked(row["sizes"]).astype(np.int64))
                listed = [data[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
                if len(known) > REMEMBERED:
                    known = {}
                fresh = [w for w in dict.fromkeys(listed) if w not in known]
                known.update(zip(fresh, one.encode([w.decode() for w in fresh]), strict=True))
                ids = [known[w] for w in listed]
                yield {
                    "chunk": [row["chunk"]], "at": [row["at"]],
                    "ids": [_packed(np.fromiter((i for x in ids for i in x), np.int64))],
                    "counts": [_packed(np.fromiter(map(len, ids), np.int64, len(ids)))],
                }

    rows = chunks.where("bucket IS NOT NULL").select("chunk", "bucket", "at", "words", "sizes")
    return map_arrow(rows.repartition(partitions, "bucket"), run, _IDS)


class Pieces:
    """The id-to-piece table as flat arrays."""

    def __init__(self, path: str):
        rows = pieces(path)
        sizes = np.zeros(rows[-1][0] + 1, np.int64)
        for i, piece in rows:
            sizes[i] = len(piece)
        self.starts = np.append(0, np.cumsum(sizes))
        self.data = np.frombuffer(b"".join(p for _, p in rows), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The pieces of ``ids`` end to end."""
        return ragged_take(self.data, self.starts, ids)[0].tobytes()


def decoded_text(data: bytes) -> str:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return data.decode("utf-8", errors="replace")


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """``doc_id`` and the ids of its ``text``, one row for each row of ``docs``.

    With ``digest`` the ids are not returned but summed up: ``n_tokens``, ``ids_sha256`` over the
    ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` over the decoded text.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    chunks = materialise(chunked(docs, path, buckets), "bpe-chunks")
    partitions = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = encoded_words(chunks, path, partitions)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string("doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"))
    arrow = to_arrow_schema(parsed)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = right.select(["at", "ids", "counts"]).to_pylist()
        places = [np.cumsum(_unpacked(p["at"]).astype(np.int64)) for p in parts]
        counts = [_unpacked(p["counts"]).astype(np.int64) for p in parts]
        flat = np.concatenate([_unpacked(p["ids"]) for p in parts]) if parts else np.zeros(0, np.uint32)
        n = sum(map(len, places))
        sizes, begins = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at, count, base in zip(places, counts, np.append(0, np.cumsum([c.sum() for c in counts])), strict=False):
            sizes[at] = count
            begins[at] = base + np.cumsum(count) - count
        order = np.argsort(begins, kind="stable")
        starts = np.append(begins[order], len(flat))  # ragged rows in the order in which they lie
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        table = Pieces(path) if digest else None
        out: dict[str, list] = {f.name: [] for f in arrow}
        for group in left.select(["doc_ids", "bounds", "codes"]).to_pylist():
            codes = row[_unpacked_codes(group["codes"])]
            bounds = group["bounds"]
            for doc_id, low, high in zip(group["doc_ids"], bounds[:-1], bounds[1:], strict=True):
                found = ragged_take(flat, starts, codes[low:high])[0].astype("<u4")
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(found))
                if digest:
                    out["ids_sha256"].append(hashlib.sha256(found.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded_text(table.join(found)).encode()).hexdigest())
                else:
                    out["ids"].append(found.astype(np.int32))
        return pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    texts = chunks.where("bucket IS NULL").select("chunk", "doc_ids", "bounds", "codes")
    return texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(assemble, parsed)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` of its ``ids`` (null: empty), by a join of each id with its piece.

    Raises for an id that the vocabulary does not have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = Pieces(path)
        for batch in batches:
            ids = [np.asarray(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "text": [decoded_text(table.join(x)) for x in ids]}

    return map_arrow(encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids"), run, "doc_id bigint, text string")
