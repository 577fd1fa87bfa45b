"""Quality of a text, by a convolutional network over its bytes.

Method. A text is cut into overlapping chunks that cover all of it. Each byte is a learned vector;
learned filters slide over them, and their largest answer in a chunk stands for it. The mean
and the maximum of all chunks go into one probability. Forward and backward pass are numpy.

Scale. The network is fitted on the driver, on a sample bounded by ``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` bytes, so fitting
costs the same on any corpus. It is drawn from the labels that have a document here; only ids, sizes and hashes of texts are
joined for that. Texts of more than ``TRAIN_TEXT`` bytes are left out of the fit, not of the scores. Scoring is one pass over the texts without a shuffle; a task holds some chunks at a time.

Rows. Null texts are empty, and an empty text is one chunk of padding: it has a score too. Labels are read from rows with a
``quality`` of 0 or 1; of several rows for one document all count. Without any labelled row nothing can be told,
and every score is 1, so that nothing is rejected. Fewer than ``LEAST_ROWS`` rows of a label in the sample give a warning.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.batches import append_columns, joined_bytes, thinned
from feedlake.session import materialise

CHUNK, STEP = 256, 192
WIDTH, STRIDE = 16, 4
DIMENSIONS, FILTERS = 8, 32
#: Bounds of the sample on which the network is fitted.
TRAIN_ROWS, TRAIN_BYTES = 3000, 4 << 20
#: Longer texts, in bytes, are not learned from; they are scored like all others.
TRAIN_TEXT = 256 << 10
#: With fewer rows of a label than this in the sample, a warning is given.
LEAST_ROWS = 50
EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 2000, 16, 0.01
ACCEPT = 0.7
_PAD = 256
#: Chunks in one matrix product.
_BLOCK = 512


class Chunks:
    """The chunks of several texts: byte codes, and the text of each."""

    def __init__(self, column: pa.Array):
        data, bounds = joined_bytes(column)
        self.data = np.append(data, np.zeros(1, np.uint8))
        sizes = np.diff(bounds)
        counts = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
        self.owner = np.repeat(np.arange(len(sizes)), counts)
        inside = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.begin = bounds[:-1][self.owner] + inside * STEP
        self.end = np.minimum(self.begin + CHUNK, bounds[1:][self.owner])
        self.texts = len(sizes)
        self.first = np.cumsum(counts) - counts

    def codes(self, low: int, high: int) -> np.ndarray:
        at = self.begin[low:high, None] + np.arange(CHUNK)
        beyond = at >= self.end[low:high, None]
        at[beyond] = len(self.data) - 1
        codes = self.data[at].astype(np.int32)
        codes[beyond] = _PAD
        return codes


class Network:
    """The parameters, and scores for texts."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bytes = rng.normal(0, 0.5, (_PAD + 1, DIMENSIONS)).astype(np.float32)
        self.bytes[_PAD] = 0
        self.filters = rng.normal(0, (2 / (WIDTH * DIMENSIONS)) ** 0.5, (WIDTH * DIMENSIONS, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = np.zeros(2 * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """(chunk, place, values of the window)."""
        view = np.lib.stride_tricks.sliding_window_view(self.bytes[codes].reshape(len(codes), -1), WIDTH * DIMENSIONS, axis=1)
        return view[:, :: STRIDE * DIMENSIONS]

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter in each chunk, and its place."""
        w = self.windows(codes)
        answers = np.maximum(w.reshape(-1, w.shape[2]) @ self.filters + self.shift, 0).reshape(len(codes), -1, FILTERS)
        at = answers.argmax(axis=1)
        return np.take_along_axis(answers, at[:, None], axis=1)[:, 0], at

    def features(self, chunks: Chunks) -> np.ndarray:
        """Mean and maximum over the chunks of each text."""
        best = np.concatenate([self._largest(chunks.codes(low, min(low + _BLOCK, len(chunks.owner)))) for low in range(0, len(chunks.owner), _BLOCK)] or [np.zeros((0, FILTERS), np.float32)])
        counts = np.diff(np.append(chunks.first, len(chunks.owner)))[:, None]
        return np.concatenate([np.add.reduceat(best, chunks.first, axis=0) / counts, np.maximum.reduceat(best, chunks.first, axis=0)], axis=1)

    def _largest(self, codes: np.ndarray) -> np.ndarray:
        w = self.windows(codes)
        answers = (w.reshape(-1, w.shape[2]) @ self.filters).reshape(len(codes), -1, FILTERS)
        return np.maximum(answers.max(axis=1) + self.shift, 0)

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        logit = self.features(Chunks(column)).astype(np.float64) @ self.weights + self.bias[0]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def fit(self, texts: list[str | None], labels: list[int]) -> Network:
        """Adam on the cross-entropy; the answers' gradient reaches only the windows that were largest."""
        rng = np.random.default_rng(5)
        names = ("bytes", "filters", "shift", "weights", "bias")
        moment = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in names}
        labels_, rounds = np.asarray(labels, np.float32), 0
        epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(texts) // BATCH)))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for low in range(0, len(order), BATCH):
                pick = order[low : low + BATCH]
                chunks = Chunks(pa.array([texts[i] for i in pick], pa.string()))
                codes = chunks.codes(0, len(chunks.owner))
                best, at = self.pooled(codes)
                counts = np.diff(np.append(chunks.first, len(best)))[:, None]
                mean = np.add.reduceat(best, chunks.first, axis=0) / counts
                most = np.maximum.reduceat(best, chunks.first, axis=0)
                x = np.concatenate([mean, most], axis=1)
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -60, 60)))
                error = (p - labels_[pick]) / len(pick)
                grad = {"weights": x.T @ error + 1e-4 * self.weights, "bias": error.sum(keepdims=True)}
                to = error[:, None] * self.weights
                down = (to[:, :FILTERS] / counts)[chunks.owner]
                down += np.where(best == most[chunks.owner], to[:, FILTERS:][chunks.owner], 0)
                down *= best > 0
                grad["shift"] = down.sum(axis=0)
                w = self.windows(codes)
                grad["filters"] = np.stack([down[:, f] @ w[np.arange(len(at)), at[:, f]] for f in range(FILTERS)], axis=1)
                place = at[:, :, None] * STRIDE + np.arange(WIDTH)  # (chunk, filter, byte of the window)
                hit = np.take_along_axis(codes[:, None, :], place, axis=2).ravel()
                own = self.filters.reshape(WIDTH, DIMENSIONS, FILTERS)
                to_bytes = np.stack([np.bincount(hit, (down[:, :, None] * own[:, d, :].T).ravel(), _PAD + 1) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
                to_bytes[_PAD] = 0
                grad["bytes"] = to_bytes
                rounds += 1
                rate = RATE * (1 - 0.9 * epoch / epochs)
                for n in names:
                    first, second = moment[n]
                    first += 0.1 * (grad[n] - first)
                    second += 0.01 * (grad[n] ** 2 - second)
                    getattr(self, n)[...] -= rate * (first / (1 - 0.9**rounds)) / (np.sqrt(second / (1 - 0.99**rounds)) + 1e-8)
        return self


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str | None], list[int]]:
    """Texts and labels of a bounded sample of the labelled rows of ``docs`` that aren't held out, in the order of a hash.

    What doesn't fit into the rest of the bytes is passed over, so a long text costs no other its place.
    """
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("id"), "quality").where(~held_out("id"))
    known = known.groupBy("id", "quality").agg(F.count("*").alias("labelled"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    sizes = texts.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("hash")).where(F.col("n") <= TRAIN_TEXT)
    sizes = sizes.groupBy("doc_id", "n", "hash").agg(F.count("*").alias("stored"))
    # equal rows count as often as they are there, but none more often than the sample needs
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("labelled") * F.col("stored"), F.lit(4 * TRAIN_ROWS)).cast("int"))).alias("copy")
    rows = materialise(sizes.join(known, F.col("doc_id") == F.col("id")).select("id", "quality", "n", "hash", copies), "quality-labelled")
    drawn = thinned(rows, TRAIN_ROWS).select(F.xxhash64("id", "quality", "hash", "copy").alias("place"), "id", "quality", "n", "hash").collect()
    taken, room = [], TRAIN_BYTES
    for r in sorted(drawn):
        if r["n"] <= room and len(taken) < TRAIN_ROWS:
            taken.append(r)
            room -= r["n"]
    for value in (0, 1):
        if (count := sum(r["quality"] == value for r in taken)) < LEAST_ROWS:
            warnings.warn(f"the quality network learns from {count} rows of quality {value}, fewer than {LEAST_ROWS}", stacklevel=2)
    if not taken:
        return [], []
    wanted = docs.sparkSession.createDataFrame([*{(r["id"], r["hash"]) for r in taken}], rows.select("id", "hash").schema)
    found = texts.join(F.broadcast(wanted), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("hash")))  # TRAIN_ROWS rows
    text = {(r["id"], r["hash"]): r["text"] for r in found.groupBy("id", "hash").agg(F.min("text").alias("text")).collect()}
    return [text[r["id"], r["hash"]] for r in taken], [r["quality"] for r in taken]


def fitted(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network for the labelled rows of ``docs``; none if there are none."""
    texts, known = training_sample(docs, labels)
    return Network().fit(texts, known) if texts else None


def scored(docs: DataFrame, network: Network | None, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, the score (0 to 1, higher is better) of the whole ``text``."""

    def run(batch: pa.RecordBatch) -> dict:
        return {column: np.ones(batch.num_rows) if network is None else network.scores(batch.column(batch.schema.get_field_index("text")))}

    return append_columns(docs, run, f"`{column}` double")
