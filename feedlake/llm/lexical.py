"""Ranked lexical search through norm buckets.

Method. A document is a vector with one coordinate for each term of the items asked for: the term's impact in it times the root of the
term's weight; an item is the vector of its repeats times the same roots, so the score is their inner product. Documents are
ordered by the length of their vectors and cut into buckets. For an item whose ten best scores so far are all at least t,
Cauchy-Schwarz ends the search at the first bucket whose longest vector times the item's is below t. Inside a bucket the item's
largest coordinates are looked up until the rest of it, times the bucket's longest vector, is below t: a document with none of them can't
reach t. For the others the coordinates found so far, and Cauchy-Schwarz on the rest of both vectors, bound the score. Survivors
are scored again exactly, in 64-bit integers.

Scale. Texts are read once, where they lie, into vectors over the items' terms only, which are written once; nothing else of the texts is kept
or sent. Counts of documents are summed on the map side. Each task orders and cuts its own vectors, a bounded number at a time: all that
Cauchy-Schwarz prunes is the short end of every such order, so no shuffle has to bring equal lengths together, and copies of one text,
however many, stay spread. A bounded sample of documents gives every item a first t; any score that ten documents reach is a
valid one, so the sample decides on speed alone. Every task sends at most ten rows an item. Items are searched in blocks of
bounded size, dealt by hash; a block's terms and weights are broadcast.

Rows. Null texts and texts without terms count for nothing and are never found. A document without ``doc_id`` counts and is ranked like others, after
those of equal score that have one. Repeated rows are documents of their own. Equal rows of ``items`` count once; several texts of one ``item_id`` (or
of none) are one item with the terms of all. Items without terms, or without any document above zero, have no rows. Other columns are not looked at.
Texts are read whole; a very long one costs memory in proportion, alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.batches import map_arrow, text_slices
from feedlake.session import materialise

#: Documents of a bucket, and vectors ordered at once by a task (in coordinates).
BUCKET = 2048
ORDER_COORDINATES = 4 << 20
#: (item, term) rows of a block of items, in the mean.
BLOCK_TERMS = 200_000
#: Documents whose scores give the first thresholds.
SAMPLE = 20_000
#: Relative room for rounding in the bounds; exact scores decide.
ROOM = 1e-9

#: Bytes that are no part of a term become blanks, A-Z becomes a-z; all bytes from 0x80 on belong to terms.
_FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode().translate(_FOLDED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, repeats``: the terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            found = [(i, t, n) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t, n in Counter(terms(text)).items()]
            yield {"item_id": [f[0] for f in found], "term": [f[1] for f in found], "repeats": [f[2] for f in found]}

    named = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return map_arrow(named, run, "item_id bigint, term binary, repeats bigint").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def vectors(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, ids, counts``: all terms of every document counted, and those in ``known`` by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            n, ids, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                held = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
                n.append(len(words))
                ids.append([t for t, _ in held])
                counts.append([c for _, c in held])
            yield {"doc_id": batch.column("doc_id"), "n": n, "ids": ids, "counts": counts}

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(named, run, "doc_id bigint, n bigint, ids array<int>, counts array<bigint>").where("n > 0")


@dataclass
class Asked:
    """The items of a block, the corpus figures they need, and their thresholds."""

    documents: int
    length: int
    weight: np.ndarray
    items: list[tuple[int | None, np.ndarray, np.ndarray]]  # id, terms, repeats
    least: np.ndarray
    best: int


class Order:
    """Some documents, longest vector first."""

    def __init__(self, asked: Asked, batch: pa.RecordBatch) -> None:
        ids = batch.column("ids")
        size = pa.compute.list_value_length(ids).to_numpy().astype(np.int64)
        total = batch.column("n").to_pylist()
        # numbers of any size: 75 * n * N may pass 64 bits
        m = np.asarray([25 + 75 * n * asked.documents // asked.length for n in total], np.int64)
        counts = batch.column("counts").flatten().to_numpy()
        self.begin = np.append(0, np.cumsum(size))
        self.term = ids.flatten().to_numpy().astype(np.int64)
        self.impact = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, size))
        self.value = self.impact * np.sqrt(asked.weight[self.term])
        squares = np.append(0.0, np.cumsum(self.value**2))
        # a sum of differences would round; short rows are summed apart
        self.norm = np.sqrt(np.add.reduceat(np.append(self.value**2, 0.0), np.minimum(self.begin[:-1], len(self.value)))) if len(size) else squares[:0]
        self.norm[size == 0] = 0.0
        self.order = np.argsort(-self.norm, kind="stable")
        column = batch.column("doc_id")
        self.unnamed = column.is_null().to_numpy(zero_copy_only=False)
        self.ids = column.fill_null(0).to_numpy().astype(np.int64)

    def slices(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the coordinates of ``rows`` end to end, and how many each has."""
        size = self.begin[rows + 1] - self.begin[rows]
        first = np.repeat(self.begin[rows] - (np.cumsum(size) - size), size)
        return first + np.arange(len(first)), size


@dataclass
class Found:
    """The best documents of an item so far."""

    score: np.ndarray
    unnamed: np.ndarray
    ids: np.ndarray

    def merged(self, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray, best: int) -> Found:
        score, unnamed, ids = np.append(self.score, score), np.append(self.unnamed, unnamed), np.append(self.ids, ids)
        top = np.lexsort((ids, unnamed, -score))[:best]
        return Found(score[top], unnamed[top], ids[top])


def _searched(asked: Asked, order: Order, found: list[Found], least: np.ndarray) -> None:
    """Adds the documents of ``order`` to what was found for each item."""
    root = np.sqrt(asked.weight)
    queries = []
    for _, term, repeats in asked.items:
        value = repeats * root[term]
        large = np.argsort(-value, kind="stable")
        value = value[large]
        rest = np.sqrt(np.append(np.cumsum((value**2)[::-1])[::-1], 0.0))  # of the item without its first coordinates
        queries.append((term[large], value, rest))
    exact = np.zeros(len(asked.weight), np.int64)
    open_ = np.flatnonzero([len(q[0]) > 0 for q in queries])
    for low in range(0, len(order.order), BUCKET):
        rows = order.order[low : low + BUCKET]
        longest = order.norm[rows[0]] * (1 + ROOM)
        if not longest:
            break
        # Cauchy-Schwarz: what this bucket can't reach, no later one can
        open_ = open_[[queries[k][2][0] * longest >= least[k] for k in open_]]
        if not len(open_):
            break
        places, size = order.slices(rows)
        term = order.term[places]
        by_term = np.argsort(term, kind="stable")
        owner, value = np.repeat(np.arange(len(rows)), size)[by_term], order.value[places][by_term]
        heads, starts = np.unique(term[by_term], return_index=True)
        ends = np.append(starts[1:], len(term))
        squared = order.norm[rows] ** 2
        for k in open_:
            wanted, weights, rest = queries[k]
            focus = len(wanted) if least[k] <= 0 else int(np.argmax(rest * longest < least[k])) if rest[-1] * longest < least[k] else len(wanted)
            at = np.searchsorted(heads, wanted[:focus])
            held = np.flatnonzero((at < len(heads)) & (heads[np.minimum(at, len(heads) - 1)] == wanted[:focus]))
            if not len(held):
                continue
            lists = [np.arange(starts[at[h]], ends[at[h]]) for h in held]
            where = np.concatenate(lists)
            own, part = owner[where], value[where]
            product = np.bincount(own, part * np.repeat(weights[held], [len(x) for x in lists]), len(rows))
            left = np.maximum(squared - np.bincount(own, part**2, len(rows)) * (1 - ROOM), 0.0)
            able = np.flatnonzero((product > 0) & ((product + rest[focus] * np.sqrt(left)) * (1 + ROOM) >= least[k]))
            if not len(able):
                continue
            _, asked_terms, repeats = asked.items[k]
            exact[asked_terms] = repeats * asked.weight[asked_terms]
            chosen = rows[able]
            spots, sizes = order.slices(chosen)
            sums = np.append(0, np.cumsum(exact[order.term[spots]] * order.impact[spots]))
            stop = np.cumsum(sizes)
            score = sums[stop] - sums[stop - sizes]
            exact[asked_terms] = 0
            good = (score > 0) & (score >= least[k])
            if good.any():
                found[k] = found[k].merged(score[good], order.unnamed[chosen[good]], order.ids[chosen[good]], asked.best)
                if len(found[k].score) == asked.best:
                    least[k] = max(least[k], int(found[k].score[-1]))


def best_of_tasks(rows: DataFrame, asked: Asked) -> DataFrame:
    """``item, score, doc_id``: what each task finds best; ``item`` is the place in ``asked.items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        none = np.zeros(0, np.int64)
        found = [Found(none, none.astype(bool), none) for _ in asked.items]
        least = asked.least.copy()
        held: list[pa.RecordBatch] = []
        coordinates = 0

        def search() -> None:
            if held:
                _searched(asked, Order(asked, pa.Table.from_batches(held).combine_chunks().to_batches()[0]), found, least)
            held.clear()

        for batch in batches:
            low = 0
            ends = np.cumsum(pa.compute.list_value_length(batch.column("ids")).to_numpy().astype(np.int64))
            while low < batch.num_rows:
                done = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + ORDER_COORDINATES - coordinates, side="right")))
                held.append(batch.slice(low, high - low))
                coordinates += int(ends[high - 1]) - done
                low = high
                if coordinates >= ORDER_COORDINATES or low < batch.num_rows:
                    search()
                    coordinates = 0
        search()
        item = np.repeat(np.arange(len(found)), [len(f.score) for f in found])
        if len(item):
            unnamed = np.concatenate([f.unnamed for f in found])
            yield {"item": item, "score": np.concatenate([f.score for f in found]), "doc_id": pa.array(np.concatenate([f.ids for f in found]), mask=unnamed)}

    return map_arrow(rows, run, "item int, score bigint, doc_id bigint")


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= best)


def _block(docs: DataFrame, rows: list, best: int) -> DataFrame:
    """The search for the items of one block, given as (item, term, repeats)."""
    known = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    held = materialise(vectors(docs, known), "lexical-vectors")
    documents, length = held.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    holders = held.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(len(known), np.int64)
    for r in holders.collect():  # at most one for each term of the block
        df[r["term"]] = r["df"]
    weight = np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    by_item: dict[int | None, list] = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append((known[bytes(r["term"])], r["repeats"]))
    items = [(i, *np.asarray(sorted(of), np.int64).T) for i, of in by_item.items()]
    asked = Asked(documents, int(length), weight, items, np.zeros(len(items), np.int64), best)
    if documents > 2 * SAMPLE:
        share = max(1, documents // SAMPLE)
        sample = held.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0)
        enough = _ranked(best_of_tasks(sample, asked), best).groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == best)
        for r in enough.collect():  # at most one for each item of the block
            asked.least[r["item"]] = r["least"]
    found = _ranked(best_of_tasks(held, asked), best)
    names = docs.sparkSession.createDataFrame([(k, i[0]) for k, i in enumerate(items)], "item int, item_id bigint")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents (``doc_id``, ``text``) for each of ``items`` (``item_id``, ``text``).

    Score: the sum over an item's terms, repeats included, of w * ((10^9 * tf) div (1000 * tf + 8 * m)), where
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + (75 * n * N) div L, over documents with at least one term.
    """
    spark = docs.sparkSession
    asked = materialise(item_terms(items), "lexical-items")
    blocks = -(-asked.count() // BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about BLOCK_TERMS
        if rows:
            part = _block(docs, rows, best)
            out = part if blocks == 1 else out.unionByName(materialise(part, "lexical-block"))
    return out


#: The same over the given tables.
SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, docs),
asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN size USING (r) JOIN weight USING (term), corpus GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
