"""Repeated byte strings by bucket-pointer refinement of suffixes.

Method. A suffix starts in the bucket of its first ``GRAM`` bytes, and buckets are refined in rounds by sorting on the bucket
identifiers of later offsets. An identifier of one depth is made of two of the depth before, (b(i), b(i + 32)) for 64 bytes and pairs of
those for more, so every round uses the identifiers of the last again. An identifier is a 64-bit hash of the bytes
it stands for: every task names a bucket alike and sorting brings it together. Suffixes whose bucket stays alone leave after each round.

Of the suffixes in a stretch only one need carry the stretch: for each window of ``SIZE`` bytes the leftmost ``GRAM`` with the
least hash is its anchor, which depends on these bytes alone, so equal windows have equal anchors. Windows that share an anchor form a run; about one suffix in 35 is
an anchor. The rounds are

1. buckets of 32 bytes: runs by their anchors;
2. buckets of 83 bytes and more: the windows of a run that hold the anchor within the same ``PART`` offsets share all the bytes from the first
   of these offsets to the end of the last window, so a part of a run that is alone with these has no window that occurs twice;
3. buckets of ``SIZE`` bytes: single windows.

In a bucket whose members agree in all their bytes all but the earliest are settled and go no further; where a bucket has different ones, each goes into the
next round. No window is skipped.

Scale. Runs are cut down in each task to the first of each kind, so a passage that is everywhere arrives once a task. A bucket
with many different surroundings (the end of such a passage) is found on a sample of texts, dealt by the whole run and goes to the third round at once;
the sample decides the dealing only. Texts are shuffled once, for the second and third round and the result together; the rounds read lists of offsets as flat arrays.

Rows. Null text counts as empty. Rows that agree in ``doc_id`` and text are one document, and each is returned with its result;
different texts under one ``doc_id``, or under none, are told apart and ordered by a hash of 64 bits (two of n such texts share one with a
probability of about n * n / 2**65). A null ``doc_id`` comes after all others. Other columns are passed on. Strings are compared by 64-bit hashes
of their anchor and of their whole, so two different ones are taken for one with a probability of about 2**-64 a pair within a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from feedlake.llm.batches import joined_bytes, map_arrow, release_shuffles, text_slices
from feedlake.llm.shingles import mixed
from feedlake.session import materialise

SIZE = 100
GRAM = 32
#: Offsets of an anchor that the windows of one part of a run have.
PART = 18
#: Windows computed in one step.
STEP = 1 << 19
#: Share of the texts in which common anchors are looked for, and the most that are kept.
SAMPLE = 0.01
COMMON = 1000

_rng = np.random.default_rng(65537)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 20) - 1)


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of ``GRAM`` bytes from each position on; length doubles with every round."""
    bucket, length, k = _BYTE[data], 1, 0
    while length < GRAM:
        bucket = bucket[:-length] * _FACTOR[k] + bucket[length:]
        length, k = 2 * length, k + 1
    return bucket


def _twice(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of twice ``GRAM`` bytes from each position ``at`` on."""
    return mixed(grams[at] * _FACTOR[8] + grams[at + GRAM])


def window_buckets(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of the ``SIZE`` bytes from each position ``at`` on: pairs of pairs of shorter buckets."""
    return mixed(_twice(grams, at) * _FACTOR[9] + _twice(grams, at + SIZE - 2 * GRAM))


def _whole(grams: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of all bytes from the window ``first`` to the end of the window ``last``, with the place of the anchor in it."""
    shape = ((last - first) * 128 + (at - first)).astype(np.uint64)
    return mixed(window_buckets(grams, first) * _FACTOR[10] + window_buckets(grams, last) * _FACTOR[11] + shape).view(np.int64)


def parts(data: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of runs (positions in ``data``): ``first, last`` window and anchor, bucket of the bytes that all windows of such a part share, bucket of all its bytes."""
    pieces = []
    for low in range(0, SIZE - GRAM + 1, PART):
        high = min(low + PART - 1, SIZE - GRAM)  # offsets of the anchor
        here = (at - first >= low) & (at - last <= high)
        a = at[here]
        pieces.append((np.maximum(first[here], a - high), np.minimum(last[here], a - low), a, a - low, a - high + SIZE - 2 * GRAM))
    first, last, at, head, tail = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(first, kind="stable")
    first, last, at, head, tail = (x[order] for x in (first, last, at, head, tail))
    for low in range(0, len(data), STEP):
        here = slice(*np.searchsorted(first, (low, low + STEP)))
        if here.start == here.stop:
            continue
        begin = int(first[here.start])
        grams = gram_buckets(data[begin : low + STEP + SIZE + PART])
        f, e, a, h, t = (x[here] - begin for x in (first, last, at, head, tail))
        shared = mixed(_twice(grams, h) * _FACTOR[9] + _twice(grams, t) + (a - h).astype(np.uint64))
        yield first[here], last[here], at[here], shared.view(np.int64), _whole(grams, f, e, a)


def runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: ``first, last`` window and the anchor (positions in ``data``), bucket of the anchor, bucket of the run."""
    usable = np.zeros(len(data), bool)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        usable[low : max(low, high - SIZE + 1)] = True
    span = SIZE - GRAM + 1  # grams in a window
    for low in range(0, len(data), STEP):
        valid = usable[low : low + STEP]
        if not valid.any():
            continue
        valid = valid[: np.flatnonzero(valid)[-1] + 1]
        grams = gram_buckets(data[low : low + len(valid) + SIZE - 1])
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = span - width
        least = np.minimum(least[: len(least) - rest], least[rest:])[: len(valid)]
        anchor = (least & _PLACE).astype(np.int64)
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        end = valid.copy()
        end[:-1] &= new[1:] | ~valid[1:]
        last = np.flatnonzero(end)
        at = anchor[first]
        yield first + low, last + low, at + low, grams[at].view(np.int64), _whole(grams, first, last, at)


def _ranges(batch: pa.RecordBatch, texts: tuple[np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document keys and offsets in the document of windows given as positions in the batch."""
    bounds = texts[1]
    owner = np.searchsorted(bounds, first, side="right") - 1
    return batch.column("ord").to_numpy()[owner], batch.column("crc").to_numpy()[owner], first - bounds[owner], last - bounds[owner]


_RANGE = "ord bigint, crc bigint, low bigint, high bigint"


def _seen_before(*sorted_keys: np.ndarray) -> np.ndarray:
    """Flags of the rows that equal the one before in all keys."""
    same = np.ones(len(sorted_keys[0]), bool)
    same[:1] = False
    for k in sorted_keys:
        same[1:] &= k[1:] == k[:-1]
    return same


_TABLE = f"bucket bigint, whole bigint, {_RANGE}, at bigint, settled boolean"


def _table(batch: pa.RecordBatch, texts: tuple[np.ndarray, np.ndarray], found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[dict]:
    """Rows of ``_TABLE`` for stretches of windows in the order of their places, ``settled`` if the batch has an equal one that comes earlier."""
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    if not columns or not len(columns[0]):
        return
    first, last, at, bucket, whole = columns
    ord_, crc, low, high = _ranges(batch, texts, first, last)
    order = np.lexsort((low, crc, ord_, whole, bucket))
    repeat = np.zeros(len(order), bool)
    repeat[order] = _seen_before(bucket[order], whole[order])
    again = np.zeros(len(order), bool)  # the same place of the same document: a repeated row
    again[order] = _seen_before(bucket[order], whole[order], ord_[order], crc[order], low[order])
    # settled stretches that follow each other become one
    joined = np.zeros(len(order), bool)
    joined[1:] = repeat[1:] & repeat[:-1] & (first[1:] == last[:-1] + 1) & (ord_[1:] == ord_[:-1]) & (low[1:] > low[:-1])
    high = high[np.append(np.flatnonzero(~joined)[1:] - 1, len(order) - 1)]
    keep = ~again[~joined]
    named = (("bucket", bucket), ("whole", whole), ("ord", ord_), ("crc", crc), ("low", low), ("at", at - first))
    yield {n: v[~joined][keep] for n, v in named} | {"high": high[keep], "settled": repeat[~joined][keep]}


def run_table(keyed: DataFrame) -> DataFrame:
    """The runs of all texts in the buckets of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            texts = joined_bytes(batch.column("text"))
            yield from _table(batch, texts, runs(*texts))

    return map_arrow(keyed.select("ord", "crc", "text"), run, _TABLE)


def _listed(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The row and the fields of all elements of a list of structs."""
    counts = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), counts), *(f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten())


def part_table(texts: DataFrame) -> DataFrame:
    """The parts of the runs ``open`` of the texts in the buckets of the bytes that their windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            data, bounds = joined_bytes(batch.column("text"))
            owner, low, high, at = _listed(batch.column("open"))
            begin = bounds[owner]
            yield from _table(batch, (data, bounds), parts(data, begin + low, begin + high, begin + low + at))

    return map_arrow(texts, run, _TABLE)


def _common_anchors(keyed: DataFrame) -> list[int]:
    """Anchors with many different surroundings in a sample of the texts, ``COMMON`` at most."""
    sample = run_table(keyed.sample(SAMPLE, seed=1)).where("NOT settled").groupBy("bucket").agg(F.count("*").alias("n"))
    return [r["bucket"] for r in sample.where("n >= 8").orderBy(F.desc("n"), "bucket").limit(COMMON).collect()]


def refine(table: DataFrame, common: list[int]) -> DataFrame:
    """Of stretches of windows those that occur earlier (``open`` false), and those of buckets with different ones (``open`` true).

    What is alone in its bucket is left out, unless the bucket is ``common``: then it is ``hot``, and open.
    """
    known = np.sort(np.asarray(common, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("bucket", "whole", "ord", "crc", "low", "high", "at")
        carry = {n: np.zeros(0, np.int64) for n in (*names, "done")}
        for batch in batches:
            if not batch.num_rows:
                continue
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            rows = {n: np.append(carry[n], batch.column(n).to_numpy()) for n in names}
            old = len(carry["ord"])
            settled = np.append(np.zeros(old, bool), settled)
            done = np.append(carry["done"], np.zeros(batch.num_rows, np.int64)).astype(bool)
            n = len(settled)
            starts_bucket = ~_seen_before(rows["bucket"])
            starts_run = ~_seen_before(rows["bucket"], rows["whole"])
            bucket = np.cumsum(starts_bucket) - 1
            many = np.bincount(bucket, starts_run) > 1
            hot = np.isin(rows["bucket"][starts_bucket], known)
            many |= hot
            head = np.flatnonzero(starts_run)[np.cumsum(starts_run) - 1]
            same_place = (rows["ord"] == rows["ord"][head]) & (rows["crc"] == rows["crc"][head]) & (rows["low"] == rows["low"][head])
            earlier = settled | ~starts_run & ~same_place
            open_ = starts_run & many[bucket] & ~done & ~settled
            done |= open_
            earlier[:old] = False
            out = earlier | open_
            yield {c: rows[c][out] for c in ("ord", "crc", "low", "high", "at")} | {"open": open_[out], "hot": hot[bucket][out]}
            last_bucket = int(np.flatnonzero(starts_bucket)[-1])
            keep = np.unique([last_bucket, int(head[n - 1])])
            carry = {c: rows[c][keep] for c in names} | {"done": done[keep].astype(np.int64)}

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # settled rows wait for nobody
    key = F.when(F.col("settled"), F.xxhash64("ord", "low")).when(F.col("bucket").isin(common), F.col("whole")).otherwise(F.col("bucket"))
    dealt = table.withColumn("key", key).repartition(n, "key").sortWithinPartitions("bucket", "whole", "ord", "crc", "low").drop("key")
    return map_arrow(dealt, run, f"{_RANGE}, at bigint, open boolean, hot boolean")


def refine_windows(texts: DataFrame) -> DataFrame:
    """Of the windows ``open`` (low and high of each range) of the texts, those that occur earlier among all of them."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in text_slices(batches):
            texts_ = joined_bytes(batch.column("text"))
            data, bounds = texts_
            owner, low, high, _ = _listed(batch.column("open"))
            count = high - low + 1
            at = np.unique(np.repeat(bounds[owner] + low - np.cumsum(count) + count, count) + np.arange(count.sum()))
            if not len(at):
                continue
            bucket = np.empty(len(at), np.int64)
            for low in range(0, len(at), STEP):
                here = at[low : low + STEP]
                cuts = np.append(0, np.append(np.flatnonzero(np.diff(here) > STEP) + 1, len(here)))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = here[a:b]
                    bucket[low + a : low + b] = window_buckets(gram_buckets(data[part[0] : part[-1] + SIZE]), part - part[0]).view(np.int64)
            ord_, crc, low, _ = _ranges(batch, texts_, at, at)
            order = np.lexsort((low, crc, ord_, bucket))
            bucket, ord_, crc, low = bucket[order], ord_[order], crc[order], low[order]
            keep = ~_seen_before(bucket, ord_, crc, low)
            bucket, ord_, crc, low = bucket[keep], ord_[keep], crc[keep], low[keep]
            settled = _seen_before(bucket)
            # settled windows that follow each other become one row, and wait for nobody
            done = [x[settled] for x in (low, crc, ord_)]
            low_, crc_, own_ = (x[np.lexsort(done)] for x in done)
            cuts = np.flatnonzero(~(_seen_before(own_, crc_) & (np.diff(low_, prepend=-2) == 1)))
            high_ = low_[np.append(cuts[1:], len(low_)) - 1] if len(cuts) else low_
            low_, crc_, own_ = low_[cuts], crc_[cuts], own_[cuts]
            fresh = ~settled
            yield {
                "bucket": np.append(bucket[fresh], (mixed(own_.astype(np.uint64) + low_.astype(np.uint64))).view(np.int64)),
                "ord": np.append(ord_[fresh], own_), "crc": np.append(crc[fresh], crc_), "low": np.append(low[fresh], low_),
                "more": np.append(np.zeros(fresh.sum(), np.int64), high_ - low_), "settled": np.append(np.zeros(fresh.sum(), bool), np.ones(len(low_), bool)),
            }

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        head = np.zeros((5, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.append(head, np.stack([batch.column(n).to_numpy() for n in ("bucket", "ord", "crc", "low", "more")]), axis=1)
            settled = np.append(np.zeros(head.shape[1], bool), batch.column("settled").to_numpy(zero_copy_only=False))
            starts = ~_seen_before(rows[0], settled)
            first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            earlier = settled | (rows[1:4] != rows[1:4, first]).any(axis=0)
            earlier[: head.shape[1]] = False
            yield {"ord": rows[1][earlier], "crc": rows[2][earlier], "low": rows[3][earlier], "high": rows[3][earlier] + rows[4][earlier]}
            head = rows[:, first[-1:]] if not settled[-1] else head[:, :0]

    named = map_arrow(texts, name, "bucket bigint, ord bigint, crc bigint, low bigint, more bigint, settled boolean")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(named.repartition(n, "bucket").sortWithinPartitions("bucket", "settled", "ord", "crc", "low"), compare, _RANGE)


def _removed(data: np.ndarray, bounds: np.ndarray, cut: pa.Array) -> np.ndarray:
    """Flags of the bytes that the windows of all ranges cover."""
    owner, low, high, _ = _listed(cut)
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, bounds[owner] + low, 1)
    np.add.at(cover, bounds[owner] + high + SIZE, -1)
    return np.cumsum(cover, dtype=np.int32)[:-1] > 0


#: What becomes of the bytes that are left: themselves, a text without the parts of cut characters, or their SHA-256.
KEPT = {"bytes": "kept binary", "text": "kept string", "sha256": "kept_sha256 string"}


def deduplicate(docs: DataFrame, kept: str = "bytes") -> DataFrame:
    """``docs`` without every byte that a ``SIZE``-byte string covers which also starts earlier.

    Earlier is in a row of smaller ``doc_id`` or further to the front of the same text. Strings never cross texts
    and are judged on the input. The other columns come first (those named like a new one are replaced), then ``n_bytes, n_removed,
    n_spans`` and what ``kept`` names in ``KEPT``.
    """
    new = {"text", "n_bytes", "n_removed", "n_spans", KEPT[kept].split()[0]}
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(text).alias("crc"), text.alias("text"))
    ranges = materialise(refine(run_table(keyed), _common_anchors(keyed)), "suffix-ranges")
    release_shuffles(docs.sparkSession)  # of the runs, as large as what follows

    def with_ranges(rows: DataFrame, name: str) -> DataFrame:
        # all of ``keyed`` each time, so that the joins share one shuffle of the texts
        lists = rows.groupBy("ord", "crc").agg(F.collect_list(F.struct("low", "high", "at")).alias(name))
        return keyed.join(lists, ["ord", "crc"], "left")

    second = refine(part_table(with_ranges(ranges.where("open AND NOT hot"), "open")), [])
    both = ranges.where("hot OR NOT open").unionByName(second)
    windows = refine_windows(with_ranges(both.where("open"), "open")).withColumn("at", F.lit(0).cast("bigint"))
    earlier = both.where("NOT open").drop("open", "hot").unionByName(windows)
    marked = with_ranges(earlier, "cut").select("row", "text", "cut")

    fields = [f for f in docs.schema if f.name.lower() not in new]
    own = _parse_datatype_string("n_bytes bigint, n_removed bigint, n_spans bigint, " + KEPT[kept])
    made = {"bytes": lambda b: b, "text": lambda b: b.decode("utf-8", errors="ignore"), "sha256": lambda b: hashlib.sha256(b).hexdigest()}[kept]
    schema = StructType([marked.schema["row"], *own])
    arrow = to_arrow_schema(own)
    row_type = to_arrow_schema(StructType([marked.schema["row"]]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, bounds = joined_bytes(batch.column("text"))
            out: dict[str, list] = {f.name: [] for f in own}
            removed = _removed(data, bounds, batch.column("cut"))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                flags = removed[low:high]
                spans = int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
                for n, v in zip(own.names, (high - low, int(flags.sum()), spans, made(data[low:high][~flags].tobytes())), strict=True):
                    out[n].append(v)
            columns = [batch.column("row").cast(row_type.field(0).type), *(pa.array(out[f.name], f.type) for f in arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([row_type.field(0), *arrow]))

    cutted = marked.mapInArrow(cut, schema)
    return cutted.select(*(F.col("row").getField(f.name).alias(f.name) for f in fields), *own.names)


#: The same over the table ``documents``: every string of 100 bytes, as hexadecimal digits, against its earliest place.
SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), places AS (
  SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM docs
), strings AS (
  SELECT substr(h, 2 * i + 1, 200) AS s, list({'doc_id': doc_id, 'i': i}) AS found FROM places GROUP BY 1 HAVING count(*) > 1
), repeated AS (
  SELECT place.doc_id, place.i FROM (SELECT unnest(found) AS place, list_min(found) AS earliest FROM strings) WHERE place <> earliest
), begun AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS opens FROM repeated
), numbered AS (
  SELECT doc_id, i, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM begun
), spans AS (
  SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans
), cut AS (
  SELECT d.doc_id, CAST(sum(g.high - g.low) AS BIGINT) AS n_removed, count(*) AS n_spans,
    concat(string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY low), substr(any_value(h), 2 * max(high) + 1)) AS rest
  FROM docs d JOIN gaps g USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
