"""Incremental ingest: pages arrive, each item is written once."""

from __future__ import annotations

import datetime as dt
import json
import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions.url import is_valid_url, page_id_of
from feedlake.operators import pages as PG
from feedlake.operators.patterns import Patterns, flagged, prepare
from feedlake.schema import ITEM_COLUMNS, ITEM_FIELDS
from feedlake.session import materialise
from feedlake.sources.landed import page_corpus
from feedlake.streaming import keys

ITEMS_SCHEMA = (
    "feed string, "
    + ", ".join(f"{name} {kind}" for name, kind in ITEM_FIELDS.items())
    + ", ord bigint, run_id string"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS_SCHEMA).parquet(path)


def keys_path(path: str) -> str:
    """Where the keys of the items table at ``path`` are."""
    return f"{path.rstrip('/')}-keys"


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the stream whose progress is in ``checkpoint``.

    It lasts as long as the folder, and a folder made anew under the same name has another one, so no batch takes the
    place of another stream's.
    """
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def ingest_batch(
    arrived: DataFrame,
    run_id: str,
    path: str,
    as_of: dt.datetime,
    with_feed,
    rules: Patterns | None = None,
    key_digits: int = keys.DIGITS,
) -> None:
    """One micro-batch: new links of the arrived good pages, parsed and appended.

    The same filters as in a batch run: answers of status 400 and more, invalid urls and links that the patterns of
    ``rules`` keep out are dropped, then the lowest ``page_id`` answers for each feed and final page; of several
    versions of that page in one batch, the one whose item comes first by title and text.

    What counts as seen is the key table, of which only the prefixes that the batch holds are opened; it is not stream state, so state does
    not grow with the corpus. A repeated batch overwrites its own ``run_id`` folders, which makes
    it idempotent: its own earlier output is not counted as seen. Items are written before their keys, so a batch that dies in between
    is simply repeated. ``run_id`` must name one batch of one stream, or it replaces another's rows.
    """
    spark = arrived.sparkSession
    pages = with_feed(page_corpus(arrived)).filter(F.col("good") & F.expr(is_valid_url("url")))
    if rules:
        pages = flagged(pages.withColumn("ord", F.col("page_id")), rules).filter("allowed AND NOT blocked")
    keyed = materialise(pages.selectExpr("page_id", "feed", f"{page_id_of('final_url')} AS id"), "arrived")
    fresh = (
        keyed.join(keys.seen(keyed, keys_path(path), run_id, key_digits), ["feed", "id"], "left_anti")
        .groupBy("feed", "id")
        .agg(F.min("page_id").alias("page_id"))
    )
    wanted = fresh.select("feed", "page_id", F.col("id").alias("_wanted"))
    bodies = PG.with_page_ids(pages.join(wanted, ["feed", "page_id"])).where("id = _wanted")
    items = PG.page_items(bodies, as_of, ["feed", "page_id"])
    first = Window.partitionBy("feed", "id").orderBy("title", "content_html", "url")
    (
        items.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select("feed", *ITEM_COLUMNS, F.col("page_id").alias("ord"), F.lit(run_id).alias("run_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )
    keys.add_keys(read_items(spark, path).where(F.col("run_id") == run_id), run_id, keys_path(path), key_digits)


def run_available(
    arrivals: DataFrame,
    path: str,
    checkpoint: str,
    as_of: dt.datetime,
    with_feed,
    rules: Patterns | None = None,
    key_digits: int = keys.DIGITS,
) -> None:
    """Process everything that has arrived, then stop.

    ``arrivals`` is a streaming page table; ``with_feed`` adds the ``feed`` column; ``rules`` are a feed and a pattern table. Several streams may write to one table.
    """
    spark = arrivals.sparkSession
    prepared = prepare(rules[1]) if rules else None
    spark.createDataFrame([], ITEMS_SCHEMA).write.mode("ignore").partitionBy("run_id").parquet(path)
    keys.create_keys(spark, read_items(spark, path), keys_path(path), key_digits)
    name: list[str] = []
    named = threading.Event()

    def ingest(batch: DataFrame, batch_id: int) -> None:
        named.wait()  # the first batch may begin before the query's id is known here
        ingest_batch(batch, f"{name[0]}-{batch_id}", path, as_of, with_feed, prepared, key_digits)

    query = arrivals.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    name.append(query.id)
    named.set()
    query.awaitTermination()
    keys.merge_runs(spark, keys_path(path), digits=key_digits)


def stream_pages(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Page files as a stream, in batches of at most ``files_per_batch`` files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )
