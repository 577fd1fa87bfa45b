"""Landed files: notes, boards, sitemaps, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.schema import BOARD


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.md`` files below a folder: ``path``, ``content``. Unreadable ones are skipped."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """Board exports, one per file: ``board``, ``cards``, ``lists``."""
    return (
        spark.read.schema(BOARD)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .select(F.col("_metadata.file_path").alias("board"), "cards", "lists")
    )


def board_cards(boards: DataFrame) -> DataFrame:
    """One row per card; ``card`` is its place on the board."""
    return boards.select("board", F.posexplode("cards").alias("card", "_c")).select(
        "board",
        "card",
        F.col("_c.name").alias("name"),
        F.col("_c.desc").alias("descr"),
        F.col("_c.closed").alias("closed"),
        F.col("_c.idList").alias("idlist"),
    )


def board_lists(boards: DataFrame) -> DataFrame:
    """One row per list that has both an id and a name."""
    return (
        boards.select("board", F.inline("lists"))
        .na.drop(subset=["id", "name"])
        .select("board", F.col("id").alias("idlist"), F.col("name").alias("list_name"))
    )


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Locations of landed sitemap files: ``path``, ``url``.

    Reads ``url`` elements only, so entries of a sitemap index are not followed.
    """
    return (
        spark.read.format("xml")
        .schema("loc string")
        .option("rowTag", "url")
        .option("mode", "DROPMALFORMED")
        .load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.trim("loc").alias("url"))
        .filter("url <> ''")
    )


# Defaults for the columns a page table may lack.
_PAGE_DEFAULTS = {
    "final_url": lambda: F.col("url"),
    "content_type": lambda: F.lit(None).cast("string"),
    "content_length": lambda: F.octet_length("html").cast("bigint"),
    "status": lambda: F.lit(200),
}


def page_corpus(pages: DataFrame) -> DataFrame:
    """A page table with all columns the jobs use, and ``good`` for usable answers.

    Needs ``page_id``, ``url`` and ``html``; everything else has a default.
    """
    full = pages
    for name, default in _PAGE_DEFAULTS.items():
        if name not in pages.columns:
            full = full.withColumn(name, default())
    full = full.withColumn("final_url", F.coalesce("final_url", "url"))
    return full.withColumn("good", F.coalesce(F.col("status"), F.lit(200)) < 400)


def write_page_corpus(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed by ``page_id``, so that fetching by id never moves bodies."""
    pages.write.bucketBy(buckets, "page_id").sortBy("page_id").mode("overwrite").saveAsTable(table)
