"""Stored feed documents back to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.functions.dates import date_columns
from feedlake.schema import ATTACHMENTS, AUTHORS, JSON_FEED


# Stored order continues from page to page; a page never holds this many items.
PAGE_STRIDE = 1_000_000_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents written by ``write_documents``: ``feed``, ``document``.

    Folders are ``feed=<name>``; the folder names the feed.
    """
    return (
        spark.read.option("lineSep", "\n")
        .schema("value string, feed string")
        .text(path)
        .select("feed", F.col("value").alias("document"))
    )


def read_feed_files(spark: SparkSession, path: str, name: str = "feed.json") -> DataFrame:
    """``feed.json`` files below a folder, one document each; the folder names the feed."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .option("ignoreCorruptFiles", True)
        .text(path, wholetext=True)
        .select(
            F.element_at(F.split("_metadata.file_path", "/"), -2).alias("feed"),
            F.col("value").alias("document"),
        )
    )


def parsed_documents(documents: DataFrame) -> DataFrame:
    """Documents as structs; an unreadable one counts as no stored feed."""
    parsed = documents.select("feed", F.from_json("document", JSON_FEED).alias("_d"))
    return parsed.filter("_d.items IS NOT NULL OR _d.title IS NOT NULL")


def stored_headers(documents: DataFrame) -> DataFrame:
    """Feed headers, defaults filled in."""
    return (
        parsed_documents(documents)
        .select(
            "feed",
            F.coalesce("_d.title", F.lit(fixed.UNTITLED_FEED)).alias("title"),
            "_d.home_page_url",
            "_d.feed_url",
            "_d.description",
            "_d.language",
        )
        .distinct()
    )


def stored_items(documents: DataFrame) -> DataFrame:
    """Items of the stored feeds in stored order (``ord``), dates typed.

    An unreadable date becomes NULL and keeps its item.
    """
    rows = (
        parsed_documents(documents)
        .select(
            "feed",
            F.coalesce("_d._page", F.lit(1)).alias("page"),
            F.posexplode_outer("_d.items").alias("pos", "_i"),
        )
        .filter("pos IS NOT NULL")
        .select("feed", "page", "pos", "_i.*")
    )
    return rows.selectExpr(
        "feed",
        "id",
        "url",
        "title",
        "summary",
        "content_html",
        *date_columns("date_published", "date_published", "date_local", "date_iso"),
        *date_columns("date_modified", "date_modified", "modified_local", "modified_iso"),
        f"coalesce(authors, CAST(array() AS {AUTHORS})) AS authors",
        "language",
        "coalesce(tags, CAST(array() AS array<string>)) AS tags",
        f"coalesce(attachments, CAST(array() AS {ATTACHMENTS})) AS attachments",
        f"(page - 1) * {PAGE_STRIDE}L + pos AS ord",
    )
