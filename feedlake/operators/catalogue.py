"""The catalogue of all feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.functions.dates import parse_date
from feedlake.functions.sql import first_nonempty, let, lit, matches, nonempty
from feedlake.functions.text import escape_html
from feedlake.operators.ranking import rank_within


def _wall_clock(date_text: str) -> str:
    """ISO text as written, its offset dropped and not applied; NULL if unreadable."""
    iso = r"^\d{4}-\d{2}-\d{2}"
    return let(date_text, lambda d: f"if({matches(d, iso)}, {parse_date(d)}.local, NULL)")


def feed_catalogue(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Per feed: path, title, description, number of items, day of the last update.

    ``items`` needs ``feed``, ``date_iso`` and ``modified_iso`` only. Counting and
    maximum combine on the map side; feeds without items are kept.
    """
    return catalogue_of(feeds, feed_totals(items))


def feed_totals(items: DataFrame) -> DataFrame:
    """``feed``, ``items`` and ``last``, the last update as wall-clock time. Totals of parts of the items add up to those of all."""
    dated = items.selectExpr(
        "feed", f"{_wall_clock(first_nonempty('date_iso', 'modified_iso'))} AS _at"
    )
    return dated.groupBy("feed").agg(F.count(F.lit(1)).alias("items"), F.max("_at").alias("last"))


def catalogue_of(feeds: DataFrame, totals: DataFrame) -> DataFrame:
    """The catalogue from totals per feed (``feed``, ``items``, ``last``), wherever they come from."""
    return (
        feeds.join(totals.selectExpr("feed", "items AS item_count", "last AS _last"), "feed", "left")
        .selectExpr("*", f"{first_nonempty('output_dir', 'feed')} AS path")
        .selectExpr(
            "feed",
            "path",
            "coalesce(title, path) AS title",
            f"coalesce({nonempty('description')}, {lit(fixed.NO_DESCRIPTION)}) AS description",
            "coalesce(item_count, 0) AS item_count",
            f"coalesce(date_format(_last, 'yyyy-MM-dd'), {lit(fixed.NO_DATE)}) AS last_updated",
        )
    )


def catalogue_listing(catalogue: DataFrame) -> DataFrame:
    """One row per feed with its links and ready-made html, ordered by path.

    The order is a range-partitioned sort, so the listing may have any length.
    """
    title, text = escape_html("title"), escape_html("description")
    entry = (
        f"""concat('<dt><a href="', json_url, '">', {title}, '</a> <a href="', rss_url, '">rss</a></dt><dd>',"""
        f""" {text}, ' (', item_count, ', ', last_updated, ')</dd>')"""
    )
    discovery = (
        f"""concat('<link rel="alternate" type="application/rss+xml" title="', {title},"""
        """ '" href="', rss_url, '">')"""
    )
    return (
        catalogue.selectExpr(
            "*", "concat(path, '/feed.json') AS json_url", "concat(path, '/feed.xml') AS rss_url"
        )
        .selectExpr("path", "json_url", "rss_url", f"{entry} AS entry", f"{discovery} AS autodiscovery")
        .orderBy("path")
    )


def write_page(lines: DataFrame, path: str) -> None:
    """The lines of ``catalogue_lines`` as text files whose name order is the page's order; one after the other they are the page.

    The sort that orders the lines is range-partitioned, and a task writes its range into a file of its own.
    """
    lines.select("line").write.mode("error").text(path)


def read_page(spark: SparkSession, path: str) -> DataFrame:
    """``pos`` (from 1) and ``line`` of a written page."""
    lines = spark.read.text(path).select(
        F.lit("page").alias("page"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line")
    )
    # rows of a file rise in the order they are read, whichever tasks read them
    return rank_within(lines, "page", [F.col("file"), F.col("row")], ["line"], "pos").select("pos", "line")


def catalogue_lines(
    listing: DataFrame,
    as_of: str,
    title: str | None = None,
    description: str | None = None,
) -> DataFrame:
    """The catalogue page as ordered lines (``section``, ``path``, ``line``).

    Sorted by section and path they make up the page; nothing is gathered into one
    row, so it can be written with a range-partitioned text sink.
    """
    spark = listing.sparkSession
    head = escape_html(lit(title or fixed.SITE_TITLE))
    about = escape_html(lit(description or fixed.SITE_DESCRIPTION))

    def single(section: int, line: str) -> DataFrame:
        return spark.range(1).selectExpr(f"{section} AS section", "'' AS path", f"{line} AS line")

    def rows(section: int, column: str) -> DataFrame:
        return listing.select(F.lit(section).alias("section"), "path", F.col(column).alias("line"))

    none = listing.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return (
        single(
            0,
            f"""concat('<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>', {head}, '</title>')""",
        )
        .unionByName(rows(1, "autodiscovery"))
        .unionByName(
            single(
                2,
                f"""concat('</head><body><h1>', {head}, '</h1>', {about}, '<dl>')""",
            )
        )
        .unionByName(rows(3, "entry"))
        .unionByName(
            none.select(
                F.lit(3).alias("section"), F.lit("").alias("path"), F.lit(fixed.NO_FEEDS).alias("line")
            )
        )
        .unionByName(
            single(4, lit(f"</dl><p>As of {as_of}</p></body></html>"))
        )
        .orderBy("section", "path")
    )
