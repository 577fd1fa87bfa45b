"""The whole run: many feeds, one job.

``feed`` is a key in every step, so one feed or a million are the same plan. Bodies are
read once per page no matter how many feeds want it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.operators import frontier as FR
from feedlake.operators import pages as PG
from feedlake.operators.funnel import ingest_funnel
from feedlake.operators.ranking import rank_within
from feedlake.schema import ITEM_COLUMNS


def new_links(
    frontier: DataFrame, feeds: DataFrame, patterns: DataFrame, stored: DataFrame
) -> DataFrame:
    """Valid, allowed, not blocked, first-seen links that are not stored yet."""
    checked = FR.flag_patterns(FR.with_ids(frontier).filter("valid"), feeds, patterns)
    kept = checked.filter("allowed AND NOT blocked").select("feed", "id", "url", "ord")
    return FR.not_stored(FR.first_seen(kept), stored)


def fetched_links(links: DataFrame, pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Links with their page; one per (feed, page), the earliest, if the feed does not hold the page yet."""
    matched = FR.first_seen(PG.match_pages(links, pages), key="final_id")
    return matched.join(stored.selectExpr("feed", "id AS final_id"), ["feed", "final_id"], "left_anti").select(*matched.columns)


def items_of(links: DataFrame, pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Items of matched links; each page is parsed once and then joined to its feeds."""
    bodies = PG.with_page_ids(PG.wanted_pages(links, pages))
    parsed = PG.page_items(bodies, as_of, ["page_id"])
    placed = links.select("feed", "ord", "page_id")
    return parsed.join(placed, "page_id").select("feed", *ITEM_COLUMNS, "ord")


def collect_items(
    frontier: DataFrame,
    feeds: DataFrame,
    patterns: DataFrame,
    stored: DataFrame,
    pages: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """New items of all feeds; ``ord`` is the position among the new ones, from 0."""
    links = fetched_links(new_links(frontier, feeds, patterns, stored), pages, stored)
    placed = rank_within(links, "feed", [F.col("ord")], ["page_id"])
    dense = placed.select("feed", "page_id", (F.col("rank") - 1).alias("ord"))
    return items_of(dense, pages, as_of)


def funnel_of(
    frontier: DataFrame, feeds: DataFrame, patterns: DataFrame, stored: DataFrame, pages: DataFrame
) -> DataFrame:
    flagged = FR.flag_patterns(FR.with_ids(frontier), feeds, patterns)
    return ingest_funnel(flagged, stored, pages)
