"""The frontier: every link somebody wants in a feed, and what becomes of it.

A frontier has ``feed``, ``url`` and ``ord`` (any orderable column; unique per feed).
Bodies of pages never travel through these jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import strip
from feedlake.functions.url import canonical_url, domain, is_valid_url, url_id
from feedlake.operators.patterns import flagged, prepare


def union_sources(*sources: DataFrame) -> DataFrame:
    """One frontier out of several link tables, order kept explicit in ``ord``."""
    merged = reduce(lambda a, b: a.unionByName(b), sources)
    return merged.withColumn("ord", F.struct("source_rank", "ref_id", "source_ref", "part", "pos"))


def with_ids(frontier: DataFrame) -> DataFrame:
    """Add ``canonical_url``, ``id`` and ``valid``."""
    return frontier.selectExpr(
        "*", f"{canonical_url('url')} AS canonical_url", f"{is_valid_url('url')} AS valid"
    ).selectExpr("*", f"{url_id('canonical_url')} AS id")


def valid_only(frontier: DataFrame) -> DataFrame:
    return frontier.filter(is_valid_url("url"))


def links_per_domain(frontier: DataFrame) -> DataFrame:
    """Number of links per feed and domain."""
    domains = frontier.selectExpr("feed", f"{domain('url')} AS domain")
    return domains.groupBy("feed", "domain").agg(F.count(F.lit(1)).alias("links"))


# --- patterns --------------------------------------------------------------------


def effective_patterns(feeds: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns that apply to each feed: its own and the global ones (NULL feed)."""
    scopes = feeds.select(
        "feed",
        F.explode(F.array(F.col("feed"), F.lit(None).cast("string"))).alias("scope"),
    )
    p = patterns.select(F.col("feed").alias("scope_of"), "kind", "pattern")
    return scopes.join(p, F.col("scope").eqNullSafe(F.col("scope_of"))).selectExpr(
        "feed", "kind", f"lower({strip('pattern')}) AS pattern"
    )


def flag_patterns(frontier: DataFrame, feeds: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``blocked``; patterns without a feed hold for every link, also of feeds that are not in ``feeds``.

    The pattern table is counted now; ``patterns.prepare`` does so once for many frontiers.
    """
    return flagged(frontier, prepare(patterns))


def allow_listed(frontier: DataFrame, feeds: DataFrame, patterns: DataFrame) -> DataFrame:
    """Links that pass their feed's allow list."""
    return flag_patterns(frontier, feeds, patterns.filter("kind = 'allow'")).filter("allowed").select(
        *frontier.columns
    )


def not_blocked(frontier: DataFrame, feeds: DataFrame, patterns: DataFrame) -> DataFrame:
    """Links that no block pattern of their feed matches."""
    return flag_patterns(frontier, feeds, patterns.filter("kind = 'block'")).filter(~F.col("blocked")).select(
        *frontier.columns
    )


# --- identity --------------------------------------------------------------------


def first_seen(frontier: DataFrame, key: str = "id") -> DataFrame:
    """First link per (feed, id) in frontier order.

    ``min_by`` combines on the map side, so a link repeated millions of times arrives
    as one row per map task.
    """
    others = [c for c in frontier.columns if c not in ("feed", key)]
    return (
        frontier.groupBy("feed", key)
        .agg(F.min_by(F.struct(*others), F.col("ord")).alias("_row"))
        .select("feed", key, *[F.col("_row")[c].alias(c) for c in others])
        .select(*frontier.columns)
    )


def not_stored(frontier: DataFrame, stored: DataFrame) -> DataFrame:
    """Links whose id the feed does not hold yet."""
    return frontier.join(stored.select("feed", "id"), ["feed", "id"], "left_anti").select(
        *frontier.columns
    )
