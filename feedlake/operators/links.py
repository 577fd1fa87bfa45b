"""Link discovery: notes, boards, sitemaps and stored pages to frontier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.functions import html as H
from feedlake.functions import links as L
from feedlake.functions.sql import lit
from feedlake.functions.url import domain


def exploded(df: DataFrame, keep: list[str], array: str, names: str = "pos, url") -> DataFrame:
    """One row per element of a computed array.

    The outer form plus a filter on the position: for the inner form the optimizer infers
    a filter on the array itself and would compute it two more times.
    """
    rows = df.selectExpr(*keep, f"posexplode_outer({array}) AS ({names})")
    return rows.filter("pos IS NOT NULL")


def note_links(notes: DataFrame, keep: list[str], text: str = "content") -> DataFrame:
    """One row per distinct link of each note: ``keep``, ``pos``, ``url``."""
    return exploded(notes, keep, L.markdown_links(text))


def open_cards(cards: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Cards that are not closed and, for boards with a list filter, on a wanted list.

    ``lists`` has ``board`` and ``idlist``; a board without rows there is not filtered.
    A card without a list fails any filter.
    """
    kept = cards.filter("NOT coalesce(closed, false)")
    if lists is None:
        return kept
    # a board's filter is a handful of list ids, so it travels as one array per board
    wanted = lists.groupBy("board").agg(F.collect_set("idlist").alias("_wanted"))
    return (
        kept.join(wanted, "board", "left")
        .filter("_wanted IS NULL OR coalesce(array_contains(_wanted, idlist), false)")
        .select(*cards.columns)
    )


_CARD_LINKS = f"concat({L.text_links('name')}, {L.text_links('descr')})"


def card_links(cards: DataFrame, keep: list[str]) -> DataFrame:
    """Links of each card, name before description: ``keep``, ``pos``, ``url``."""
    return exploded(cards, keep, _CARD_LINKS)


def board_links(cards: DataFrame) -> DataFrame:
    """First occurrence of each link per board: ``board``, ``card``, ``pos``, ``url``."""
    found = card_links(cards, ["board", "card"])
    return (
        found.groupBy("board", "url")
        .agg(F.min(F.struct("card", "pos")).alias("_first"))
        .select("board", "_first.card", "_first.pos", "url")
    )


def board_list_counts(cards: DataFrame, lists: DataFrame) -> DataFrame:
    """Links per board list: ``board``, ``list_name``, ``cards``, ``links``."""
    per_card = cards.selectExpr("board", "idlist", f"size({_CARD_LINKS}) AS n")
    counts = per_card.groupBy("board", "idlist").agg(
        F.count(F.lit(1)).alias("cards"), F.sum("n").alias("links")
    )
    return counts.join(lists, ["board", "idlist"]).select("board", "list_name", "cards", "links")


def sitemap_links(sitemaps: DataFrame) -> DataFrame:
    """All locations of all landed sitemaps: ``site``, ``candidate``, ``pos``, ``url``."""
    return exploded(sitemaps, ["site", "candidate"], L.sitemap_locations("xml"))


def landed_candidates(files: DataFrame) -> DataFrame:
    """Landed sitemap files (``path``, ``xml``) as candidates of a host: ``site``, ``candidate``, ``xml``.

    A file lies in a folder named like the host (with its port); its name says which candidate it is, others are left out.
    """
    names = ", ".join(lit(n) for n in fixed.SITEMAP_NAMES)
    parts = files.selectExpr("path", "xml", r"lower(regexp_extract(path, '([^/]+)/[^/]+$', 1)) AS site", rf"array_position(array({names}), lower(regexp_extract(path, '([^/]+)$', 1))) - 1 AS candidate")
    known = parts.filter("candidate >= 0 AND site <> ''")
    return known.groupBy("site", "candidate").agg(F.min_by("xml", "path").alias("xml"))


def first_sitemap(sitemaps: DataFrame, limit: int | None = None) -> DataFrame:
    """Per site the (first ``limit``) locations of its first candidate that has any.

    At most three candidates exist per site, so a group is never large.
    """
    found = L.sitemap_locations("xml")
    return (
        sitemaps.selectExpr("site", "candidate", f"{f'slice({found}, 1, {limit})' if limit else found} AS urls")
        .filter(F.size("urls") > 0)
        .groupBy("site")
        .agg(
            F.min("candidate").alias("candidate"),
            F.min_by("urls", "candidate").alias("urls"),
        )
    )


def outlinks(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Article links of each stored page: ``keep``, ``pos``, ``url``."""
    found = L.article_links(L.page_links("url", "doc"), "url")
    docs = pages.selectExpr(*keep, "url", f"{H.visible('html')} AS doc")
    return exploded(docs, keep, found)


def site_links(
    sites: DataFrame,
    sitemaps: DataFrame,
    keep: list[str],
    limit: int = fixed.MAX_SITE_LINKS,
    by_host: bool = False,
) -> DataFrame:
    """Up to ``limit`` article links per website, sitemap first.

    ``sites`` holds the website's page (``url``, ``html``), ``sitemaps`` its landed
    sitemap candidates keyed by ``site``: its url or, ``by_host``, its host (see ``landed_candidates``). The first ``limit`` sitemap locations are
    taken; the page's own links are added only if those are fewer. The limit is a
    property of the scrape, and all lists are per website, so this is one join and
    otherwise row-local.
    """
    first = first_sitemap(sitemaps, limit).selectExpr("site AS _key", "array_distinct(urls) AS mapped")
    pages = sites.selectExpr(*keep, "url AS site", f"{H.visible('html')} AS doc").selectExpr(
        *keep, "site", f"{domain('site') if by_host else 'site'} AS _key", f"{L.page_links('site', 'doc')} AS own"
    )
    merged = f"if(size(mapped) >= {limit}, mapped, array_distinct(concat(coalesce(mapped, array()), own)))"
    both = pages.join(first, "_key", "left").selectExpr(*keep, "site", f"{merged} AS merged")
    return exploded(both, keep, f"slice({L.article_links('merged', 'site')}, 1, {limit})")
