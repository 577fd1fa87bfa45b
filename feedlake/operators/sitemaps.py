"""Landed sitemap files of many hosts, index files included, and the article links of every website page.

A file lies where it came from: ``.../<scheme>/<host>/<name>`` is ``<scheme>://<host>/<name>``. Three names are candidates for a host; others
count only as parts that an index file points to. Index entries are rows of their own, joined to the files they name, so an index of
any length is no row of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.functions import html as H
from feedlake.functions import links as L
from feedlake.functions.sql import let, lits
from feedlake.functions.url import url_parts
from feedlake.operators.links import exploded

#: Pages of one host in a task; a host with more is split.
HOST_ROWS = 100_000

_PLACE = r"^.*?/(https?)/([^/]+)/(.+)$"


def host_of(url: str) -> str:
    """``<scheme>://<host>`` with the port, in lower case."""
    return let(url_parts(url), lambda u: f"lower(concat({u}[0], '://', {u}[1]))")


def located(files: DataFrame) -> DataFrame:
    """Landed files (``path``, ``xml``) by their addresses: ``site``, ``address``, ``candidate`` (from 0; -1: none), ``xml``; one for each address."""
    parts = files.selectExpr(
        "path",
        "xml",
        f"concat(regexp_extract(path, '{_PLACE}', 1), '://', lower(regexp_extract(path, '{_PLACE}', 2))) AS site",
        f"regexp_extract(path, '{_PLACE}', 3) AS name",
    ).where("name <> ''")
    named = parts.selectExpr("path", "xml", "site", "concat(site, '/', name) AS address", f"coalesce(array_position(array({lits(fixed.SITEMAP_NAMES)}), lower(name)), 0) - 1 AS candidate")
    return named.groupBy("site", "address", "candidate").agg(F.min_by("xml", "path").alias("xml"))


def map_links(files: DataFrame, limit: int = fixed.MAX_SITE_LINKS, follow: bool = True) -> DataFrame:
    """``site``, ``candidate``, ``urls``: the first ``limit`` locations of each site's first candidate that has any.

    With ``follow`` the locations of an index file are its own and then those of the files it names, in its order, as far as they have landed;
    without, entries of an index are passed over.
    """
    read = located(files).selectExpr("site", "candidate", "address", f"slice({L.sitemap_locations('xml')}, 1, {limit}) AS urls", f"if(candidate >= 0, {L.sitemap_parts('xml')}, NULL) AS parts")
    own = read.where("candidate >= 0").selectExpr("site", "candidate", "-1 AS part", "posexplode(urls) AS (pos, url)")
    if follow:
        named = read.where("candidate >= 0").selectExpr("site", "candidate", "posexplode(parts) AS (part, address)")
        held = read.selectExpr("address", "urls").where("size(urls) > 0")
        own = own.unionByName(named.join(held, "address").selectExpr("site", "candidate", "part", "posexplode(urls) AS (pos, url)"))
    order = Window.partitionBy("site", "candidate").orderBy("part", "pos")
    first = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)  # a limit that each task applies first
    lists = first.groupBy("site", "candidate").agg(F.array_sort(F.collect_list(F.struct("_n", "url"))).alias("_l"))
    return lists.groupBy("site").agg(F.min("candidate").alias("candidate"), F.min_by(F.transform("_l", lambda x: x["url"]), "candidate").alias("urls"))


def host_links(sites: DataFrame, files: DataFrame, keep: list[str], limit: int = fixed.MAX_SITE_LINKS, follow: bool = True, host_rows: int = HOST_ROWS) -> DataFrame:
    """Up to ``limit`` article links for every page of ``sites`` (``url``, ``html``): ``keep``, ``pos``, ``url``.

    First those of its host's sitemap, by scheme and host with its port; the page's own are added only if those are fewer than ``limit``. No html is
    shuffled: links are read where the page lies. A host with more than ``host_rows`` pages is dealt over as many tasks as that takes, and
    its one row of sitemap links is repeated for each.
    """
    pages = sites.selectExpr(*keep, "url AS site", f"{H.visible('html')} AS doc").selectExpr(
        *keep, "site", f"{host_of('site')} AS _host", f"{L.page_links('site', 'doc')} AS own"
    )
    counts = sites.selectExpr(f"{host_of('url')} AS _host").groupBy("_host").agg(F.count("*").alias("n"))
    # at most one row for each host_rows pages
    crowded = counts.where(F.col("n") > host_rows).select("_host", F.ceil(F.col("n") / host_rows).cast("int").alias("_salts"))
    maps = map_links(files, limit, follow).selectExpr("site AS _host", "array_distinct(urls) AS mapped")
    salts = F.coalesce("_salts", F.lit(1))
    spread = maps.join(crowded, "_host", "left").select("_host", "mapped", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    dealt = pages.join(crowded, "_host", "left").withColumn("_salt", F.pmod(F.xxhash64("site", *keep), salts).cast("int"))
    merged = f"if(size(mapped) >= {limit}, mapped, array_distinct(concat(coalesce(mapped, array()), own)))"
    both = dealt.join(spread, ["_host", "_salt"], "left").selectExpr(*keep, "site", f"{merged} AS merged")
    return exploded(both, keep, f"slice({L.article_links('merged', 'site')}, 1, {limit})")
