"""Inputs with links, dates and media, derived from the given tables.

The given pages carry no meta tags, notes, boards or sitemaps, so those are built from
``pages``, ``documents`` and ``conversations`` by plain string building, row by row and
over the whole tables. The SQL text runs unchanged in Spark SQL and in the checking
database unless a dialect is named.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.dates import date_columns
from feedlake.functions.url import page_id_of
from feedlake.schema import ATTACHMENTS, AUTHORS, FEEDS, PATTERNS
from feedlake.sources.config import local_table
from feedlake.sources.landed import page_corpus

AS_OF = dt.datetime(2025, 12, 29)

FEED_OF_URL = "regexp_extract(url, '//[^/]+/([a-z]{2})/', 1)"

_DAY = "lpad(concat('', 1 + page_id % 28), 2, '0')"

PAGES_X = f"""
SELECT page_id, {FEED_OF_URL} AS feed,
  CASE WHEN page_id % 13 = 0 THEN concat('https://media.example.com/files/ep%20', page_id,
            CASE WHEN page_id % 3 = 0 THEN '.mp3' WHEN page_id % 3 = 1 THEN '.pdf?dl=1' ELSE '.AVI' END)
       WHEN page_id % 17 = 0 THEN
            CASE WHEN page_id % 3 = 0 THEN concat('https://www.youtube.com/watch?v=vid_', page_id)
                 WHEN page_id % 3 = 1 THEN concat('https://youtu.be/vid-', page_id)
                 ELSE concat('https://youtube.com/shorts/v', page_id) END
       ELSE url END AS url,
  replace(replace(
    replace(replace(
      CASE WHEN page_id % 19 = 0 THEN replace(replace(html, '<title>', '<!--'), '</title>', '-->') ELSE html END,
      '<article', concat(CASE WHEN page_id % 8 = 3 THEN '<main-nav><p>No part of it</p></main-nav><article-list><p>Neither</p></article-list>' ELSE '' END, '<article')),
      '</article>', CASE WHEN page_id % 16 = 5 THEN '<article class="in"><p>Inner one</p></article><p>After it</p></article >'
                         WHEN page_id % 32 = 9 THEN '' ELSE '</article>' END),
    '<meta charset="utf-8">', concat('<meta charset="utf-8">',
      CASE WHEN page_id % 4 = 0 THEN concat('<meta property="og:title" content=" OG ', page_id, ' ">') ELSE '' END,
      CASE WHEN page_id % 4 = 1 THEN concat('<meta name="twitter:title" content="TW ', page_id, '">') ELSE '' END,
      CASE WHEN page_id % 3 = 0 THEN concat('<meta name="description" content="Desc ', page_id, '">') ELSE '' END,
      CASE WHEN page_id % 6 = 0 THEN concat('<meta property="og:description" content="OGD ', page_id, '">') ELSE '' END,
      CASE WHEN page_id % 7 = 0 THEN concat('<meta name="author" content="By Author ', page_id % 5, '">') ELSE '' END,
      CASE WHEN page_id % 11 = 0 THEN '<meta property="article:published_time" content="soon">'
           WHEN page_id % 5 = 0 THEN concat('<meta property="article:published_time" content="2025-01-', {_DAY}, 'T10:00:00Z">')
           WHEN page_id % 5 = 1 THEN concat('<script type="application/ld+json">{{"datePublished":"2025-02-', {_DAY}, '"}}</script>')
           WHEN page_id % 5 = 2 THEN concat('<script type="application/ld+json">[{{"x":1}},{{"dateCreated":"2025-03-', {_DAY}, '"}}]</script>')
           ELSE '' END,
      CASE WHEN page_id % 17 = 0 THEN concat('<meta itemprop="duration" content="PT1H', page_id % 60,
                'M5S"><link itemprop="name" content="Channel ', page_id % 4, '">') ELSE '' END)),
    '</h1>', concat('</h1>',
      CASE WHEN page_id % 5 = 3 THEN concat('<time datetime="2025-04-', {_DAY}, '">x</time>') ELSE '' END,
      CASE WHEN page_id % 10 = 4 THEN '<p>Published June 13, 2025</p>' WHEN page_id % 10 = 9 THEN '<p>Published yesterday</p>' ELSE '' END,
      CASE WHEN page_id % 2 = 0 THEN concat('<div><a href="/blog/', page_id, '">a</a><a href="/tag/x/">b</a><a href="/i.png">c</a>',
           '<a href="https://other.example.org/post/', page_id, '">d</a><a href="#top">e</a></div>') ELSE '' END)) AS html
FROM pages
"""

_LATE = "(13 + page_id % 15)"  # a day that can't be a month

# Dates as pages write them, in fifteen shapes, and two texts that are none.
DATE_TEXTS = f"""
SELECT page_id, CASE page_id % 18 WHEN 0 THEN concat('2025-03-', {_DAY}, 'T10:00:00Z') WHEN 1 THEN concat('2025-03-', {_DAY}) WHEN 2 THEN concat('2025/03/', {_DAY}, ' 08:30')
  WHEN 3 THEN concat('202503', {_DAY}, 'T100000Z') WHEN 4 THEN concat({_LATE}, '.03.2025') WHEN 5 THEN concat('03/', {_LATE}, '/2025 9:05 PM')
  WHEN 6 THEN concat('March ', 1 + page_id % 28, ', 2025') WHEN 7 THEN concat({_DAY}, ' Mar 2025 10:00:00 +0200') WHEN 8 THEN concat('Sat, ', {_DAY}, ' Mar 2025 10:00:00 GMT')
  WHEN 9 THEN concat('Mar ', {_DAY}, ' 10:00:00 UTC 2025') WHEN 10 THEN concat('10:00 ', {_DAY}, ' Mar 2025') WHEN 11 THEN concat({_LATE}, '/03/25')
  WHEN 12 THEN concat('2025-03-', {_DAY}, 'T10:00:00.250-05:00') WHEN 13 THEN concat('March ', 1 + page_id % 28, 'th, 2025 at 7:15 am') WHEN 14 THEN concat('202503', {_DAY})
  WHEN 15 THEN 'soon' WHEN 16 THEN concat('week ', page_id % 50, ' of 2025') ELSE '' END AS date_raw
FROM pages
"""

NOTES = """
SELECT d.doc_id, d.lang, concat(d.text, chr(10),
  'see [one](', coalesce(p.url, concat('https://docs.example.com/en/', d.doc_id)), ') and ![img](https://img.example.com/', d.doc_id, '.png)', chr(10),
  'bare ', coalesce(p.url, concat('https://docs.example.com/en/', d.doc_id)), '. end https://notes.example.com/', d.doc_id,
  ', and https://tail.example.com/', d.doc_id, 'z)', chr(10),
  '(https://skip.example.com/', d.doc_id, ')') AS content
FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id
"""

CARDS = """
SELECT c.conv_id AS board, c.turn AS card, concat('L', c.turn % 5) AS idlist,
  CASE WHEN c.turn % 7 = 6 THEN NULL ELSE c.turn % 5 = 4 END AS closed,
  concat('Read ', coalesce(p.url, concat('https://talks.example.com/en/', c.conv_id)), '| later') AS name,
  CASE WHEN c.turn % 3 = 0 THEN NULL ELSE concat(c.text, ' also https://trello.com/c/', c.turn, ' and ',
      coalesce(p.url, concat('https://talks.example.com/en/', c.conv_id)), '?c=', c.turn, ',') END AS descr
FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id
"""

BOARD_LISTS = """
SELECT DISTINCT conv_id AS board, concat('L', turn % 5) AS idlist, concat('List ', turn % 5) AS list_name
FROM conversations
"""

_LONG_SITEMAP = {
    "spark": "array_join(transform(sequence(1, 120), i -> concat('<url><loc>', url, '/s', i, '</loc></url>')), '')",
    "check": "array_to_string(list_transform(range(1, 121), lambda i: concat('<url><loc>', url, '/s', i, '</loc></url>')), '')",
}


def sitemaps(dialect: str) -> str:
    """Three sitemap candidates per page, taken as a website of its own."""
    return f"""
SELECT url AS site, 1 AS candidate, CASE WHEN page_id % 2 = 1 THEN '<urlset></urlset>'
  ELSE concat('<urlset><url><loc> ', url, '/one </loc></url><url><lastmod>2025</lastmod><loc>', url, '/tag/two/</loc></url></urlset>') END AS xml
FROM pages
UNION ALL
SELECT url, 2, CASE WHEN page_id % 9 = 1 THEN concat('<urlset>', {_LONG_SITEMAP[dialect]}, '</urlset>')
  WHEN page_id % 9 = 3 THEN concat('<sitemapindex><sitemap><loc>', url, '/other.xml</loc></sitemap></sitemapindex>')
  ELSE concat('<urlset><url><loc>', url, '/two</loc></url><url><loc></loc></url></urlset>') END
FROM pages
UNION ALL
SELECT url, 3, concat('<urlset><url><loc>', url, '/three</loc></url></urlset>') FROM pages
"""


_HOST = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PLACE = "concat('/landed/', replace(host, '://', '/'), '/"

# Landed sitemap files of every host: a plain one that is often empty, an index of ten parts, and a third candidate.
SITEMAP_FILES = f"""
SELECT {_PLACE}sitemap.xml') AS path, CASE WHEN length(host) % 3 = 0 THEN concat('<urlset><url><loc>', host, '/direct/one</loc></url></urlset>') ELSE '<urlset></urlset>' END AS xml
FROM (SELECT DISTINCT {_HOST} AS host FROM pages) h
UNION ALL
SELECT {_PLACE}sitemap_index.xml'), concat('<sitemapindex>', {", ".join(f"'<sitemap><loc>', host, '/maps/{k}.xml</loc></sitemap>'" for k in (3, 1, 4, 0, 5, 9, 2, 6, 8, 7))}, '</sitemapindex>')
FROM (SELECT DISTINCT {_HOST} AS host FROM pages) h WHERE length(host) % 2 = 0
UNION ALL
SELECT {_PLACE}maps/', k, '.xml'), concat('<urlset><url><loc>', low, '</loc></url><url><loc> ', high, '/more </loc></url></urlset>')
FROM (SELECT host, k, min(url) AS low, max(url) AS high FROM (SELECT {_HOST} AS host, page_id % 10 AS k, url FROM pages) p GROUP BY host, k) m
UNION ALL
SELECT {_PLACE}sitemap-index.xml'), concat('<urlset><url><loc>', host, '/third</loc></url></urlset>') FROM (SELECT DISTINCT {_HOST} AS host FROM pages) h
"""

# The pages as they arrive in four batches: some are lost at first (404) and come again at the end, others simply come again.
ARRIVALS = """
SELECT page_id, url, html, CASE WHEN page_id % 23 = 7 THEN 404 ELSE 200 END AS status, CAST(page_id % 4 AS INTEGER) AS batch FROM pages
UNION ALL
SELECT page_id, url, html, 200, 3 FROM pages WHERE page_id % 46 = 7
UNION ALL
SELECT page_id, url, concat(html, ' '), 200, CAST(page_id % 4 + 1 AS INTEGER) FROM pages WHERE page_id % 10 = 0 AND page_id % 4 < 3
"""

FRONTIER = f"""
SELECT {FEED_OF_URL} AS feed, page_id * 4 AS ord, url FROM pages
UNION ALL
SELECT {FEED_OF_URL}, page_id * 4 + 1, concat(url, CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'gclid=1')
FROM pages WHERE url NOT LIKE '%#%'
UNION ALL
SELECT {FEED_OF_URL}, page_id * 4 + 2, concat('ftp://x.example.com/', page_id) FROM pages
UNION ALL
SELECT {FEED_OF_URL}, page_id * 4 + 3, concat('https://lost.example.com/', page_id) FROM pages
"""

# What the feeds hold already: the pages known under a plain http address.
STORED = f"SELECT {FEED_OF_URL} AS feed, page_id, url FROM pages WHERE url LIKE 'http:%'"

PATTERN_ROWS = [
    (None, "block", "*.cheap-pills.example.com"),
    ("en", "allow", "*.example.com"),
    ("en", "allow", "*.example.net"),
    ("de", "allow", "https://www.*"),
    ("fr", "block", "blog.*"),
]

# A glob for every page, from its own url: the end, the beginning, or a piece of the middle with any one sign after it.
GLOBS = f"""
SELECT CASE WHEN page_id % 3 = 0 THEN NULL ELSE {FEED_OF_URL} END AS feed, CASE WHEN page_id % 2 = 0 THEN 'allow' ELSE 'block' END AS kind,
  CASE WHEN page_id % 4 = 0 THEN concat('*', substring(lower(url), length(url) - 11, 12)) WHEN page_id % 4 = 1 THEN concat(substring(lower(url), 1, 30), '*')
    ELSE concat('*', substring(lower(url), 20, 9), '?[!0]*') END AS pattern
FROM pages
"""

FEED_ROWS = [
    ("en", "Feed <en>", "https://en.example.com", None, "English & more", "en", None),
    ("de", "Feed de", None, "https://de.example.com/feed.json", None, "de", "out/de"),
    ("fr", "Feed fr", None, None, 'Le "fil"', "fr", None),
    ("es", None, None, None, None, None, None),
    ("it", "Feed it", None, None, None, None, None),
]

RAW_TAGS = """
SELECT doc_id, concat('1. ', replace(text, ' ', concat(chr(10),
  CASE WHEN doc_id % 4 = 0 THEN '- ' WHEN doc_id % 4 = 1 THEN '* ' WHEN doc_id % 4 = 2 THEN '12. ' ELSE ' ' END)),
  chr(10), 'Last Line!') AS raw
FROM documents
"""

ITEMS_RAW = f"""
SELECT {FEED_OF_URL} AS feed, page_id, url,
  CASE WHEN page_id % 6 = 5 THEN '' ELSE concat('T', chr(1), 'itle <', page_id, '> & "x"', chr(11)) END AS title,
  CASE WHEN page_id % 2 = 0 THEN concat('Summary ', chr(7), page_id) END AS summary,
  concat('<p>', page_id, '</p>') AS content_html,
  CASE page_id % 5 WHEN 0 THEN concat('2025-01-', {_DAY}, 'T23:30:00-05:00') WHEN 1 THEN concat('2025-02-', {_DAY}, 'T08:30:00')
    WHEN 2 THEN concat('2025-01-', {_DAY}, 'T10:00:00Z') WHEN 3 THEN 'not a date' END AS published_raw,
  CASE WHEN page_id % 5 = 4 THEN concat('2025-03-', {_DAY}) END AS modified_raw,
  CASE WHEN page_id % 3 = 0 THEN concat('Author ', page_id % 5) END AS author,
  CASE WHEN page_id % 4 = 0 THEN concat('https://cdn.example.com/', page_id, '.mp3') END AS media_url,
  CASE WHEN page_id % 8 = 0 THEN page_id * 10 END AS media_size,
  page_id % 7 AS topic
FROM pages
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The given small tables are one file with one row group each; give every core some of it.

    Only for these test inputs: a table of several files is returned as it is, so real bodies never move.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def derive(spark: SparkSession, sf_dir: str, sql: str, heavy: bool = False) -> DataFrame:
    """Run fixture SQL over the tables below ``sf_dir``; ``heavy`` for work on whole texts."""
    for name in ("pages", "documents", "conversations"):
        view = f"feedlake_{name}"
        if f" {name}" in sql:
            source = table(spark, sf_dir, name)
            (spread(source) if heavy else source).createOrReplaceTempView(view)
            for keyword in ("FROM", "JOIN"):
                sql = sql.replace(f"{keyword} {name}", f"{keyword} {view}")
    return spark.sql(sql)


def pages_x(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Pages with meta tags, dates, links, media and videos, as a page corpus."""
    return page_corpus(derive(spark, sf_dir, PAGES_X, heavy))


def feeds(spark: SparkSession) -> DataFrame:
    return local_table(spark, FEED_ROWS, FEEDS)


def patterns(spark: SparkSession) -> DataFrame:
    return local_table(spark, PATTERN_ROWS, PATTERNS)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feed``, ``id``, ``page_id`` of the stored items."""
    return derive(spark, sf_dir, STORED).selectExpr("feed", "page_id", f"{page_id_of('url')} AS id")


def typed_items(raw: DataFrame) -> DataFrame:
    """``ITEMS_RAW`` rows as items, one per page; ``ord`` is the page id."""

    return raw.selectExpr(
        "feed",
        f"{page_id_of('url')} AS id",
        "url",
        "title",
        "summary",
        "content_html",
        *date_columns("published_raw", "date_published", "date_local", "date_iso"),
        *date_columns("modified_raw", "date_modified", "modified_local", "modified_iso"),
        f"CAST(if(author IS NULL, array(), array(struct(author, NULL))) AS {AUTHORS}) AS authors",
        "feed AS language",
        "array(feed, concat('topic', topic)) AS tags",
        "CAST(if(media_url IS NULL, array(), array(struct(media_url, 'audio/mpeg', media_size, NULL)))"
        f" AS {ATTACHMENTS}) AS attachments",
        "page_id AS ord",
    )


def items_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all pages, one per (feed, id), the lowest page first."""
    items = typed_items(derive(spark, sf_dir, ITEMS_RAW))
    others = [c for c in items.columns if c not in ("feed", "id")]
    return (
        items.groupBy("feed", "id")
        .agg(F.min_by(F.struct(*others), "ord").alias("_i"))
        .select("feed", "id", "_i.*")
        .select(*items.columns)
    )
