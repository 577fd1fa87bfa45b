"""Feed assembly: merge, documents, rss ranking, enclosures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.functions import dates
from feedlake.functions.sql import each, extract, first_nonempty, keep, lit, nonempty
from feedlake.functions.text import escape_html, xml_clean
from feedlake.operators.ranking import measured_within, rank_within
from feedlake.schema import ITEM_COLUMNS

# A feed document ends after this many items, or with the item that reaches so many bytes of text;
# a larger feed continues on further pages, linked with ``next_url``. No item is left out, and a document
# holds at most PAGE_BYTES and one item more.
PAGE_ITEMS = 1000
PAGE_BYTES = 8 << 20


# --- merge -------------------------------------------------------------------------


def new_items_only(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New items whose id the feed does not hold, numbered after the stored ones."""
    last = stored.groupBy("feed").agg(F.max("ord").alias("_last"))
    return (
        new.join(stored.select("feed", "id"), ["feed", "id"], "left_anti")
        .join(last, "feed", "left")
        .withColumn("ord", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("ord"))
        .select(*new.columns)
    )


def merge_append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored items first and unchanged, then the new ones."""
    return stored.unionByName(new_items_only(stored, new))


def merge_rebuild(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New items replace a feed; feeds without new items keep what they have."""
    rebuilt = new.select("feed").distinct()
    return new.unionByName(stored.join(rebuilt, "feed", "left_anti").select(*new.columns))


def dry_run(stored: DataFrame, new: DataFrame) -> DataFrame:
    """What a merge would add: ``feed``, ``id``, ``label``."""
    return new_items_only(stored, new).selectExpr(
        "feed", "id", f"{first_nonempty('title', 'url')} AS label"
    )


def _by_feed(items: DataFrame) -> DataFrame:
    """Rows of a feed together, so that a small one is one file; adaptive execution splits a large one."""
    return items.hint("rebalance", "feed")


def append_items(stored: DataFrame, new: DataFrame, path: str) -> None:
    """Append sink: only the delta is written, few files a feed."""
    _by_feed(new_items_only(stored, new)).write.mode("append").partitionBy("feed").parquet(path)


def rebuild_items(new: DataFrame, path: str) -> None:
    """Rebuild sink: overwrites exactly the feeds that have new items."""
    _by_feed(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed").parquet(path)


# --- JSON Feed ---------------------------------------------------------------------


_TEXT_FIELDS = ("title", "summary", "content_html")


def item_json() -> str:
    """One JSON Feed item; empty fields are left out, key order is fixed."""
    texts = [f"{nonempty(name)} AS {name}" for name in _TEXT_FIELDS]
    lists = {name: f"if(size({name}) > 0, {name}, NULL) AS {name}" for name in ("authors", "tags", "attachments")}
    fields = [
        "id",
        "url",
        *texts,
        "date_iso AS date_published",
        "modified_iso AS date_modified",
        lists["authors"],
        f"{nonempty('language')} AS language",
        lists["tags"],
        lists["attachments"],
    ]
    return f"to_json(struct({', '.join(fields)}))"


def json_items(items: DataFrame) -> DataFrame:
    return items.selectExpr("feed", "id", "ord", f"{item_json()} AS item")


def page_key(rank: str, before: str, page_items: int, page_bytes: int) -> Column:
    """Rises by one or more wherever a page ends; places without a gap between them share it."""
    return F.floor((F.col(rank) - 1) / page_items) + F.floor(F.col(before) / page_bytes)


def _paged(items: DataFrame, order: list[Column], text: str, page_items: int, page_bytes: int) -> DataFrame:
    """Texts of each feed gathered per document page, in order: ``feed``, ``page``, ``texts``.

    A row's place among the items and bytes of its feed (a distributed prefix sum) says on which page it is: a new
    one begins wherever a multiple of ``page_items`` or of ``page_bytes`` is passed. The places that pages begin at are
    numbered afterwards, one row a page. The text travels with its row through the one sort, so a stored
    row is rendered once, also where a feed holds an id twice.
    """
    texts = items.selectExpr("feed", "id", "ord", "date_published", f"{text} AS _text").withColumn("_bytes", F.octet_length("_text"))
    placed = measured_within(texts, "feed", order, ["_text"], "_bytes")
    key = page_key("rank", "before", page_items, page_bytes)
    gathered = (
        placed.withColumn("_key", key)
        .groupBy("feed", "_key")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "_text"))).alias("_rows"))
        .select("feed", "_key", F.transform("_rows", lambda r: r["_text"]).alias("texts"))
    )
    numbers = rank_within(placed.select("feed", key.alias("_key")).distinct(), "feed", [F.col("_key")], ["_key"], "page")
    return gathered.join(numbers, ["feed", "_key"]).select("feed", F.col("page").cast("int").alias("page"), "texts")


def _document_pages(feeds: DataFrame, paged: DataFrame) -> DataFrame:
    """Every feed has page 1, even without items; ``pages`` is the number of pages."""
    counts = paged.groupBy("feed").agg(F.max("page").alias("pages"))
    heads = feeds.join(counts, "feed", "left").select(
        *feeds.columns,
        F.coalesce("pages", F.lit(1)).alias("pages"),
        F.explode(F.sequence(F.lit(1), F.coalesce("pages", F.lit(1)))).alias("page"),
    )
    return heads.join(paged, ["feed", "page"], "left").withColumn(
        "texts", F.coalesce("texts", F.array().cast("array<string>"))
    )


def json_documents(feeds: DataFrame, items: DataFrame, page_items: int = PAGE_ITEMS, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """JSON Feed 1.1 documents: ``feed``, ``page``, ``document``; stored order. ``_page`` is the number of the page."""
    paged = _paged(items, [F.col("ord"), F.col("id")], item_json(), page_items, page_bytes)
    header = ", ".join(
        [
            f"{lit(fixed.JSON_FEED_VERSION)} AS version",
            f"coalesce(title, {lit(fixed.UNTITLED_FEED)}) AS title",
            f"{nonempty('home_page_url')} AS home_page_url",
            f"{nonempty('feed_url')} AS feed_url",
            "if(page < pages, concat('feed-', page + 1, '.json'), NULL) AS next_url",
            "page AS _page",
            f"{nonempty('description')} AS description",
            f"{nonempty('language')} AS language",
        ]
    )
    return _document_pages(feeds, paged).selectExpr(
        "feed",
        "page",
        f"""concat(rtrim('}}', to_json(struct({header}))), ',"items":[', array_join(texts, ','), ']}}') AS document""",
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One file for each document, in the folder ``feed=<feed>/page=<page>``; ``sinks.published`` puts them under their names."""
    pages = documents.select("feed", "page", "document").repartition("feed", "page")
    pages.write.mode("overwrite").partitionBy("feed", "page").option("lineSep", "\n").text(path)


# --- published documents -----------------------------------------------------------


def published_name(path: str, page: str, kind: str) -> str:
    """Where a document belongs below the published folder: ``<path>/feed.json``, ``<path>/feed-2.json`` and so on.

    ``path`` is the feed's ``output_dir`` or name. Characters that mean something to file systems are percent-encoded; empty
    steps and steps to a folder above are left out.
    """
    kept = keep(f"split({path}, '/')", lambda s: f"{s} NOT IN ('', '.', '..')")
    safe = each(kept, lambda s: f"replace(url_encode({s}), '+', '%20')")
    file = f"concat('feed', if({page} > 1, concat('-', {page}), ''), '.{kind}')"
    return f"array_join(concat({safe}, array({file})), '/')"


def named_documents(feeds: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    """``name``, ``feed``, ``page``, ``document``; ``kind`` is ``json`` or ``xml``. Documents link to each other by these names."""
    placed = documents.select("feed", "page", "document").join(feeds.select("feed", "output_dir"), "feed", "left")
    path = first_nonempty("output_dir", "feed")
    return placed.selectExpr(f"{published_name(path, 'page', kind)} AS name", "feed", "page", "document")


# --- RSS -----------------------------------------------------------------------------



def newest_first() -> list[Column]:
    """Newest first, undated last, then stored order."""
    return [F.col("date_published").desc_nulls_last(), F.col("ord"), F.col("id")]


def rss_ranked(items: DataFrame) -> DataFrame:
    """Position of each item in its feed's rss document: ``feed``, ``id``, ``rank``."""
    return rank_within(
        items.select("feed", "id", "ord", "date_published"), "feed", newest_first(), ["id"]
    )


def rss_texts() -> dict[str, str]:
    """The texts of one rss item before escaping."""
    offset = nonempty(extract("date_iso", r"([+-]\d{2}:\d{2})$"))
    return {
        "title": first_nonempty(xml_clean("title"), "url"),
        "description": xml_clean(first_nonempty("summary", "content_html")),
        "pub_date": f"if(date_published IS NULL, NULL, {dates.rss_date('date_local', offset)})",
    }


def enclosures(items: DataFrame) -> DataFrame:
    """One row per attachment: ``feed``, ``id``, ``pos``, ``url``, ``type``, ``length``."""
    rows = items.select("feed", "id", F.posexplode_outer("attachments").alias("pos", "_a"))
    return rows.filter("pos IS NOT NULL").select(
        "feed",
        "id",
        "pos",
        F.col("_a.url").alias("url"),
        F.col("_a.mime_type").alias("type"),
        F.coalesce("_a.size_in_bytes", F.lit(0)).alias("length"),
    )


def clean_for_xml(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop characters xml does not allow from the named text columns."""
    return df.selectExpr(*[f"{xml_clean(c)} AS {c}" if c in columns else c for c in df.columns])


def _element(name: str, text: str, attributes: str = "") -> str:
    """An element, or '' where the text is NULL."""
    opened, closed = lit(f"<{name}{attributes}>"), lit(f"</{name}>")
    return f"coalesce(concat({opened}, {escape_html(text)}, {closed}), '')"


def rss_item() -> str:
    """One ``<item>`` element."""
    texts = rss_texts()
    authors = keep("authors", lambda a: f"{a}.name <> ''")
    enclosure = each(
        "attachments",
        lambda a: f"""concat('<enclosure url="', {escape_html(f'{a}.url')}, '" length="',"""
        f""" coalesce({a}.size_in_bytes, 0), '" type="', {escape_html(f'{a}.mime_type')}, '"/>')""",
    )
    parts = [
        "'<item>'",
        _element("title", texts["title"]),
        _element("link", "url"),
        _element("description", texts["description"]),
        f"array_join({each(authors, lambda a: _element('author', xml_clean(f'{a}.name')))}, '')",
        f"array_join({each('tags', lambda t: _element('category', xml_clean(t)))}, '')",
        f"array_join({enclosure}, '')",
        _element("guid", "id", ' isPermaLink="false"'),
        _element("pubDate", texts["pub_date"]),
        "'</item>'",
    ]
    return f"concat({', '.join(parts)})"


def rss_documents(feeds: DataFrame, items: DataFrame, page_items: int = PAGE_ITEMS, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """RSS 2.0 documents: ``feed``, ``page``, ``document``; newest first."""
    paged = _paged(items, newest_first(), rss_item(), page_items, page_bytes)
    title = xml_clean(f"coalesce(title, {lit(fixed.UNTITLED_FEED)})")
    self_link = f"""concat('<atom:link href="', {escape_html(nonempty('feed_url'))}, '" rel="self"/>')"""
    next_link = """if(page < pages, concat('<atom:link href="feed-', page + 1, '.xml" rel="next"/>'), '')"""
    parts = [
        lit(
            '<?xml version="1.0" encoding="UTF-8"?>'
            '<rss xmlns:atom="http://www.w3.org/2005/Atom" version="2.0"><channel>'
        ),
        _element("title", title),
        _element("link", first_nonempty("home_page_url", lit(fixed.PLACEHOLDER_LINK))),
        _element("description", first_nonempty(xml_clean("description"), title)),
        f"coalesce({self_link}, '')",
        next_link,
        _element("language", nonempty("language")),
        "array_join(texts, '')",
        "'</channel></rss>'",
    ]
    return _document_pages(feeds, paged).selectExpr(
        "feed", "page", f"concat({', '.join(parts)}) AS document"
    )
