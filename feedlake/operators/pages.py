"""Stored pages to feed items.

All extraction is one chain of projections over the page scan: no shuffle, no Python.
Every extractor yields NULL on input it cannot read, so a bad page still gives an item
with its id and url.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.functions import dates, html as H
from feedlake.functions.sql import (
    case,
    each,
    extract,
    first_nonempty,
    keep,
    let,
    lit,
    lits,
    matches,
    nonempty,
    substitute,
)
from feedlake.functions.text import strip, unescape
from feedlake.functions.url import decode_path, page_id_of, url_parts
from feedlake.schema import ITEM_COLUMNS, ITEM_FIELDS


def media_suffix_type(url: str) -> str:
    """Type by the first known suffix at the end of the url or before a ``?``."""

    def first_match(lower: str) -> str:
        return case(
            *[
                (f"endswith({lower}, {lit(s)}) OR contains({lower}, {lit(s + '?')})", lit(mime))
                for s, mime in fixed.MEDIA_TYPES
            ]
        )

    return let(f"lower({url})", first_match)


def page_kind(url: str) -> str:
    """``video`` before ``media`` before ``article``."""
    video = "(?iU)" + "|".join(fixed.VIDEO_URLS)
    return case(
        (matches(url, video), "'video'"),
        (f"{media_suffix_type(url)} IS NOT NULL", "'media'"),
        otherwise="'article'",
    )


def media_type(url: str, content_type: str) -> str:
    """A known header type, else the suffix type."""
    main = f"lower(trim(substring_index({content_type}, ';', 1)))"
    known = keep(f"array({main})", lambda m: f"{m} IN ({lits(fixed.HEADER_TYPES)})")
    return f"coalesce(get({known}, 0), {media_suffix_type(url)})"


def media_title(url: str) -> str:
    """Last path segment, percent-decoded; NULL if empty."""
    path = decode_path(f"{url_parts(url)}[2]")
    return nonempty(extract(path, r"(?s)^.*/([^/?]*)[^/]*$"))


def video_id(url: str) -> str:
    return first_nonempty(*[extract(url, f"(?U){rx}") for rx in fixed.VIDEO_ID_PATTERNS])


def with_page_ids(pages: DataFrame) -> DataFrame:
    """Add ``id`` (of the final url) and ``kind``."""
    return pages.selectExpr(
        "*", f"{page_id_of('final_url')} AS id", f"{page_kind('final_url')} AS kind"
    )


def _prepared(pages: DataFrame) -> DataFrame:
    """Add the columns the extractors share: ``doc``, ``head``, ``ld``, ``mime``."""
    return pages.selectExpr(
        "*",
        f"if(kind <> 'media', {H.visible('html')}, NULL) AS doc",
        f"if(kind = 'article', {H.json_ld_scripts('html')}, NULL) AS ld",
        f"if(kind = 'media', {media_type('final_url', 'content_type')}, NULL) AS mime",
    ).selectExpr("*", f"{H.head_tags('doc')} AS head")


def title(doc: str, head: str) -> str:
    """``og:title``, ``twitter:title``, ``<title>``, first ``<h1>``."""
    return H.clean(
        first_nonempty(
            H.meta_property(head, "og:title"),
            H.meta_name(head, "twitter:title"),
            H.title_tag(doc),
            H.first_heading(doc),
        )
    )


def description(head: str, twitter: bool = True) -> str:
    """``og:description``, ``description``, ``twitter:description``, 500 characters."""
    chain = [H.meta_property(head, "og:description"), H.meta_name(head, "description")]
    if twitter:
        chain.append(H.meta_name(head, "twitter:description"))
    return nonempty(f"left({strip(unescape(first_nonempty(*chain)))}, {fixed.SUMMARY_CHARS})")


def author(head: str) -> str:
    """``author``, ``article:author``, without a leading "By"."""
    raw = first_nonempty(H.meta_name(head, "author"), H.meta_property(head, "article:author"))
    return nonempty(substitute(strip(unescape(raw)), fixed.BYLINE_PREFIX))


def date_text(doc: str, head: str, ld: str) -> str:
    """The first non-empty date text; only this one is ever parsed."""
    return unescape(
        first_nonempty(
            H.meta_property(head, "article:published_time"),
            H.json_ld_date(ld),
            H.meta_name(head, "date"),
            H.meta_name(head, "DC.date"),
            H.time_tag(doc),
        )
    )


def timestamp_literal(moment: dt.datetime) -> str:
    return f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S}'"


def top_date(blocks: str, as_of: dt.datetime) -> str:
    """First date named in the blocks of a text."""
    return dates.body_date(f"array_join({blocks}, ' ')", timestamp_literal(as_of))


def article_fields(prepared: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Add the article columns (``a_*``) to prepared pages.

    With a title the summary comes from the text first and the body may name the date;
    without one the description comes first, and there is neither body date nor content.
    """
    return (
        prepared.selectExpr(
            "*",
            f"{title('doc', 'head')} AS a_title",
            f"{H.article_scope('doc')} AS scope",
            f"{date_text('doc', 'head', 'ld')} AS date_raw",
            f"{description('head')} AS a_meta",
            f"{author('head')} AS a_author",
            f"{H.language('doc', 'head')} AS a_language",
        )
        .selectExpr(
            "*",
            f"{H.text_blocks('scope')} AS blocks",
            f"{dates.parse_date('date_raw')} AS a_found",
        )
        .selectExpr(
            "*",
            f"if(a_title IS NOT NULL AND a_found.local IS NULL, {top_date('blocks', as_of)}, NULL) AS a_body",
            f"if(a_title IS NOT NULL, coalesce({H.best_block('blocks')}, a_meta), coalesce(a_meta,"
            f" {H.best_block(H.paragraph_texts('doc', fixed.SUMMARY_BLOCKS))})) AS a_summary",
            f"if(a_title IS NOT NULL, {nonempty('scope')}, NULL) AS a_content",
        )
        .selectExpr(
            "*",
            f"coalesce(a_found.local, a_body, {timestamp_literal(as_of)}) AS a_local",
            "if(a_found.local IS NOT NULL, a_found.zone, NULL) AS a_zone",
            "(a_found.local IS NULL AND a_body IS NULL) AS date_is_fallback",
        )
    )


def _authors(name: str) -> str:
    named = keep(f"array({name})", lambda n: f"{n} IS NOT NULL")
    return each(named, lambda n: f"named_struct('name', {n}, 'url', CAST(NULL AS STRING))")


def _attachments(url: str, mime: str, size: str = "NULL", seconds: str = "NULL") -> str:
    """One attachment, or none where there is no url."""
    present = keep(f"array({url})", lambda u: f"{u} IS NOT NULL")
    return each(
        present,
        lambda u: f"named_struct('url', {u}, 'mime_type', {mime},"
        f" 'size_in_bytes', CAST({size} AS BIGINT), 'duration_in_seconds', CAST({seconds} AS INT))",
    )


def _article_item() -> dict[str, str]:
    return {
        "title": "a_title",
        "summary": "a_summary",
        "content_html": "a_content",
        "date_published": dates.instant("a_local", "a_zone"),
        "date_local": "a_local",
        "date_iso": dates.iso_text("a_local", "a_zone"),
        "authors": _authors("a_author"),
        "language": "a_language",
    }


def video_title(doc: str, head: str) -> str:
    plain = substitute(strip(H.title_tag(doc)), f"{fixed.VIDEO_TITLE_SUFFIX}$")
    return H.clean(first_nonempty(H.meta_property(head, "og:title"), plain))


def thumbnail(head: str, url: str) -> str:
    """``og:image``, else the picture address made from the video id."""
    built = f"concat({lit(fixed.THUMBNAIL_PREFIX)}, {video_id(url)}, {lit(fixed.THUMBNAIL_SUFFIX)})"
    return first_nonempty(unescape(H.meta_property(head, "og:image")), built)


def _video_item() -> dict[str, str]:
    seconds = dates.iso_duration_seconds(H.tag_value("head", "meta", "itemprop", "duration"))
    return {
        "title": video_title("doc", "head"),
        "summary": description("head", twitter=False),
        "authors": _authors(H.clean(H.tag_value("head", "link", "itemprop", "name"))),
        "tags": f"array({lits(fixed.VIDEO_TAGS)})",
        "attachments": _attachments(
            thumbnail("head", "final_url"), lit(fixed.THUMBNAIL_TYPE), seconds=seconds
        ),
    }


def _media_item() -> dict[str, str]:
    tag = case(
        ("startswith(mime, 'audio/')", "array('audio')"),
        ("startswith(mime, 'video/')", "array('video')"),
        ("mime = 'application/pdf'", "array('pdf')"),
        otherwise="array()",
    )
    return {
        "title": media_title("final_url"),
        "tags": f"CAST({tag} AS array<string>)",
        "attachments": _attachments(
            "final_url", f"coalesce(mime, {lit(fixed.UNKNOWN_TYPE)})", size="content_length"
        ),
    }


def _default(name: str) -> str:
    return "array()" if ITEM_FIELDS[name].startswith("array") else "NULL"


def _typed(name: str, value: str) -> str:
    return f"CAST({value} AS {ITEM_FIELDS[name]})"


def _as_items(rows: DataFrame, keep_columns: list[str], fields: dict[str, str], extra: list[str]) -> DataFrame:
    columns = {"id": "id", "url": "final_url", **fields}
    return rows.selectExpr(
        *keep_columns,
        *[f"{_typed(name, columns.get(name, _default(name)))} AS {name}" for name in ITEM_COLUMNS],
        *extra,
    )


def article_items(pages: DataFrame, as_of: dt.datetime, keep_columns: list[str]) -> DataFrame:
    """Items of the article pages only, plus ``date_raw`` and ``date_is_fallback``."""
    rows = article_fields(_prepared(pages.filter("kind = 'article'")), as_of)
    return _as_items(rows, keep_columns, _article_item(), ["date_raw", "date_is_fallback"])


def video_items(pages: DataFrame, keep_columns: list[str]) -> DataFrame:
    """Items of the video pages only."""
    return _as_items(_prepared(pages.filter("kind = 'video'")), keep_columns, _video_item(), [])


def media_items(pages: DataFrame, keep_columns: list[str]) -> DataFrame:
    """Items of the media links only; their bodies are never parsed."""
    links = pages.filter("kind = 'media'").selectExpr(
        "*", f"{media_type('final_url', 'content_type')} AS mime"
    )
    return _as_items(links, keep_columns, _media_item(), [])


def page_items(pages: DataFrame, as_of: dt.datetime, keep_columns: list[str]) -> DataFrame:
    """Items of all pages in one pass over the corpus.

    The three kinds share one scan: a union of three filtered scans would read every
    body three times.
    """
    rows = article_fields(_prepared(pages), as_of)
    article, video, media = _article_item(), _video_item(), _media_item()

    def choose(name: str) -> str:
        default = _default(name)
        values = [_typed(name, source.get(name, default)) for source in (video, media, article)]
        if values[0] == values[1] == values[2]:
            return values[0]
        return case(
            ("kind = 'video'", values[0]), ("kind = 'media'", values[1]), otherwise=values[2]
        )

    fields = {name: choose(name) for name in ITEM_COLUMNS if name not in ("id", "url")}
    return _as_items(rows, keep_columns, fields, ["kind"])


# --- frontier and corpus -------------------------------------------------------------


def corpus_keys(pages: DataFrame) -> DataFrame:
    """``page_id``, requested ``id``, ``final_id`` of the good pages; never reads bodies."""
    return pages.filter("good").selectExpr(
        "page_id", f"{page_id_of('url')} AS id", f"{page_id_of('final_url')} AS final_id"
    )


def answers(pages: DataFrame) -> DataFrame:
    """One page per requested id, the lowest ``page_id``: ``id``, ``page_id``, ``final_id``."""
    return (
        corpus_keys(pages)
        .groupBy("id")
        .agg(F.min(F.struct("page_id", "final_id")).alias("_page"))
        .select("id", "_page.page_id", "_page.final_id")
    )


def match_pages(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows with the page that answers them (``page_id``, ``final_id``).

    Only urls are read and shuffled.
    """
    return frontier.join(answers(pages), "id").select(*frontier.columns, "page_id", "final_id")


def unanswered(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows without a good page."""
    return frontier.join(corpus_keys(pages).select("id"), "id", "left_anti").select(
        *frontier.columns
    )


def wanted_pages(matched: DataFrame, pages: DataFrame) -> DataFrame:
    """The bodies that are really needed, each once.

    Their size decides: few ids are broadcast and no body moves; with many, a corpus
    bucketed by ``page_id`` stays where it is too.
    """
    return pages.join(matched.select("page_id").distinct(), "page_id", "left_semi")
