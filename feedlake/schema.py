"""Column types shared by all jobs; nothing is ever inferred from data."""

from __future__ import annotations

AUTHORS = "array<struct<name:string,url:string>>"
ATTACHMENTS = (
    "array<struct<url:string,mime_type:string,size_in_bytes:bigint,duration_in_seconds:int>>"
)

# One row per (feed, item). ``date_*`` hold the instant, ``*_local`` the wall clock as
# written, ``*_iso`` the text that goes into the feed documents.
ITEM_FIELDS = {
    "id": "string",
    "url": "string",
    "title": "string",
    "summary": "string",
    "content_html": "string",
    "date_published": "timestamp",
    "date_local": "timestamp_ntz",
    "date_iso": "string",
    "date_modified": "timestamp",
    "modified_local": "timestamp_ntz",
    "modified_iso": "string",
    "authors": AUTHORS,
    "language": "string",
    "tags": "array<string>",
    "attachments": ATTACHMENTS,
}
ITEM_COLUMNS = list(ITEM_FIELDS)

FEEDS = (
    "feed string, title string, home_page_url string, feed_url string, "
    "description string, language string, output_dir string"
)
SOURCES = "feed string, source_rank int, source_kind string, ref_id bigint, source_ref string, part bigint, pos bigint, url string"
PATTERNS = "feed string, kind string, pattern string"

_JSON_ITEM = {
    "id": "string",
    "url": "string",
    "title": "string",
    "summary": "string",
    "content_html": "string",
    "date_published": "string",
    "date_modified": "string",
    "authors": AUTHORS,
    "language": "string",
    "tags": "array<string>",
    "attachments": ATTACHMENTS,
}
JSON_ITEM = "struct<" + ",".join(f"{name}:{kind}" for name, kind in _JSON_ITEM.items()) + ">"
JSON_FEED = (
    "version string, title string, home_page_url string, feed_url string, next_url string, _page int, "
    f"description string, authors {AUTHORS}, language string, items array<{JSON_ITEM}>"
)

BOARD = (
    "cards array<struct<name:string,desc:string,closed:boolean,idList:string>>, "
    "lists array<struct<id:string,name:string>>"
)

