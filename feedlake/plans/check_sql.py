"""The query catalogue once more, in plain SQL for the checking database.

Written independently of the Spark jobs: windows instead of map-side minima, look-around
free patterns, ``EXISTS`` instead of compiled pattern lists. Only the fixture SQL is shared.
"""

from __future__ import annotations

from feedlake import fixed
from feedlake.operators.feeds import PAGE_ITEMS
from feedlake.plans import fixtures as FX

_RFC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_TRACKING = ", ".join(f"'{k}'" for k in fixed.TRACKING_KEYS)


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


def _table(name: str, sql: str) -> str:
    return f"{name} AS ({sql})"


def _canon(source: str, out: str) -> str:
    """CTEs that add ``canonical_url``, ``id``, ``aut`` and ``valid`` to ``source``."""
    decode = "url_decode(replace({}, '+', ' '))"
    return f"""
{out}_1 AS (SELECT *, regexp_extract(url, '{_RFC}', 1) AS _s, regexp_extract(url, '{_RFC}', 2) AS _a,
  regexp_extract(url, '{_RFC}', 3) AS _p, regexp_extract(url, '{_RFC}', 4) AS _q FROM {source}),
{out}_2 AS (SELECT *,
  CASE lower(_s) WHEN 'http' THEN regexp_replace(lower(_a), ':80$', '') WHEN 'https' THEN regexp_replace(lower(_a), ':443$', '') ELSE lower(_a) END AS _host,
  regexp_replace(_p, ';[^/]*$', '') AS _path,
  list_filter(list_transform(list_filter(string_split(_q, '&'), lambda x: x <> ''),
    lambda x: {{'k': {decode.format("split_part(x, '=', 1)")}, 'v': {decode.format("regexp_replace(x, '^[^=]*=?', '')")}}}),
    lambda kv: lower(kv.k) NOT IN ({_TRACKING})) AS _kv FROM {out}_1),
{out}_3 AS (SELECT *, list_sort(list_transform(_kv, lambda kv, i: {{'first': list_position(list_transform(_kv, lambda z: z.k), kv.k), 'i': i, 'k': kv.k, 'v': kv.v}})) AS _sorted FROM {out}_2),
{out}_4 AS (SELECT *, array_to_string(list_transform(_sorted, lambda kv: concat(replace(url_encode(kv.k), '%20', '+'), '=', replace(url_encode(kv.v), '%20', '+'))), '&') AS _query FROM {out}_3),
{out}_5 AS (SELECT * EXCLUDE (_s, _p, _q, _kv, _sorted), lower(_s) IN ('http', 'https') AND _a <> '' AS valid, _a AS aut,
  concat(lower(_s), '://', _host, CASE WHEN _path = '/' THEN '/' ELSE rtrim(_path, '/') END, CASE WHEN _query = '' THEN '' ELSE concat('?', _query) END) AS canonical_url FROM {out}_4),
{out} AS (SELECT *, substr(sha256(canonical_url), 1, 16) AS id FROM {out}_5)"""


def _first(source: str, out: str, key: str = "id", order: str = "ord") -> str:
    return f"{out} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY feed, {key} ORDER BY {order}) = 1)"


_PATTERNS = "patterns(scope, kind, pattern) AS (VALUES " + ", ".join(
    f"({'NULL' if f is None else repr(f)}, {k!r}, {p!r})" for f, k, p in FX.PATTERN_ROWS
) + ")"


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_FEEDS = "feeds(feed, title, home_page_url, feed_url, description, language, output_dir) AS (VALUES " + ", ".join(
    "(" + ", ".join(_sql_text(v) for v in row) + ")" for row in FX.FEED_ROWS
) + ")"


def _hit(kind: str, row: str) -> str:
    host = f"split_part(lower({row}.aut), ':', 1)"
    return f"""EXISTS (SELECT 1 FROM patterns p WHERE p.kind = '{kind}' AND (p.scope IS NULL OR p.scope = {row}.feed) AND
  CASE WHEN starts_with(p.pattern, '*.') THEN {host} = substr(p.pattern, 3) OR ends_with({host}, concat('.', substr(p.pattern, 3)))
  ELSE {host} GLOB p.pattern OR lower({row}.url) GLOB p.pattern END)"""


def _none(kind: str, row: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM patterns p WHERE p.kind = '{kind}' AND (p.scope IS NULL OR p.scope = {row}.feed))"


_FRONTIER = _table("frontier", FX.FRONTIER)
_ALLOWED = f"({_none('allow', 'f')} OR {_hit('allow', 'f')})"
_BLOCKED = _hit("block", "f")
_FRONTIER_IDS = (_FRONTIER, _canon("frontier", "ids"))
_VALID_IDS = (*_FRONTIER_IDS, _table("valid_ids", "SELECT * FROM ids WHERE valid"), _first("valid_ids", "firsts"))
_STORED = (_table("stored_urls", FX.STORED), _canon("stored_urls", "stored"))
_PX = _table("px", FX.PAGES_X)
_PX_IDS = (_PX, _canon("px", "pxi"))
_ANSWERS = _table("answers", "SELECT id, min(page_id) AS page_id FROM pxi GROUP BY id")

# --- text sources -------------------------------------------------------------------

_VALID_RX = r"^https?://[^/?#]"

_NOTES = (
    _table("notes", FX.NOTES),
    r"""note_raw AS (SELECT doc_id, lang, list_concat(
  list_transform(regexp_extract_all(regexp_replace(content, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[[^\]]*\]\(([^)]+)\)', 1), lambda u: trim(u)),
  list_transform(regexp_extract_all(content, '(?:^|[^(\[])(https?://[^\s<>"''\)]+\)?)', 1),
    lambda u: rtrim(CASE WHEN ends_with(u, ')') THEN left(u, length(u) - 2) ELSE u END, '.,;:!?'))) AS found FROM notes)""",
    """note_rows AS (SELECT doc_id, lang, unnest(found) AS url, generate_subscripts(found, 1) AS i FROM note_raw)""",
    f"""note_firsts AS (SELECT doc_id, lang, url, min(i) AS i FROM note_rows WHERE regexp_matches(url, '{_VALID_RX}') GROUP BY ALL)""",
    """note_links AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, url FROM note_firsts)""",
)


def _text_links(column: str) -> str:
    return (
        rf"""list_transform(regexp_extract_all(coalesce({column}, ''), 'https?://[^\s<>"''\)\]]+'), lambda u: rtrim(u, '.,;:!?|'))"""
    )


_CARD_LINKS = (
    _table("cards", FX.CARDS),
    f"""card_raw AS (SELECT board, card, idlist, closed, {_text_links('name')} AS a, {_text_links('descr')} AS b FROM cards)""",
    f"""card_rows AS (
  SELECT board, card, idlist, closed, 0 AS side, unnest(a) AS url, generate_subscripts(a, 1) AS i FROM card_raw
  UNION ALL SELECT board, card, idlist, closed, 1, unnest(b), generate_subscripts(b, 1) FROM card_raw)""",
    f"""card_firsts AS (SELECT board, card, idlist, closed, side, url, min(i) AS i FROM card_rows
  WHERE regexp_matches(url, '{_VALID_RX}') AND NOT regexp_matches(lower(url), '^https?://(www\\.)?trello\\.com([/?#]|$)') GROUP BY ALL)""",
    """card_links AS (SELECT *, CAST(row_number() OVER (PARTITION BY board, card ORDER BY side, i) - 1 AS INTEGER) AS pos FROM card_firsts)""",
)


def _board_links(condition: str) -> str:
    return f"""SELECT board, card, pos, url FROM card_links WHERE coalesce(closed, false) = false AND {condition}
QUALIFY row_number() OVER (PARTITION BY board, url ORDER BY card, pos) = 1"""


_SITEMAPS = (
    _table("sitemaps", FX.sitemaps("check")),
    r"""map_raw AS (SELECT site, candidate, list_filter(list_transform(regexp_extract_all(xml, '(?is)<url\b[^>]*>(.*?)</url\s*>', 1),
  lambda e: trim(regexp_extract(e, '(?is)<loc\b[^>]*>(.*?)</loc\s*>', 1))), lambda u: u <> '') AS urls FROM sitemaps)""",
    """first_map AS (SELECT * FROM map_raw WHERE len(urls) > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY candidate) = 1)""",
)

# --- pages --------------------------------------------------------------------------


def _unescape(c: str) -> str:
    for name, char in (("&#39;", "'"), *fixed.ENTITIES):
        c = f"replace({c}, '{name}', {_sql_text(char)})"
    return c


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _meta(attr: str, key: str, tag: str = "meta") -> str:
    return rf"""nullif({_unescape(f"regexp_extract(doc, '<{tag} {attr}=" + chr(34) + key + chr(34) + r"[^>]*content=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")}, '')"""


_BLOCK = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|section)(?:\s[^>]*|/)?>"


def _texts(pieces: str) -> str:
    inner = _unescape(r"regexp_replace(x, '<[^>]*>', ' ', 'g')")
    return rf"list_transform({pieces}, lambda x: trim(regexp_replace({inner}, '\s+', ' ', 'g')))"


def _best(blocks: str) -> str:
    return f"""left(list_reduce(list_prepend('', list_filter(list_slice({blocks}, 1, 4), lambda b: length(b) > 100)),
    lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), 500)"""


_SUFFIX_TYPE = "CASE " + " ".join(
    f"WHEN ends_with(lower(url), '{s}') OR contains(lower(url), '{s}?') THEN '{m}'" for s, m in fixed.MEDIA_TYPES
) + " END"

_TEXT_DAY = r"\b\d{4}-\d{2}-\d{2}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b|(?i:\bpublished (?:yesterday|today)\b)"
_DOCS = (
    *_PX_IDS,
    f"""kinds AS (SELECT *, CASE WHEN regexp_matches(url, '(?i)^https?://(www\\.)?youtube\\.com/(watch\\?v=|shorts/)[\\w-]+|^https?://youtu\\.be/[\\w-]+') THEN 'video'
  WHEN {_SUFFIX_TYPE} IS NOT NULL THEN 'media' ELSE 'article' END AS kind FROM pxi)""",
    r"""docs_1 AS (SELECT *, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS doc FROM kinds)""",
    rf"""docs_2 AS (SELECT *, CASE WHEN regexp_matches(doc, '(?i)</article[\s>]') THEN regexp_extract(doc, '(?is)<article(?:\s[^>]*)?>(.*)</article\s*>', 1)
    ELSE regexp_replace(regexp_extract(doc, '(?is)<article(?:\s[^>]*)?>(.*)$', 1), '(?is)</(?:body|html)\s*>.*$', '') END AS scope,
  coalesce({_meta('property', 'og:title')}, {_meta('name', 'twitter:title')},
    nullif({_unescape("regexp_extract(doc, '(?is)<title>(.*?)</title>', 1)")}, ''),
    nullif({_unescape("regexp_replace(regexp_extract(doc, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')")}, '')) AS raw_title,
  coalesce({_meta('property', 'og:description')}, {_meta('name', 'description')}) AS raw_description,
  {_meta('name', 'author')} AS raw_author, regexp_extract(doc, '<html lang="([^"]*)"', 1) AS language,
  coalesce({_meta('property', 'article:published_time')},
    nullif(regexp_extract(html, '"datePublished":"([^"]*)"', 1), ''), nullif(regexp_extract(html, '"dateCreated":"([^"]*)"', 1), ''),
    nullif(regexp_extract(doc, '<time datetime="([^"]*)"', 1), '')) AS date_raw FROM docs_1)""",
    rf"""docs_3 AS (SELECT *, nullif({_trim('raw_title')}, '') AS title, nullif(left({_trim('raw_description')}, 500), '') AS description,
  regexp_replace({_trim('raw_author')}, '^(By|by|BY) ', '') AS author,
  list_filter({_texts(f"regexp_split_to_array(scope, '{_BLOCK}')")}, lambda b: b <> '') AS blocks,
  {_texts(r"list_transform(list_slice(regexp_split_to_array(doc, '(?i)<p(?:\s[^>]*)?>'), 2, 5), lambda x: regexp_replace(x, '(?is)</?(?:p|div|h[1-6]|li|ul|ol|section|article|main|body|header|footer|nav|aside|table|td|blockquote|form)(?:\s[^>]*|/)?>.*$', ''))")} AS paragraphs,
  CASE WHEN regexp_matches(date_raw, '^\d{{4}}-\d\d-\d\d$') THEN concat(date_raw, 'T00:00:00')
    WHEN regexp_matches(date_raw, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ$') THEN concat(left(date_raw, 19), '+00:00') END AS date_iso FROM docs_2)""",
    rf"""docs_4 AS (SELECT *, nullif({_best('blocks')}, '') AS best_block, nullif({_best('paragraphs')}, '') AS best_paragraph,
  array_to_string(blocks, ' ') AS top FROM docs_3)""",
    rf"""docs_5a AS (SELECT *, coalesce(nullif(regexp_extract(top, '\b(?i:published|posted|updated)(?i: on| at)?:? ({_TEXT_DAY})', 1), ''),
  nullif(regexp_extract(top, '({_TEXT_DAY})', 1), '')) AS day_text FROM docs_4)""",
    r"""docs_5 AS (SELECT *, CASE WHEN lower(day_text) = 'published yesterday' THEN '2025-12-28' WHEN lower(day_text) = 'published today' THEN '2025-12-29'
  WHEN regexp_matches(day_text, '^\d') THEN strftime(try_cast(day_text AS DATE), '%Y-%m-%d') ELSE strftime(try_strptime(day_text, '%B %d, %Y'), '%Y-%m-%d') END AS body_date FROM docs_5a)""",
    """docs AS (SELECT *, CASE WHEN title IS NULL THEN coalesce(description, best_paragraph) ELSE coalesce(best_block, description) END AS summary,
  CASE WHEN title IS NOT NULL THEN nullif(scope, '') END AS content_html,
  CASE WHEN title IS NOT NULL AND date_iso IS NULL THEN concat(body_date, 'T00:00:00') END AS body_iso FROM docs_4a)""",
)
_DOCS = (*_DOCS[:-1], _DOCS[-1].replace("FROM docs_4a", "FROM docs_5").replace(
    "concat(body_date, 'T00:00:00')", "body_date || 'T00:00:00'"))

_ARTICLE = """id, url, title, summary, CAST(length(content_html) AS INTEGER) AS content_length, md5(content_html) AS content_md5,
  coalesce(date_iso, body_iso, '2025-12-29T00:00:00') AS date_iso, coalesce(author, '') AS author, language"""

_VIDEO_ID = r"coalesce(nullif(regexp_extract(url, '[?&]v=([\w-]+)', 1), ''), nullif(regexp_extract(url, 'youtu\.be/([\w-]+)', 1), ''), nullif(regexp_extract(url, 'shorts/([\w-]+)', 1), ''))"
_VIDEO = rf"""SELECT page_id, id, url, coalesce(nullif(trim({_meta('property', 'og:title')}), ''),
    regexp_replace({_trim(_unescape("regexp_extract(doc, '(?is)<title>(.*?)</title>', 1)"))}, ' - YouTube$', '')) AS title,
  description AS summary, coalesce(trim({_meta('itemprop', 'name', 'link')}), '') AS author, 'video|youtube' AS tags,
  concat('https://img.youtube.com/vi/', {_VIDEO_ID}, '/maxresdefault.jpg') AS attachment_url, 'image/jpeg' AS mime_type,
  3600 + 60 * CAST(regexp_extract(doc, 'content="PT1H(\d+)M5S"', 1) AS INTEGER) + 5 AS duration_in_seconds FROM docs WHERE kind = 'video'"""
_VIDEO = _VIDEO.replace("regexp_replace(" + _trim(_unescape("regexp_extract(doc, '(?is)<title>(.*?)</title>', 1)")) + ", ' - YouTube$', '')",
    "nullif(regexp_replace(" + _trim(_unescape("regexp_extract(doc, '(?is)<title>(.*?)</title>', 1)")) + ", ' - YouTube$', ''), '')")
_MEDIA = rf"""SELECT page_id, id, url, url_decode(regexp_extract(url, '^[^?#]*/([^/?#]*)', 1)) AS title,
  CASE WHEN {_SUFFIX_TYPE} LIKE 'audio/%' THEN 'audio' WHEN {_SUFFIX_TYPE} LIKE 'video/%' THEN 'video' ELSE 'pdf' END AS tags,
  url AS attachment_url, {_SUFFIX_TYPE} AS mime_type, strlen(html) AS size_in_bytes, CAST(NULL AS INTEGER) AS duration_in_seconds
  FROM docs WHERE kind = 'media'"""

_OUTLINKS = (
    r"""anchors_1 AS (SELECT page_id, url, aut, regexp_extract(url, '^[a-z]+', 0) AS sch, regexp_extract_all(scope, '<a href="([^"]+)"', 1) AS inside,
  regexp_extract_all(doc, '<a href="([^"]+)"', 1) AS every FROM docs)""",
    """anchors_2 AS (SELECT page_id, url, aut, sch, 1 AS scoped, unnest(inside) AS href, generate_subscripts(inside, 1) AS i FROM anchors_1
  UNION ALL SELECT page_id, url, aut, sch, 0, unnest(every), generate_subscripts(every, 1) FROM anchors_1)""",
    f"""anchors_3 AS (SELECT page_id, url AS site, aut, scoped, i, {_unescape('href')} AS h,
  CASE WHEN href LIKE 'http%' THEN {_unescape('href')} WHEN starts_with(href, '#') THEN concat(regexp_extract(url, '^[^#]*', 0), href)
    ELSE concat(sch, '://', aut, {_unescape('href')}) END AS url FROM anchors_2)""",
    """anchors_4 AS (SELECT page_id, site, url, scoped, min(i) AS i FROM anchors_3
  WHERE regexp_extract(url, '^https?://([^/?#]*)', 1) = aut OR ends_with(regexp_extract(url, '^https?://([^/?#]*)', 1), concat('.', aut)) GROUP BY ALL)""",
    """page_own AS (SELECT * FROM anchors_4 a WHERE scoped = 1 OR NOT EXISTS (SELECT 1 FROM anchors_4 b WHERE b.page_id = a.page_id AND b.scoped = 1))""",
)
_UNWANTED = "(?i)" + "|".join(fixed.EXCLUDED_LINKS)


def _article_link(url: str, site: str) -> str:
    return f"(regexp_matches({url}, '{_VALID_RX}') AND rtrim({url}, '/') <> rtrim({site}, '/') AND NOT regexp_matches({url}, '{_UNWANTED}'))"


# --- items --------------------------------------------------------------------------

_ITEMS = (
    _table("items_raw", FX.ITEMS_RAW),
    _canon("items_raw", "items_id"),
    """items AS (SELECT *, page_id AS ord, feed AS language, concat(feed, '|topic', topic) AS tags, concat('topic', topic) AS second_tag,
  CASE WHEN published_raw = 'not a date' THEN NULL ELSE replace(published_raw, 'Z', '+00:00') END AS date_iso,
  CASE WHEN published_raw <> 'not a date' THEN CAST(left(published_raw, 19) AS TIMESTAMP) END AS date_local,
  CASE WHEN modified_raw IS NOT NULL THEN concat(modified_raw, 'T00:00:00') END AS modified_iso
  FROM items_id QUALIFY row_number() OVER (PARTITION BY feed, id ORDER BY page_id) = 1)""",
    """ranked AS (SELECT *, date_local + CASE WHEN date_iso LIKE '%-05:00' THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS moment FROM items)""",
    """rss AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY moment DESC NULLS LAST, ord, id) AS rank FROM ranked)""",
)
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _clean(c: str) -> str:
    return f"regexp_replace({c}, '{_CONTROL}', '', 'g')"


def _escape(c: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{char}', '{name}')"
    return c


_MERGE = (
    *_ITEMS,
    "old AS (SELECT feed, id, url, ord, concat('Old ', title) AS title FROM items WHERE url LIKE 'http:%')",
    "new AS (SELECT feed, id, url, ord, title FROM items WHERE url LIKE 'https:%' OR feed = 'es')",
    """delta AS (SELECT n.feed, n.id, n.url, n.title, coalesce((SELECT max(ord) + 1 FROM old o WHERE o.feed = n.feed), 0) + n.ord AS ord
  FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.feed = n.feed AND o.id = n.id))""",
)

_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


def _tfidf(source: str, key: str) -> tuple[str, ...]:
    return (
        rf"""tokens AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}][\p{{L}}\p{{N}}-]{{2,}}')) AS term FROM {source})""",
        f"tf AS (SELECT {key}, term, count(*) AS tf FROM tokens WHERE length(term) <= {fixed.TAG_MAX_CHARS} AND term NOT IN ({_STOP}) GROUP BY ALL)",
        f"""scores AS (SELECT {key}, term, round(tf * (ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*) OVER (PARTITION BY term))) + 1), 6) AS score FROM tf)""",
        f"""topics AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC, term) AS INTEGER) AS rank, term, score
  FROM scores QUALIFY rank <= {fixed.MAX_TAGS})""",
    )


_CATALOGUE = (
    *_ITEMS,
    _FEEDS,
    """listed AS (SELECT f.feed, coalesce(f.output_dir, f.feed) AS path, coalesce(f.title, f.output_dir, f.feed) AS title,
  coalesce(f.description, 'No description') AS description, count(i.id) AS item_count,
  coalesce(strftime(max(CAST(left(coalesce(i.date_iso, i.modified_iso), 19) AS TIMESTAMP)), '%Y-%m-%d'), 'Unknown') AS last_updated
  FROM feeds f LEFT JOIN items i ON i.feed = f.feed GROUP BY ALL)""",
)

_RUN = (
    *_FRONTIER_IDS,
    _PATTERNS,
    *_STORED,
    *_DOCS,
    _ANSWERS,
    f"""staged AS (SELECT f.feed, f.id, f.ord, f.url, CASE WHEN NOT f.valid THEN 'invalid' WHEN NOT {_ALLOWED} THEN 'not_allowed' WHEN {_BLOCKED} THEN 'blocked' END AS early FROM ids f)""",
    """numbered AS (SELECT *, row_number() OVER (PARTITION BY feed, id, early ORDER BY ord) AS n FROM staged)""",
    """judged AS (SELECT n.*, a.page_id, CASE WHEN early IS NOT NULL THEN early WHEN n > 1 THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM stored s WHERE s.feed = n.feed AND s.id = n.id) THEN 'stored'
  WHEN a.id IS NULL THEN 'no_page' ELSE 'added' END AS stage FROM numbered n LEFT JOIN answers a ON a.id = n.id)""",
)

_STAGES = ("invalid", "not_allowed", "blocked", "duplicate", "stored", "no_page", "same_page", "added")

_PLAIN_ITEMS = (
    _table("plain", f"SELECT page_id, {FX.FEED_OF_URL} AS feed, url, html FROM pages"),
    _canon("plain", "plain_ids"),
    "chosen AS (SELECT * FROM plain_ids WHERE valid QUALIFY row_number() OVER (PARTITION BY feed, id ORDER BY page_id) = 1)",
    *[
        c.replace("FROM pxi", "FROM chosen") if c.lstrip().startswith("kinds AS") else c
        for c in _DOCS
        if not c.lstrip().startswith(("px AS", "pxi_1 AS"))
    ],
)
_PLAIN_BODY = """SELECT feed, id, url, title, summary, language, coalesce(date_iso, body_iso, '2025-12-29T00:00:00') AS date_iso FROM docs"""
_ARRIVED = _with(
    _table("arrived", FX.ARRIVALS),
    _table("plain", f"SELECT page_id, {FX.FEED_OF_URL} AS feed, url, html, batch FROM arrived WHERE status < 400"),
    _PATTERNS,
    *[
        c.replace("FROM plain_ids WHERE valid", f"FROM plain_ids f WHERE valid AND {_ALLOWED} AND NOT {_BLOCKED}").replace("ORDER BY page_id) = 1", "ORDER BY batch, page_id, html) = 1")
        for c in _PLAIN_ITEMS[1:]
    ],
    body=_PLAIN_BODY,
)
_PLAIN = _with(
    *_PLAIN_ITEMS,
    body=_PLAIN_BODY,
)

_DATE_TEXTS = (
    _table("texts", FX.DATE_TEXTS),
    """understood AS (SELECT t.*, concat('2025-03-', CASE WHEN page_id % 18 IN (4, 5, 11) THEN concat('', 13 + page_id % 15) ELSE lpad(concat('', 1 + page_id % 28), 2, '0') END,
  CASE page_id % 18 WHEN 0 THEN 'T10:00:00+00:00' WHEN 2 THEN 'T08:30:00' WHEN 3 THEN 'T10:00:00+00:00' WHEN 5 THEN 'T21:05:00' WHEN 7 THEN 'T10:00:00+02:00' WHEN 8 THEN 'T10:00:00+00:00'
    WHEN 9 THEN 'T10:00:00+00:00' WHEN 10 THEN 'T10:00:00' WHEN 12 THEN 'T10:00:00.250000-05:00' WHEN 13 THEN 'T07:15:00' ELSE 'T00:00:00' END) AS iso FROM texts t)""",
    """judged_dates AS (SELECT page_id, date_raw, CASE WHEN page_id % 18 < 15 THEN iso END AS date_iso,
  CASE WHEN page_id % 18 < 15 THEN 'read' WHEN page_id % 18 < 17 THEN 'unread' ELSE 'none' END AS outcome FROM understood)""",
)

CHECK_SQL = {
    "dates_read": _with(*_DATE_TEXTS, body="SELECT page_id, date_raw, date_iso, outcome FROM judged_dates"),
    "date_shape_report": _with(
        *_DATE_TEXTS,
        r"shaped AS (SELECT outcome, left(regexp_replace(regexp_replace(date_raw, '[0-9]', '9', 'g'), '[A-Za-z]+', 'a', 'g'), 60) AS shape FROM judged_dates)",
        body="SELECT DISTINCT outcome, count(*) OVER (PARTITION BY outcome) AS n, shape, count(*) OVER (PARTITION BY outcome, shape) AS texts FROM shaped",
    ),
    "url_canonical_ids": _with(_canon("pages", "c"), body="SELECT page_id, url, canonical_url, id, valid FROM c"),
    "valid_links": _with(_FRONTIER, body=f"SELECT feed, ord, url FROM frontier WHERE regexp_matches(url, '{_VALID_RX}')"),
    "links_per_domain": _with(
        _FRONTIER,
        body="SELECT feed, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain, count(*) AS links FROM frontier GROUP BY ALL",
    ),
    "allowlist_semi": _with(*_FRONTIER_IDS, _PATTERNS, body=f"SELECT feed, ord, url FROM ids f WHERE {_ALLOWED}"),
    "blocklist_anti": _with(*_FRONTIER_IDS, _PATTERNS, body=f"SELECT feed, ord, url FROM ids f WHERE NOT {_BLOCKED}"),
    "glob_matches": _with(
        *_FRONTIER_IDS,
        _table("globs", FX.GLOBS),
        body="""SELECT f.feed, f.ord, g.kind, count(*) AS globs FROM ids f JOIN (SELECT DISTINCT feed, kind, pattern FROM globs WHERE NOT starts_with(pattern, '*.')) g
  ON (g.feed IS NULL OR g.feed = f.feed) AND (split_part(lower(f.aut), ':', 1) GLOB g.pattern OR lower(f.url) GLOB g.pattern) GROUP BY ALL""",
    ),
    "dedup_first_seen": _with(*_VALID_IDS, body="SELECT feed, id, ord, url FROM firsts"),
    "new_links_anti": _with(
        *_VALID_IDS,
        *_STORED,
        body="SELECT feed, id, url FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.feed = f.feed AND s.id = f.id)",
    ),
    "markdown_links": _with(*_NOTES, body="SELECT doc_id, pos, url FROM note_links"),
    "board_links": _with(*_CARD_LINKS, body=_board_links("true")),
    "board_links_on_lists": _with(
        *_CARD_LINKS,
        # a board that has neither list is not filtered
        body=_board_links(
            "(board % 2 = 0 OR idlist IN ('L0', 'L2') OR NOT EXISTS (SELECT 1 FROM cards k WHERE k.board = card_links.board AND k.idlist IN ('L0', 'L2')))"
        ),
    ),
    "board_list_counts": _with(
        *_CARD_LINKS,
        _table("lists", FX.BOARD_LISTS),
        body="""SELECT l.board, l.list_name, count(DISTINCT c.card) AS cards, count(k.url) AS links FROM lists l JOIN cards c ON c.board = l.board AND c.idlist = l.idlist
LEFT JOIN card_links k ON k.board = c.board AND k.card = c.card GROUP BY ALL""",
    ),
    "sitemap_links": _with(
        *_SITEMAPS, body="SELECT site, candidate, CAST(generate_subscripts(urls, 1) - 1 AS INTEGER) AS pos, unnest(urls) AS url FROM map_raw"
    ),
    "sitemap_first_candidate": _with(
        *_SITEMAPS, body="SELECT site, candidate, CAST(len(urls) AS INTEGER) AS links, urls[1] AS first_url FROM first_map"
    ),
    "page_outlinks": _with(
        *_DOCS,
        *_OUTLINKS,
        body=f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, url FROM page_own
WHERE {_article_link('url', 'site')}""",
    ),
    "site_links_top100": _with(
        *_DOCS,
        *_OUTLINKS,
        *_SITEMAPS,
        "mapped AS (SELECT site, unnest(urls[1:100]) AS url, generate_subscripts(urls[1:100], 1) AS i FROM first_map)",
        "map_firsts AS (SELECT site, url, min(i) AS i FROM mapped GROUP BY ALL)",
        "map_counts AS (SELECT site, count(*) AS n FROM map_firsts GROUP BY ALL)",
        """both_sides AS (SELECT d.page_id, d.url AS site, m.url, 0 AS prio, m.i FROM docs d JOIN map_firsts m ON m.site = d.url
  UNION ALL SELECT o.page_id, o.site, o.url, 1, o.i FROM page_own o LEFT JOIN map_counts c ON c.site = o.site WHERE coalesce(c.n, 0) < 100)""",
        "uniq AS (SELECT * FROM both_sides QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY prio, i) = 1)",
        body=f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY prio, i) - 1 AS INTEGER) AS pos, url FROM uniq
WHERE {_article_link('url', 'site')} QUALIFY pos < 100""",
    ),
    "host_site_links": _with(
        *_DOCS,
        *_OUTLINKS,
        _table("landed", FX.SITEMAP_FILES),
        r"""files AS (SELECT concat(regexp_extract(path, '/landed/([a-z]+)/', 1), '://', regexp_extract(path, '/landed/[a-z]+/([^/]+)/', 1)) AS host,
  regexp_extract(path, '/landed/[a-z]+/[^/]+/(.*)$', 1) AS name, list_transform(regexp_extract_all(xml, '<url><loc>([^<]*)</loc></url>', 1), lambda u: trim(u)) AS urls,
  regexp_extract_all(xml, '<sitemap><loc>([^<]*)</loc></sitemap>', 1) AS parts FROM landed)""",
        """tops AS (SELECT *, list_position(['sitemap.xml', 'sitemap_index.xml', 'sitemap-index.xml'], name) AS candidate FROM files)""",
        """entries AS (SELECT host, candidate, 0 AS part, generate_subscripts(urls, 1) AS i, unnest(urls) AS url FROM tops WHERE candidate IS NOT NULL
  UNION ALL SELECT t.host, t.candidate, t.part, generate_subscripts(f.urls, 1), unnest(f.urls)
  FROM (SELECT host, candidate, generate_subscripts(parts, 1) AS part, unnest(parts) AS loc FROM tops WHERE candidate IS NOT NULL) t JOIN files f ON concat(f.host, '/', f.name) = t.loc)""",
        """best AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY part, i) AS n FROM entries e
  WHERE candidate = (SELECT min(candidate) FROM entries b WHERE b.host = e.host) QUALIFY n <= 100)""",
        "map_firsts AS (SELECT host, url, min(n) AS i FROM best GROUP BY ALL)",
        "map_counts AS (SELECT host, count(*) AS n FROM map_firsts GROUP BY ALL)",
        "starts AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host FROM docs)",
        """both_sides AS (SELECT d.page_id, d.url AS site, m.url, 0 AS prio, m.i FROM starts d JOIN map_firsts m ON m.host = d.host
  UNION ALL SELECT o.page_id, o.site, o.url, 1, o.i FROM page_own o JOIN starts d ON d.page_id = o.page_id LEFT JOIN map_counts c ON c.host = d.host WHERE coalesce(c.n, 0) < 100)""",
        "uniq AS (SELECT * FROM both_sides QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY prio, i) = 1)",
        body=f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY prio, i) - 1 AS INTEGER) AS pos, url FROM uniq
WHERE {_article_link('url', 'site')} QUALIFY pos < 100""",
    ),
    "static_list_links": "SELECT 'list' AS feed, 'config' AS source_kind, row_number() OVER (ORDER BY page_id) AS rank, url FROM pages",
    "config_feeds": """SELECT lang AS feed, concat(count(*), ' texts') AS title, CAST(NULL AS VARCHAR) AS home_page_url, CAST(NULL AS VARCHAR) AS feed_url,
  CAST(NULL AS VARCHAR) AS description, lang AS language, concat('out/', lang) AS output_dir FROM documents GROUP BY lang""",
    "source_union_ordered": _with(
        *_NOTES,
        *_CARD_LINKS,
        body=f"""SELECT {FX.FEED_OF_URL} AS feed, 1 AS source_rank, 'config' AS source_kind, CAST(NULL AS BIGINT) AS ref_id, '' AS source_ref, 0 AS part, page_id AS pos, url FROM pages
UNION ALL SELECT lang, 4, 'notes', doc_id, CAST(doc_id AS VARCHAR), 0, pos, url FROM note_links
UNION ALL SELECT 'en', 6, 'board', CAST(board AS BIGINT), CAST(board AS VARCHAR), card, pos, url FROM ({_board_links('true')})""",
    ),
    "page_fetch_join": _with(
        *_VALID_IDS,
        *_PX_IDS,
        _ANSWERS,
        body="SELECT f.feed, f.id, f.ord, a.page_id, a.id AS final_id FROM firsts f JOIN answers a ON a.id = f.id",
    ),
    "fetch_failures": _with(
        *_VALID_IDS, *_PX_IDS, body="SELECT feed, id, url FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM pxi p WHERE p.id = f.id)"
    ),
    "page_kind_counts": _with(*_DOCS[:3], body="SELECT kind, count(*) AS pages FROM kinds GROUP BY ALL"),
    "article_items": _with(
        *_DOCS,
        body=f"SELECT page_id, {_ARTICLE}, date_raw, date_iso IS NULL AND body_iso IS NULL AS date_is_fallback FROM docs WHERE kind = 'article'".replace(
            "date_iso IS NULL AND", "docs.date_iso IS NULL AND"
        ),
    ),
    "article_titles": _with(*_DOCS, body="SELECT page_id, title FROM docs"),
    "article_summaries": _with(*_DOCS, body="SELECT page_id, description, best_block, best_paragraph FROM docs"),
    "article_authors": _with(*_DOCS, body="SELECT page_id, author, language FROM docs"),
    "pages_per_language": _with(*_DOCS, body="SELECT language, count(*) AS pages FROM docs GROUP BY ALL"),
    "article_dates": _with(*_DOCS, body="SELECT page_id, date_raw, date_iso FROM docs"),
    "body_dates": _with(*_DOCS, body="SELECT page_id, body_date FROM docs"),
    "text_blocks": _with(
        *_DOCS, body="SELECT page_id, CAST(generate_subscripts(blocks, 1) - 1 AS INTEGER) AS pos, unnest(blocks) AS block FROM docs"
    ),
    "article_bodies": _with(*_DOCS, body="SELECT page_id, CAST(length(scope) AS INTEGER) AS chars, md5(scope) AS content_md5 FROM docs"),
    "video_items": _with(*_DOCS, body=_VIDEO),
    "videos_per_channel": _with(*_DOCS, body=f"SELECT author AS channel, count(*) AS videos FROM ({_VIDEO}) GROUP BY ALL"),
    "media_items": _with(*_DOCS, body=_MEDIA),
    "media_per_type": _with(*_DOCS, body=f"SELECT mime_type, count(*) AS items FROM ({_MEDIA}) GROUP BY ALL"),
    "page_items": _with(
        *_DOCS,
        body=f"""SELECT page_id, kind, {_ARTICLE}, '' AS tags, NULL AS attachment_url, NULL AS mime_type, NULL AS size_in_bytes, NULL AS duration_in_seconds FROM docs WHERE kind = 'article'
UNION ALL SELECT page_id, 'video', id, url, title, summary, NULL, NULL, NULL, author, NULL, tags, attachment_url, mime_type, NULL, duration_in_seconds FROM ({_VIDEO})
UNION ALL SELECT page_id, 'media', id, url, title, NULL, NULL, NULL, NULL, '', NULL, tags, attachment_url, mime_type, size_in_bytes, duration_in_seconds FROM ({_MEDIA})""",
    ),
    "tag_clean": _with(
        _table("raw_tags", FX.RAW_TAGS),
        rf"""lines AS (SELECT doc_id, list_transform(string_split({_trim('raw')}, chr(10)), lambda l: regexp_extract(regexp_replace(regexp_replace(lower({_trim('l')}),
  '^[\p{{Nd}}.\-*•]+\s*', ''), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '^\s*(\S+)', 1)) AS found FROM raw_tags)""",
        "tag_rows AS (SELECT doc_id, unnest(found) AS tag, generate_subscripts(found, 1) AS i FROM lines)",
        "tag_firsts AS (SELECT doc_id, tag, min(i) AS i FROM tag_rows WHERE length(tag) BETWEEN 2 AND 30 GROUP BY ALL)",
        "tag_top AS (SELECT * FROM tag_firsts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 5)",
        body="""SELECT d.doc_id, coalesce(string_agg(t.tag, '|' ORDER BY t.i), '') AS tags FROM documents d LEFT JOIN tag_top t ON t.doc_id = d.doc_id GROUP BY ALL""",
    ),
    "running_topics": _with(*_tfidf("documents", "doc_id"), body="SELECT doc_id, rank, term, score FROM topics"),
    "topic_tags_tfidf": _with(*_tfidf("documents", "doc_id"), body="SELECT doc_id, rank, term, score FROM topics"),
    "item_tags_merged": _with(
        *_ITEMS,
        r"""bodies AS (SELECT page_id, regexp_replace(regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
  '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), '<[^>]*>', ' ', 'g') AS body FROM pages)""",
        f"item_texts AS (SELECT i.id, {_unescape('b.body')} AS text FROM items i JOIN bodies b ON b.page_id = i.page_id)",
        *_tfidf("item_texts", "id"),
        """all_tags AS (SELECT feed, id, unnest(string_split(tags, '|')) AS tag FROM items UNION SELECT i.feed, i.id, t.term FROM items i JOIN topics t ON t.id = i.id)""",
        body="SELECT feed, id, string_agg(tag, '|' ORDER BY tag) AS tags FROM all_tags GROUP BY ALL",
    ),
    "tag_rollup": _with(
        *_ITEMS,
        body="SELECT feed, tag, count(*) AS items FROM (SELECT feed, unnest(string_split(tags, '|')) AS tag FROM items) GROUP BY ALL",
    ),
    "merge_append": _with(
        *_MERGE, body="SELECT feed, id, title, ord FROM old UNION ALL SELECT feed, id, title, ord FROM delta"
    ),
    "merge_rebuild": _with(
        *_MERGE,
        body="""SELECT feed, id, title, ord FROM new WHERE feed <> 'fr'
UNION ALL SELECT feed, id, title, ord FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.feed = o.feed AND n.feed <> 'fr')""",
    ),
    "dry_run_delta": _with(*_MERGE, body="SELECT feed, id, coalesce(nullif(title, ''), url) AS label FROM delta"),
    "json_feed_items": _with(
        *_ITEMS,
        body="""SELECT feed, ord, id, url, nullif(title, '') AS title, summary, content_html, date_iso AS date_published, modified_iso AS date_modified,
  author, language, second_tag, media_url, CAST(media_size AS VARCHAR) AS media_size,
  concat_ws(',', 'id', 'url', CASE WHEN title <> '' THEN 'title' END, CASE WHEN summary <> '' THEN 'summary' END, 'content_html',
    CASE WHEN date_iso IS NOT NULL THEN 'date_published' END, CASE WHEN modified_iso IS NOT NULL THEN 'date_modified' END,
    CASE WHEN author IS NOT NULL THEN 'authors' END, 'language', 'tags', CASE WHEN media_url IS NOT NULL THEN 'attachments' END) AS keys FROM items""",
    ),
    "stored_feed_roundtrip": _with(
        *_ITEMS,
        body="SELECT feed, id, url, nullif(title, '') AS title, summary, date_iso, modified_iso, author, tags, media_size FROM items",
    ),
    "stored_feed_headers": _with(
        *_ITEMS,
        _FEEDS,
        body="""SELECT f.feed, coalesce(f.title, 'Untitled Feed') AS title, f.home_page_url, f.feed_url, f.description, f.language, count(i.url) AS items, max(i.url) AS last_url
FROM feeds f LEFT JOIN items i ON i.feed = f.feed GROUP BY ALL""",
    ),
    "json_feed_pages": _with(
        *_ITEMS,
        _FEEDS,
        "placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY feed ORDER BY ord, id) - 1) // 50 + 1 AS INTEGER) AS page FROM items)",
        "counted AS (SELECT feed, page, count(*) AS items, arg_min(url, ord) AS first_url, string_agg(id, ',' ORDER BY ord, id) AS ids FROM placed GROUP BY ALL)",
        body="""SELECT f.feed, coalesce(c.page, 1) AS page, CAST(coalesce(c.items, 0) AS INTEGER) AS items,
  CASE WHEN c.page < max(c.page) OVER (PARTITION BY f.feed) THEN concat('feed-', c.page + 1, '.json') END AS next_url, c.first_url, md5(coalesce(c.ids, '')) AS ids_md5
FROM feeds f LEFT JOIN counted c ON c.feed = f.feed""",
    ),
    "rss_ranked_items": _with(*_ITEMS, body="SELECT feed, id, rank FROM rss"),
    "rss_item_texts": _with(
        *_ITEMS,
        body=f"""SELECT feed, id, coalesce(nullif({_clean('title')}, ''), url) AS title, {_clean("coalesce(nullif(summary, ''), content_html)")} AS description,
  concat(strftime(date_local, '%a, %d %b %Y %H:%M:%S '), CASE WHEN date_iso LIKE '%-05:00' THEN '-0500' ELSE '+0000' END) AS pub_date FROM items""".replace(
            "concat(strftime(date_local, '%a, %d %b %Y %H:%M:%S '), CASE", "strftime(date_local, '%a, %d %b %Y %H:%M:%S ') || (CASE"
        ).replace("ELSE '+0000' END) AS", "ELSE '+0000' END) AS"),
    ),
    "rss_documents": _with(
        *_ITEMS,
        _FEEDS,
        body=f"""SELECT f.feed, CAST(coalesce((i.rank - 1) // {PAGE_ITEMS}, 0) + 1 AS INTEGER) AS page, {_escape("coalesce(f.title, 'Untitled Feed')")} AS title, coalesce(f.home_page_url, 'https://example.com') AS link,
  {_escape("coalesce(f.description, f.title, 'Untitled Feed')")} AS description, CAST(count(i.id) AS INTEGER) AS items, CAST(count(i.media_url) AS INTEGER) AS enclosures,
  CAST(2 * count(i.id) AS INTEGER) AS categories, CAST(count(i.date_iso) AS INTEGER) AS dates, coalesce(arg_min(i.id, i.rank), '') AS first_id, md5(coalesce(string_agg(i.id, ',' ORDER BY i.rank), '')) AS ids_md5
FROM feeds f LEFT JOIN rss i ON i.feed = f.feed GROUP BY ALL""",
    ),
    "byte_pages": """SELECT lang, doc_id, rank, before, (rank - 1) // 100 + before // 65536 AS page_key FROM (
  SELECT lang, doc_id, row_number() OVER w AS rank, CAST(sum(size) OVER w - size AS BIGINT) AS before
  FROM (SELECT lang, doc_id, coalesce(strlen(text), 0) AS size FROM documents) WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING))""",
    "published_documents": _with(
        *_ITEMS,
        _FEEDS,
        "held AS (SELECT * FROM ranked WHERE feed <> 'en' OR url LIKE 'http:%')",
        """sorted AS (SELECT feed, id, 'json' AS kind, row_number() OVER (PARTITION BY feed ORDER BY ord, id) AS rank FROM held
  UNION ALL SELECT feed, id, 'xml', row_number() OVER (PARTITION BY feed ORDER BY moment DESC NULLS LAST, ord, id) FROM held)""",
        "paged AS (SELECT feed, kind, (rank - 1) // 50 + 1 AS page, count(*) AS items, string_agg(id, ',' ORDER BY rank) AS ids FROM sorted GROUP BY ALL)",
        """wanted AS (SELECT feed, output_dir, unnest(['json', 'xml']) AS kind FROM feeds)""",
        body="""SELECT concat(coalesce(output_dir, feed), '/feed', CASE WHEN page > 1 THEN concat('-', page) ELSE '' END, '.', kind) AS name, feed,
  CAST(coalesce(items, 0) AS INTEGER) AS items, md5(coalesce(ids, '')) AS ids_md5 FROM wanted LEFT JOIN paged USING (feed, kind)""",
    ),
    "rss_enclosures": _with(
        *_ITEMS,
        body="""SELECT feed, id, 0 AS pos, media_url AS url, 'audio/mpeg' AS type, coalesce(media_size, 0) AS length FROM items WHERE media_url IS NOT NULL""",
    ),
    "xml_clean_items": _with(
        *_ITEMS, body=f"SELECT feed, id, {_clean('title')} AS title, {_clean('summary')} AS summary, {_clean('content_html')} AS content_html FROM items"
    ),
    "feed_catalogue": _with(*_CATALOGUE, body="SELECT feed, path, title, description, item_count, last_updated FROM listed"),
    "running_catalogue": _with(*_CATALOGUE, body="SELECT feed, path, title, description, item_count, last_updated FROM listed"),
    "catalogue_page": _with(
        *_CATALOGUE,
        f"""lines AS (SELECT 0 AS section, '' AS path, '<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>{fixed.SITE_TITLE}</title>' AS line
  UNION ALL SELECT 1, path, concat('<link rel="alternate" type="application/rss+xml" title="', {_escape('title')}, '" href="', path, '/feed.xml">') FROM listed
  UNION ALL SELECT 2, '', '</head><body><h1>{fixed.SITE_TITLE}</h1>{fixed.SITE_DESCRIPTION}<dl>'
  UNION ALL SELECT 3, path, concat('<dt><a href="', path, '/feed.json">', {_escape('title')}, '</a> <a href="', path, '/feed.xml">rss</a></dt><dd>', {_escape('description')}, ' (', item_count, ', ', last_updated, ')</dd>') FROM listed
  UNION ALL SELECT 4, '', '</dl><p>As of 2025-12-29</p></body></html>')""",
        body="SELECT row_number() OVER (ORDER BY section, path) AS pos, line FROM lines",
    ),
    "catalogue_listing": _with(
        *_CATALOGUE,
        body=f"""SELECT path, concat(path, '/feed.json') AS json_url, concat(path, '/feed.xml') AS rss_url,
  concat('<dt><a href="', path, '/feed.json">', {_escape('title')}, '</a> <a href="', path, '/feed.xml">rss</a></dt><dd>', {_escape('description')}, ' (', item_count, ', ', last_updated, ')</dd>') AS entry,
  concat('<link rel="alternate" type="application/rss+xml" title="', {_escape('title')}, '" href="', path, '/feed.xml">') AS autodiscovery FROM listed""",
    ),
    "ingest_funnel": _with(
        *_RUN,
        body="SELECT feed, count(*) AS collected, "
        + ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS {s}" for s in _STAGES)
        + " FROM judged GROUP BY ALL",
    ),
    "running_funnel": _with(
        *_RUN,
        """halves AS (SELECT *, ord % 2 AS run, row_number() OVER (PARTITION BY feed, id, early, ord % 2 ORDER BY ord) AS nth FROM staged)""",
        """seen_in AS (SELECT h.*, a.page_id, EXISTS (SELECT 1 FROM stored s WHERE s.feed = h.feed AND s.id = h.id) AS held FROM halves h LEFT JOIN answers a ON a.id = h.id)""",
        """first_run AS (SELECT DISTINCT feed, id FROM seen_in WHERE run = 0 AND early IS NULL AND NOT held AND page_id IS NOT NULL)""",
        """told AS (SELECT s.feed, s.id, CASE WHEN early IS NOT NULL THEN early WHEN nth > 1 THEN 'duplicate' WHEN held OR (run = 1 AND f.id IS NOT NULL) THEN 'stored'
  WHEN page_id IS NULL THEN 'no_page' ELSE 'added' END AS stage FROM seen_in s LEFT JOIN first_run f ON f.feed = s.feed AND f.id = s.id)""",
        "kept AS (SELECT feed, count(DISTINCT id) AS n FROM stored GROUP BY feed)",
        body="SELECT feed, count(*) AS collected, "
        + ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS {s}" for s in _STAGES)
        + ", count(*) FILTER (WHERE stage = 'added') AS parsed, count(*) FILTER (WHERE stage = 'added') + coalesce((SELECT n FROM kept k WHERE k.feed = told.feed), 0) AS total FROM told GROUP BY feed",
    ),
    "multi_feed_run": _with(
        *_RUN,
        "placed AS (SELECT feed, page_id, row_number() OVER (PARTITION BY feed ORDER BY ord) - 1 AS ord FROM judged WHERE stage = 'added')",
        body="""SELECT p.feed, d.id, d.url, CASE WHEN kind = 'video' THEN v.title WHEN kind = 'media' THEN m.title ELSE d.title END AS title,
  CASE WHEN kind = 'article' THEN d.summary WHEN kind = 'video' THEN v.summary END AS summary,
  CASE WHEN kind = 'article' THEN coalesce(d.date_iso, d.body_iso, '2025-12-29T00:00:00') END AS date_iso,
  CASE WHEN kind = 'article' THEN d.language END AS language, p.ord
FROM placed p JOIN docs d ON d.page_id = p.page_id LEFT JOIN (VIDEO) v ON v.page_id = p.page_id LEFT JOIN (MEDIA) m ON m.page_id = p.page_id""".replace(
            "VIDEO", _VIDEO
        ).replace("MEDIA", _MEDIA),
    ),
    "corpus_items": _PLAIN,
    "incremental_equals_batch": _ARRIVED,
}

CHECK_SQL["source_union_first_seen"] = _with(
    _table("merged", CHECK_SQL["source_union_ordered"]),
    _canon("merged", "merged_ids"),
    _table("merged_valid", "SELECT * FROM merged_ids WHERE valid"),
    _first("merged_valid", "merged_firsts", order="source_rank, ref_id, source_ref, part, pos"),
    body="SELECT feed, id, source_kind, source_ref, part, pos, url FROM merged_firsts",
)
