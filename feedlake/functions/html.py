"""Reading stored html with regular expressions, inside the JVM.

The body is scanned once to drop comments, scripts and styles, and once to pull the
``meta``/``link`` tags into a short string. All look-ups of single values then run on
that short string, so their number does not multiply the cost of a large page.
"""

from __future__ import annotations

from feedlake import fixed
from feedlake.functions.sql import (
    case,
    each,
    extract,
    extract_all,
    first_nonempty,
    fold,
    keep,
    let,
    lit,
    lits,
    matches,
    nonempty,
    replace,
    substitute,
)
from feedlake.functions.text import collapse, strip, unescape

# What follows the name of an element: without it ``<main-nav>`` would be taken for ``<main>``.
_NAMED = r"(?=[\s/>])"
_HIDDEN = rf"(?is)<(?:!--.*?-->|script{_NAMED}.*?</script\s*>|style{_NAMED}.*?</style\s*>)"
_JSON_LD = (
    rf"(?is)<!--.*?-->|<script{_NAMED}[^>]*?[\s\"']type\s*=\s*[\"']?application/ld\+json[\"']?"
    rf"[^>]*>(.*?)</script\s*>|<script{_NAMED}.*?</script\s*>"
)
_HEAD_TAGS = rf"(?is)<(?:meta|link){_NAMED}(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_BLOCK = r"</?(?:p|div|h[1-6]|li|ul|ol|section)(?:\s[^>]*|/)?>"
_MARK = "\u0002"
# an unclosed paragraph ends at the next block or where the element around it ends
_PARAGRAPH_END = (
    r"(?is)</?(?:p|div|h[1-6]|li|ul|ol|section|article|main|body|header|footer|nav|aside"
    r"|table|td|blockquote|form)(?:\s[^>]*|/)?>.*$"
)
_ATTR_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def visible(html: str) -> str:
    """The page without comments, scripts and styles."""
    return substitute(html, _HIDDEN)


def head_tags(doc: str) -> str:
    """All meta and link tags of a visible page, one string, in order."""
    tags = each(
        extract_all(doc, _HEAD_TAGS),
        lambda tag: f"concat({replace(f'left({tag}, length({tag}) - 1)', '>', '&gt;')}, '>')",
    )
    return f"array_join({tags}, '\\n')"


def attribute(tag: str, name: str) -> str:
    """Raw value of an attribute of one tag; '' if it is missing."""
    return substitute(extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{_ATTR_VALUE}"), "^[\"']|[\"']$")


def tag_value(tags: str, element: str, attr: str, key: str, value: str = "content") -> str:
    """Raw ``value`` of the first ``element`` whose ``attr`` is ``key``; '' if missing."""
    quoted = key.replace(".", r"\.")
    found = extract(
        tags,
        rf"(?s)<(?i:{element}){_NAMED}[^>]*?[\s\"'](?i:{attr})\s*=\s*"
        rf"(?:\"{quoted}\"|'{quoted}'|{quoted}(?=[\s/>]))[^>]*>",
        0,
    )
    return attribute(found, value)


def meta_property(tags: str, key: str) -> str:
    return tag_value(tags, "meta", "property", key)


def meta_name(tags: str, key: str) -> str:
    return tag_value(tags, "meta", "name", key)


def _without_tags(fragment: str) -> str:
    return substitute(fragment, r"<[^<>]*+>", " ")


def inner_text(fragment: str) -> str:
    """Text of a fragment: inline tags become one blank, white space is collapsed."""
    return collapse(unescape(_without_tags(fragment)))


def clean(c: str) -> str:
    """Decoded and trimmed text, NULL if nothing is left."""
    return nonempty(strip(unescape(c)))


def title_tag(doc: str) -> str:
    """Raw text of ``<title>``; '' if missing."""
    return extract(doc, rf"(?is)<title{_NAMED}[^>]*>(.*?)</title\s*>")


def first_heading(doc: str) -> str:
    """Raw text of the first ``<h1>`` without inner tags; '' if missing."""
    return collapse(_without_tags(extract(doc, rf"(?is)<h1{_NAMED}[^>]*>(.*?)</h1\s*>")))


def element(doc: str, name: str) -> str:
    """Inner html of the first element of exactly this name, up to the end tag that balances; '' if there is none.

    The depth is counted over the begin and end tags of the name, so elements of the same name may lie inside. An element that is never
    closed ends with the body.
    """
    begin, end = rf"<{name}{_NAMED}[^>]*+>", rf"</{name}{_NAMED}[^>]*+>"
    start = "named_struct('depth', 1, 'taken', 0)"
    rest = extract(doc, rf"(?is){begin}(.*)")

    def parts(pieces: str) -> str:
        depth = f"(acc.depth + regexp_count(piece, {lit('(?i)' + begin)}) - 1)"
        walked = (
            f"aggregate({pieces}, {start}, (acc, piece) -> if(acc.depth = 0, acc,"
            f" named_struct('depth', {depth}, 'taken', acc.taken + 1)))"
        )
        # the last piece has no end tag, so what is taken up to it is open still
        return let(
            f"({walked}).taken",
            lambda taken: f"if({taken} < size({pieces}), array_join(slice({pieces}, 1, {taken}), '</{name}>'),"
            f" {substitute(f'array_join({pieces}, {lit(f"</{name}>")})', r'(?is)</(?:body|html)\s*>.*$')})",
        )

    return let(f"split({rest}, {lit('(?i)' + end)}, -1)", parts)


def article_scope(doc: str) -> str:
    """Inner html of the first ``<article>``, else ``<main>``, else ``<body>``, else all."""
    return case(
        *[(matches(doc, rf"(?i)<{name}{_NAMED}"), element(doc, name)) for name in ("article", "main", "body")],
        otherwise=doc,
    )


def text_blocks(fragment: str) -> str:
    """Non-empty text blocks of a fragment, in order.

    Block tags become a mark first, so the text is cleaned once as a whole and not
    block by block.
    """
    marked = substitute(replace(fragment, _MARK, " "), "(?i)" + _BLOCK, _MARK)
    pieces = f"split({inner_text(marked)}, {lit(_MARK)})"
    return keep(each(pieces, lambda b: f"trim({b})"), lambda b: f"{b} <> ''")


def paragraph_texts(doc: str, limit: int) -> str:
    """Texts of the first ``limit`` ``<p>`` elements, each up to its end."""
    pieces = f"slice(split({doc}, {lit(r'(?i)<p(?:\s[^>]*)?>')}), 2, {limit})"
    return each(pieces, lambda piece: inner_text(substitute(piece, _PARAGRAPH_END)))


def best_block(blocks: str) -> str:
    """Longest of the first four blocks with more than 100 characters, cut to 500.

    The first one wins a tie. NULL if no block is long enough.
    """
    candidates = keep(
        f"slice({blocks}, 1, {fixed.SUMMARY_BLOCKS})",
        lambda b: f"length({b}) > {fixed.SUMMARY_MIN_CHARS}",
    )
    longest = fold(
        candidates, "''", lambda best, b: f"if(length({b}) > length({best}), {b}, {best})"
    )
    return nonempty(f"left({longest}, {fixed.SUMMARY_CHARS})")


def language(doc: str, tags: str) -> str:
    """``<html lang>``, else ``og:locale``."""
    lang = attribute(extract(doc, rf"(?is)<html{_NAMED}[^>]*>", 0), "lang")
    return unescape(first_nonempty(lang, meta_property(tags, "og:locale")))


def json_ld_scripts(html: str) -> str:
    """Bodies of all JSON-LD scripts outside comments."""
    found = keep(extract_all(html, _JSON_LD, 1), lambda s: f"{s} <> ''")
    return f"if(contains({html}, 'ld+json'), {found}, CAST(array() AS array<string>))"


def json_ld_date(scripts: str) -> str:
    """First non-empty ``datePublished``/``dateCreated`` over all scripts."""
    schema = "array<struct<datePublished:string,dateCreated:string>>"
    entries = each(
        scripts, lambda s: f"coalesce(from_json({s}, '{schema}'), CAST(array() AS {schema}))"
    )
    dates = each(f"flatten({entries})", lambda e: f"array({e}.datePublished, {e}.dateCreated)")
    return f"get({keep(f'flatten({dates})', lambda d: f'{d} <> {lit("")}')}, 0)"


def time_tag(doc: str) -> str:
    """Raw ``datetime`` of the first ``<time>`` that has one; '' if missing."""
    return attribute(extract(doc, rf"(?is)<time{_NAMED}[^>]*?[\s\"']datetime\s*=[^>]*>", 0), "datetime")


def anchors(doc: str) -> str:
    """``array<struct<href, scoped>>`` of all links with a target, in page order.

    ``scoped`` marks links inside an article-like element (by tag or class) or with an
    article-like path. An element ends where the count of its own tag name is balanced,
    so unclosed inner tags do no harm. Pages without article-like classes only need
    their anchor, article and main tags looked at.
    """
    classes, void = "|".join(fixed.SCOPE_CLASSES), "|".join(fixed.VOID_TAGS)
    class_rx = (
        rf"(?s)^<[^>]*[\s\"'](?i:class)\s*=\s*(?:\"(?:[^\"]*\s)?(?:{classes})(?:\s[^\"]*)?\""
        rf"|'(?:[^']*\s)?(?:{classes})(?:\s[^']*)?'|(?:{classes})[\s>])"
    )
    hint = rf"(?i)class\s*=\s*[\"']?[^\"'>]*(?:{classes})"
    some = r"(?is)</?(?:a|article|main)(?:\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)?>"
    every = r"(?is)</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    tags = f"if({matches(doc, hint)}, {extract_all(doc, every)}, {extract_all(doc, some)})"

    parsed = (
        f"transform({tags}, (tag, i) -> named_struct('pos', i,"
        f" 'name', lower({extract('tag', r'^</?([A-Za-z][A-Za-z0-9-]*)')}),"
        f" 'step', CASE WHEN {matches('tag', rf'^(?i)</?(?:{void})\b')} OR endswith(tag, '/>') THEN 0"
        " WHEN startswith(tag, '</') THEN -1 ELSE 1 END,"
        f" 'marked', {matches('tag', class_rx)},"
        f" 'href', if({matches('tag', r'^<[aA]\s')}, {unescape(attribute('tag', 'href'))}, NULL)))"
    )

    def spans(all_tags: str) -> str:
        """First and last tag position of each article-like element; few per page."""
        opens = (
            "(acc.depth = 0 AND t.step = 1 AND"
            f" (t.name IN ({lits(fixed.SCOPE_TAGS)}) OR t.marked))"
        )
        same = "(acc.depth > 0 AND t.name = acc.name)"
        depth = case((same, "acc.depth + t.step"), (opens, "1"), otherwise="acc.depth")
        closed = f"if({same} AND acc.depth + t.step = 0, concat(acc.done, array(named_struct('lo', acc.lo, 'hi', t.pos))), acc.done)"
        return (
            f"aggregate({all_tags},"
            " named_struct('name', '', 'depth', 0, 'lo', -1, 'done', CAST(array() AS array<struct<lo:int,hi:int>>)),"
            f" (acc, t) -> named_struct('name', if({opens}, t.name, acc.name), 'depth', {depth},"
            f" 'lo', if({opens}, t.pos, acc.lo), 'done', {closed}),"
            " acc -> if(acc.depth > 0, concat(acc.done, array(named_struct('lo', acc.lo, 'hi', 2147483647))), acc.done))"
        )

    def links(all_tags: str, scopes: str) -> str:
        inside = f"exists({scopes}, s -> a.pos > s.lo AND a.pos < s.hi)"
        by_path = matches("a.href", "|".join(fixed.SCOPE_PATHS))
        return (
            f"transform(filter({all_tags}, t -> t.href <> ''),"
            f" a -> named_struct('href', a.href, 'scoped', {inside} OR {by_path}))"
        )

    return let(parsed, lambda found: let(spans(found), lambda scopes: links(found, scopes)))
