"""Links inside text and pages, as arrays."""

from __future__ import annotations

from feedlake import fixed
from feedlake.functions.html import anchors
from feedlake.functions.sql import each, extract, extract_all, keep, let, lits, matches
from feedlake.functions.text import cut_right, strip, unescape
from feedlake.functions.url import authority, domain, is_valid_url, resolve_url, within_site


def _bare(text: str, rx: str, trail: str) -> str:
    return each(extract_all(text, rx), lambda u: cut_right(strip(u), trail))


def markdown_links(text: str) -> str:
    """Distinct valid urls of a Markdown text: inline links first, then bare urls."""
    inline = each(extract_all(text, fixed.MARKDOWN_LINK, 2), strip)
    bare = _bare(text, fixed.MARKDOWN_BARE, fixed.MARKDOWN_TRAIL)
    return f"array_distinct({keep(f'concat({inline}, {bare})', is_valid_url)})"


def text_links(text: str) -> str:
    """Distinct valid urls of free text that do not point back at the board service."""
    found = _bare(f"coalesce({text}, '')", fixed.BOARD_BARE, fixed.BOARD_TRAIL)
    foreign = keep(
        found, lambda u: f"({is_valid_url(u)} AND {domain(u)} NOT IN ({lits(fixed.BOARD_HOSTS)}))"
    )
    return f"array_distinct({foreign})"


def sitemap_locations(xml: str) -> str:
    """Trimmed, non-empty ``loc`` of each ``url`` entry; index entries are not among them."""
    return _locations(xml, "url")


def sitemap_parts(xml: str) -> str:
    """Trimmed, non-empty ``loc`` of each entry of a sitemap index."""
    return _locations(xml, "sitemap")


def _locations(xml: str, name: str) -> str:
    entries = extract_all(xml, rf"(?is)<{name}(?=[\s/>])[^>]*>(.*?)</{name}\s*>", 1)
    locations = each(
        entries, lambda e: strip(unescape(extract(e, r"(?is)<loc\b[^>]*>(.*?)</loc\s*>")))
    )
    return keep(locations, lambda u: f"{u} <> ''")


def page_links(url: str, doc: str) -> str:
    """Distinct absolute same-site links of a page, in page order.

    Links in article-like places only; if none of those is on the same site, all links.
    """

    def choose(found: str) -> str:
        scoped = keep(found, lambda one: f"{one}.scoped")
        chosen = let(scoped, lambda s: f"if(size({s}) > 0, {s}, {found})")
        return f"array_distinct({each(chosen, lambda one: f'{one}.link')})"

    def resolved(site: str) -> str:
        links = each(
            anchors(doc),
            lambda a: f"named_struct('link', {resolve_url(url, f'{a}.href')}, 'scoped', {a}.scoped)",
        )
        return keep(links, lambda one: within_site(authority(f"{one}.link"), site))

    return let(let(authority(url), resolved), choose)


def article_links(links: str, site: str) -> str:
    """Drop the site itself, invalid urls, assets, taxonomy, sign-in and search links."""
    unwanted = "(?i)" + "|".join(fixed.EXCLUDED_LINKS)
    return keep(
        links,
        lambda u: f"({is_valid_url(u)} AND {cut_right(u, '/')} <> {cut_right(site, '/')}"
        f" AND NOT {matches(u, unwanted)})",
    )
