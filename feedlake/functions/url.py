"""Url handling.

Urls are taken apart with one regular expression (RFC 3986, appendix B) and never
with ``parse_url``, which rejects blanks and bars that real links contain.
"""

from __future__ import annotations

from feedlake import fixed
from feedlake.functions.sql import (
    case,
    each,
    fold,
    keep,
    let,
    lit,
    lits,
    matches,
    replace,
    substitute,
)

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
_SEP = "\u0001"


def url_parts(url: str) -> str:
    """``[scheme, authority, path, query, fragment]``, '' for what is missing."""
    clean = substitute(url, r"^[\x00-\x20]+|[\t\r\n\x01]")
    marked = substitute(clean, _SPLIT, _SEP.join(f"${i}" for i in range(1, 6)))
    return f"split({marked}, {lit(_SEP)}, -1)"


def _authority_ok(authority: str) -> str:
    """Square brackets come in pairs or not at all."""
    return f"(contains({authority}, '[') = contains({authority}, ']'))"


def is_valid_url(url: str) -> str:
    """True for http(s) urls with a host."""
    ok = let(
        url_parts(url),
        lambda p: f"(lower({p}[0]) IN ('http', 'https') AND {p}[1] <> '' AND {_authority_ok(f'{p}[1]')})",
    )
    return f"coalesce({ok}, false)"


def authority(url: str) -> str:
    """Authority as written, case and port included."""
    return f"{url_parts(url)}[1]"


def domain(url: str) -> str:
    """Lower-cased authority, port included; '' where there is none."""
    return let(authority(url), lambda a: case((_authority_ok(a), f"lower({a})"), otherwise="''"))


def pattern_host(url: str) -> str:
    """The host patterns are compared with: authority up to its first colon."""
    return f"substring_index({domain(url)}, ':', 1)"


def _decode(c: str) -> str:
    """Form decoding that keeps malformed escapes instead of giving up."""
    return f"try_url_decode({substitute(c, '%(?![0-9A-Fa-f]{2})', '%25')})"


def decode_path(c: str) -> str:
    """Percent-decoding that leaves a plus sign alone."""
    return _decode(replace(c, "+", "%2B"))


def _encode(c: str) -> str:
    return replace(replace(f"url_encode({c})", "*", "%2A"), "%7E", "~")


def _canonical_query(query: str) -> str:
    """Drop tracking keys; gather repeats of a key at its first position."""
    parts = keep(f"split({query}, '&')", lambda part: f"{part} <> ''")
    pairs = keep(
        each(
            parts,
            lambda part: f"named_struct('k', {_decode(f'substring_index({part}, {lit("=")}, 1)')},"
            f" 'v', {_decode(substitute(part, '(?s)^[^=]*=?'))})",
        ),
        lambda pair: f"lower({pair}.k) NOT IN ({lits(fixed.TRACKING_KEYS)})",
    )

    def gather(all_pairs: str) -> str:
        keys = f"array_distinct({each(all_pairs, lambda one: f'{one}.k')})"
        regrouped = each(keys, lambda key: keep(all_pairs, lambda one: f"{one}.k = {key}"))
        return case((f"size({keys}) = size({all_pairs})", all_pairs), otherwise=f"flatten({regrouped})")

    texts = each(
        let(pairs, gather),
        lambda kv: f"concat({_encode(f'{kv}.k')}, '=', {_encode(f'{kv}.v')})",
    )
    return f"array_join({texts}, '&')"


def _joined(scheme: str, authority: str, path: str, query: str) -> str:
    """Write a url from its parts; "//" only where an authority or the scheme calls for it."""
    rooted = f"({path} = '' OR startswith({path}, '/'))"
    slashes = (
        f"{authority} <> '' OR startswith({path}, '//')"
        f" OR ({rooted} AND {scheme} IN ({lits(fixed.NETLOC_SCHEMES)}))"
    )
    return (
        f"concat(if({scheme} = '', '', concat({scheme}, ':')), if({slashes}, '//', ''), {authority},"
        f" if({authority} <> '' AND NOT {rooted}, '/', ''), {path},"
        f" if({query} = '', '', concat('?', {query})))"
    )


def canonical_url(url: str) -> str:
    """One spelling per page: see the module tests for the full list of rules."""

    def rebuilt(p: str) -> str:
        path = substitute(f"{p}[2]", r";[^/]*$")
        cleaned = (
            f"array(lower({p}[0]), "
            + case(
                (f"lower({p}[0]) = 'http'", substitute(f"lower({p}[1])", r":80$")),
                (f"lower({p}[0]) = 'https'", substitute(f"lower({p}[1])", r":443$")),
                otherwise=f"lower({p}[1])",
            )
            + f", {let(path, lambda q: f'if({q} = {lit("/")}, {q}, rtrim({lit("/")}, {q}))')}"
            + f", if({p}[3] = '', '', {_canonical_query(f'{p}[3]')}))"
        )
        built = let(cleaned, lambda c: _joined(f"{c}[0]", f"{c}[1]", f"{c}[2]", f"{c}[3]"))
        return f"if({_authority_ok(f'{p}[1]')}, {built}, {url})"

    return let(url_parts(url), rebuilt)


def url_id(canonical: str) -> str:
    """Stable 64-bit id, as 16 hex digits, of a canonical url."""
    return f"substring(sha2({canonical}, 256), 1, 16)"


def page_id_of(url: str) -> str:
    """Id of a url as found: canonical form, then hash."""
    return url_id(canonical_url(url))


def _merge_path(base_path: str, path: str) -> str:
    """Resolve ``path`` against ``base_path``: dot segments go, and so do empty
    segments inside a relative path."""
    folder = let(substitute(base_path, r"[^/]*$"), lambda f: f"if({f} = '', '/', {f})")
    joined = f"if(startswith({path}, '/'), {path}, concat({folder}, {path}))"

    def walk(segments: str) -> str:
        inner = (
            f"if(startswith({path}, '/'), {segments},"
            f" filter({segments}, (seg, i) -> seg <> '' OR i = size({segments}) - 1))"
        )
        kept = fold(
            inner,
            "CAST(array() AS array<string>)",
            lambda acc, seg: case(
                (f"{seg} = '..'", f"slice({acc}, 1, greatest(size({acc}) - 1, 0))"),
                (f"{seg} = '.'", acc),
                otherwise=f"concat({acc}, array({seg}))",
            ),
        )
        return let(
            kept,
            lambda k: f"concat('/', array_join({k}, '/'),"
            f" if(element_at({segments}, -1) IN ('.', '..') AND size({k}) > 0, '/', ''))",
        )

    return let(
        joined,
        lambda whole: case(
            (matches(whole, r"//|/\.{1,2}(/|$)"), let(f"split(substring({whole}, 2), '/', -1)", walk)),
            otherwise=whole,
        ),
    )


def resolve_url(base: str, href: str) -> str:
    """Absolute form of ``href`` as found on the page ``base``."""
    return let(url_parts(base), lambda b: let(url_parts(href), lambda h: _resolved(base, href, b, h)))


def _resolved(base: str, href: str, b: str, h: str) -> str:
    own_authority, own_path = f"{h}[1] <> ''", f"{h}[2] <> ''"
    query = f"if({own_authority} OR {own_path} OR {h}[3] <> '', {h}[3], {b}[3])"
    path = case(
        (own_authority, f"{h}[2]"),
        (own_path, _merge_path(f"{b}[2]", f"{h}[2]")),
        otherwise=f"{b}[2]",
    )
    return case(
        (f"{href} = ''", base),
        (f"{h}[0] <> '' AND lower({h}[0]) <> lower({b}[0])", href),
        otherwise=(
            f"concat(lower({b}[0]), '://', if({own_authority}, {h}[1], {b}[1]), {path}, "
            + let(query, lambda q: f"if({q} = '', '', concat('?', {q}))")
            + f", if({h}[4] = '', '', concat('#', {h}[4])))"
        ),
    )


def within_site(link_authority: str, site_authority: str) -> str:
    """The link's authority is the site's or a sub-domain of it (case matters)."""
    return (
        f"({link_authority} = {site_authority}"
        f" OR endswith({link_authority}, concat('.', {site_authority})))"
    )
