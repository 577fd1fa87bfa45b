"""Text clean-up."""

from __future__ import annotations

from functools import cache
from html.entities import html5

from feedlake import fixed
from feedlake.functions.sql import case, each, extract_all, fold, keep, let, lit, matches, replace, substitute


# All Unicode white space, as a trim set.
_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: str) -> str:
    """Trim all Unicode white space at both ends (``trim`` only knows the blank)."""
    return f"btrim({c}, {lit(_SPACE)})"


def collapse(c: str) -> str:
    """One blank for each run of white space, none at the ends."""
    return f"trim({substitute(c, r'(?U)\s+', ' ')})"


def _numeric_entities(c: str) -> str:
    """Decode ``&#8217;`` and ``&#x2019;`` forms."""

    def usable(digits: str, base: int) -> str:
        """A code point of Unicode, however many zeros stand before it."""
        short = f"ltrim('0', {digits})"
        number = f"CAST(conv({short}, {base}, 10) AS INT)"
        return f"(length({short}) BETWEEN 1 AND 7 AND {number} <= 1114111 AND {number} NOT BETWEEN 55296 AND 57343)"

    def decoded(text: str, digits: str, hexa: str) -> str:
        char = f"decode(unhex(lpad({hexa}, 8, '0')), 'UTF-32')"
        return f"replace({text}, concat('&#', {digits}, ';'), {char})"

    decimal = keep(f"array_distinct({extract_all(c, '&#([0-9]+);', 1)})", lambda d: usable(d, 10))
    step1 = fold(decimal, c, lambda acc, d: decoded(acc, d, f"conv(ltrim('0', {d}), 10, 16)"))
    hexa = keep(
        f"array_distinct({extract_all(c, '&#([xX][0-9A-Fa-f]+);', 1)})",
        lambda d: usable(f"substring({d}, 2)", 16),
    )
    return fold(hexa, step1, lambda acc, d: decoded(acc, d, f"ltrim('0', substring({d}, 2))"))


@cache
def _named_entities() -> str:
    """All named html entities but ``&amp;``, as a map that is folded to a constant."""
    names = {n: c for n, c in html5.items() if n.endswith(";") and n.lower() != "amp;"}
    return f"str_to_map({lit(chr(1).join(f'&{n}{chr(2)}{c}' for n, c in names.items()))}, '\\u0001', '\\u0002')"


def unescape(c: str) -> str:
    """Decode html entities; text without ``&`` is passed through untouched.

    Only the names that occur in the text are replaced, ``&amp;`` after all others.
    """
    chars = _named_entities()

    def numeric(t: str) -> str:
        return case((f"contains({t}, '&#')", _numeric_entities(t)), otherwise=t)

    def decode(t: str) -> str:
        found = keep(
            f"array_distinct({extract_all(t, '&[A-Za-z][A-Za-z0-9]*;')})", lambda n: f"map_contains_key({chars}, {n})"
        )
        named = fold(found, t, lambda acc, n: f"replace({acc}, {n}, {chars}[{n}])")
        return case((f"contains({t}, '&')", replace(let(named, numeric), "&amp;", "&")), otherwise=t)

    return let(c, decode)


def escape_html(c: str) -> str:
    """Escape the four characters that matter in html and xml text and attributes."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = replace(c, char, name)
    return c


def xml_clean(c: str) -> str:
    """Drop control characters that xml 1.0 does not allow."""
    return substitute(c, fixed.XML_INVALID)


#: A closed class of a glob, ``[ab]`` or ``[!a-z]``; the first character may be the bracket itself.
GLOB_CLASS = r"(?s)\[!?\]?[^\]]*\]"


def _quoted(char: str) -> str:
    return f"if({matches(char, r'^[!-/:-@\[-`{-~\s]')}, concat('\\\\', {char}), {char})"


def _glob_class(token: str) -> str:
    """A class with every sign quoted; ranges that run backwards hold nothing."""
    negative = f"startswith({token}, '[!')"
    inner = f"substring({token}, if({negative}, 3, 2), length({token}) - if({negative}, 3, 2))"

    def part(p: str) -> str:
        first, last = f"left({p}, 1)", f"right({p}, 1)"
        return case(
            (f"length({p}) = 1", _quoted(p)),
            (f"{first} <= {last}", f"concat({_quoted(first)}, '-', {_quoted(last)})"),
            otherwise="''",
        )

    members = f"array_join({each(extract_all(inner, '(?s).-.|.'), part)}, '')"
    return let(
        members,
        lambda m: case(
            (f"{m} = '' AND {negative}", "'.'"),
            (f"{m} = ''", "'(?!)'"),
            otherwise=f"concat('[', if({negative}, '^', ''), {m}, ']')",
        ),
    )


def glob_regex(pattern: str) -> str:
    """Shell-style pattern to a regular expression.

    ``*`` any run, ``?`` one character, ``[ab]`` and ``[!ab]`` classes; a bracket
    that is never closed stands for itself. Every pattern gives a valid expression.
    """

    def token(t: str) -> str:
        return case((f"{t} = '*'", "'.*'"), (f"{t} = '?'", "'.'"), (f"length({t}) > 1", _glob_class(t)), otherwise=_quoted(t))

    return f"array_join({each(extract_all(pattern, GLOB_CLASS + '|.'), token)}, '')"


def cut_right(c: str, characters: str) -> str:
    """Remove any of ``characters`` from the right end."""
    return f"rtrim({lit(characters)}, {c})"
