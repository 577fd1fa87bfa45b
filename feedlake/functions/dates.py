"""Dates as found in pages.

A date keeps its wall-clock reading and its offset apart: the instant is needed for
ordering, the wall clock for the catalogue, the text for the feed documents.
"""

from __future__ import annotations

from feedlake.functions.sql import case, extract, first_nonempty, let, lit, matches, replace, substitute
from feedlake.functions.text import collapse, strip

_WEEKDAY = r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_TIME = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)(?:\s?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\(?(Z|z|[A-Z]{2,4}|[+-]\d{2}(?::?\d{2})?)\)?"
_TAIL = rf"(?:(?:[Tt]|,? (?:at )?){_TIME})?(?:\s?{_ZONE})?$"
_MONTH = rf"(?i:({_MONTHS})[a-z]*\.?)"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
# what a date may look like, and its year, month, day, time, half of the day and zone
_SHAPES = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}", "$1|$2|$3|$4|$5|$6"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TAIL}", "$1|$2|$3|$4|$5|$6"),
    (rf"^(1[3-9]|[23]\d)[-/.](\d{{1,2}})[-/.](\d{{4}}){_TAIL}", "$3|$2|$1|$4|$5|$6"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TAIL}", "$3|$1|$2|$4|$5|$6"),
    (rf"^{_MONTH} {_DAY},? (\d{{4}}){_TAIL}", "$3|$1|$2|$4|$5|$6"),
    (rf"^{_DAY}[ -]{_MONTH},?[ -](\d{{4}}){_TAIL}", "$3|$2|$1|$4|$5|$6"),
    (rf"^{_MONTH} {_DAY} {_TIME}(?: {_ZONE})? (\d{{4}})$", "$6|$1|$2|$3|$4|$5"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})\s?{_ZONE}?$", "$1|$2|$3|$4:$5:$6||$7"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})\s?{_ZONE}?$", "$1|$2|$3|$4:$5||$6"),
    (rf"^{_TIME},? {_DAY} {_MONTH},? (\d{{4}})(?: {_ZONE})?$", "$5|$4|$3|$1|$2|$6"),
    (rf"^(1[3-9]|[23]\d)[-/.](\d{{1,2}})[-/.](\d{{2}}){_TAIL}", "20$3|$2|$1|$4|$5|$6"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{2}}){_TAIL}", "20$3|$1|$2|$4|$5|$6"),
)


def _ymd(year: str, month_name: str, day: str) -> str:
    """Year, English month name and day as ``yyyy-MM-dd``."""
    names = lit(_MONTHS.replace("|", "").lower())
    month = f"CAST(ceil(instr({names}, lower({month_name})) / 3) AS STRING)"
    return f"concat_ws('-', {year}, lpad({month}, 2, '0'), lpad({day}, 2, '0'))"


def _offset(z: str) -> str:
    """``+hh:mm`` from any offset spelling; NULL if there is none, or only a name that has no fixed meaning."""
    return case(
        (f"upper({z}) IN ('Z', 'GMT', 'UTC')", "'+00:00'"),
        (matches(z, r"^[+-]\d{2}$"), f"concat({z}, ':00')"),
        (matches(z, r"^[+-]\d{2}:?\d{2}$"), substitute(z, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")),
    )


def _clock(time: str, half: str) -> str:
    """Time of day on a clock of 24 hours."""
    hour = f"CAST(substring_index({time}, ':', 1) AS INT)"
    shift = case((f"upper({half}) = 'P' AND {hour} < 12", "12"), (f"upper({half}) = 'A' AND {hour} = 12", "-12"), otherwise="0")
    rest = f"substring({time}, instr({time}, ':'))"
    return f"if({time} = '', '00:00:00', concat(lpad(CAST({hour} + {shift} AS STRING), 2, '0'), {rest}))"


def parse_date(raw: str) -> str:
    """``struct<local timestamp_ntz, zone string>``; NULL local if unreadable.

    Reads year-first and year-last numeric dates (month before day where both are possible), English month
    names before or after the day, mail-style dates and those of the C library, each with optional time and zone.
    """
    return let(substitute(collapse(strip(raw)), _WEEKDAY), _parsed)


def _parsed(text: str) -> str:
    fields = case(*((matches(text, rx), substitute(text, rx, order)) for rx, order in _SHAPES))

    def read(p: str) -> str:
        numeric = f"concat_ws('-', {p}[0], lpad({p}[1], 2, '0'), lpad({p}[2], 2, '0'))"
        day = f"if({matches(f'{p}[1]', '^[0-9]')}, {numeric}, {_ymd(f'{p}[0]', f'{p}[1]', f'{p}[2]')})"
        local = f"try_cast(concat_ws(' ', {day}, {_clock(f'{p}[3]', f'{p}[4]')}) AS TIMESTAMP_NTZ)"
        return f"named_struct('local', {local}, 'zone', {_offset(f'{p}[5]')})"

    nothing = "named_struct('local', CAST(NULL AS TIMESTAMP_NTZ), 'zone', CAST(NULL AS STRING))"
    return let(f"split({fields}, '[|]', -1)", lambda p: f"if({p} IS NULL, {nothing}, {read(p)})")


def instant(local: str, zone: str) -> str:
    """The moment in time; a date without offset counts as UTC."""
    return f"try_cast(concat(CAST({local} AS STRING), coalesce({zone}, '+00:00')) AS TIMESTAMP)"


def iso_text(local: str, zone: str) -> str:
    """ISO 8601 text: seconds always, fraction and offset only where present."""
    fraction = let(f"date_format({local}, 'SSSSSS')", lambda f: f"if({f} = '000000', '', concat('.', {f}))")
    return (
        f"concat(date_format({local}, {lit(chr(39).join(('yyyy-MM-dd', 'T', 'HH:mm:ss')))}),"
        f" {fraction}, coalesce({zone}, ''))"
    )


def rss_date(local: str, zone: str) -> str:
    """Mail-style date for RSS; a date without offset counts as UTC."""
    return (
        f"concat(date_format({local}, 'EEE, dd MMM yyyy HH:mm:ss '),"
        f" {replace(f'coalesce({zone}, {lit("+00:00")})', ':', '')})"
    )


def date_columns(raw: str, instant_name: str, local_name: str, iso_name: str) -> list[str]:
    """The three columns that keep a date text, as select items."""
    found = parse_date(raw)
    return [
        let(found, lambda d: instant(f"{d}.local", f"{d}.zone")) + f" AS {instant_name}",
        f"{found}.local AS {local_name}",
        let(found, lambda d: iso_text(f"{d}.local", f"{d}.zone")) + f" AS {iso_name}",
    ]


_TEXT_DAY = (
    r"(?:\b(\d{4}-\d{2}-\d{2})\b"
    rf"|\b(?i:({_MONTHS})(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember)?) (\d{{1,2}}),? (\d{{4}})\b"
    r"|\b(?i:published (yesterday|today))\b)"
)
_SAID = r"\b(?i:published|posted|updated)(?i: on| at)?:? (?:(?i:mon|tues|wednes|thurs|fri|satur|sun)day,? )?"


def date_shape(raw: str) -> str:
    """What a date text looks like: ``9`` for a digit, ``a`` for a word, at most 60 characters; '' for none."""
    return f"left({substitute(substitute(f'coalesce({collapse(strip(raw))}, {lit("")})', r'\p{Nd}', '9'), r'\p{L}+', 'a')}, 60)"


def body_date(text: str, as_of: str) -> str:
    """Publication day named in an article, as ``timestamp_ntz``.

    The first day that is said to be the one it was published, posted or updated on, else the first day named anywhere: as an ISO
    day, as "Month d, yyyy", or as "Published yesterday" or "today", seen from ``as_of``. What looks like a day but is none counts as no date.
    """

    def day(found: str) -> str:
        parts = [extract(found, "^" + _TEXT_DAY, k) for k in range(1, 6)]
        iso, month, date, year, relative = parts
        return case(
            (f"{iso} <> ''", f"try_cast({iso} AS DATE)"),
            (f"{year} <> ''", f"try_cast({_ymd(year, month, date)} AS DATE)"),
            (f"lower({relative}) = 'yesterday'", f"date_sub(CAST({as_of} AS DATE), 1)"),
            (f"{relative} <> ''", f"CAST({as_of} AS DATE)"),
        )

    def found(t: str) -> str:
        # no text without a digit or a relative day has any date: most blocks are passed over by this alone
        said = first_nonempty(extract(t, f"{_SAID}({_TEXT_DAY})", 1), extract(t, _TEXT_DAY, 0))
        return f"if({matches(t, r'[0-9]|(?i)published ')}, {let(said, day)}, NULL)"

    return f"CAST({let(text, found)} AS TIMESTAMP_NTZ)"


def iso_duration_seconds(raw: str) -> str:
    """Seconds of ``PT#H#M#S``; NULL if the text does not start with ``PT``."""

    def seconds(d: str) -> str:
        hours, minutes, rest = (
            f"coalesce(try_cast({extract(d, rx)} AS INT), 0)"
            for rx in (r"^PT(\d+)H", r"^PT(?:\d+H)?(\d+)M", r"^PT(?:\d+H)?(?:\d+M)?(\d+)S")
        )
        return f"if(startswith({d}, 'PT'), {hours} * 3600 + {minutes} * 60 + {rest}, NULL)"

    return let(raw, seconds)
