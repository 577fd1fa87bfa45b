"""Small building blocks for SQL text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

_fresh = count()


def lit(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values: Iterable[str]) -> str:
    """A comma-separated list of string literals."""
    return ", ".join(lit(v) for v in values)


def _var() -> str:
    return f"v{next(_fresh)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it several times (a one-element transform)."""
    var = _var()
    return f"transform(array({value}), {var} -> {body(var)})[0]"


def each(array: str, body: Callable[[str], str]) -> str:
    """``body`` of each element."""
    var = _var()
    return f"transform({array}, {var} -> {body(var)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    """The elements that pass ``test``."""
    var = _var()
    return f"filter({array}, {var} -> {test(var)})"


def fold(array: str, start: str, step: Callable[[str, str], str], finish: str | None = None) -> str:
    """Left fold; ``finish`` names a field of the final state."""
    acc, item = _var(), _var()
    done = f", {acc} -> {acc}.{finish}" if finish else ""
    return f"aggregate({array}, {start}, ({acc}, {item}) -> {step(acc, item)}{done})"


def case(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"CASE {whens} ELSE {otherwise} END"


def first_nonempty(*values: str) -> str:
    """The first text that is neither NULL nor empty; NULL if there is none.

    Each value is written once, which keeps long fallback chains small.
    """
    return f"get({keep(f'array({', '.join(values)})', lambda v: f'{v} <> {lit('')}')}, 0)"


def nonempty(c: str) -> str:
    """NULL for the empty string."""
    return first_nonempty(c)


def extract(c: str, regex: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {lit(regex)}, {group})"


def extract_all(c: str, regex: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, {lit(regex)}, {group})"


def substitute(c: str, regex: str, replacement: str = "") -> str:
    return f"regexp_replace({c}, {lit(regex)}, {lit(replacement)})"


def matches(c: str, regex: str) -> str:
    return f"({c} RLIKE {lit(regex)})"


def replace(c: str, old: str, new: str) -> str:
    return f"replace({c}, {lit(old)}, {lit(new)})"
