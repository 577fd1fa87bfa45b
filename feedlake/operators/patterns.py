"""Allow and block lists: which links the patterns of their feed, or of all feeds, let in or keep out.

A pattern is a domain suffix (``*.example.com``), a plain text, or a glob. Suffixes and texts are exact keys. Short lists are matched inside
the scan, with no shuffle; long ones through an equi-join on the keys. Few globs become literal regular expressions. Many are found
through a q-gram index: a glob is filed under the rarest piece of ``GRAM`` characters of its fixed text, a link is looked up under all pieces
of its url, and only the globs that share a piece are tried. All ways give the same answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.sql import case, each, keep, let, lit, lits, matches, substitute
from feedlake.functions.text import GLOB_CLASS, glob_regex, strip
from feedlake.functions.url import pattern_host
from feedlake.session import materialise

KINDS = ("allow", "block")
# Up to this many exact keys for one feed are tested row by row inside the scan.
INLINE_PATTERNS = 256
# A pattern table is only broadcast while it is known to hold no more rows than this.
BROADCAST_ROWS = 100_000
# Up to this many globs over all feeds become literal patterns, compiled once a task.
LITERAL_GLOBS = 2_000
# Characters of the pieces that globs are filed under; a glob whose fixed texts are all shorter has a shorter one.
GRAM = 6


@dataclass
class Patterns:
    """A pattern table, counted and taken apart once; any number of frontiers can be flagged with it."""

    compiled: DataFrame  # scope (NULL: every feed), kind, pattern, key or glob
    total: int
    inline: bool
    everywhere: dict[str, int]  # patterns without a feed
    shared_keys: dict[str, list[str]]
    glob_tests: dict[str, str] | None


def compiled(patterns: DataFrame) -> DataFrame:
    """Patterns as exact keys (``d:`` domain suffix, ``=`` text) or globs. What starts with ``*.`` is a suffix and nothing else."""
    key = case(
        ("startswith(pattern, '*.')", "concat('d:', substring(pattern, 3))"),
        (f"NOT {matches('pattern', r'[*?\[]')}", "concat('=', pattern)"),
    )
    return (
        patterns.selectExpr("feed AS scope", "kind", f"lower({strip('pattern')}) AS pattern")
        .where("pattern IS NOT NULL")
        .distinct()
        .selectExpr("*", f"{key} AS key")
        .selectExpr("*", f"if(key IS NULL, {glob_regex('pattern')}, NULL) AS glob")
    )


def _any_of(globs: list[str]) -> str:
    regex = lit("(?s)^(?:" + "|".join(globs) + r")\z")
    return f"coalesce(_host RLIKE {regex} OR _url RLIKE {regex}, false)"


def _glob_tests(found: list) -> dict[str, str]:
    """For each kind the test of a link against the globs of its feed and of every feed, as literal patterns."""
    tests = {}
    for kind in KINDS:
        by_scope: dict[str | None, set[str]] = {}
        for row in found:
            if row["kind"] == kind:
                by_scope.setdefault(row["scope"], set()).add(row["glob"])
        shared = by_scope.pop(None, None)
        alike: dict[tuple[str, ...], list[str]] = {}
        for feed, globs in sorted(by_scope.items()):
            alike.setdefault(tuple(sorted(globs)), []).append(feed)
        branches = [(f"feed IN ({lits(feeds)})", _any_of(list(globs))) for globs, feeds in alike.items()]
        own = case(*branches, otherwise="false") if branches else "false"
        tests[kind] = f"({own} OR {_any_of(sorted(shared))})" if shared else own
    return tests


def prepare(patterns: DataFrame) -> Patterns:
    """Count the patterns and choose how they will be matched. Runs small jobs over the pattern table alone."""
    table = compiled(patterns)
    counts = (
        table.groupBy("scope", "kind")
        .agg(F.count("key").alias("keys"), F.count("*").alias("n"))
        .agg(
            F.max("keys").alias("widest"),
            F.sum("n").alias("total"),
            *[F.expr(f"sum(if(scope IS NULL AND kind = '{kind}', n, 0))").alias(kind) for kind in KINDS],
        )
        .first()
    )
    inline = (counts["widest"] or 0) <= INLINE_PATTERNS
    shared: dict[str, list[str]] = {kind: [] for kind in KINDS}
    if inline and any(counts[kind] for kind in KINDS):
        for row in table.where("scope IS NULL AND key IS NOT NULL").select("kind", "key").collect():  # INLINE_PATTERNS of a kind at most
            shared.setdefault(row["kind"], []).append(row["key"])
    globs = table.where("glob IS NOT NULL").select("scope", "kind", "glob").limit(LITERAL_GLOBS + 1).collect()
    return Patterns(
        table,
        counts["total"] or 0,
        inline,
        {kind: counts[kind] or 0 for kind in KINDS},
        {kind: sorted(keys) for kind, keys in shared.items()},
        _glob_tests(globs) if len(globs) <= LITERAL_GLOBS else None,
    )


def _keys(host: str, url: str) -> str:
    """All exact keys a url answers to: its host's suffixes, its host, itself."""
    suffixes = let(
        f"split({host}, {lit(chr(92) + '.')}, -1)",
        lambda labels: f"transform({labels}, (label, i) ->"
        f" concat('d:', array_join(slice({labels}, i + 1, size({labels})), '.')))",
    )
    return f"array_distinct(concat({suffixes}, array(concat('=', {host}), concat('=', {url}))))"


# --- the q-gram index ----------------------------------------------------------------


def _grams(text: str, size: str) -> str:
    """All pieces of ``size`` characters; none if the text is shorter."""
    return f"if(length({text}) >= {size}, transform(sequence(1, length({text}) - {size} + 1), i -> substring({text}, i, {size})), CAST(array() AS array<string>))"


def glob_index(globs: DataFrame) -> DataFrame:
    """``gram``, ``pattern``, ``glob``, ``text``: every distinct glob once, under the piece of its fixed texts that fewest globs have.

    Whatever a glob matches holds each of its fixed texts, and so that piece, and also ``text``, the longest of them. A glob without any has
    empty ones.
    """
    fixed = keep(f"split({substitute('pattern', GLOB_CLASS, '*')}, '[*?]+')", lambda t: f"{t} <> ''")
    longest = f"least({GRAM}, array_max(transform({fixed}, t -> length(t))))"
    pieces = let(longest, lambda size: f"flatten({each(fixed, lambda t: _grams(t, size))})")
    grams = f"if(size({fixed}) = 0, array(''), {pieces})"
    text = f"coalesce(array_max(transform({fixed}, t -> struct(length(t) AS n, t AS t))).t, '') AS text"
    filed = globs.select("pattern", "glob").distinct().selectExpr("pattern", "glob", text, f"explode(array_distinct({grams})) AS gram")
    counts = filed.groupBy("gram").agg(F.count("*").alias("n"))
    least = F.min(F.struct("n", "gram"))["gram"].alias("gram")
    return filed.join(counts, "gram").groupBy("pattern", "glob", "text").agg(least).select("gram", "pattern", "glob", "text")


def _scoped(links: DataFrame) -> DataFrame:
    """Every link under its feed and under the scope of every feed."""
    return links.withColumn("_scope", F.explode(F.array(F.col("feed"), F.lit(None).cast("string"))))


def _of_scope(table: DataFrame, on: str):
    return F.col("_scope").eqNullSafe(table["scope"]) & (F.col(f"_{on}") == table[on])


def with_texts(frontier: DataFrame) -> DataFrame:
    """Adds the two texts of a link that patterns are held against: ``_host`` and ``_url``."""
    return frontier.selectExpr("*", f"{pattern_host('url')} AS _host", "lower(url) AS _url")


def glob_hits(links: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``feed``, ``ord``, ``kind`` of links (``with_texts``) and the globs of ``table`` (``compiled``) that match them, through the index.

    One row for each glob and link that match; ``small`` says that the table may be broadcast.
    """
    globs = table.where("glob IS NOT NULL")
    index = materialise(glob_index(globs), "globs")  # read twice below
    sizes = [r["n"] for r in index.select(F.length("gram").alias("n")).distinct().collect()]  # GRAM + 1 at most
    pieces = ", ".join(_grams("_url", str(n)) if n else "array('')" for n in sorted(sizes))
    regex = f"concat('(?s)^(?:', glob, {lit(')' + chr(92) + 'z')})"
    looked_up = links.selectExpr("feed", "ord", "_host", "_url", f"explode(array_distinct(concat({pieces}))) AS gram")
    tried = looked_up.join(F.broadcast(index) if small else index, "gram").where(f"contains(_url, text) AND (_host RLIKE {regex} OR _url RLIKE {regex})")
    hits = _scoped(tried.select("feed", "ord", F.col("pattern").alias("_pattern")))
    owners = globs.select("scope", "kind", "pattern")
    return hits.join(F.broadcast(owners) if small else owners, _of_scope(owners, "pattern")).select("feed", "ord", "kind")


def _key_hits(links: DataFrame, patterns: Patterns) -> DataFrame:
    """``feed``, ``ord``, ``kind`` of links and the exact keys they answer to."""
    keys = patterns.compiled.where("key IS NOT NULL").select("scope", "kind", "key")
    answered = _scoped(links.selectExpr("feed", "ord", f"explode({_keys('_host', '_url')}) AS _key"))
    return answered.join(F.broadcast(keys) if patterns.total <= BROADCAST_ROWS else keys, _of_scope(keys, "key")).select("feed", "ord", "kind")


# --- flags ---------------------------------------------------------------------------


def flagged(frontier: DataFrame, patterns: Patterns) -> DataFrame:
    """Add ``allowed`` and ``blocked`` to links (``feed``, ``ord``, ``url``).

    A link without allow patterns for its feed or for every feed is allowed. A link of no feed (NULL) has the patterns of every feed.
    """
    if not patterns.total:
        return frontier.select("*", F.lit(True).alias("allowed"), F.lit(False).alias("blocked"))
    links = with_texts(frontier)
    own = (
        patterns.compiled.where("scope IS NOT NULL")
        .groupBy(F.col("scope").alias("feed"))
        .agg(
            F.expr("count_if(kind = 'allow') AS _allow_n"),
            *[F.expr(f"collect_set(key) FILTER (WHERE kind = '{kind}') AS _{kind}_keys") for kind in KINDS if patterns.inline],
        )
    )
    joined = links.join(F.broadcast(own) if patterns.total <= BROADCAST_ROWS else own, "feed", "left")
    tests: dict[str, list[str]] = {kind: [] for kind in KINDS}
    if patterns.inline:
        joined = joined.selectExpr("*", f"{_keys('_host', '_url')} AS _keys")
        for kind in KINDS:
            tests[kind].append(f"coalesce(arrays_overlap(_keys, _{kind}_keys), false)")
            if patterns.shared_keys[kind]:
                tests[kind].append(f"coalesce(arrays_overlap(_keys, array({lits(patterns.shared_keys[kind])})), false)")
    hits = [] if patterns.inline else [_key_hits(links, patterns)]
    if patterns.glob_tests is None:
        hits.append(glob_hits(links, patterns.compiled, patterns.total <= BROADCAST_ROWS))
    else:
        for kind in KINDS:
            tests[kind].append(patterns.glob_tests[kind])
    if hits:
        found = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        by_link = found.groupBy(F.col("feed").alias("_feed"), F.col("ord").alias("_ord")).agg(*[F.expr(f"bool_or(kind = '{kind}') AS _{kind}_hit") for kind in KINDS])
        joined = joined.join(by_link, F.col("feed").eqNullSafe(F.col("_feed")) & (F.col("ord") == F.col("_ord")), "left")
        for kind in KINDS:
            tests[kind].append(f"coalesce(_{kind}_hit, false)")
    some = "true" if patterns.everywhere["allow"] else "coalesce(_allow_n, 0) > 0"
    return joined.selectExpr(
        *[f"`{c}`" for c in frontier.columns],
        f"(NOT ({some}) OR {' OR '.join(tests['allow'])}) AS allowed",
        f"({' OR '.join(tests['block'])}) AS blocked",
    )
