"""Feed configuration as tables: feeds, static sources, patterns, other inputs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.schema import FEEDS, PATTERNS, SOURCES

# Place of each kind of source in the collected link list.
SOURCE_RANKS = {
    "config": 1,
    "argument": 2,
    "notes_argument": 3,
    "notes": 4,
    "board_argument": 5,
    "board": 6,
    "site_argument": 7,
    "site": 8,
}


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def local_table(spark: SparkSession, rows: Iterable[tuple], columns: str) -> DataFrame:
    """A small table out of driver-side rows, with a known size and no Python workers."""
    fields = [tuple(part.split()) for part in columns.split(",")]
    data = list(zip(*rows)) or [[] for _ in fields]
    arrays = [pa.array(list(values), _ARROW[kind]) for values, (_, kind) in zip(data, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))


def named_configs(files: Mapping[str, Mapping]) -> list[dict]:
    """A folder of single-feed configurations: the file stem names the feed.

    All sources of a file are kept, its notes folder and board included.
    """
    return [{**files[path], "name": PurePath(path).stem} for path in sorted(files)]


def feed_table(spark: SparkSession, configs: Iterable[Mapping]) -> DataFrame:
    """One row per feed with its header."""
    rows = []
    for config in configs:
        head = config.get("feed") or {}
        rows.append(
            (
                config.get("name", fixed.UNNAMED_FEED),
                head.get("title", fixed.UNTITLED_FEED),
                head.get("home_page_url"),
                head.get("feed_url"),
                head.get("description"),
                head.get("language"),
                config.get("output_dir"),
            )
        )
    return local_table(spark, rows, FEEDS)


def pattern_table(
    spark: SparkSession,
    configs: Iterable[Mapping],
    global_allow: Iterable[str] = (),
    global_block: Iterable[str] = (),
) -> DataFrame:
    """Allow and block patterns; a NULL feed means all feeds."""
    rows = [(None, "allow", p) for p in global_allow] + [(None, "block", p) for p in global_block]
    for config in configs:
        name = config.get("name", fixed.UNNAMED_FEED)
        rows += [(name, "allow", p) for p in config.get("whitelist") or ()]
        rows += [(name, "block", p) for p in config.get("blacklist") or ()]
    return local_table(spark, rows, PATTERNS)


def static_sources(spark: SparkSession, configs: Iterable[Mapping], kind: str = "config") -> DataFrame:
    """The links written into the configuration, in order."""
    rows = [
        (config.get("name", fixed.UNNAMED_FEED), pos, url)
        for config in configs
        for pos, url in enumerate(config.get("sources") or ())
    ]
    return as_source(local_table(spark, rows, "feed string, pos bigint, url string"), kind, F.lit(""))


def link_list(spark: SparkSession, path: str, feed: str, kind: str = "config") -> DataFrame:
    """Landed text files with one link per line, file by file and in the order of the lines.

    A line's place is its split's place in the file and its number within the split, so ``pos`` increases
    but is not dense.
    """
    lines = spark.read.text(path).select(
        F.lit(feed).alias("feed"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.trim("value").alias("url"),
    )
    return as_source(lines.filter("url <> ''"), kind, F.col("file"), F.col("block"))


def as_source(links: DataFrame, kind: str, ref, part=None) -> DataFrame:
    """Bring ``feed``, ``pos``, ``url`` into the common shape of link tables.

    Links come in the order of ``ref`` (numbers by value, other names by text), ``part`` of it, and ``pos``.
    """
    number = ref.cast("string").try_cast("bigint")
    return links.select(
        F.col("feed").cast("string").alias("feed"),
        F.lit(SOURCE_RANKS[kind]).alias("source_rank"),
        F.lit(kind).alias("source_kind"),
        number.alias("ref_id"),
        ref.cast("string").alias("source_ref"),
        (F.lit(0) if part is None else part).cast("bigint").alias("part"),
        F.col("pos").cast("bigint").alias("pos"),
        "url",
    )


def empty_sources(spark: SparkSession) -> DataFrame:
    return local_table(spark, [], SOURCES)
