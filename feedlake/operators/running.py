"""Totals that runs add to, so that no run counts what an earlier one has counted.

A run writes only its own part (rows of what it has changed) into a partition of its own; the total is the sum of the parts. A run that is
repeated replaces its part. Parts of finished runs are merged from time to time: the merged part is written first, then one small row says which
runs it stands for, and that row is the switch, so readers add up the old parts or the merged one, never both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import fixed
from feedlake.operators import tags as TAG
from feedlake.operators.catalogue import feed_totals
from feedlake.operators.funnel import STAGES
from feedlake.session import exists, materialise

MERGED = "merged-"
COUNTS = ("collected", *STAGES, "items")
#: What a run adds to a feed: its counts, its new items and their last update.
FEED_PART = "feed string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", last timestamp_ntz"


# --- parts ---------------------------------------------------------------------------


def put(part: DataFrame, run_id: str, path: str) -> None:
    """Write the part of a run, in place of what the same run has written before."""
    part.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _standing(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Merged parts that count, and the runs they stand for."""
    if not exists(spark, f"{path}-merged"):
        return [], []
    rows = spark.read.schema("part string, run string").parquet(f"{path}-merged").collect()  # one for each run ever merged
    return sorted({r["part"] for r in rows}), sorted({r["run"] for r in rows})


def parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All parts that count, with their ``run_id``; empty before the first."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, run_id string")
    merged, gone = _standing(spark, path)
    rows = spark.read.schema(f"{schema}, run_id string").parquet(path)
    counts = ~F.col("run_id").startswith(MERGED)
    if merged:
        counts = (counts | F.col("run_id").isin(merged)) & ~F.col("run_id").isin(gone)
    return rows.where(counts)


def merge(spark: SparkSession, path: str, schema: str, runs: list[str], add: Callable[[DataFrame], DataFrame]) -> str:
    """Put the parts of ``runs``, which must be finished for good, together by ``add``; the name of the merged part."""
    name = MERGED + uuid.uuid4().hex
    put(add(parts(spark, path, schema).where(F.col("run_id").isin(runs)).drop("run_id")), name, path)
    spark.createDataFrame([(name, run) for run in runs], "part string, run string").coalesce(1).write.mode("append").parquet(f"{path}-merged")
    return name


# --- feeds ---------------------------------------------------------------------------


def _feed_part(rows: DataFrame) -> DataFrame:
    return rows.select("feed", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in COUNTS], "last")


def stored_part(items: DataFrame) -> DataFrame:
    """What the feeds held before the first run."""
    return _feed_part(feed_totals(items).select("*", *[F.lit(0).alias(c) for c in COUNTS[:-1]]))


def run_part(funnel: DataFrame, new_items: DataFrame) -> DataFrame:
    """What one run adds, from its funnel and the items that it has added."""
    return _feed_part(funnel.join(feed_totals(new_items), "feed", "full"))


def add_feed_parts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feed").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("last").alias("last"))


def feed_run_totals(spark: SparkSession, path: str) -> DataFrame:
    """Per feed the funnel over all runs, ``parsed`` (links that led to a page), ``total`` (items held) and ``last``; also ``items`` for ``catalogue_of``."""
    return add_feed_parts(parts(spark, path, FEED_PART)).select("*", (F.col("same_page") + F.col("added")).alias("parsed"), F.col("items").alias("total"))


# --- terms ---------------------------------------------------------------------------


def add_texts(texts: DataFrame, run_id: str, path: str, kind: str = "string") -> None:
    """Count the terms of the texts (``id`` of type ``kind``, ``text``) of a run.

    Only these texts are read. The counts of documents get rows for the terms that occur in them, all others stay as they are. A text whose
    id an earlier run has counted is passed over. Only ids are compared with those of earlier runs; texts stay where they are, unless very many come again.
    """
    spark = texts.sparkSession
    known = parts(spark, f"{path}/texts", f"id {kind}").where(F.col("run_id") != run_id).select("id")
    came = materialise(texts.select("id").join(known, "id", "left_semi").distinct(), "known")
    fresh = texts.select("id", "text")
    fresh = fresh if came.isEmpty() else fresh.join(came, "id", "left_anti")
    put(TAG.text_terms(fresh, "id"), run_id, f"{path}/tf")
    counted = TAG.added_up(_terms(spark, path, kind).where(F.col("run_id") == run_id).drop("run_id"), fresh.select("id"), ["id"])
    put(counted.groupBy("term").agg(F.count("*").alias("df")), run_id, f"{path}/df")
    put(fresh.select("id"), run_id, f"{path}/texts")


def _terms(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The terms of all texts by run; an id that comes several times in a run has its terms as often."""
    return parts(spark, f"{path}/tf", f"id {kind}, term string, tf bigint")


def add_document_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def merge_document_counts(spark: SparkSession, path: str, runs: list[str]) -> str:
    """One row a term for the counts of ``runs``, which must be finished for good."""
    return merge(spark, f"{path}/df", "term string, df bigint", runs, add_document_counts)


def topics(spark: SparkSession, path: str, kind: str = "string", run_id: str | None = None, top: int = fixed.MAX_TAGS) -> DataFrame:
    """The terms of all texts counted so far, or of those of one run, as one count over all texts would rank them: ``id``, ``rank``, ``term``, ``score``."""
    tf, texts = _terms(spark, path, kind), parts(spark, f"{path}/texts", f"id {kind}")
    n_texts = texts.count()
    if run_id:
        tf, texts = (rows.where(F.col("run_id") == run_id) for rows in (tf, texts))
    df = add_document_counts(parts(spark, f"{path}/df", "term string, df bigint"))
    return TAG.ranked_terms(TAG.added_up(tf, texts, ["id", "run_id"]).drop("run_id"), df, n_texts, "id", top)
