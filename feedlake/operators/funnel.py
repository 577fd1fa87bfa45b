"""Where links get lost on their way into a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.operators.pages import answers

STAGES = (
    "invalid",
    "not_allowed",
    "blocked",
    "duplicate",
    "stored",
    "no_page",
    "same_page",
    "added",
)


def ingest_funnel(flagged: DataFrame, stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts per feed and stage; the stages add up to ``collected``.

    ``flagged`` is a frontier with ``id``, ``valid``, ``allowed`` and ``blocked``. It is
    read once and shuffled once, combined on the map side to one row per (feed, id); the
    rows that fail a check share one row per feed. A link to a page that the feed holds under
    another address is ``same_page``. No page body is touched.
    """
    passed = "(valid AND allowed AND NOT blocked)"
    groups = (
        flagged.selectExpr("feed", f"if({passed}, id, NULL) AS id", "valid", "allowed", "blocked")
        .groupBy("feed", "id")
        .agg(
            F.expr("count_if(NOT valid) AS invalid"),
            F.expr("count_if(valid AND NOT allowed) AS not_allowed"),
            F.expr("count_if(valid AND allowed AND blocked) AS blocked"),
            F.expr(f"count_if({passed}) AS n"),
        )
    )
    held = stored.select("feed", "id").distinct().withColumn("held", F.lit(True))
    stage = (
        "CASE WHEN id IS NULL THEN 'failed' WHEN held THEN 'stored' WHEN final_id IS NULL THEN 'no_page'"
        " WHEN held_page THEN 'same_page' ELSE 'added' END AS stage"
    )
    per_page = (
        groups.join(held, ["feed", "id"], "left")
        .join(answers(pages).select("id", "final_id"), "id", "left")
        .join(held.selectExpr("feed", "id AS final_id", "held AS held_page"), ["feed", "final_id"], "left")
        .selectExpr("*", stage)
        .selectExpr("*", "if(stage = 'added', final_id, NULL) AS page")
        .groupBy("feed", "stage", "page")
        .agg(
            F.count(F.lit(1)).alias("ids"),
            *[F.sum(c).alias(c) for c in ("invalid", "not_allowed", "blocked", "n")],
        )
    )
    counts = {
        "collected": "invalid + not_allowed + blocked + n",
        "invalid": "invalid",
        "not_allowed": "not_allowed",
        "blocked": "blocked",
        "duplicate": "if(stage = 'failed', 0, n - ids)",
        "stored": "if(stage = 'stored', ids, 0)",
        "no_page": "if(stage = 'no_page', ids, 0)",
        "same_page": "CASE stage WHEN 'added' THEN ids - 1 WHEN 'same_page' THEN ids ELSE 0 END",
        "added": "if(stage = 'added', 1, 0)",
    }
    return per_page.groupBy("feed").agg(
        *[F.expr(f"CAST(sum({value}) AS BIGINT) AS {name}") for name, value in counts.items()]
    )
