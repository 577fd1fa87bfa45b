"""Which date texts are read and which are not: the commonest shapes, in bounded memory over any corpus.

A shape is the text with digits and words masked. Each run keeps a frequent-items sketch for every outcome (a fixed number of tracked
shapes, combined on the map side), and sketches of runs are combined again for the report, so no run looks at the pages of an earlier one. Counts are exact while a
corpus has fewer shapes than three quarters of ``TRACKED``; beyond, the common ones are still found and their counts are estimates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import dates

#: Shapes a sketch keeps track of, at most.
TRACKED = 4096
_SKETCH = "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"
#: What a run adds: one row for each outcome.
PART = f"outcome string, n bigint, shapes {_SKETCH}"


def read_dates(texts: DataFrame, raw: str = "date_raw") -> DataFrame:
    """Adds ``date_iso`` and ``outcome``: ``read``, ``unread`` or ``none``."""
    return (
        texts.selectExpr("*", f"{dates.parse_date(raw)} AS _found")
        .selectExpr("*", f"{dates.iso_text('_found.local', '_found.zone')} AS date_iso")
        .selectExpr("*", f"CASE WHEN _found.local IS NOT NULL THEN 'read' WHEN trim({raw}) <> '' THEN 'unread' ELSE 'none' END AS outcome")
        .drop("_found")
    )


def shape_part(texts: DataFrame, raw: str = "date_raw", tracked: int = TRACKED) -> DataFrame:
    """The sketches of one run over texts with an ``outcome``."""
    return texts.groupBy("outcome").agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate({dates.date_shape(raw)}, {tracked})").cast(_SKETCH).alias("shapes"))


def add_parts(parts: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """The sketches of several runs as those of one."""
    return parts.groupBy("outcome").agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(shapes, {tracked})").cast(_SKETCH).alias("shapes"))


def shape_report(parts: DataFrame, top: int = 20, tracked: int = TRACKED) -> DataFrame:
    """``outcome``, ``n`` (texts of that outcome), ``shape``, ``texts`` (of that shape): the ``top`` shapes of each outcome."""
    found = add_parts(parts, tracked).selectExpr("outcome", "n", f"explode(approx_top_k_estimate(shapes, {top})) AS _s")
    return found.select("outcome", "n", F.col("_s.item").alias("shape"), F.col("_s.count").alias("texts"))
