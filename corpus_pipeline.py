"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Every stage works on all rows that the one before kept. Null texts are empty, empty tables stay empty, and extra columns are passed on up to
the last stage. Rows without ``doc_id`` are scored, cut and packed like others and never count as duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import minhash, packing, quality, suffixes
from feedlake.llm.batches import table
from feedlake.llm.queries import TOKENIZER
from feedlake.session import materialise

#: Shared shingles, in percent, from which documents are near-duplicates here.
LIKENESS = 80


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels")
    scored = quality.scored(docs, quality.fitted(docs, labels), "quality of this stage")
    return scored.where(F.col("`quality of this stage`") >= quality.ACCEPT).select([f"`{c}`" for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest ``doc_id``."""
    out = minhash.near_duplicates(docs, percent=LIKENESS).where("NOT kept").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select([f"`{c}`" for c in docs.columns])


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that come earlier in the corpus; a character that loses a byte goes as a whole.

    A document may become empty; it stays.
    """
    # as one column, whatever the names are; the operator adds its own beside it
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")
    cut = suffixes.deduplicate(docs.select(others, "doc_id", "text"), kept="text")
    new = {"text": F.col("kept").alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select([new.get(c, F.col("others").getField(c).alias(c)) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, TOKENIZER, size=1024, end_id=2)


STAGES = [("quality classifier", accepted), ("minhash near-dedup", distinct), ("suffix-array dedup", unrepeated), ("best-fit packing", packed)]

#: A trained network and a tokenizer can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
