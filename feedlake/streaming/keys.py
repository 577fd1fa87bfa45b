"""What earlier runs have stored: a slim table of (feed, id), dealt by the first digits of the id.

``<path>/prefix=<digits>/run_id=<run>`` holds the keys a run has added, sorted by id, with a bloom filter for ids in every file. Ids are
hashes, so all prefixes are alike in size. A batch lists and opens only the prefixes it holds; a small batch also names its ids, so that files and
row groups which can't hold them are passed over by their bounds and bloom filters. Nothing of the items themselves is read.

Files of finished runs are merged from time to time. The keys of a set count once however often they are written, so a merge that dies half-way
does no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import exists

KEYS = "feed string, id string, prefix string, run_id string"
#: Hexadecimal digits of a prefix. A table keeps the number it was made with: 2 give 256 parts, 3 suit some 10^10 keys.
DIGITS = 2
#: Batches of at most so many ids name them in the scan.
NAMED_IDS = 500
#: Merged once more runs than this have files of their own.
RUNS = 64

MERGED = "merged"


def with_prefix(keys: DataFrame, digits: int = DIGITS) -> DataFrame:
    return keys.withColumn("prefix", F.substring("id", 1, digits))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KEYS).parquet(path)


def _written(rows: DataFrame, digits: int):
    """A writer for keys by prefix and run; the filters are sized for the rows there are, or each would take a megabyte."""
    each = rows.count() // 16**digits + 1
    return (
        rows.repartition("prefix")
        .sortWithinPartitions("prefix", "run_id", "id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.expected.ndv#id", str(2 * each))
        .partitionBy("prefix", "run_id")
    )


def add_keys(keys: DataFrame, run_id: str, path: str, digits: int = DIGITS) -> None:
    """Write the keys (``feed``, ``id``) of a run; the same run again replaces its own in the prefixes it has."""
    rows = with_prefix(keys.select("feed", "id"), digits).withColumn("run_id", F.lit(run_id))
    _written(rows, digits).option("partitionOverwriteMode", "dynamic").parquet(path)


def create_keys(spark: SparkSession, items: DataFrame, path: str, digits: int = DIGITS) -> None:
    """Make the table where there is none, from the items stored so far (``feed``, ``id``, ``run_id``)."""
    if not exists(spark, f"{path}/_SUCCESS"):
        _written(with_prefix(items.select("feed", "id", "run_id"), digits), digits).parquet(path)


def seen(wanted: DataFrame, path: str, but: str, digits: int = DIGITS) -> DataFrame:
    """``feed, id`` of all stored keys that may be among ``wanted`` (``feed``, ``id``), leaving out those of the run ``but``.

    The prefixes, and the ids if they are few, become literals of the scan.
    """
    rows = read_keys(wanted.sparkSession, path).where(F.col("run_id") != but)
    ids = [r["id"] for r in wanted.where("id IS NOT NULL").select("id").distinct().limit(NAMED_IDS + 1).collect()]
    if len(ids) <= NAMED_IDS:
        rows = rows.where(F.col("prefix").isin(sorted({i[:digits] for i in ids})) & F.col("id").isin(sorted(ids)))
    else:
        held = with_prefix(wanted.where("id IS NOT NULL").select("id"), digits).select("prefix").distinct().collect()  # 16 ** digits at most
        rows = rows.where(F.col("prefix").isin(sorted(r["prefix"] for r in held)))
    return rows.select("feed", "id")


def stale_runs(runs: list[str]) -> list[str]:
    """Runs that can't be repeated: all but the last batch of each stream (``<stream>-<batch>``), and earlier merges."""
    last: dict[str, tuple[int, str]] = {}
    for run in runs:
        stream, _, batch = run.rpartition("-")
        if stream != MERGED and batch.isdigit():
            last[stream] = max(last.get(stream, (-1, "")), (int(batch), run))
    kept = {run for _, run in last.values()} | {run for run in runs if not run.startswith(f"{MERGED}-") and not run.rpartition("-")[2].isdigit()}
    return sorted(set(runs) - kept)


def merge_runs(spark: SparkSession, path: str, most: int = RUNS, digits: int = DIGITS) -> int:
    """Put the keys of finished runs together if more than ``most`` runs have files; the number of runs merged.

    To be called while no batch is reading.
    """
    runs = [r["run_id"] for r in read_keys(spark, path).select("run_id").distinct().collect()]  # one for each run since the last merge
    old = stale_runs(runs) if len(runs) > most else []
    if len(old) < 2:
        return 0
    add_keys(read_keys(spark, path).where(F.col("run_id").isin(old)).select("feed", "id").distinct(), f"{MERGED}-{uuid.uuid4().hex}", path, digits)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for prefix in files.listStatus(root):
        for run in old if prefix.isDirectory() else []:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(prefix.getPath(), f"run_id={run}"), True)
    return len(old)
