"""A published folder of named documents that readers see as a whole: all of an old set, or all of a new one.

``<root>/files/<run>/<name>`` holds the documents a run has written, each a file under its published name. ``<root>/sets/<number>`` is a table
(``name``, ``feed``, ``run``) of all documents that belong to a set. A set counts once its table is complete, which Spark marks by one last
empty file; that is the switch. Until then readers find the set before, with files that nobody changes.

A run writes the documents of the feeds it has; those of all other feeds are taken over from the set before by name, unread. Pages that a
feed no longer has are in no later set. A run that dies leaves files which no set names, and can simply be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import materialise

SET = "name string, feed string, run string"
#: Files put in their places at once, and told to the file system by so many threads.
BATCH, THREADS = 4096, 32


class NameTaken(ValueError):
    """Two documents have one name."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def _sets(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all complete sets, rising."""
    files, folder = _files(spark, root), _path(spark, root, "sets")
    if not files.exists(folder):
        return []
    found = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n) for n in found if n.isdigit() and files.exists(_path(spark, root, "sets", n, "_SUCCESS")))


def current_set(spark: SparkSession, root: str) -> DataFrame:
    """``name``, ``feed``, ``run`` of every document of the newest set; empty before the first one."""
    numbers = _sets(spark, root)
    if not numbers:
        return spark.createDataFrame([], SET)
    return spark.read.schema(SET).parquet(f"{root}/sets/{numbers[-1]:010d}")


def _in_batches(rows: Iterable, size: int) -> Iterable[list]:
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


def _put_in_place(spark: SparkSession, named: DataFrame, staged: str, target: str) -> None:
    """Moves the one file of each folder ``key=<key>`` to its name; only names pass the driver, a batch at a time."""
    files = _files(spark, target)

    def move(row) -> None:
        source = [s.getPath() for s in files.listStatus(_path(spark, staged, f"key={row['key']}")) if s.getPath().getName().startswith("part-")]
        goal = _path(spark, target, row["name"])
        files.mkdirs(goal.getParent())
        if len(source) != 1 or not files.rename(source[0], goal):
            raise OSError(f"{row['name']} can't be put into {target}")

    with ThreadPoolExecutor(THREADS) as pool:
        for batch in _in_batches(named.toLocalIterator(), BATCH):
            list(pool.map(move, batch))


def publish(documents: DataFrame, root: str) -> int:
    """Publish ``documents`` (``name``, ``feed``, ``document``) in place of all earlier documents of the same feeds; the set's number.

    Fails before anything is switched if two documents, new or kept, have one name.
    """
    spark = documents.sparkSession
    run = uuid.uuid4().hex
    staged, target = f"{root}/staged/{run}", f"{root}/files/{run}"
    held = materialise(documents.select("name", "feed", "document").withColumn("key", F.sha2("name", 256)), "published")
    new = held.select("name", "feed", F.lit(run).alias("run"))
    kept = current_set(spark, root).join(held.select("feed").distinct(), "feed", "left_anti").select("name", "feed", "run")
    whole = new.unionByName(kept)
    twice = whole.groupBy("name").count().where("count > 1").first()
    if twice:
        raise NameTaken(f"{twice['count']} documents are named {twice['name']}")
    held.select("key", "document").repartition("key").write.partitionBy("key").option("lineSep", "\n").text(staged)
    _put_in_place(spark, held.select("name", "key"), staged, target)
    number = (_sets(spark, root) or [0])[-1] + 1
    # fails if another run has taken the number meanwhile
    whole.repartitionByRange("name").sortWithinPartitions("name").write.mode("error").parquet(f"{root}/sets/{number:010d}")
    return number


def published(spark: SparkSession, root: str) -> DataFrame:
    """``name``, ``feed``, ``document`` of the newest set."""
    now = current_set(spark, root)
    runs = [r["run"] for r in now.select("run").distinct().collect()]  # one for each run that still has a document
    if not runs:
        return spark.createDataFrame([], "name string, feed string, document string")
    files = spark.read.option("recursiveFileLookup", True).text([f"{root}/files/{run}" for run in runs], wholetext=True)
    path = F.col("_metadata.file_path")
    placed = files.select(
        F.rtrim(F.col("value"), F.lit("\n")).alias("document"),
        F.regexp_extract(path, "/files/([0-9a-f]{32})/", 1).alias("run"),
        # the reader shows paths as addresses, in which a % of a name is written once more
        F.url_decode(F.replace(F.regexp_extract(path, "/files/[0-9a-f]{32}/(.*)$", 1), F.lit("+"), F.lit("%2B"))).alias("name"),
    )
    return placed.join(now, ["run", "name"]).select("name", "feed", "document")
