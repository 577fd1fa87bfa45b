"""The published folder: whole sets, names, what stays and what goes."""

import os

import pytest
from pyspark.sql import functions as F

from feedlake.operators import feeds as FD
from feedlake.sinks import published as P

DOCS = "name string, feed string, document string"


def _docs(spark, *rows):
    return spark.createDataFrame(rows, DOCS)


def _now(spark, root):
    return {r.name: r.document for r in P.published(spark, root).collect()}


def test_sets_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "site")
    assert _now(spark, root) == {}
    first = [("f/feed.json", "f", "one"), ("f/feed-2.json", "f", "two"), ("f/feed-3.json", "f", "three"), ("g/feed.json", "g", "a\nb"), ("g/feed.xml", "g", "<x/>")]
    assert P.publish(_docs(spark, *first), root) == 1
    assert _now(spark, root) == {n: d for n, _, d in first}
    # files lie under their names
    runs = os.listdir(f"{root}/files")
    assert len(runs) == 1 and {"feed.json", "feed-2.json", "feed-3.json"} <= set(os.listdir(f"{root}/files/{runs[0]}/f"))
    assert open(f"{root}/files/{runs[0]}/f/feed-2.json").read().rstrip("\n") == "two"
    # f has fewer pages now, g stays
    assert P.publish(_docs(spark, ("f/feed.json", "f", "new")), root) == 2
    assert _now(spark, root) == {"f/feed.json": "new", "g/feed.json": "a\nb", "g/feed.xml": "<x/>"}
    # nothing new changes nothing
    assert P.publish(_docs(spark, first[0]).limit(0), root) == 3
    assert len(_now(spark, root)) == 3


def test_readers_see_the_old_set_until_the_new_is_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "site")
    P.publish(_docs(spark, ("f/feed.json", "f", "old")), root)

    def dies(*_):
        raise OSError("the machine is gone")

    with monkeypatch.context() as broken:
        broken.setattr(P, "_put_in_place", dies)
        with pytest.raises(OSError, match="gone"):
            P.publish(_docs(spark, ("f/feed.json", "f", "new")), root)
    assert _now(spark, root) == {"f/feed.json": "old"}
    # a set without its last mark is passed over
    os.makedirs(f"{root}/sets/0000000002")
    assert _now(spark, root) == {"f/feed.json": "old"}


def test_two_documents_of_one_name_are_refused(spark, tmp_path):
    root = str(tmp_path / "site")
    P.publish(_docs(spark, ("a/feed.json", "f", "f")), root)
    for rows in ([("a/feed.json", "g", "g")], [("b/feed.json", "g", "g"), ("b/feed.json", "h", "h")]):
        with pytest.raises(P.NameTaken):
            P.publish(_docs(spark, *rows), root)
    assert _now(spark, root) == {"a/feed.json": "f"}


NAMES = [
    ("out/de/", 1, "out/de/feed.json"), ("a", 2, "a/feed-2.json"), ("a/b:c %", 1, "a/b%3Ac%20%25/feed.json"), ("../up//./é", 3, "up/%C3%A9/feed-3.json"), ("", 1, "feed.json"), ("x+y", 1, "x%2By/feed.json"),
]


def test_names(spark):
    rows = spark.createDataFrame([(p, n) for p, n, _ in NAMES], "path string, page int")
    got = rows.selectExpr("path", "page", f"{FD.published_name('path', 'page', 'json')} AS name").collect()
    assert {(r.path, r.page, r.name) for r in got} == set(NAMES)


def test_odd_names_are_found_again(spark, tmp_path):
    root = str(tmp_path / "site")
    feeds = spark.createDataFrame([("a/b:c %", None), ("x", "ü x/+"), ("y", None)], "feed string, output_dir string")
    documents = feeds.select("feed", F.lit(1).alias("page"), F.concat(F.lit("doc "), "feed").alias("document"))
    named = FD.named_documents(feeds, documents, "json")
    P.publish(named, root)
    assert _now(spark, root) == {r.name: r.document for r in named.collect()} and len(_now(spark, root)) == 3
