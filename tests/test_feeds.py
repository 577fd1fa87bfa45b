import datetime as dt
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedlake.operators import catalogue as CAT
from feedlake.operators import feeds as FD
from feedlake.operators.ranking import measured_within, rank_within
from feedlake.plans import fixtures as FX
from feedlake.schema import ITEM_FIELDS
from feedlake.sources import stored as ST

SCHEMA = "feed string, " + ", ".join(f"{n} {t}" for n, t in ITEM_FIELDS.items()) + ", ord bigint"


@pytest.fixture
def items(spark):
    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            base = {"feed": "f", "id": f"id{i}", "url": f"https://e.com/{i}", "authors": [], "tags": [], "attachments": [], "ord": i}
            base.update(row)
            full.append(tuple(base.get(n) for n in ["feed", *ITEM_FIELDS, "ord"]))
        return spark.createDataFrame(full, SCHEMA)

    return make


def _feeds(spark, *rows):
    return spark.createDataFrame(
        [(r + (None,) * 7)[:7] for r in rows],
        "feed string, title string, home_page_url string, feed_url string, description string, language string, output_dir string",
    )


def test_minimal_item_json(items):
    got = FD.json_items(items({"title": "T", "summary": "", "tags": ["a"]})).first().item
    assert json.loads(got) == {"id": "id0", "url": "https://e.com/0", "title": "T", "tags": ["a"]}


def test_full_item_json_key_order(items):
    row = {
        "title": "T", "summary": "S", "content_html": "<p>é/</p>", "date_iso": "2025-01-01T00:00:00", "modified_iso": "2025-01-02T00:00:00",
        "authors": [("A", None)], "language": "en", "tags": ["x"], "attachments": [("https://a/b", "audio/mpeg", 5, None)],
    }
    got = json.loads(FD.json_items(items(row)).first().item)
    assert list(got) == ["id", "url", "title", "summary", "content_html", "date_published", "date_modified", "authors", "language", "tags", "attachments"]
    assert got["authors"] == [{"name": "A"}]
    assert got["attachments"] == [{"url": "https://a/b", "mime_type": "audio/mpeg", "size_in_bytes": 5}]


def test_merge_keeps_stored_version(items):
    stored = items({"id": "x", "title": "old", "ord": 4}, {"feed": "g", "id": "x", "title": "g", "ord": 0})
    new = items({"id": "x", "title": "new", "ord": 0}, {"id": "y", "title": "y", "ord": 1}, {"feed": "h", "id": "x", "title": "h", "ord": 0})
    merged = {(r.feed, r.id): (r.title, r.ord) for r in FD.merge_append(stored, new).collect()}
    assert merged == {("f", "x"): ("old", 4), ("g", "x"): ("g", 0), ("f", "y"): ("y", 6), ("h", "x"): ("h", 0)}
    again = FD.merge_append(FD.merge_append(stored, new), new)
    assert again.count() == 4
    assert sorted(r.label for r in FD.dry_run(stored, new).collect()) == ["h", "y"]


def test_rebuild_leaves_other_feeds(items, spark, tmp_path):
    stored = items({"id": "x", "title": "old"}, {"feed": "g", "id": "x", "title": "g"})
    new = items({"id": "z", "title": "new"})
    want = {("f", "z", "new"), ("g", "x", "g")}
    assert {(r.feed, r.id, r.title) for r in FD.merge_rebuild(stored, new).collect()} == want
    path = str(tmp_path / "items")
    FD.rebuild_items(stored, path)
    FD.rebuild_items(new, path)
    read = spark.read.parquet(path)
    assert {(r.feed, r.id, r.title) for r in read.collect()} == want
    FD.append_items(read, items({"id": "z", "title": "again"}, {"id": "q", "title": "q", "ord": 7}), path)
    final = {(r.feed, r.id, r.title, r.ord) for r in spark.read.parquet(path).collect()}
    assert final == {("f", "z", "new", 0), ("g", "x", "g", 1), ("f", "q", "q", 8)}


def test_documents_round_trip(items, spark, tmp_path):
    rows = [
        {"title": f"t{i}", "date_iso": "2025-01-01T10:00:00+02:00", "date_published": dt.datetime(2025, 1, 1, 8), "tags": ["a", "b"], "authors": [("A", "u")]}
        for i in range(7)
    ]
    feeds = _feeds(spark, ("f", 'T "x"}', "https://h", None, "d"), ("empty", None))
    docs = FD.json_documents(feeds, items(*rows), page_items=3)
    FD.write_documents(docs, str(tmp_path / "json"))
    read = ST.read_documents(spark, str(tmp_path / "json"))
    back = sorted(ST.stored_items(read).collect(), key=lambda r: r.ord)
    assert [r.title for r in back] == [f"t{i}" for i in range(7)]
    assert back[0].date_iso == "2025-01-01T10:00:00+02:00" and back[0].date_published == dt.datetime(2025, 1, 1, 8)
    assert back[0].authors[0].url == "u" and back[0].tags == ["a", "b"]
    heads = {(r.feed, r.title, r.home_page_url) for r in ST.stored_headers(read).collect()}
    assert heads == {("f", 'T "x"}', "https://h"), ("empty", "Untitled Feed", None)}
    pages = sorted((r.feed, r.page, json.loads(r.document)) for r in docs.collect() if r.feed == "f")
    assert [p[2].get("next_url") for p in pages] == ["feed-2.json", "feed-3.json", None]


def test_pages_end_at_bytes(items, spark):
    """Large items make many documents, none with more than the limit and one item; a feed that fits stays one."""
    rows = [{"title": "x" * 2000, "ord": k, "id": f"i{k:03d}"} for k in range(60)] + [{"feed": "g", "id": "s", "title": "small"}, {"feed": "h", "id": "big", "title": "y" * 9000, "ord": 0}, {"feed": "h", "id": "z", "ord": 1}]
    feeds = _feeds(spark, ("f", "F"), ("g", "G"), ("h", "H"), ("none", "N"))
    docs = {(r.feed, r.page): json.loads(r.document) for r in FD.json_documents(feeds, items(*rows), page_items=25, page_bytes=5000).repartition(3).collect()}
    pages = sorted(p for f, p in docs if f == "f")
    assert pages == list(range(1, len(pages) + 1)) and 20 <= len(pages) <= 30
    assert [i["id"] for p in pages for i in docs["f", p]["items"]] == [f"i{k:03d}" for k in range(60)]
    assert [docs["f", p].get("next_url") for p in pages] == [f"feed-{p + 1}.json" for p in pages[:-1]] + [None]
    assert max(len(docs["f", p]["items"]) for p in pages) <= 3
    assert [(f, p, len(d["items"])) for (f, p), d in sorted(docs.items()) if f != "f"] == [("g", 1, 1), ("h", 1, 1), ("h", 2, 1), ("none", 1, 0)]
    assert FD.json_documents(feeds, items(*rows), page_bytes=1 << 30).count() == 4


@pytest.mark.parametrize("partitions", [1, 7])
def test_measured_within_equals_window(spark, partitions):
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('g', id % 40) END AS feed", "id", "if(id % 11 = 0, NULL, id % 13) AS size"
    ).repartition(partitions)
    over = Window.partitionBy("feed").orderBy("id")
    size = F.coalesce("size", F.lit(0))
    want = df.select("feed", "id", F.row_number().over(over).alias("rank"), (F.sum(size).over(over) - size).alias("before")).where("feed IS NOT NULL")
    got = measured_within(df, "feed", [F.col("id")], ["id"], "size").select("feed", "id", "rank", "before")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert measured_within(df.limit(0), "feed", [F.col("id")], ["id"], "size").count() == 0


def test_small_feed_is_one_plain_document(items, spark):
    docs = FD.json_documents(_feeds(spark, ("f", "T")), items({"title": "a"}, {"title": "b"})).collect()
    assert json.loads(docs[0].document) == {
        "version": "https://jsonfeed.org/version/1.1",
        "title": "T",
        "_page": 1,
        "items": [{"id": "id0", "url": "https://e.com/0", "title": "a"}, {"id": "id1", "url": "https://e.com/1", "title": "b"}],
    }


def test_stored_feed_files(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (tmp_path / "bad").mkdir()
    (good / "feed.json").write_text(
        json.dumps({"title": "G", "items": [{"id": "1", "url": "u", "date_published": "2024-01-15T10:00:00Z"}, {"id": "2", "url": "v", "date_published": "junk"}]}, indent=2)
    )
    (tmp_path / "bad" / "feed.json").write_text("{not json")
    docs = ST.read_feed_files(spark, str(tmp_path))
    rows = sorted(ST.stored_items(docs).collect(), key=lambda r: r.ord)
    assert [(r.feed, r.id, r.date_iso) for r in rows] == [("good", "1", "2024-01-15T10:00:00+00:00"), ("good", "2", None)]


def test_rss_document(items, spark):
    rows = [
        {"title": "old <1>", "date_published": dt.datetime(2024, 1, 1), "date_local": dt.datetime(2024, 1, 1), "date_iso": "2024-01-01T00:00:00", "summary": "s\x07 & t"},
        {"title": None, "content_html": "<p>c</p>"},
        {"title": "new", "date_published": dt.datetime(2025, 1, 1, 5), "date_local": dt.datetime(2025, 1, 1), "date_iso": "2025-01-01T00:00:00-05:00",
         "authors": [("A", None), (None, "u")], "tags": ["x", "y"], "attachments": [("https://a/b?x=1&y=2", "audio/mpeg", None, None)]},
    ]
    doc = FD.rss_documents(_feeds(spark, ("f", "T", None, "https://self")), items(*rows)).first().document
    channel = ET.fromstring(doc.encode()).find("channel")
    assert [channel.findtext(t) for t in ("title", "link", "description")] == ["T", "https://example.com", "T"]
    got = channel.findall("item")
    assert [i.findtext("title") for i in got] == ["new", "old <1>", "https://e.com/1"]
    assert got[0].findtext("pubDate") == "Wed, 01 Jan 2025 00:00:00 -0500"
    assert got[1].findtext("pubDate") == "Mon, 01 Jan 2024 00:00:00 +0000"
    assert [a.text for a in got[0].findall("author")] == ["A"]
    assert [c.text for c in got[0].findall("category")] == ["x", "y"]
    assert got[0].find("enclosure").attrib == {"url": "https://a/b?x=1&y=2", "length": "0", "type": "audio/mpeg"}
    assert got[1].findtext("description") == "s & t" and got[2].findtext("description") == "<p>c</p>"


@pytest.mark.parametrize("partitions", [1, 7])
def test_rank_within_equals_window(spark, partitions):
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 40) END AS feed", "id", "if(id % 11 = 0, NULL, id % 13) AS score"
    ).repartition(partitions)
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("feed").orderBy(*order))).select("feed", "id", "rank")
    got = rank_within(df, "feed", order, ["id"]).select("feed", "id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


DATES = [
    (["2024-01-15T10:00:00Z", "2024-03-15T10:00:00+00:00"], "2024-03-15"),
    (["2024-01-15T23:30:00-05:00"], "2024-01-15"),
    (["2024-01-15T10:00:00", "2024-02-20T10:00:00+00:00"], "2024-02-20"),
    (["invalid", ""], "Unknown"),
    (["invalid", "2024-01-15"], "2024-01-15"),
    ([], "Unknown"),
]


def test_last_updated(spark):
    feeds = _feeds(spark, *[(f"f{i}", f"F{i}") for i in range(len(DATES))])
    rows = [(f"f{i}", d, None) for i, (ds, _) in enumerate(DATES) for d in ds] + [("f5", None, "2023-05-05T00:00:00")]
    got = CAT.feed_catalogue(feeds, spark.createDataFrame(rows, "feed string, date_iso string, modified_iso string"))
    updated = {r.feed: (r.item_count, r.last_updated) for r in got.collect()}
    want = {f"f{i}": (len(ds), day) for i, (ds, day) in enumerate(DATES)}
    want["f5"] = (1, "2023-05-05")
    assert updated == want


def test_catalogue_page(spark):
    feeds = _feeds(spark, ("b", "B & <b>", None, None, 'say "hi"'), ("a", None, None, None, None, None, "nested/a"))
    none = spark.createDataFrame([], "feed string, date_iso string, modified_iso string")
    listing = CAT.catalogue_listing(CAT.feed_catalogue(feeds, none))
    rows = listing.collect()
    assert [r.path for r in rows] == ["b", "nested/a"]
    assert rows[0].autodiscovery == '<link rel="alternate" type="application/rss+xml" title="B &amp; &lt;b&gt;" href="b/feed.xml">'
    assert "No description" in rows[1].entry and "say &quot;hi&quot;" in rows[0].entry and "(0, Unknown)" in rows[0].entry
    page = "".join(r.line for r in CAT.catalogue_lines(listing, "2025-12-29 00:00", title="My <Site>").collect())
    assert page.index("b/feed.json") < page.index("nested/a/feed.json") and "<title>My &lt;Site&gt;</title>" in page
    empty = CAT.catalogue_lines(listing.limit(0), "now")
    text = "".join(r.line for r in empty.collect())
    assert "No feeds found" in text and "Feed Index" in text and "A collection of RSS and JSON feeds" in text


def test_items_fixture_ids_are_unique_per_feed(spark):
    items = FX.items_x(spark, "/root/testdata/sf0.001")
    assert items.groupBy("feed", "id").count().filter("count > 1").count() == 0


def test_repeated_stored_ids_are_rendered_once_each(spark, items):
    rows = [dict(feed="f", id=i, title=t, ord=k) for k, (i, t) in enumerate((("a", "1"), ("a", "2"), ("b", "3")))]
    docs = FD.json_documents(_feeds(spark, ("f", "T", None, None, None)), items(*rows)).collect()
    assert [x["title"] for x in json.loads(docs[0].document)["items"]] == ["1", "2", "3"]
