"""Totals by run: repeated runs, merges that die half-way, texts that come again."""

import math

import pytest
from pyspark.sql import functions as F

from feedlake.operators import catalogue as CAT
from feedlake.operators import running as RUN
from feedlake.operators import tags as TAG

PART = "term string, df bigint"


def _sums(spark, path):
    return {r.term: r.df for r in RUN.add_document_counts(RUN.parts(spark, path, PART)).collect()}


def test_parts_add_up(spark, tmp_path):
    path = str(tmp_path / "df")
    assert _sums(spark, path) == {}
    for run, rows in (("r-0", [("a", 1), ("b", 2)]), ("r-1", [("a", 5)]), ("r-1", [("a", 4)]), ("r-2", [("c", 7)])):
        RUN.put(spark.createDataFrame(rows, PART), run, path)
    want = {"a": 5, "b": 2, "c": 7}
    assert _sums(spark, path) == want
    RUN.merge(spark, path, PART, ["r-0", "r-1"], RUN.add_document_counts)
    assert _sums(spark, path) == want
    assert {r.run_id.split("-")[0] for r in RUN.parts(spark, path, PART).collect()} == {"merged", "r"}
    RUN.put(spark.createDataFrame([("b", 1)], PART), "r-3", path)
    merged = [r.run_id for r in RUN.parts(spark, path, PART).select("run_id").distinct().collect()]
    RUN.merge(spark, path, PART, [m for m in merged if m != "r-3"], RUN.add_document_counts)
    assert _sums(spark, path) == {"a": 5, "b": 3, "c": 7}


def test_a_merge_that_dies_counts_nothing_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "df")
    for run in ("r-0", "r-1"):
        RUN.put(spark.createDataFrame([("a", 1)], PART), run, path)
    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            RUN.merge(spark, path, PART, ["r-0", "r-1"], RUN.add_document_counts)
    assert _sums(spark, path) == {"a": 2}
    RUN.merge(spark, path, PART, ["r-0", "r-1"], RUN.add_document_counts)
    assert _sums(spark, path) == {"a": 2}


def test_topics_by_run(spark, tmp_path):
    path = str(tmp_path / "terms")
    rows = [(str(k), f"common word{k % 4} Spark{k % 3} lake {'deep ' * (k % 5)}") for k in range(40)] + [("x", None), ("y", "")]
    texts = spark.createDataFrame(rows, "id string, text string")
    part = F.abs(F.hash("id")) % 3
    for run in range(3):
        RUN.add_texts(texts.where(part == run), f"r-{run}", path)
        so_far = texts.where(part <= run)
        got = sorted(map(tuple, RUN.topics(spark, path).collect()))
        assert got == sorted(map(tuple, TAG.topic_terms(so_far, "id").collect()))
    # only terms of a run's own texts have rows in its part; texts that come again change nothing
    RUN.add_texts(spark.createDataFrame([("0", "other text entirely"), ("new", "fresh common")], "id string, text string"), "r-3", path)
    assert {r.term for r in RUN.parts(spark, f"{path}/df", PART).where("run_id = 'r-3'").collect()} == {"fresh", "common"}
    assert {r.id for r in RUN.topics(spark, path, run_id="r-3").collect()} == {"new"}


def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch):
    """A text's words are counted and written where it is read: no text and no word count is shuffled, also where earlier ids are too many to be sent around."""
    path, plans = str(tmp_path / "terms"), []
    spark.range(60).selectExpr("CAST(id AS string) AS id", "concat('common word', id % 7, ' lake') AS text").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    RUN.add_texts(texts.where("CAST(id AS int) < 40"), "r-0", path)
    for name in ("put", "materialise"):

        def watched(rows, *args, write=getattr(RUN, name)):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return write(rows, *args)

        monkeypatch.setattr(RUN, name, watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        RUN.add_texts(texts.where("CAST(id AS int) >= 40"), "r-1", path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counting = [p for p in plans if "regexp_extract_all" in p]
    assert counting and not any("Exchange" in p or "Aggregate" in p for p in counting)
    assert sorted(map(tuple, RUN.topics(spark, path).collect())) == sorted(map(tuple, TAG.topic_terms(texts, "id").collect()))


def test_topics_of_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    """Texts of one id in one run are one text of terms, in df too; null ids are one id of their run."""
    monkeypatch.setattr(TAG, "_COMMON_TERMS", 2, raising=False)
    path = str(tmp_path / "terms")
    first = [("a", "lake lake river"), ("a", "lake stone"), ("b", "river sand"), (None, "stone stone"), (None, "stone sand"), ("c", None)]
    then = [("a", "passed over"), ("d", "lake sand sand sand"), (None, "stone")]
    for k, rows in enumerate((first, then)):
        RUN.add_texts(spark.createDataFrame(rows, "id string, text string"), f"r-{k}", path)
    df = {"lake": 2, "river": 2, "stone": 3, "sand": 3}
    assert _sums(spark, f"{path}/df") == df
    counts = [("a", "lake", 3), ("a", "river", 1), ("a", "stone", 1), ("b", "river", 1), ("b", "sand", 1), ("d", "lake", 1), ("d", "sand", 3)]
    want = {(k, t): round(n * (math.log((1 + 8) / (1 + df[t])) + 1), 6) for k, t, n in counts}
    got = RUN.topics(spark, path).collect()
    assert {(r.id, r.term): r.score for r in got if r.id} == want
    # the null ids of both runs share their ranks, with the terms of each run
    stone, sand = (math.log(9 / 4) + 1,) * 2
    assert sorted((r.term, r.score) for r in got if not r.id) == sorted([("stone", round(3 * stone, 6)), ("sand", round(sand, 6)), ("stone", round(stone, 6))])


def test_catalogue_after_every_run(spark, tmp_path):
    path = str(tmp_path / "feeds")
    feeds = spark.createDataFrame([("f", "F"), ("g", "G")], "feed string, title string").selectExpr("*", *[f"CAST(NULL AS string) AS {c}" for c in ("home_page_url", "feed_url", "description", "language", "output_dir")])
    runs = [[("f", "2025-01-01T10:00:00+02:00", None)], [], [("f", "junk", None), ("g", None, "2025-03-04T00:00:00")], [("f", "2025-02-01T23:30:00-05:00", None)]]
    schema = "feed string, date_iso string, modified_iso string"
    for k, rows in enumerate(runs):
        RUN.put(RUN.stored_part(spark.createDataFrame(rows, schema)), f"r-{k}", path)
        so_far = spark.createDataFrame([r for some in runs[: k + 1] for r in some], schema)
        got = CAT.catalogue_of(feeds, RUN.feed_run_totals(spark, path))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, CAT.feed_catalogue(feeds, so_far).collect()))


def test_written_page_is_in_order(spark, tmp_path):
    listing = spark.range(500).selectExpr("concat('p', lpad(id, 4, '0')) AS path", "concat('entry ', id) AS entry", "concat('auto ', id) AS autodiscovery").repartition(7)
    lines = CAT.catalogue_lines(listing, "now")
    CAT.write_page(lines, str(tmp_path / "page"))
    got = [r.line for r in CAT.read_page(spark, str(tmp_path / "page")).orderBy("pos").collect()]
    assert got == [r.line for r in lines.collect()] and len(got) == 1003
