import datetime as dt

from pyspark.sql import functions as F

from feedlake.functions.url import page_id_of
from feedlake.operators.funnel import STAGES
from feedlake.plans import fixtures as FX
from feedlake.plans import ingest
from feedlake.plans import queries as Q
from feedlake.sources.landed import page_corpus
from feedlake.streaming import incremental as INC
from feedlake.streaming import keys

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2025, 12, 29)


def test_funnel_adds_up_and_agrees_with_the_run(spark):
    rows = {r.feed: r.asDict() for r in Q.ingest_funnel(spark, SF).collect()}
    assert all(r["collected"] == sum(r[s] for s in STAGES) for r in rows.values())
    assert sum(r["collected"] for r in rows.values()) == FX.derive(spark, SF, FX.FRONTIER).count()
    added = {r.feed: r["count"] for r in Q.multi_feed_run(spark, SF).groupBy("feed").count().collect()}
    assert added == {f: r["added"] for f, r in rows.items() if r["added"]}


def test_redirects_to_one_page_give_one_item(spark):
    pages = page_corpus(
        spark.createDataFrame(
            [(1, "https://e.com/a", "https://e.com/z", "<title>Z</title>"), (2, "https://e.com/b", "https://e.com/z?ref=x", "<title>Z</title>"), (3, "https://e.com/c", None, "<title>C</title>")],
            "page_id bigint, url string, final_url string, html string",
        )
    )
    frontier = spark.createDataFrame(
        [("f", 0, "https://e.com/b"), ("f", 1, "https://e.com/a"), ("f", 2, "https://e.com/c"), ("g", 0, "https://e.com/c#x"), ("f", 3, "https://e.com/c/")],
        "feed string, ord bigint, url string",
    )
    feeds = spark.createDataFrame([("f",), ("g",)], "feed string")
    patterns = spark.createDataFrame([], "feed string, kind string, pattern string")
    stored = spark.createDataFrame([], "feed string, id string")
    args = (frontier, feeds, patterns, stored, pages)
    got = sorted((r.feed, r.ord, r.url) for r in ingest.collect_items(*args, AS_OF).collect())
    assert got == [("f", 0, "https://e.com/z?ref=x"), ("f", 1, "https://e.com/c"), ("g", 0, "https://e.com/c")]
    funnel = {r.feed: r for r in ingest.funnel_of(*args).collect()}
    assert (funnel["f"].same_page, funnel["f"].duplicate, funnel["f"].added) == (1, 1, 2)


def test_run_skips_what_is_stored(spark):
    frontier = FX.derive(spark, SF, FX.FRONTIER)
    args = (FX.feeds(spark), FX.patterns(spark))
    pages = FX.pages_x(spark, SF)
    first = ingest.collect_items(frontier, *args, FX.stored(spark, SF), pages, AS_OF).cache()
    assert first.count() > 0
    known = first.select("feed", "id").unionByName(FX.stored(spark, SF).select("feed", "id"))
    assert ingest.collect_items(frontier, *args, known, pages, AS_OF).count() == 0
    first.unpersist()


def _with_feed(pages):
    return pages.withColumn("feed", F.expr(FX.FEED_OF_URL))


def test_incremental_equals_batch(spark, tmp_path):
    pages = FX.table(spark, SF, "pages").select("page_id", "url", "html")
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "items", "progress"))
    (tmp_path / "landing").mkdir()
    arrivals = INC.stream_pages(spark, landing, "page_id bigint, url string, html string", files_per_batch=1)
    for part in range(3):
        pages.filter(f"page_id % 3 = {part}").coalesce(1).write.mode("append").parquet(landing)
    INC.run_available(arrivals, table, progress, AS_OF, _with_feed)
    pages.filter("page_id % 10 = 0").coalesce(1).write.mode("append").parquet(landing)
    INC.run_available(arrivals, table, progress, AS_OF, _with_feed)
    items = INC.read_items(spark, table)
    assert items.select("run_id").distinct().count() == 3
    streamed = {(r.feed, r.id) for r in items.select("feed", "id").collect()}
    wanted = {(r.feed, r.id) for r in pages.selectExpr(f"{FX.FEED_OF_URL} AS feed", f"{page_id_of('url')} AS id").collect()}
    assert streamed == wanted and items.count() == len(wanted)
    # a batch that is run again replaces its own output
    INC.ingest_batch(pages.filter("page_id % 3 = 0"), f"{INC.stream_name(spark, progress)}-0", table, AS_OF, _with_feed)
    assert INC.read_items(spark, table).count() == len(wanted)


def test_second_stream_keeps_the_first_ones_items(spark, tmp_path):
    """Another progress folder starts at batch 0 again; bad answers and blocked links stay out; a page may be in two feeds."""
    schema = "page_id bigint, url string, html string, status int"
    landing, table = str(tmp_path / "landing"), str(tmp_path / "items")
    rows = [(1, "https://e.com/a", "<title>A</title>", 200), (2, "https://e.com/b", "<title>B</title>", 404), (3, "https://bad.com/c", "<title>C</title>", 200), (1, "https://e.com/a", "<title>A</title>", 200)]
    feeds = spark.createDataFrame([("f",)], "feed string")
    patterns = spark.createDataFrame([(None, "block", "*.bad.com")], "feed string, kind string, pattern string")

    def two_feeds(pages):
        return pages.withColumn("feed", F.explode(F.array(F.lit("f"), F.lit("g"))))

    def run(progress):
        arrivals = INC.stream_pages(spark, landing, schema)
        INC.run_available(arrivals, table, str(tmp_path / progress), AS_OF, two_feeds, (feeds, patterns))
        return sorted((r.feed, r.title) for r in INC.read_items(spark, table).collect())

    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    assert run("one") == [("f", "A"), ("g", "A")]
    spark.createDataFrame([(9, "https://e.com/z", "<title>Z</title>", 200)], schema).coalesce(1).write.mode("append").parquet(landing)
    assert run("two") == [("f", "A"), ("f", "Z"), ("g", "A"), ("g", "Z")]


def test_a_stored_final_page_is_not_added_again(spark):
    pages = page_corpus(spark.createDataFrame([(1, "https://e.com/a", "https://e.com/z", "<title>Z</title>")], "page_id bigint, url string, final_url string, html string"))
    frontier = spark.createDataFrame([("f", 0, "https://e.com/a")], "feed string, ord bigint, url string")
    feeds = spark.createDataFrame([("f",)], "feed string")
    patterns = spark.createDataFrame([], "feed string, kind string, pattern string")
    stored = spark.range(1).selectExpr("'f' AS feed", f"{page_id_of(chr(39) + 'https://e.com/z' + chr(39))} AS id")
    args = (frontier, feeds, patterns, stored, pages)
    funnel = ingest.funnel_of(*args).first()
    assert (funnel.added, funnel.same_page) == (0, 1)
    assert ingest.collect_items(*args, AS_OF).count() == 0


def test_few_wanted_pages_move_no_body(spark, tmp_path):
    pages = page_corpus(FX.table(spark, SF, "pages"))
    links = pages.filter("page_id < 2").selectExpr("'f' AS feed", "page_id AS ord", "page_id")
    items = ingest.items_of(links, pages, AS_OF)
    items.collect()
    plan = items._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    above, depths = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        while depths and depths[-1][0] >= depth:
            depths.pop()
        depths.append((depth, line))
        if "FileScan" in line and "html" in line:
            above += [x for _, x in depths if "Exchange" in x and "Broadcast" not in x]
    assert "html" in plan and not above


def test_a_batch_opens_only_its_prefixes(spark, tmp_path):
    """Partitions are pruned by the batch's prefixes, and few ids are named to the files."""
    path = str(tmp_path / "keys")
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 'f', 'g') AS feed", "substring(sha2(cast(id AS string), 256), 1, 16) AS id", "'a-0' AS run_id")
    keys.create_keys(spark, rows, path)
    wanted = rows.where("feed = 'f'").limit(3).cache()
    found = keys.seen(wanted, path, "none")
    assert sorted(map(tuple, found.collect())) == sorted((r.feed, r.id) for r in wanted.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "prefix" in plan.split("PartitionFilters:")[1].split("]")[0] and "In(id" in plan.replace(" ", "").split("PushedFilters:")[1]
    assert len({f.split("prefix=")[1][:2] for f in keys.read_keys(spark, path).inputFiles()}) == 256
    assert found.select(F.input_file_name().alias("file")).distinct().count() <= 3
    many = keys.seen(rows.where("id LIKE '0%'").unionByName(rows.where("id LIKE '1%'")), path, "none")
    assert {i[:1] for i in (r.id for r in many.collect())} == {"0", "1"}
    assert keys.seen(wanted, path, "a-0").count() == 0 and keys.seen(rows.limit(0), path, "none").count() == 0


def test_finished_runs_are_merged(spark, tmp_path):
    path = str(tmp_path / "keys")
    rows = spark.range(60).selectExpr("'f' AS feed", "substring(sha2(cast(id AS string), 256), 1, 16) AS id", "cast(id % 6 AS int) AS k")
    keys.create_keys(spark, rows.limit(0).withColumn("run_id", F.lit("x-0")), path)
    for k in range(6):
        keys.add_keys(rows.where(f"k = {k}"), f"{'s' if k < 4 else 't'}-{k}", path)
    assert keys.merge_runs(spark, path, most=100) == 0
    assert keys.merge_runs(spark, path, most=2) == 4
    left = {r.run_id.split("-")[0]: r.n for r in keys.read_keys(spark, path).groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert left == {"merged": 40, "s": 10, "t": 10}
    keys.add_keys(rows.where("k = 0"), "s-6", path)
    assert keys.merge_runs(spark, path, most=2) == 2
    assert keys.read_keys(spark, path).select("id").distinct().count() == 60


def test_a_progress_folder_made_anew_is_another_stream(spark, tmp_path):
    """The earlier stream's batch 0 stays, although the new one has the same folder and number."""
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "items", "progress"))
    schema = "page_id bigint, url string, html string"

    def land_and_run(i):
        spark.createDataFrame([(i, f"https://www.e.com/en/{i}", f"<title>{i}</title>")], schema).coalesce(1).write.mode("append").parquet(landing)
        INC.run_available(INC.stream_pages(spark, landing, schema), table, progress, AS_OF, _with_feed)

    land_and_run(1)
    one = INC.stream_name(spark, progress)
    (tmp_path / "progress").rename(tmp_path / "earlier")
    land_and_run(2)
    assert INC.stream_name(spark, progress) != one
    assert sorted(r.title for r in INC.read_items(spark, table).collect()) == ["1", "2"]


def test_versions_of_a_page_in_one_batch(spark, tmp_path):
    schema = "page_id bigint, url string, html string"
    for order in (1, -1):
        table = str(tmp_path / f"items{order}")
        rows = [(1, "https://e.com/a", "<title>B</title>"), (1, "https://e.com/a", "<title>A</title>")][::order]
        spark.createDataFrame([], INC.ITEMS_SCHEMA).write.partitionBy("run_id").parquet(table)
        keys.create_keys(spark, INC.read_items(spark, table), INC.keys_path(table))
        INC.ingest_batch(spark.createDataFrame(rows, schema), "r-0", table, AS_OF, lambda p: p.withColumn("feed", F.lit("f")))
        assert [r.title for r in INC.read_items(spark, table).collect()] == ["A"]
