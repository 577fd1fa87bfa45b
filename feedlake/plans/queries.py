"""The query catalogue: every job over the given tables, with scalar results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import dates, html as H
from feedlake.functions.url import is_valid_url, page_id_of
from feedlake.operators import catalogue as CAT
from feedlake.operators import feeds as FD
from feedlake.operators import frontier as FR
from feedlake.operators import links as LNK
from feedlake.operators import misses as MISS
from feedlake.operators import pages as PG
from feedlake.operators import patterns as PT
from feedlake.operators import running as RUN
from feedlake.operators import sitemaps as SM
from feedlake.operators import tags as TAG
from feedlake.operators.funnel import STAGES
from feedlake.operators.ranking import measured_within, rank_within
from feedlake.plans import fixtures as FX
from feedlake.plans import ingest
from feedlake.session import materialise, scratch_path
from feedlake.sinks.published import publish, published
from feedlake.sources.config import as_source, feed_table, link_list
from feedlake.sources.landed import page_corpus
from feedlake.sources.stored import stored_headers, stored_items
from feedlake.streaming import incremental as INC

AS_OF = FX.AS_OF


# --- frontier ----------------------------------------------------------------------


def url_canonical_ids(spark: SparkSession, sf: str) -> DataFrame:
    pages = FX.table(spark, sf, "pages").select("page_id", "url")
    return FR.with_ids(pages).select("page_id", "url", "canonical_url", "id", "valid")


def valid_links(spark: SparkSession, sf: str) -> DataFrame:
    return FR.valid_only(FX.derive(spark, sf, FX.FRONTIER)).select("feed", "ord", "url")


def links_per_domain(spark: SparkSession, sf: str) -> DataFrame:
    return FR.links_per_domain(FX.derive(spark, sf, FX.FRONTIER))


def allowlist_semi(spark: SparkSession, sf: str) -> DataFrame:
    frontier = FX.derive(spark, sf, FX.FRONTIER)
    return FR.allow_listed(frontier, FX.feeds(spark), FX.patterns(spark)).select("feed", "ord", "url")


def blocklist_anti(spark: SparkSession, sf: str) -> DataFrame:
    frontier = FX.derive(spark, sf, FX.FRONTIER)
    return FR.not_blocked(frontier, FX.feeds(spark), FX.patterns(spark)).select("feed", "ord", "url")


def glob_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Links and how many of as many globs as there are pages match them, through the q-gram index."""
    links = PT.with_texts(FX.derive(spark, sf, FX.FRONTIER))
    hits = PT.glob_hits(links, PT.compiled(FX.derive(spark, sf, FX.GLOBS)), small=False)
    return hits.groupBy("feed", "ord", "kind").agg(F.count("*").alias("globs"))


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    frontier = FR.with_ids(FX.derive(spark, sf, FX.FRONTIER))
    return frontier.filter("valid").select("feed", "id", "ord", "url")


def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return FR.first_seen(_identified(spark, sf))


def new_links_anti(spark: SparkSession, sf: str) -> DataFrame:
    fresh = FR.not_stored(FR.first_seen(_identified(spark, sf)), FX.stored(spark, sf))
    return fresh.select("feed", "id", "url")


def static_list_links(spark: SparkSession, sf: str) -> DataFrame:
    """The urls of the pages, landed as files of lines and read back in their order."""
    landed = scratch_path(spark, "link-list")
    FX.table(spark, sf, "pages").repartitionByRange(4, "page_id").sortWithinPartitions("page_id").select("url").write.text(landed)
    links = link_list(spark, landed, "list")
    ranked = rank_within(links, "feed", [F.col("source_ref"), F.col("part"), F.col("pos")], ["source_kind", "url"])
    return ranked.select("feed", "source_kind", "rank", "url")


def config_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """A configured feed for each language of the documents."""
    languages = FX.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()  # a few rows
    return feed_table(
        spark,
        [{"name": r["lang"], "feed": {"title": f"{r['n']} texts", "language": r["lang"]}, "output_dir": f"out/{r['lang']}"} for r in languages],
    )


def _all_sources(spark: SparkSession, sf: str) -> DataFrame:
    static = FX.table(spark, sf, "pages").select(
        F.expr(FX.FEED_OF_URL).alias("feed"), F.col("page_id").alias("pos"), "url"
    )
    notes = LNK.note_links(FX.derive(spark, sf, FX.NOTES, heavy=True), ["doc_id", "lang"]).select(
        F.col("lang").alias("feed"), F.col("doc_id").alias("ref"), "pos", "url"
    )
    boards = LNK.board_links(LNK.open_cards(_cards(spark, sf))).select(
        F.lit("en").alias("feed"),
        F.col("board").alias("ref"),
        "card",
        "pos",
        "url",
    )
    return FR.union_sources(
        as_source(static, "config", F.lit("")),
        as_source(notes, "notes", F.col("ref")),
        as_source(boards, "board", F.col("ref"), F.col("card")),
    )


def source_union_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return _all_sources(spark, sf).drop("ord")


def source_union_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    frontier = FR.with_ids(_all_sources(spark, sf)).filter("valid").drop("canonical_url", "valid")
    return FR.first_seen(frontier).select("feed", "id", "source_kind", "source_ref", "part", "pos", "url")


# --- link discovery ----------------------------------------------------------------


def markdown_links(spark: SparkSession, sf: str) -> DataFrame:
    return LNK.note_links(FX.derive(spark, sf, FX.NOTES, heavy=True), ["doc_id"])


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    return FX.derive(spark, sf, FX.CARDS, heavy=True)


def _list_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Boards with an odd number take lists L0 and L2 only; the others have no filter."""
    return (
        FX.derive(spark, sf, FX.BOARD_LISTS)
        .filter("board % 2 = 1 AND idlist IN ('L0', 'L2')")
        .select("board", "idlist")
    )


def board_links(spark: SparkSession, sf: str) -> DataFrame:
    return LNK.board_links(LNK.open_cards(_cards(spark, sf)))


def board_links_on_lists(spark: SparkSession, sf: str) -> DataFrame:
    return LNK.board_links(LNK.open_cards(_cards(spark, sf), _list_filter(spark, sf)))


def board_list_counts(spark: SparkSession, sf: str) -> DataFrame:
    return LNK.board_list_counts(_cards(spark, sf), FX.derive(spark, sf, FX.BOARD_LISTS))


def sitemap_links(spark: SparkSession, sf: str) -> DataFrame:
    return LNK.sitemap_links(FX.derive(spark, sf, FX.sitemaps("spark")))


def sitemap_first_candidate(spark: SparkSession, sf: str) -> DataFrame:
    first = LNK.first_sitemap(FX.derive(spark, sf, FX.sitemaps("spark")))
    return first.select("site", "candidate", F.size("urls").alias("links"), F.get("urls", F.lit(0)).alias("first_url"))


def page_outlinks(spark: SparkSession, sf: str) -> DataFrame:
    return LNK.outlinks(FX.derive(spark, sf, FX.PAGES_X, heavy=True), ["page_id"])


def site_links_top100(spark: SparkSession, sf: str) -> DataFrame:
    sites = FX.derive(spark, sf, FX.PAGES_X, heavy=True)
    sitemaps = FX.derive(spark, sf, FX.sitemaps("spark"))
    return LNK.site_links(sites, sitemaps, ["page_id"])


def host_site_links(spark: SparkSession, sf: str) -> DataFrame:
    """Article links of every page from the landed sitemap files of its host, parts of index files included, topped up with its own."""
    sites = FX.derive(spark, sf, FX.PAGES_X, heavy=True)
    return SM.host_links(sites, FX.derive(spark, sf, FX.SITEMAP_FILES), ["page_id"])


# --- pages -------------------------------------------------------------------------


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return FR.first_seen(_identified(spark, sf))


def page_fetch_join(spark: SparkSession, sf: str) -> DataFrame:
    pages = FX.pages_x(spark, sf)
    return PG.match_pages(_links(spark, sf), pages).select("feed", "id", "ord", "page_id", "final_id")


def fetch_failures(spark: SparkSession, sf: str) -> DataFrame:
    return PG.unanswered(_links(spark, sf), FX.pages_x(spark, sf)).select("feed", "id", "url")


def page_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return PG.with_page_ids(FX.pages_x(spark, sf)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("pages")
    )


def _good_pages(spark: SparkSession, sf: str) -> DataFrame:
    return PG.with_page_ids(FX.pages_x(spark, sf, heavy=True).filter("good"))


def _flat(items: DataFrame, *names: str) -> DataFrame:
    """Chosen columns of items, nested ones spelt out."""
    spelt = {
        "content_length": "length(content_html)",
        "content_md5": "md5(content_html)",
        "author": "array_join(transform(authors, a -> a.name), '|')",
        "tags": "array_join(tags, '|')",
        "attachment_url": "get(attachments, 0).url",
        "mime_type": "get(attachments, 0).mime_type",
        "size_in_bytes": "get(attachments, 0).size_in_bytes",
        "duration_in_seconds": "get(attachments, 0).duration_in_seconds",
    }
    return items.selectExpr(*[f"{spelt.get(n, n)} AS {n}" for n in names])


_ARTICLE = ("id", "url", "title", "summary", "content_length", "content_md5", "date_iso", "author", "language")
_MEDIA = ("tags", "attachment_url", "mime_type", "size_in_bytes", "duration_in_seconds")


def article_items(spark: SparkSession, sf: str) -> DataFrame:
    items = PG.article_items(_good_pages(spark, sf), AS_OF, ["page_id"])
    return _flat(items, "page_id", *_ARTICLE, "date_raw", "date_is_fallback")


def _doc(spark: SparkSession, sf: str) -> DataFrame:
    pages = FX.derive(spark, sf, FX.PAGES_X, heavy=True)
    return pages.selectExpr("page_id", "html", f"{H.visible('html')} AS doc").selectExpr(
        "*", f"{H.head_tags('doc')} AS head"
    )


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(spark, sf).selectExpr("*", f"{H.text_blocks(H.article_scope('doc'))} AS blocks")


def article_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(spark, sf).selectExpr("page_id", f"{PG.title('doc', 'head')} AS title")


def article_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).selectExpr(
        "page_id",
        f"{PG.description('head')} AS description",
        f"{H.best_block('blocks')} AS best_block",
        f"{H.best_block(H.paragraph_texts('doc', 4))} AS best_paragraph",
    )


def article_authors(spark: SparkSession, sf: str) -> DataFrame:
    return _doc(spark, sf).selectExpr(
        "page_id", f"{PG.author('head')} AS author", f"{H.language('doc', 'head')} AS language"
    )


def pages_per_language(spark: SparkSession, sf: str) -> DataFrame:
    languages = _doc(spark, sf).selectExpr(f"{H.language('doc', 'head')} AS language")
    return languages.groupBy("language").agg(F.count(F.lit(1)).alias("pages"))


def article_dates(spark: SparkSession, sf: str) -> DataFrame:
    raw = _doc(spark, sf).selectExpr("page_id", "doc", "head", f"{H.json_ld_scripts('html')} AS ld")
    return (
        raw.selectExpr("page_id", f"{PG.date_text('doc', 'head', 'ld')} AS date_raw")
        .selectExpr("*", f"{dates.parse_date('date_raw')} AS found")
        .selectExpr("page_id", "date_raw", f"{dates.iso_text('found.local', 'found.zone')} AS date_iso")
    )


def dates_read(spark: SparkSession, sf: str) -> DataFrame:
    """Date texts of many shapes as they are understood."""
    return MISS.read_dates(FX.derive(spark, sf, FX.DATE_TEXTS)).select("page_id", "date_raw", "date_iso", "outcome")


def date_shape_report(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest shapes of date texts by outcome, from the sketches of three runs."""
    path = scratch_path(spark, "shapes")
    texts = MISS.read_dates(FX.derive(spark, sf, FX.DATE_TEXTS))
    for run in range(3):
        RUN.put(MISS.shape_part(texts.filter(F.col("page_id") % 3 == run)), f"r-{run}", path)
    return MISS.shape_report(RUN.parts(spark, path, MISS.PART), top=50)


def body_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).selectExpr(
        "page_id", f"date_format({PG.top_date('blocks', AS_OF)}, 'yyyy-MM-dd') AS body_date"
    )


def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return LNK.exploded(_blocks(spark, sf), ["page_id"], "blocks", "pos, block")


def article_bodies(spark: SparkSession, sf: str) -> DataFrame:
    scopes = _doc(spark, sf).selectExpr("page_id", f"{H.article_scope('doc')} AS scope")
    return scopes.selectExpr("page_id", "length(scope) AS chars", "md5(scope) AS content_md5")


def video_items(spark: SparkSession, sf: str) -> DataFrame:
    items = PG.video_items(_good_pages(spark, sf), ["page_id"])
    return _flat(
        items, "page_id", "id", "url", "title", "summary", "author", "tags", "attachment_url", "mime_type",
        "duration_in_seconds",
    )


def videos_per_channel(spark: SparkSession, sf: str) -> DataFrame:
    channels = _flat(PG.video_items(_good_pages(spark, sf), ["page_id"]), "author")
    return channels.groupBy(F.col("author").alias("channel")).agg(F.count(F.lit(1)).alias("videos"))


def media_items(spark: SparkSession, sf: str) -> DataFrame:
    items = PG.media_items(_good_pages(spark, sf), ["page_id"])
    return _flat(items, "page_id", "id", "url", "title", *_MEDIA)


def media_per_type(spark: SparkSession, sf: str) -> DataFrame:
    types = _flat(PG.media_items(_good_pages(spark, sf), ["page_id"]), "mime_type")
    return types.groupBy("mime_type").agg(F.count(F.lit(1)).alias("items"))


def page_items(spark: SparkSession, sf: str) -> DataFrame:
    items = PG.page_items(_good_pages(spark, sf), AS_OF, ["page_id"])
    return _flat(items, "page_id", "kind", *_ARTICLE, *_MEDIA)


# --- tags --------------------------------------------------------------------------


def tag_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = FX.derive(spark, sf, FX.RAW_TAGS, heavy=True)
    return raw.selectExpr("doc_id", f"array_join({TAG.clean_tags('raw')}, '|') AS tags")


def topic_tags_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    texts = FX.spread(FX.table(spark, sf, "documents").select("doc_id", "text"))
    return TAG.topic_terms(texts, "doc_id")


def item_tags_merged(spark: SparkSession, sf: str) -> DataFrame:
    items = FX.items_x(spark, sf)
    bodies = FX.spread(FX.table(spark, sf, "pages")).selectExpr(
        "page_id AS ord", f"{H.inner_text(H.article_scope(H.visible('html')))} AS text"
    )
    own = items.select("id", "ord").join(bodies, "ord")
    tagged = TAG.add_topics(items, TAG.topic_terms(own.select("id", "text"), "id"))
    return tagged.select("feed", "id", F.array_join("tags", "|").alias("tags"))


def running_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic terms after three runs, one of them repeated and two merged: as if all texts were counted at once."""
    path = scratch_path(spark, "terms")
    docs = FX.spread(FX.table(spark, sf, "documents")).selectExpr("doc_id AS id", "text", "doc_id % 3 AS run")
    for run in (0, 1, 1, 2):
        RUN.add_texts(docs.filter(F.col("run") == run), f"r-{run}", path, "bigint")
    RUN.merge_document_counts(spark, path, ["r-0", "r-1"])
    return RUN.topics(spark, path, "bigint").withColumnRenamed("id", "doc_id")


def tag_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return TAG.tag_rollup(FX.items_x(spark, sf))


# --- feeds -------------------------------------------------------------------------


def _split_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored items (retitled) and the items of the current run.

    Everything served over plain http is stored; the run finds all https pages and the
    Spanish ones again, so both sides overlap.
    """
    items = FX.items_x(spark, sf)
    old = items.filter("url LIKE 'http:%'").withColumn("title", F.concat(F.lit("Old "), "title"))
    new = items.filter("url LIKE 'https:%' OR feed = 'es'")
    return old, new


def merge_append(spark: SparkSession, sf: str) -> DataFrame:
    merged = FD.merge_append(*_split_items(spark, sf))
    return merged.select("feed", "id", "title", "ord")


def merge_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _split_items(spark, sf)
    return FD.merge_rebuild(old, new.filter("feed <> 'fr'")).select("feed", "id", "title", "ord")


def dry_run_delta(spark: SparkSession, sf: str) -> DataFrame:
    return FD.dry_run(*_split_items(spark, sf))


def _document_ids() -> Column:
    """Ids of the items of a document, in order."""
    return F.regexp_extract_all("document", F.lit('(?:\\{"id":"|<guid isPermaLink="false">)([0-9a-f]{16})'), 1)


def _ids_digest() -> Column:
    return F.md5(F.array_join(_document_ids(), ",")).alias("ids_md5")


def json_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    paths = {
        "id": "id",
        "url": "url",
        "title": "title",
        "summary": "summary",
        "content_html": "content_html",
        "date_published": "date_published",
        "date_modified": "date_modified",
        "author": "authors[0].name",
        "language": "language",
        "second_tag": "tags[1]",
        "media_url": "attachments[0].url",
        "media_size": "attachments[0].size_in_bytes",
    }
    return FD.json_items(FX.items_x(spark, sf)).selectExpr(
        "feed",
        "ord",
        *[f"get_json_object(item, '$.{path}') AS {name}" for name, path in paths.items()],
        "array_join(json_object_keys(item), ',') AS keys",
    )


def stored_feed_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    documents = FD.json_documents(FX.feeds(spark), FX.items_x(spark, sf), page_items=100)
    return stored_items(documents).select(
        "feed",
        "id",
        "url",
        "title",
        "summary",
        "date_iso",
        "modified_iso",
        F.get("authors", F.lit(0))["name"].alias("author"),
        F.array_join("tags", "|").alias("tags"),
        F.get("attachments", F.lit(0))["size_in_bytes"].alias("media_size"),
    )


def stored_feed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers with what their documents hold."""
    documents = FD.json_documents(FX.feeds(spark), FX.items_x(spark, sf))
    held = stored_items(documents).groupBy("feed").agg(F.count("*").alias("items"), F.max("url").alias("last_url"))
    return stored_headers(documents).join(held, "feed", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def json_feed_pages(spark: SparkSession, sf: str) -> DataFrame:
    documents = FD.json_documents(FX.feeds(spark), FX.items_x(spark, sf), page_items=50)
    return documents.select(
        "feed",
        "page",
        F.json_array_length(F.get_json_object("document", "$.items")).alias("items"),
        F.get_json_object("document", "$.next_url").alias("next_url"),
        F.get_json_object("document", "$.items[0].url").alias("first_url"),
        _ids_digest(),
    )


def rss_ranked_items(spark: SparkSession, sf: str) -> DataFrame:
    return FD.rss_ranked(FX.items_x(spark, sf))


def rss_item_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts = [f"{text} AS {name}" for name, text in FD.rss_texts().items()]
    return FX.items_x(spark, sf).selectExpr("feed", "id", *texts)


def rss_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = FD.rss_documents(FX.feeds(spark), FX.items_x(spark, sf))
    return documents.select(
        "feed",
        "page",
        F.regexp_extract("document", "<channel><title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("document", "</title><link>(.*?)</link>", 1).alias("link"),
        F.regexp_extract("document", "</link><description>(.*?)</description>", 1).alias("description"),
        F.regexp_count("document", F.lit("<item>")).alias("items"),
        F.regexp_count("document", F.lit("<enclosure ")).alias("enclosures"),
        F.regexp_count("document", F.lit("<category>")).alias("categories"),
        F.regexp_count("document", F.lit("<pubDate>")).alias("dates"),
        F.regexp_extract("document", '<guid isPermaLink="false">(.*?)</guid>', 1).alias("first_id"),
        _ids_digest(),
    )


def byte_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of each language in pages that end after 64 kB or 100 texts: places by a prefix sum over sorted ranges."""
    docs = FX.table(spark, sf, "documents").select("lang", "doc_id", F.octet_length("text").alias("bytes"))
    placed = measured_within(docs, "lang", [F.col("doc_id")], ["doc_id"], "bytes")
    return placed.select("lang", "doc_id", "rank", "before", FD.page_key("rank", "before", 100, 1 << 16).alias("page_key"))


def published_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What readers find after two runs: all feeds, then the English one again with fewer items, so fewer pages."""
    root = scratch_path(spark, "published")
    feeds, items = FX.feeds(spark), FX.items_x(spark, sf)
    fewer = items.filter("feed = 'en' AND url LIKE 'http:%'")
    for some, held in ((feeds, items), (feeds.filter("feed = 'en'"), fewer)):
        json = FD.named_documents(some, FD.json_documents(some, held, page_items=50), "json")
        publish(json.unionByName(FD.named_documents(some, FD.rss_documents(some, held, page_items=50), "xml")), root)
    return published(spark, root).select("name", "feed", F.size(_document_ids()).alias("items"), _ids_digest())


def rss_enclosures(spark: SparkSession, sf: str) -> DataFrame:
    return FD.enclosures(FX.items_x(spark, sf))


def xml_clean_items(spark: SparkSession, sf: str) -> DataFrame:
    items = FX.items_x(spark, sf).select("feed", "id", "title", "summary", "content_html")
    return FD.clean_for_xml(items, ["title", "summary", "content_html"])


# --- catalogue ---------------------------------------------------------------------


def feed_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return CAT.feed_catalogue(FX.feeds(spark), FX.items_x(spark, sf))


def running_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue from totals that three runs have added up; the first two are merged, and one was repeated."""
    path = scratch_path(spark, "totals")
    items = FX.items_x(spark, sf)
    for run in (0, 1, 1, 2):
        RUN.put(RUN.stored_part(items.filter(F.col("ord") % 3 == run)), f"r-{run}", path)
    RUN.merge(spark, path, RUN.FEED_PART, ["r-0", "r-1"], RUN.add_feed_parts)
    return CAT.catalogue_of(FX.feeds(spark), RUN.feed_run_totals(spark, path))


def catalogue_listing(spark: SparkSession, sf: str) -> DataFrame:
    return CAT.catalogue_listing(feed_catalogue(spark, sf))


def catalogue_page(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue page as it was written, line by line."""
    path = scratch_path(spark, "page")
    CAT.write_page(CAT.catalogue_lines(catalogue_listing(spark, sf), "2025-12-29"), path)
    return CAT.read_page(spark, path)


# --- whole runs --------------------------------------------------------------------


def ingest_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.funnel_of(
        FX.derive(spark, sf, FX.FRONTIER),
        FX.feeds(spark),
        FX.patterns(spark),
        FX.stored(spark, sf),
        FX.pages_x(spark, sf),
    )


def _two_runs(spark: SparkSession, sf: str) -> str:
    """Two runs over halves of the links, each adding its part to the totals; the folder of the parts."""
    path = scratch_path(spark, "totals")
    pages, held = FX.pages_x(spark, sf, heavy=True), FX.stored(spark, sf)
    before = FX.items_x(spark, sf).join(held.select("feed", "id").distinct(), ["feed", "id"], "left_semi")
    RUN.put(RUN.stored_part(before), "stored", path)
    known = before.select("feed", "id")
    for run in (0, 1):
        links = FX.derive(spark, sf, FX.FRONTIER).filter(F.col("ord") % 2 == run)
        args = (links, FX.feeds(spark), FX.patterns(spark), known, pages)
        new = materialise(ingest.collect_items(*args, AS_OF), "new-items")
        RUN.put(RUN.run_part(ingest.funnel_of(*args), new.withColumn("modified_iso", F.lit(None).cast("string"))), f"run-{run}", path)
        known = known.unionByName(new.select("feed", "id"))
    return path


def running_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel over two runs, with what was parsed and what the feeds hold, added up from the parts of the runs."""
    totals = RUN.feed_run_totals(spark, _two_runs(spark, sf))
    return totals.select("feed", "collected", *STAGES, "parsed", "total")


def multi_feed_run(spark: SparkSession, sf: str) -> DataFrame:
    items = ingest.collect_items(
        FX.derive(spark, sf, FX.FRONTIER),
        FX.feeds(spark),
        FX.patterns(spark),
        FX.stored(spark, sf),
        FX.pages_x(spark, sf, heavy=True),
        AS_OF,
    )
    return items.select("feed", "id", "url", "title", "summary", "date_iso", "language", "ord")


def corpus_items(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links of the corpus as feed items."""
    pages = FX.table(spark, sf, "pages")
    links = FR.first_seen(
        pages.filter(is_valid_url("url")).selectExpr(
            f"{FX.FEED_OF_URL} AS feed", f"{page_id_of('url')} AS id", "page_id AS ord", "page_id"
        )
    )
    corpus = page_corpus(FX.spread(pages))
    items = PG.page_items(PG.with_page_ids(PG.wanted_pages(links, corpus)), AS_OF, ["page_id"])
    return items.join(links.select("feed", "page_id"), "page_id").select(
        "feed", "id", "url", "title", "summary", "language", "date_iso"
    )


def incremental_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that arrive in four batches, with lost and repeated ones, kept out or in by the patterns; the table that results."""
    path, landed = scratch_path(spark, "items"), scratch_path(spark, "landed")
    arrivals = FX.derive(spark, sf, FX.ARRIVALS)
    files = 8
    for batch in range(4):
        arrivals.filter(F.col("batch") == batch).drop("batch").repartition(files).write.mode("append").parquet(landed)
    INC.run_available(
        INC.stream_pages(spark, landed, "page_id bigint, url string, html string, status int", files_per_batch=files),
        path,
        scratch_path(spark, "progress"),
        AS_OF,
        lambda pages: pages.withColumn("feed", F.expr(FX.FEED_OF_URL)),
        (FX.feeds(spark), FX.patterns(spark)),
        key_digits=1,
    )
    return INC.read_items(spark, path).select("feed", "id", "url", "title", "summary", "language", "date_iso")


CATALOGUE = {
    f.__name__: f
    for f in (
        url_canonical_ids,
        valid_links,
        links_per_domain,
        allowlist_semi,
        blocklist_anti,
        glob_matches,
        dedup_first_seen,
        new_links_anti,
        static_list_links,
        config_feeds,
        source_union_ordered,
        source_union_first_seen,
        markdown_links,
        board_links,
        board_links_on_lists,
        board_list_counts,
        sitemap_links,
        sitemap_first_candidate,
        page_outlinks,
        site_links_top100,
        host_site_links,
        page_fetch_join,
        fetch_failures,
        page_kind_counts,
        article_items,
        article_titles,
        article_summaries,
        article_authors,
        pages_per_language,
        article_dates,
        dates_read,
        date_shape_report,
        body_dates,
        text_blocks,
        article_bodies,
        video_items,
        videos_per_channel,
        media_items,
        media_per_type,
        page_items,
        tag_clean,
        topic_tags_tfidf,
        running_topics,
        item_tags_merged,
        tag_rollup,
        merge_append,
        merge_rebuild,
        dry_run_delta,
        json_feed_items,
        stored_feed_roundtrip,
        stored_feed_headers,
        json_feed_pages,
        rss_ranked_items,
        rss_item_texts,
        rss_documents,
        byte_pages,
        published_documents,
        rss_enclosures,
        xml_clean_items,
        feed_catalogue,
        catalogue_listing,
        running_catalogue,
        catalogue_page,
        ingest_funnel,
        running_funnel,
        multi_feed_run,
        corpus_items,
        incremental_equals_batch,
    )
}
