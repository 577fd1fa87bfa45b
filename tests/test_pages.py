import datetime as dt

import pytest

from feedlake.functions import dates as D
from feedlake.functions import html as H
from feedlake.functions import text as X
from feedlake.operators import pages as PG
from feedlake.sources.landed import page_corpus

AS_OF = dt.datetime(2025, 12, 29)


@pytest.fixture
def items(spark):
    """Items of (url, html) pages in order."""

    def run(*pages, **extra):
        rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
        df = spark.createDataFrame(rows, "page_id int, url string, html string")
        for name, val in extra.items():
            df = df.selectExpr("*", f"{val} AS {name}")
        parsed = PG.page_items(PG.with_page_ids(page_corpus(df)), AS_OF, ["page_id"])
        return sorted(parsed.collect(), key=lambda r: r.page_id)

    return run


def test_kinds(values):
    kinds = {
        "https://youtube.com/watch?v=abc123": "video",
        "https://www.youtube.com/watch?v=dQw4w9WgXcQ": "video",
        "https://youtu.be/abc123": "video",
        "https://youtube.com/shorts/abc123": "video",
        "https://youtube.com/channel/xyz": "article",
        "https://m.youtube.com/watch?v=abc": "article",
        "https://youtube.com/watch?t=1&v=abc": "article",
        "https://example.com/audio.MP3": "media",
        "https://example.com/doc.pdf?dl=1": "media",
        "https://example.com/video.mp4": "media",
        "https://example.com/page.html": "article",
    }
    assert values(PG.page_kind("x"), kinds) == list(kinds.values())


def test_title_chain(items):
    got = items(
        ("https://e.com/1", "<html><head><title>Test Title</title></head><body></body></html>"),
        ("https://e.com/2", '<meta property="og:title" content=" OG &amp; Title "><title>Regular</title>'),
        ("https://e.com/3", "<meta content='TW' name='twitter:title'><title>Regular</title>"),
        ("https://e.com/4", "<!-- <title>no</title> --><h1> A <b>B</b>\n C </h1>"),
        ("https://e.com/5", '<meta property="og:title" content=""><title></title>'),
        ("https://e.com/6", '<META NAME=x PROPERTY=og:title CONTENT="a > b">'),
        ("https://e.com/7", None),
    )
    assert [r.title for r in got] == ["Test Title", "OG & Title", "TW", "A B C", None, "a > b", None]
    assert all(r.id and r.url for r in got)


def test_description_only(items):
    html = '<html><head><meta name="description" content="Page description"></head></html>'
    assert items(("https://e.com", html))[0].summary == "Page description"


LONG = "This paragraph has more than one hundred characters so that it counts as a summary candidate, " * 2


def test_summary_order_depends_on_title(items):
    body = f'<meta name="description" content="short"><article><p>{LONG}</p></article>'
    titled, bare = items(("https://e.com/1", "<title>t</title>" + body), ("https://e.com/2", body))
    assert titled.summary == LONG.strip() and titled.content_html == f"<p>{LONG}</p>"
    assert bare.summary == "short" and bare.content_html is None


def test_best_block(value, spark):
    def best(*blocks):
        df = spark.createDataFrame([(list(blocks),)], "b array<string>")
        return df.selectExpr(f"{H.best_block('b')} AS r").first()["r"]

    assert best("Short.", "m" * 120, "n" * 140, "o" * 140) == "n" * 140
    assert best("s" * 100, "also short") is None
    assert best("a", "b", "c" * 101, "d", "e" * 300) == "c" * 101
    assert best("A" * 1000) == "A" * 500
    assert best() is None


def test_paragraphs(value):
    html = "<div><p>First.</p><p class=x>  Sec<b>ond</b>\n</p><pre>no</pre><p>open<div>block</div><p>4</p><p>5</p>"
    assert value(H.paragraph_texts("x", 4), x=html) == ["First.", "Sec ond", "open", "4"]


def test_text_blocks_skip_hidden_parts(value):
    html = (
        '<body><script>var t="</p>";</script><style>p{}</style><article><h1>T&amp;T</h1><p><b>one<br><p>two'
        "<!-- <p>no</p> --><ul><li>x</li></ul></article><p>outside</p></body>"
    )
    blocks = value(H.text_blocks(H.article_scope(H.visible("x"))), x=html)
    assert blocks == ["T&T", "one", "two", "x"]


def test_entities(values):
    texts = ["a &amp;lt; b", "&#8217;&#x2019;&#X41;", "&lt;p&gt; &quot;", "plain", "&#0;&#55296;&unknown;", None]
    assert values(X.unescape("x"), texts) == ["a &lt; b", "’’A", '<p> "', "plain", "&#0;&#55296;&unknown;", None]


DATES = {
    "2025-01-10T10:00:00Z": "2025-01-10T10:00:00+00:00",
    "2025-01-10T10:00:00.250+02:00": "2025-01-10T10:00:00.250000+02:00",
    "2025-01-10T10:00:00-0500": "2025-01-10T10:00:00-05:00",
    "2025-01-10T10:00:00": "2025-01-10T10:00:00",
    "2025-01-10 10:00": "2025-01-10T10:00:00",
    "2025-01-10": "2025-01-10T00:00:00",
    " Jan 5, 2025 ": "2025-01-05T00:00:00",
    "September 15, 2024": "2024-09-15T00:00:00",
    "5 March 2024": "2024-03-05T00:00:00",
    "Tue, 05 Mar 2024 08:30:00 GMT": "2024-03-05T08:30:00+00:00",
    "Tue, 05 Mar 2024 08:30:00 +0200": "2024-03-05T08:30:00+02:00",
    "soon": None,
    "2025-13-45": None,
    "": None,
    None: None,
}


def test_dates(values):
    d = D.parse_date("x")
    assert values(D.iso_text(f"{d}.local", f"{d}.zone"), DATES) == list(DATES.values())


def test_body_dates(values):
    texts = {
        "By Jo on March 15, 2024 in news": "2024-03-15",
        "It was 2024-12-28 then": "2024-12-28",
        "Published Sep 3, 2023": "2023-09-03",
        "Published yesterday": "2025-12-28",
        "Posted June 13, 2025. The treaty of 2019-05-01": "2025-06-13",
        "Founded on March 2, 1998. Updated on: Friday, May 3, 2024": "2024-05-03",
        "On 2019-05-01 it began, on May 2, 2020 it ended": "2019-05-01",
        "posted at 2021-02-03 and published yesterday": "2021-02-03",
        "published today!": "2025-12-29",
        "Marching 15, 2024": None,
        "nothing": None,
    }
    found = f"date_format({D.body_date('x', PG.timestamp_literal(AS_OF))}, 'yyyy-MM-dd')"
    assert values(found, texts) == list(texts.values())


def test_durations(values):
    cases = {"PT1H2M3S": 3723, "PT5M": 300, "PT1H5S": 3605, "PT": 0, "P1DT1H": None, "": None}
    assert values(D.iso_duration_seconds("x"), cases) == list(cases.values())


def test_date_chain(items):
    ld = '<script type="application/ld+json">{}</script>'
    got = items(
        ("https://e.com/0", '<title>t</title><meta property="article:published_time" content="2025-01-01">' + ld.format('{"datePublished":"2025-02-02"}')),
        ("https://e.com/1", "<title>t</title>" + ld.format("not json") + ld.format('[{"x":1},{"dateCreated":"2025-03-03"}]')),
        ("https://e.com/2", '<title>t</title><meta name="date" content="2025-04-04">'),
        ("https://e.com/3", '<title>t</title><meta name="DC.date" content="2025-05-05">'),
        ("https://e.com/4", '<title>t</title><time>x</time><time datetime="2025-06-06">y</time>'),
        ("https://e.com/5", '<title>t</title><meta property="article:published_time" content="soon"><time datetime="2025-06-06">y</time>'),
        ("https://e.com/6", "<title>t</title><article><p>Published yesterday</p></article>"),
        ("https://e.com/7", "<article><p>Published yesterday</p></article>"),
        ("https://e.com/8", "<title>t</title><!-- " + ld.format('{"datePublished":"2025-02-02"}') + " -->"),
    )
    assert [r.date_iso[:10] for r in got] == [
        "2025-01-01", "2025-03-03", "2025-04-04", "2025-05-05", "2025-06-06",
        "2025-12-29", "2025-12-28", "2025-12-29", "2025-12-29",
    ]


def test_author_and_language(items):
    got = items(
        ("https://e.com/0", '<html lang="en"><meta name="author" content="By Jo Doe">'),
        ("https://e.com/1", '<html><meta property="og:locale" content="de_DE"><meta property="article:author" content="X">'),
        ("https://e.com/2", "<html>"),
    )
    assert [[a.name for a in r.authors] for r in got] == [["Jo Doe"], ["X"], []]
    assert [r.language for r in got] == ["en", "de_DE", None]


def test_video(items):
    html = (
        '<title>My clip - YouTube</title><meta itemprop="duration" content="PT1H1S">'
        '<link itemprop="name" content="Chan"><meta name="description" content="D">'
    )
    plain, pictured = items(
        ("https://youtu.be/a-_1", html),
        ("https://www.youtube.com/watch?v=zz", '<meta property="og:image" content="https://i/p.jpg"><meta property="og:title" content="OG - YouTube">'),
    )
    assert (plain.title, plain.summary, plain.authors[0].name, plain.tags) == ("My clip", "D", "Chan", ["video", "youtube"])
    assert plain.attachments[0].url == "https://img.youtube.com/vi/a-_1/maxresdefault.jpg"
    assert plain.attachments[0].duration_in_seconds == 3601 and plain.date_iso is None
    assert pictured.title == "OG - YouTube" and pictured.attachments[0].url == "https://i/p.jpg"


def test_media(items):
    got = items(
        ("https://example.com/podcast-ep1.mp3", ""),
        ("https://example.com/a+b%20c.AVI", ""),
        ("https://example.com/dir/?x=.pdf", ""),
        content_type="CASE page_id WHEN 0 THEN 'Audio/MPEG; charset=x' WHEN 1 THEN 'video/x-msvideo' END",
        content_length="CAST(1024 AS BIGINT)",
    )
    assert [r.title for r in got] == ["podcast-ep1.mp3", "a+b c.AVI", None]
    assert [r.attachments[0].mime_type for r in got] == ["audio/mpeg", "video/x-msvideo", "application/pdf"]
    assert [r.tags for r in got] == [["audio"], ["video"], ["pdf"]]
    assert got[0].attachments[0].size_in_bytes == 1024


def test_single_kind_jobs_agree_with_the_one_pass_job(spark):
    from feedlake.plans import fixtures as FX

    pages = PG.with_page_ids(FX.pages_x(spark, "/root/testdata/sf0.001"))
    keep = ["page_id", "id", "url", "title", "summary", "content_html", "date_iso", "authors", "language", "tags", "attachments"]
    parts = (
        PG.article_items(pages, AS_OF, ["page_id"]).select(keep)
        .unionByName(PG.video_items(pages, ["page_id"]).select(keep))
        .unionByName(PG.media_items(pages, ["page_id"]).select(keep))
    )
    whole = PG.page_items(pages, AS_OF, ["page_id"]).select(keep)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))


def test_fetch_takes_one_good_page_per_id(spark):
    pages = page_corpus(
        spark.createDataFrame(
            [
                (1, "https://e.com/a", 404),
                (2, "https://e.com/a?utm_source=x", 200),
                (3, "https://e.com/a", 200),
                (4, "https://e.com/b", 500),
            ],
            "page_id int, url string, status int",
        ).selectExpr("*", "'<p>' AS html")
    )
    links = spark.createDataFrame([("f", "https://e.com/a/"), ("g", "https://e.com/a"), ("f", "https://e.com/b")], "feed string, url string")
    links = links.selectExpr("*", f"{PG.page_id_of('url')} AS id")
    assert sorted((r.feed, r.page_id) for r in PG.match_pages(links, pages).collect()) == [("f", 2), ("g", 2)]
    assert [(r.feed, r.url) for r in PG.unanswered(links, pages).collect()] == [("f", "https://e.com/b")]
    assert PG.wanted_pages(PG.match_pages(links, pages), pages).count() == 1


@pytest.mark.parametrize(
    ("raw", "local", "zone"),
    [
        ("January 15, 2025 10:30 AM", "2025-01-15 10:30:00", None),
        ("2025/01/15", "2025-01-15 00:00:00", None),
        ("01/15/2025", "2025-01-15 00:00:00", None),
        ("Wed Jan 15 10:00:00 2025", "2025-01-15 10:00:00", None),
        ("20250115", "2025-01-15 00:00:00", None),
        ("20250115T100000Z", "2025-01-15 10:00:00", "+00:00"),
        ("20250115T1000+0200", "2025-01-15 10:00:00", "+02:00"),
        ("10:00 15 Jan 2025", "2025-01-15 10:00:00", None),
        ("15/01/25", "2025-01-15 00:00:00", None),
        ("01/15/25 9:30 PM", "2025-01-15 21:30:00", None),
        ("2025-01-15 10:00:00 UTC", "2025-01-15 10:00:00", "+00:00"),
        ("2025-01-15T10:00:00+01", "2025-01-15 10:00:00", "+01:00"),
        ("15 Jan 2025 10:00 EST", "2025-01-15 10:00:00", None),
        ("2025-1-5", "2025-01-05 00:00:00", None),
        ("Jan 15 2025 10:00:00 GMT", "2025-01-15 10:00:00", "+00:00"),
        ("1st March 2024, 12:05 a.m.", "2024-03-01 00:05:00", None),
        ("2025-13-45", None, None),
    ],
)
def test_date_shapes(value, raw, local, zone):
    from feedlake.functions.dates import parse_date

    found = value(parse_date("x"), x=raw)
    assert (found.local and str(found.local), found.zone) == (local, zone)


def test_entities_of_any_name_and_length(value):
    from feedlake.functions.text import unescape

    raw = "Caf&eacute; &ntilde; &#00000039; &#x000027; &frac12; &amp;eacute; &nope; &#0; &#99999999; &#xD800;"
    assert value(unescape("x"), x=raw) == "Café ñ ' ' ½ &eacute; &nope; &#0; &#99999999; &#xD800;"


def test_nested_scopes_are_balanced(value):
    from feedlake.functions.html import article_scope

    assert value(article_scope("x"), x="<body>A<article>A <article>comment</article> REST</article>B</body>") == "A <article>comment</article> REST"
    assert value(article_scope("x"), x="<main>a<main>b</main>c") == "a<main>b</main>c"


def test_void_elements_open_no_scope(value):
    from feedlake.functions.html import anchors

    links = value(anchors("x"), x='<img class="post"><a href="/about">a</a><div class="post"><a href="/x">b</a></div>')
    assert [tuple(a) for a in links] == [("/about", False), ("/x", True)]


SCOPES = {
    "<main-nav><p>menu</p></main-nav><main>real</main>": "real",
    "<article-list><p>x</p></article-list><article id=1>a<article>b</article >c</article\n>d": "a<article>b</article>c",
    "<body><article>open <p>text</body></html>": "open <p>text",
    "<body><main-nav>menu</main-nav><p>text</p></body> tail": "<main-nav>menu</main-nav><p>text</p>",
    "<ARTICLE\nclass='x'>A</ARTICLE>B": "A",
    "<article/><p>x</p>": "<p>x</p>",
    "<p>no scope</p>": "<p>no scope</p>",
    "<main>one<main-part>two</main-part></main>three": "one<main-part>two</main-part>",
}


def test_scopes_are_of_exactly_their_name(values):
    assert dict(zip(SCOPES, values(H.article_scope("x"), list(SCOPES)), strict=True)) == SCOPES


def test_names_that_only_begin_alike(values):
    doc = "<title-bar>no</title-bar><title>T</title><h1-x>no</h1-x><h1>H</h1><time-ago datetime='2020-01-01'></time-ago><time datetime='2021-01-01'>x</time><script-x>kept</script-x>"
    got = [values(e, [doc])[0] for e in (H.title_tag("x"), H.first_heading("x"), H.time_tag("x"), H.visible("x"))]
    assert got == ["T", "H", "2021-01-01", doc]
