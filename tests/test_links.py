from html.parser import HTMLParser

from feedlake.functions import html as H
from feedlake.functions import links as L
from feedlake.operators import links as LNK

NOTE = (
    "see [one](https://a.com/x) and ![img](https://img.com/i.png)\n"
    "bare https://b.com/y. end https://c.com/1, and https://tail.com/9z)\n"
    '(https://skip.com/1) [t](https://t.com "title") [bad](ftp://x.com) [again](https://a.com/x)'
)


def test_markdown_links(value):
    assert value(L.markdown_links("x"), x=NOTE) == [
        "https://a.com/x",
        'https://t.com "title"',
        "https://b.com/y",
        "https://c.com/1",
        "https://tail.com/9",
    ]


def test_text_links(values):
    texts = [
        "new at https://news.test/2024/tides today",
        "both https://a.test and https://b.test/q hold",
        "from https://trello.com/c/Zk9 over https://c.test/",
        "once https://d.test/e. twice https://d.test/e|",
        "",
        None,
        "x https://Trello.com/a https://my.trello.com/b] c",
    ]
    assert values(L.text_links("x"), texts) == [
        ["https://news.test/2024/tides"],
        ["https://a.test", "https://b.test/q"],
        ["https://c.test/"],
        ["https://d.test/e"],
        [],
        [],
        ["https://my.trello.com/b"],
    ]


CARDS = [
    ("b", 0, "L1", None, "Link: https://e.com/a", "Also https://e.com/b"),
    ("b", 1, "L1", True, "closed https://e.com/c", None),
    ("b", 2, None, False, "https://e.com/d https://e.com/a", None),
    ("b", 3, "L2", False, None, None),
    ("z", 0, "L9", False, "https://e.com/a", None),
]
CARD_SCHEMA = "board string, card int, idlist string, closed boolean, name string, descr string"


def test_board_links(spark):
    cards = spark.createDataFrame(CARDS, CARD_SCHEMA)
    got = sorted((r.board, r.card, r.pos, r.url[-1]) for r in LNK.board_links(LNK.open_cards(cards)).collect())
    assert got == [("b", 0, 0, "a"), ("b", 0, 1, "b"), ("b", 2, 0, "d"), ("z", 0, 0, "a")]


def test_board_list_filter(spark):
    cards = spark.createDataFrame(CARDS, CARD_SCHEMA)
    lists = spark.createDataFrame([("b", "L1")], "board string, idlist string")
    kept = sorted((r.board, r.card) for r in LNK.open_cards(cards, lists).collect())
    assert kept == [("b", 0), ("z", 0)]


def test_sitemap(spark, value):
    xml = (
        "<urlset><url><loc> https://e.com/a </loc></url><url><loc></loc></url>"
        "<sitemap><loc>https://e.com/other.xml</loc></sitemap><url><loc>https://e.com/b?x=1&amp;y=2</loc></url></urlset>"
    )
    assert value(L.sitemap_locations("x"), x=xml) == ["https://e.com/a", "https://e.com/b?x=1&y=2"]
    maps = spark.createDataFrame(
        [("s", 3, xml), ("s", 1, "<urlset/>"), ("s", 2, xml.replace("/a", "/c"))],
        "site string, candidate int, xml string",
    )
    first = LNK.first_sitemap(maps).first()
    assert (first.candidate, first.urls[0]) == (2, "https://e.com/c")


PAGE = """<html><body><nav><a href="/nav1">1</a><a class="post" href="/nav2">2</a></nav>
<div class="big post"><p>unclosed<div><a href='/in1'>x</a></div><a href=/in2>y</a></div>
<a href="/out1">o</a><section CLASS="content"><a href="/in3?a=1&amp;b=2">z</a></section>
<a href="/x/blog/1">b</a><a name="n">no</a><a href="">empty</a><div class="postage"><a href="/out2">p</a></div>
<article><a href="mailto:x@y">m</a><a href="https://sub.h.com/s">s</a><a href="https://else.com/e">e</a></article></body></html>"""


class _Scopes(HTMLParser):
    """Independent check: a stack of open elements, as a browser keeps it."""

    def __init__(self):
        super().__init__()
        self.stack, self.links = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "a" and attrs.get("href"):
            hit = any(s for _, s in self.stack)
            self.links.append((attrs["href"], hit or any(p in attrs["href"] for p in ("/post/", "/article/", "/blog/", "/news/"))))
        classes = set((attrs.get("class") or "").split())
        scope = tag in ("article", "main") or bool(classes & {"post", "entry", "article", "content"})
        if tag not in ("br", "img", "meta", "link"):
            self.stack.append((tag, scope))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return


def test_anchor_scopes_match_an_element_stack(value):
    reader = _Scopes()
    reader.feed(PAGE)
    got = [(a.href, a.scoped) for a in value(H.anchors("x"), x=PAGE)]
    assert got == reader.links
    assert [h for h, scoped in got if scoped][:3] == ["/in1", "/in2", "/in3?a=1&b=2"]


def _links(spark, url, html):
    pages = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    return [r.url for r in sorted(LNK.outlinks(pages, ["page_id"]).collect(), key=lambda r: r.pos)]


def test_outlinks(spark):
    assert _links(spark, "https://h.com/", PAGE) == [
        "https://h.com/in1",
        "https://h.com/in2",
        "https://h.com/in3?a=1&b=2",
        "https://h.com/x/blog/1",
        "https://sub.h.com/s",
    ]


def test_outlinks_fall_back_to_all_links(spark):
    html = '<article><a href="https://else.com/">e</a></article><a href="/a">a</a><a href="/tag/x/">t</a><a href="/i.png">i</a><a href="/i.png?v=1">j</a><a href="/">home</a><a href="/login/x">l</a>'
    assert _links(spark, "https://h.com", html) == ["https://h.com/a", "https://h.com/i.png?v=1"]


def test_links_in_comments_and_scripts_are_ignored(spark):
    html = '<main><!-- <a href="/c">c</a> --><script>"<a href=\'/s\'>"</script><a href="/ok">k</a></main>'
    assert _links(spark, "https://h.com/", html) == ["https://h.com/ok"]


def test_site_links_top_up(spark):
    site = "https://h.com/"
    page = '<main><a href="/p1">1</a><a href="/s2">2</a></main>'
    sites = spark.createDataFrame([(1, site, page)], "page_id int, url string, html string")

    def run(n, limit):
        xml = "".join(f"<url><loc>https://h.com/s{i}</loc></url>" for i in range(1, n + 1))
        maps = spark.createDataFrame([(site, 1, xml)], "site string, candidate int, xml string")
        found = LNK.site_links(sites, maps, ["page_id"], limit).collect()
        return [r.url[len(site):] for r in sorted(found, key=lambda r: r.pos)]

    assert run(2, 3) == ["s1", "s2", "p1"]
    assert run(5, 3) == ["s1", "s2", "s3"]
    assert run(0, 3) == ["p1", "s2"]


def test_large_pages_stay_linear(spark, value):
    """Tens of thousands of links and of stray brackets, no stack overflow, no quadratic scan."""
    body = "".join(f'<p>t &amp; u <a href="/x/{i}">l</a></p>' for i in range(20_000))
    assert len(_links(spark, "https://h.com/", f'<div class="post">{body}</div>')) == 20_000
    assert value(f"length({H.inner_text('x')})", x="a" + "< " * 200_000) == 400_000


def test_landed_sitemaps_belong_to_hosts(spark):
    def sitemap(*urls):
        return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"

    files = spark.createDataFrame(
        [
            ("file:/in/e.com/sitemap_index.xml", sitemap("https://e.com/blog/late")),
            ("file:/in/E.com/sitemap.xml", sitemap("https://e.com/blog/one", "https://e.com/blog/two")),
            ("file:/in/f.com:8080/sitemap-index.xml", sitemap("https://f.com:8080/blog/x")),
            ("file:/in/e.com/other.xml", sitemap("https://e.com/blog/no")),
        ],
        "path string, xml string",
    )
    sites = spark.createDataFrame([(1, "https://e.com/start/", "<p>"), (2, "http://e.com", "<p>"), (3, "https://f.com:8080/", "<p>")], "page_id int, url string, html string")
    got = LNK.site_links(sites, LNK.landed_candidates(files), ["page_id"], by_host=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.url)
    assert by == {1: ["https://e.com/blog/one", "https://e.com/blog/two"], 2: ["https://e.com/blog/one", "https://e.com/blog/two"], 3: ["https://f.com:8080/blog/x"]}
