import pytest

from feedlake.functions import url as U
from feedlake.operators import frontier as FR
from feedlake.operators import patterns as PT

CANONICAL = {
    "https://example.com/page?utm_source=twitter&id=123": "https://example.com/page?id=123",
    "https://EXAMPLE.COM/Page": "https://example.com/Page",
    "https://example.com/page/": "https://example.com/page",
    "https://example.com/": "https://example.com/",
    "https://example.com": "https://example.com",
    "https://example.com//": "https://example.com",
    "https://example.com/page#section": "https://example.com/page",
    "HTTP://Ex.com:80/A/b/?b=1&a=2&b=3#x": "http://ex.com/A/b?b=1&b=3&a=2",
    "https://e.com:443/x;p=1;q?z=": "https://e.com/x?z=",
    "https://e.com:80/x": "https://e.com:80/x",
    "https://e.com/;p/q;r/s": "https://e.com/;p/q;r/s",
    "https://e.com/a b|c?x=%zz&y=a+b&~=*": "https://e.com/a b|c?x=%25zz&y=a+b&~=%2A",
    "https://e.com?x": "https://e.com?x=",
    "https://e.com/?q=%C3%A9&q=2&REF=3": "https://e.com/?q=%C3%A9&q=2",
    "https://e.com/x?a&&b=c=d": "https://e.com/x?a=&b=c%3Dd",
    "https://[::1]:443/": "https://[::1]/",
    "https://[::1/x": "https://[::1/x",
    "  https://e.com/\tx": "https://e.com/x",
    "http:///path": "http:///path",
    "not a url": "not a url",
}


def test_canonical_url(values):
    assert values(U.canonical_url("x"), CANONICAL) == list(CANONICAL.values())


def test_canonical_url_is_stable(values):
    once = list(CANONICAL.values())
    again = values(U.canonical_url("x"), once)
    assert [b for a, b in zip(once, again) if "%zz" not in a] == once


def test_id_is_hash_of_canonical_form(values):
    a, b, c = values(
        U.page_id_of("x"),
        ["https://example.com/page", "https://example.com/page?utm_source=x", "https://example.com/b"],
    )
    assert a == b != c
    assert len(a) == 16 and set(a) <= set("0123456789abcdef")


def test_valid_url(values):
    cases = {
        "https://example.com": True,
        "HTTP://example.com": True,
        "ftp://example.com": False,
        "./page.html": False,
        "file:///home/user/file.txt": False,
        "https://": False,
        "https://[::1/x": False,
        None: False,
        "https://ex.com/a b|c": True,
    }
    assert values(U.is_valid_url("x"), cases) == list(cases.values())


def test_domain(values):
    urls = ["https://Example.com:8080/page", "https://www.example.com", "nothing"]
    assert values(U.domain("x"), urls) == ["example.com:8080", "www.example.com", ""]
    assert values(U.pattern_host("x"), ["http://localhost:8000/p", "https://user:pw@h.com/"]) == [
        "localhost",
        "user",
    ]


RESOLVED = [
    ("https://h.com/a/b/c?q=1#f", "/x", "https://h.com/x"),
    ("https://h.com/a/b/c?q=1#f", "x", "https://h.com/a/b/x"),
    ("https://h.com/a/b/c?q=1#f", "../x", "https://h.com/a/x"),
    ("https://h.com/a/b/c?q=1#f", "../../../x", "https://h.com/x"),
    ("https://h.com/a/b/c?q=1#f", "./", "https://h.com/a/b/"),
    ("https://h.com/a/b/c?q=1#f", "..", "https://h.com/a/"),
    ("https://h.com/a/b/c?q=1#f", "?z=1", "https://h.com/a/b/c?z=1"),
    ("https://h.com/a/b/c?q=1#f", "#top", "https://h.com/a/b/c?q=1#top"),
    ("https://h.com/a/b/c?q=1#f", "//o.com/y", "https://o.com/y"),
    ("https://h.com/a/b/c?q=1#f", "https://o.com/p?x#y", "https://o.com/p?x#y"),
    ("https://h.com/a/b/c?q=1#f", "javascript:x", "javascript:x"),
    ("https://h.com/a/b/c?q=1#f", "", "https://h.com/a/b/c?q=1#f"),
    ("https://h.com", "x", "https://h.com/x"),
    ("https://h.com/a/", "/a//b/../c/", "https://h.com/a//c/"),
    ("https://h.com/a/", "x/./y", "https://h.com/a/x/y"),
]


def test_resolve_url(spark):
    df = spark.createDataFrame(RESOLVED, "b string, h string, want string")
    rows = df.selectExpr("*", f"{U.resolve_url('b', 'h')} AS got").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


# --- patterns ------------------------------------------------------------------------

ALLOW_CASES = [
    ([], "https://whatever.test/", True),
    (["news.test"], "https://news.test/today", True),
    (["news.test"], "https://olds.test", False),
    (["*.news.test"], "https://a.b.news.test", True),
    (["*.news.test"], "https://news.test", True),
    (["*.news.test"], "https://badnews.test", False),
    (["one.test", "*.two.test", "three.test"], "https://team.two.test", True),
    (["one.test", "*.two.test", "three.test"], "https://four.test", False),
    (["  News.TEST "], "https://NEWS.test", True),
    (["inner"], "http://inner:9090/x", True),
    (["https://news.test/v1/*"], "https://news.test/v1/list", True),
    (["https://news.test/v1/*"], "https://news.test/v2", False),
    (["news.test"], "no address", False),
    (["news.test"], "", False),
    (["blog.*"], "https://blog.x.org/", True),
    (["n?ws.test"], "https://news.test/", True),
    (["[m-o]ews.test"], "https://news.test/", True),
    (["[!m-o]ews.test"], "https://news.test/", False),
    (["news.[test"], "https://news.test/", False),
    ([".news.test/x"], "https://news.test/x", False),
    (["*x[a[b]y"], "https://h.test/x[y", True),
    (["*x[a[b]y"], "https://h.test/xcy", False),
    (["*x[z-a]y"], "https://h.test/xmy", False),
    (["*x[!z-a]y"], "https://h.test/xmy", True),
    (["*x[]a]y"], "https://h.test/x]y", True),
    (["*x[!]a]y"], "https://h.test/x]y", False),
    (["*x[a-]y"], "https://h.test/x-y", True),
    (["*x[a-c-e]y"], "https://h.test/x-y", True),
    (["*x[a-c-e]y"], "https://h.test/xdy", False),
    (["*x[a&&b]y"], "https://h.test/x&y", True),
    (["*x[^a]y"], "https://h.test/x^y", True),
    (["*x[\\d]y"], "https://h.test/xdy", True),
    (["*x{1}(y)|z+$"], "https://h.test/x{1}(y)|z+$", True),
    (["*"], "https://h.test/any", True),
    (["??"], "https://ab/any", True),
    (["[a-b][b-c]"], "https://ab/any", True),
    (["*é*"], "https://h.test/caf\u00e9", True),
]


def _flags(spark, kind):
    feeds = [(f"f{i}",) for i in range(len(ALLOW_CASES))]
    frontier = [(f"f{i}", i, url) for i, (_, url, _) in enumerate(ALLOW_CASES)]
    patterns = [(f"f{i}", kind, p) for i, (ps, _, _) in enumerate(ALLOW_CASES) for p in ps]
    flagged = FR.flag_patterns(
        spark.createDataFrame(frontier, "feed string, ord int, url string"),
        spark.createDataFrame(feeds, "feed string"),
        spark.createDataFrame(patterns, "feed string, kind string, pattern string"),
    )
    return {r.ord: r for r in flagged.collect()}


@pytest.mark.parametrize("inline", [256, 0])
@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("literal", [2000, 0])
def test_pattern_ways_agree(spark, monkeypatch, inline, broadcast, literal):
    monkeypatch.setattr(PT, "INLINE_PATTERNS", inline)
    monkeypatch.setattr(PT, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(PT, "LITERAL_GLOBS", literal)
    allowed, blocked = _flags(spark, "allow"), _flags(spark, "block")
    for i, (patterns, url, want) in enumerate(ALLOW_CASES):
        assert allowed[i].allowed is want, (patterns, url)
        assert blocked[i].blocked is (want and bool(patterns)), (patterns, url)


def test_global_patterns_reach_every_feed(spark):
    feeds = spark.createDataFrame([("a",), ("b",)], "feed string")
    patterns = spark.createDataFrame(
        [(None, "block", "*.bad.com"), ("a", "block", "odd.com")],
        "feed string, kind string, pattern string",
    )
    got = {tuple(r) for r in FR.effective_patterns(feeds, patterns).collect()}
    assert got == {
        ("a", "block", "*.bad.com"),
        ("b", "block", "*.bad.com"),
        ("a", "block", "odd.com"),
    }


def test_first_seen_and_stored(spark):
    frontier = spark.createDataFrame(
        [
            ("f", 3, "https://e.com/a?utm_source=x"),
            ("f", 1, "https://e.com/a"),
            ("f", 2, "https://e.com/b"),
            ("g", 5, "https://e.com/a/"),
        ],
        "feed string, ord int, url string",
    )
    ids = FR.with_ids(frontier)
    first = {(r.feed, r.ord) for r in FR.first_seen(ids).collect()}
    assert first == {("f", 1), ("f", 2), ("g", 5)}
    stored = ids.filter("feed = 'f' AND ord = 2").select("feed", "id")
    left = {(r.feed, r.ord) for r in FR.not_stored(FR.first_seen(ids), stored).collect()}
    assert left == {("f", 1), ("g", 5)}


def test_first_seen_does_not_depend_on_partitions(spark):
    rows = [("f" if i % 3 else "g", i, f"https://e.com/{i % 7}") for i in range(200)]
    df = FR.with_ids(spark.createDataFrame(rows, "feed string, ord int, url string"))
    one = sorted(tuple(r) for r in FR.first_seen(df.coalesce(1)).collect())
    many = sorted(tuple(r) for r in FR.first_seen(df.repartition(8)).collect())
    assert one == many and len(one) == 14


def test_literal_and_column_globs_agree(spark, monkeypatch):
    urls = ["https://a.com/x", "https://b.org:8080/y", "https://c.net/blog/1", "https://c.net/other", "http://d.io/q?z=[1]", "https://sub.a.com/"]
    rows = [(f, i, u) for f in ("f", "g", "unlisted") for i, u in enumerate(urls)]
    frontier = spark.createDataFrame(rows, "feed string, ord int, url string")
    feeds = spark.createDataFrame([("f",), ("g",)], "feed string")
    patterns = spark.createDataFrame(
        [(None, "block", "*/other"), ("f", "allow", "https://[!a].*"), ("f", "allow", "?.com"), ("g", "block", "*.a.com"), ("g", "block", "*q?z=*"), ("g", "allow", "https://b.org:8080/*")],
        "feed string, kind string, pattern string",
    )

    def flags():
        return sorted(map(tuple, FR.flag_patterns(frontier, feeds, patterns).collect()))

    literal = flags()
    monkeypatch.setattr(PT, "LITERAL_GLOBS", 1)
    assert flags() == literal
    blocked = {(r[0], r[2]) for r in literal if r[4]}
    assert ("unlisted", "https://c.net/other") in blocked and ("g", "https://sub.a.com/") in blocked
    assert {r[2] for r in literal if r[0] == "g" and r[3]} == {"https://b.org:8080/y"}


def test_links_of_no_feed_have_the_global_patterns(spark, monkeypatch):
    frontier = spark.createDataFrame([(None, 1, "https://bad.test/x"), (None, 2, "https://good.test/x"), ("f", 1, "https://bad.test/x")], "feed string, ord int, url string")
    feeds = spark.createDataFrame([("f",)], "feed string")
    patterns = spark.createDataFrame([(None, "block", "bad.test"), (None, "block", "*/gone*"), ("f", "allow", "*b*d*")], "feed string, kind string, pattern string")
    for inline, literal in ((256, 2000), (0, 0)):
        monkeypatch.setattr(PT, "INLINE_PATTERNS", inline)
        monkeypatch.setattr(PT, "LITERAL_GLOBS", literal)
        got = {(r.feed, r.ord): (r.allowed, r.blocked) for r in FR.flag_patterns(frontier, feeds, patterns).collect()}
        assert got == {(None, 1): (True, True), (None, 2): (True, False), ("f", 1): (True, True)}


def test_many_globs_through_the_index(spark, monkeypatch):
    """Thousands of globs, one compiled pattern for each link that shares a rare piece with it; as the literal way says."""
    patterns = spark.range(3000).selectExpr(
        "if(id % 3 = 0, NULL, concat('f', id % 5)) AS feed", "if(id % 2 = 0, 'allow', 'block') AS kind",
        "CASE id % 4 WHEN 0 THEN concat('*/topic-', id, '/*') WHEN 1 THEN concat('https://h', id, '.test/?[0-9]*') WHEN 2 THEN concat('h', id % 97, '?test') ELSE concat('*', id, 'z') END AS pattern",
    )
    frontier = spark.range(4000).selectExpr(
        "if(id % 11 = 0, NULL, concat('f', id % 6)) AS feed", "id AS ord",
        "CASE id % 4 WHEN 0 THEN concat('https://x.test/topic-', id, '/a') WHEN 1 THEN concat('https://h', id, '.test/a', id) WHEN 2 THEN concat('https://h', id % 211, '.test') ELSE concat('https://y.test/', id, 'z') END AS url",
    )
    feeds = spark.range(5).selectExpr("concat('f', id) AS feed")
    monkeypatch.setattr(PT, "LITERAL_GLOBS", 5000)
    literal = sorted(map(tuple, FR.flag_patterns(frontier, feeds, patterns).collect()), key=str)
    monkeypatch.setattr(PT, "LITERAL_GLOBS", 10)
    for broadcast in (100_000, 10):
        monkeypatch.setattr(PT, "BROADCAST_ROWS", broadcast)
        assert sorted(map(tuple, FR.flag_patterns(frontier, feeds, patterns).collect()), key=str) == literal
    assert 100 < sum(r[4] for r in literal) < 2000 and any(r[3] for r in literal if r[0] is None)
