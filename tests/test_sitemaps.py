"""Sitemap files by host: candidates, index files, and hosts with many pages."""

import pytest

from feedlake.operators import sitemaps as SM


def _urls(*urls):
    return "<urlset>" + "".join(f"<url><lastmod>1</lastmod><loc> {u} </loc></url>" for u in urls) + "</urlset>"


def _index(*parts):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{p}</loc></sitemap>" for p in parts) + "</sitemapindex>"


FILES = [
    ("/x/https/a.com/sitemap.xml", _urls()),
    ("/x/https/a.com/sitemap_index.xml", _index("https://a.com/m/2.xml", "https://a.com/gone.xml", "https://a.com/m/1.xml")),
    ("/x/https/a.com/m/1.xml", _urls("https://a.com/one", "https://a.com/two")),
    ("/x/https/a.com/m/2.xml", _urls(*[f"https://a.com/p{k}" for k in range(4)])),
    ("/x/https/a.com/sitemap-index.xml", _urls("https://a.com/late")),
    ("/x/http/a.com/Sitemap.XML", _urls("http://a.com/plain")),
    ("/x/https/b.com:8080/sitemap.xml", _urls("https://b.com:8080/b1")),
    ("/y/https/b.com:8080/sitemap.xml", _urls("https://b.com:8080/second-landing")),
    ("/x/https/c.com/sitemap.xml", "no xml at all <url>"),
    ("/x/https/c.com/sitemap_index.xml", None),
    ("/elsewhere/sitemap.xml", _urls("https://nobody.com/")),
    (None, _urls("https://nobody.com/")),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, xml string")


def test_first_candidate_with_links(files):
    got = {r.site: (r.candidate, r.urls) for r in SM.map_links(files, limit=5).collect()}
    assert got == {
        "https://a.com": (1, ["https://a.com/p0", "https://a.com/p1", "https://a.com/p2", "https://a.com/p3", "https://a.com/one"]),
        "http://a.com": (0, ["http://a.com/plain"]),
        "https://b.com:8080": (0, ["https://b.com:8080/b1"]),
    }


def test_index_not_followed(files):
    got = {r.site: r.urls for r in SM.map_links(files, follow=False).collect()}
    assert got["https://a.com"] == ["https://a.com/late"]


@pytest.mark.parametrize("rows", [100_000, 3])
def test_hosts_are_split_without_change(spark, files, rows):
    """A host with more pages than a task should hold is dealt out; the links stay the same."""
    pages = [(k, f"https://a.com/start/{k}", f"<article><a href='/own{k}'>x</a></article>") for k in range(20)]
    pages += [(100, "HTTPS://B.com:8080/x", "<p>"), (101, "https://unknown.com", "<a href='/y'>y</a>"), (102, None, None), (3, "https://a.com/start/3", "<p>again</p>")]
    sites = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {}
    for r in SM.host_links(sites, files, ["page_id"], limit=8, host_rows=rows).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.url)
    maps = [*[f"https://a.com/p{k}" for k in range(4)], "https://a.com/one", "https://a.com/two"]
    assert got[5] == [*maps, "https://a.com/own5"]
    assert sorted(got[3]) == sorted([*maps, *maps, "https://a.com/own3"])
    assert got[100] == ["https://b.com:8080/b1"] and got[101] == ["https://unknown.com/y"] and 102 not in got


def test_limit_is_of_the_whole_list(spark, files):
    sites = spark.createDataFrame([(1, "https://a.com/", "<a href='/own'>x</a>")], "page_id int, url string, html string")
    assert [r.url for r in SM.host_links(sites, files, ["page_id"], limit=2).orderBy("pos").collect()] == ["https://a.com/p0", "https://a.com/p1"]
    assert SM.host_links(sites, files.limit(0), ["page_id"]).count() == 1
    assert SM.host_links(sites.limit(0), files, ["page_id"]).count() == 0
