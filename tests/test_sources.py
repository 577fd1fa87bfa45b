import json

from feedlake.operators import links as LNK
from feedlake.sources import config as C
from feedlake.sources import landed as S

CONFIGS = [
    {"name": "a", "feed": {"title": "A", "language": "en"}, "sources": ["https://e.com/2", "https://e.com/1"], "whitelist": ["*.e.com"], "blacklist": ["x.e.com"]},
    {"feed": {}, "output_dir": "out"},
]


def test_configuration_tables(spark):
    feeds = {r.feed: (r.title, r.language, r.output_dir) for r in C.feed_table(spark, CONFIGS).collect()}
    assert feeds == {"a": ("A", "en", None), "unnamed": ("Untitled Feed", None, "out")}
    patterns = {tuple(r) for r in C.pattern_table(spark, CONFIGS, global_block=["*.bad.com"]).collect()}
    assert patterns == {(None, "block", "*.bad.com"), ("a", "allow", "*.e.com"), ("a", "block", "x.e.com")}
    sources = [(r.feed, r.source_rank, r.pos, r.url) for r in C.static_sources(spark, CONFIGS).orderBy("pos").collect()]
    assert sources == [("a", 1, 0, "https://e.com/2"), ("a", 1, 1, "https://e.com/1")]
    assert C.pattern_table(spark, []).count() == 0


def test_configuration_folder_names_feeds_by_file():
    named = C.named_configs({"/c/b.yaml": {"sources": ["u"], "markdown_dir": "m"}, "/c/a.yaml": {}})
    assert [(c["name"], c.get("markdown_dir")) for c in named] == [("a", None), ("b", "m")]


def test_link_list_keeps_file_order(spark, tmp_path):
    (tmp_path / "links.txt").write_text("https://e.com/b\n\n https://e.com/a \n")
    rows = C.link_list(spark, str(tmp_path / "links.txt"), "f").orderBy("pos").collect()
    assert [r.url for r in rows] == ["https://e.com/b", "https://e.com/a"]


def test_notes_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("[x](https://e.com/a)\nsecond https://e.com/b.")
    (tmp_path / "sub" / "b.md").write_text("https://e.com/c")
    (tmp_path / "c.txt").write_text("https://e.com/no")
    found = LNK.note_links(S.read_notes(spark, str(tmp_path)), ["path"])
    assert sorted(r.url for r in found.collect()) == [f"https://e.com/{x}" for x in "abc"]


def test_board_files(spark, tmp_path):
    board = {
        "lists": [{"id": "L1", "name": "Read"}, {"id": "L2"}, {"name": "x"}],
        "cards": [
            {"id": "1", "name": "https://e.com/a", "desc": "again https://e.com/a", "idList": "L1"},
            {"name": "https://e.com/b", "closed": True, "idList": "L1"},
            {"idList": "L2"},
        ],
    }
    (tmp_path / "one.json").write_text(json.dumps(board, indent=1))
    (tmp_path / "broken.json").write_text("{")
    boards = S.read_boards(spark, str(tmp_path))
    cards, lists = S.board_cards(boards), S.board_lists(boards)
    assert [r.url for r in LNK.board_links(LNK.open_cards(cards)).collect()] == ["https://e.com/a"]
    assert [(r.idlist, r.list_name) for r in lists.collect()] == [("L1", "Read")]
    counts = LNK.board_list_counts(cards, lists).collect()
    assert [(r.list_name, r.cards, r.links) for r in counts] == [("Read", 2, 3)]


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        "<urlset><url><loc> https://e.com/a </loc><lastmod>2025</lastmod></url><sitemap><loc>https://e.com/x.xml</loc></sitemap><url><loc>https://e.com/b</loc></url></urlset>"
    )
    assert sorted(r.url for r in S.read_sitemaps(spark, str(tmp_path / "s.xml")).collect()) == ["https://e.com/a", "https://e.com/b"]


def test_page_corpus_defaults(spark):
    pages = spark.createDataFrame([(1, "https://e.com", "é")], "page_id int, url string, html string")
    row = S.page_corpus(pages).first()
    assert (row.final_url, row.content_length, row.status, row.good) == ("https://e.com", 2, 200, True)
