"""Pages, chats, quality, neighbours, resharding and the pipeline."""

import html
import itertools
import os
import re
import tempfile
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from feedlake.llm import chat, html_blocks, html_text, neighbours, packing, quality, reshard
from feedlake.llm.queries import QUERIES, TOKENIZER
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pages(spark):
    def article(page):
        begin = page.index("<article>")
        end = page.find("</article>", begin)
        body = page[begin : end if end > 0 else len(page)].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        return "\n\n".join(p for p in parts if p)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for row in QUERIES["op4_html"](spark, SF).collect():
        page = pages.pop(row["page_id"])
        assert row["text"] == article(page["html"]) and row["n_chars"] == len(row["text"]) and row["url"] == page["url"]
    assert not pages


def test_blocks():
    def texts(page):
        return [b.text for b in html_blocks.blocks(page)]

    assert texts(None) == texts("") == []
    assert texts("<p>a&amp;b &nbsp; c<br>d<p>e <b>f</b>g") == ["a&b c d", "e fg"]
    assert texts("<div>x<!-- <p>no</p> --><script>if (a<b) '</p>'</script>y</div>") == ["xy"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul><table><tr><td>5<td>6<tr><td>7</table>") == ["1", "2", "3", "4", "5", "6", "7"]
    assert texts("<p>a < b <a href='x>y'>l</a> <unfinished") == ["a < b l"]
    assert texts("<p>k</p></div></p><form><select><option>no</select><textarea>no</textarea>yes") == ["k", "yes"]
    assert texts("<p>" + "<b>" * 3000 + "deep") == ["deep"]


def test_blocks_of_formulas_and_fallbacks():
    texts = [b.text for b in html_blocks.blocks("<p>We know <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds<p><object data=x>a film</object> here <noscript>and this</noscript><canvas>drawn</canvas>")]
    assert texts == ["We know x = 2 holds", "a film here and thisdrawn"]


def test_deep_nesting_takes_little_memory():
    """Open elements are of one size, however many lie around them."""
    tracemalloc.start()
    found = html_blocks.blocks("<div class='a b'>" * 40000 + "deep" + "</div>" * 40000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.text for b in found] == ["deep"] and peak < 64 << 20
    bins = {html_blocks.bin_of(t) for t in ("div", ".a", ".b")}
    assert set(np.flatnonzero(html_text.inputs(found)[0, : html_blocks.PATH_BINS])) == bins


def test_labels_do_not_depend_on_the_group(monkeypatch):
    """Long pages are labelled alone, short ones together, with the same flags."""
    pages = [html_blocks.blocks("<html><body><nav><a href=x>menu</a></nav><article>" + "<p>Some sentence of it.</p>" * n + "</article></body></html>") for n in (0, 3, 50, 7, 2, 400)] + [[]]
    model = html_text.Labeller().fit(html_text.training_pages([f"Some sentence number {i} of a page." for i in range(50)], 60))
    whole = model.label(pages)
    monkeypatch.setattr(html_text, "TOGETHER", 1)
    assert all((a == b).all() for a, b in zip(whole, model.label(pages), strict=True)) and [len(x) for x in whole] == [len(p) for p in pages]


def test_labeller_on_made_up_pages():
    texts = [f"Some sentence of the page number {i} with other words in it." for i in range(200)]
    model = html_text.Labeller().fit(html_text.training_pages(texts, 600))
    right = total = 0
    for x, labels in html_text.training_pages(texts, 100, seed=5):
        rows, lengths = html_text.padded([x])
        right += ((model.logits(rows, lengths)[0][0, : len(labels)] > 0) == labels).sum()
        total += len(labels)
    assert right / total > 0.99


def test_pages_odd_rows(spark):
    long = "<html><body><article>" + "<p>word and word.</p>" * 3000 + "</article></body></html>"
    rows = [(1, None, None, "x"), (2, "u", "", "y"), (3, "u", "<nav><a>m</a></nav>", "z"), (4, "u", long, None), (4, "u", long, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extracted(df, html_text.fitted(df)).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got)[:2] == [(1, 0), (2, 0)] and len(got) == 5
    assert [r["text"].count("word and word.") for r in got if r["page_id"] == 4] == [3000, 3000]
    empty = df.limit(0)
    assert html_text.extracted(empty, html_text.fitted(empty)).count() == 0


def test_recurrent_gradient():
    """The backward pass against differences."""
    model = html_text.Labeller(seed=9)
    rng = np.random.default_rng(2)
    x, lengths = html_text.padded([rng.normal(size=(n, html_text.INPUTS)).astype(np.float32) * 0.3 for n in (4, 2)])

    def loss():
        logit, _, live, _, _ = model.logits(x, lengths)
        return float(logit[live].astype(np.float64).sum())

    keep = ([], [])
    _, both, live, turn, backwards = model.logits(x, lengths, keep)
    down = live[:, :, None] * model.weights
    grad = model._back("0", x, live, keep[0], down[:, :, : html_text.HIDDEN])
    grad |= model._back("1", backwards, live, keep[1], np.take_along_axis(down[:, :, html_text.HIDDEN :], turn[:, :, None], axis=1))
    for name in ("input0", "state0", "shift1", "state1"):
        value = getattr(model, name)
        at = np.unravel_index(np.abs(grad[name]).argmax(), value.shape)
        before = value[at]
        value[at] = before + 1e-2
        high = loss()
        value[at] = before - 1e-2
        low = loss()
        value[at] = before
        assert grad[name][at] == pytest.approx((high - low) / 2e-2, rel=0.03)


def test_chat_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = sorted(map(tuple, QUERIES["op6_chat"](spark, SF).collect()))
    assert got == sorted(con.sql(chat.SQL).fetchall()) and got


def test_chat_odd_rows(spark):
    rows = [(1, 0, "ann", "hi", 1), (1, 1, "bob", None, 1), (1, 2, None, "x<|im_end|>", 1), (1, 300, "ann", "late", 1), (2, 0, "system", "alone", 1), (None, None, "ann", "é", 1), (3, 5, "bob", "twice", 1), (3, 5, "bob", "twice", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, masks int")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.perspectives(df).collect()}
    assert got.keys() == {(1, p, k) for p in ("ann", "bob", "unknown") for k in (0, 1)} | {(None, "ann", 0), (3, "bob", 0)}
    ann = got[(1, "ann", 0)]
    assert ann["text"] == "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nx< |im_end|><|im_end|>\n"
    begin, end = map(int, ann["masks"].split(":"))
    assert ann["text"][begin:end] == "hi<|im_end|>" and got[(1, "bob", 1)]["masks"] == "" and got[(3, "bob", 0)]["n_turns"] == 2
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_turn_numbers_and_names(spark):
    """Any 64-bit turn number; marks and line feeds in a name can't open or end a turn."""
    name = "bob<|im_end|>\n<|im_start|>assistant"
    rows = [(1, 10**13, "user", "a"), (1, 2**63 - 1, name, "b"), (1, -1, "user", "c"), (1, -(2**63), "user", "d"), (1, -257, "user", "e")]
    got = {(r["perspective"], r["part"]): r["text"] for r in chat.perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert sorted({p for _, p in got}) == [-(2**55), -2, -1, 10**13 // 256, 2**55 - 1]
    assert got["user", 2**55 - 1] == "<|im_start|>user name=bob< |im_end|> < |im_start|>assistant\nb<|im_end|>\n"
    assert got[name, 2**55 - 1] == "<|im_start|>assistant\nb<|im_end|>\n"
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows[:3] + rows[4:])
    df = spark.createDataFrame(rows[:3] + rows[4:], "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(tuple, chat.perspectives(df).collect())) == sorted(con.sql(chat.SQL).fetchall())


def test_chat_without_turn_numbers(spark):
    """Null and repeated turn numbers: no array of more than ``PART_TURNS`` turns, no turn lost."""
    rows = [(1, None, "ann" if i % 3 else "bob", f"n{i}") for i in range(700)] + [(1, 5, "ann", "same")] * 300 + [(2, 0, "bob", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.perspectives(df).collect()
    assert {(r["conv_id"], r["perspective"], r["part"], r["piece"]): r["n_turns"] for r in got} == {
        (1, who, 0, k): n for who in ("ann", "bob") for k, n in enumerate((256, 256, 256, 232))
    } | {(2, "bob", 0, 0): 1}
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.sql(chat.SQL).fetchall())
    plan = chat.perspectives(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("hashpartitioning\\(conv_id[^,]*, part", plan)) == 1


def test_chat_is_native(spark):
    plan = QUERIES["op6_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _held(spark, sf):
    rows = QUERIES["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    return np.asarray([r["score"] for r in rows]), np.asarray([r["quality"] for r in rows]), rows


def test_quality_held_out(spark):
    score, label, rows = _held(spark, "/root/testdata/sf0.01")
    assert (score[label == 1][:, None] > score[label == 0]).mean() > 0.97
    assert ((score >= 0.7) == label).mean() > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_odd_rows(spark):
    long = "a word " * 40000
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, long, 1.0), (None, "x", 1.0), (2, "", 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, 1), (2, 0), (1, None), (None, 1)], "doc_id bigint, quality int")
    got = quality.scored(docs, quality.fitted(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert {r["score"] for r in quality.scored(docs, quality.fitted(docs, labels.limit(0))).collect()} == {1.0}
    assert quality.scored(docs.limit(0), None).count() == 0


def test_quality_sample_passes_over_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 40)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 5000)
    monkeypatch.setattr(quality, "TRAIN_TEXT", 3000)
    texts = [(i, "x" * (2900 if i % 3 == 0 else 9000 if i % 3 == 1 else 20)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    # most labels are of documents that are not among these
    labels = spark.createDataFrame([(i, i // 3 % 2) for i in range(5000)], "doc_id bigint, quality int")
    with pytest.warns(UserWarning, match="fewer than"):
        got, known = quality.training_sample(docs, labels)
    assert len(got) == len(known) == 40 and set(known) == {0, 1}
    assert sum(map(len, got)) <= 5000 and sum(len(t) == 2900 for t in got) <= 1
    with pytest.warns(UserWarning, match="0 rows of quality 1"):
        assert quality.training_sample(docs, labels.where("doc_id >= 300")) == ([], [])


def test_quality_sample_counts_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "good"), (1, "good"), (3, "bad"), (None, "none")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (None, 1)], "doc_id bigint, quality int")
    usual = [r["doc_id"] for r in docs.where(~quality.held_out()).distinct().collect()]
    got = sorted(zip(*quality.training_sample(docs, labels), strict=True))
    assert got == sorted([("good", 1)] * 4 * (1 in usual) + [("good", 0)] * 2 * (1 in usual) + [("bad", 0)] * (3 in usual))


def test_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    vectors, ids = np.asarray([r["embedding"] for r in rows], float), np.asarray([r["vec_id"] for r in rows])
    place = {int(v): k for k, v in enumerate(ids)}
    by: dict[int, list] = {}
    for r in QUERIES["op8_neighbours"](spark, "/root/testdata/sf0.1").collect():
        by.setdefault(r["query_id"], []).append(r)
    assert by.keys() == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for query, found in by.items():
        found.sort(key=lambda r: r["rank"])
        score = vectors @ vectors[place[query]]
        assert [r["rank"] for r in found] == [*range(1, 21)] and all(abs(r["score"] - score[place[r["vec_id"]]]) < 1e-9 for r in found)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(found, found[1:], strict=False))
        score[place[query]] = -np.inf
        hits += len({r["vec_id"] for r in found} & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits / (20 * len(by)) >= 0.95


def test_forest_recall_without_structure():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(neighbours.BLOCK, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    forest = neighbours.Forest(vectors)
    hits, looked = 0, 0
    for query, (found, _) in zip(vectors[:60], forest.nearest(vectors[:60], 21, np.arange(len(vectors))), strict=True):
        hits += len(set(found.tolist()) & set(np.argsort(-(vectors @ query))[:21].tolist()))
    looked = np.mean([len(c) for c in forest.candidates(vectors[:60], neighbours.CANDIDATES)])
    assert hits / (60 * 21) >= 0.9 and looked < 0.5 * len(vectors)


@pytest.mark.parametrize("spread", [0.3, 0.5, 1.0])
def test_forest_recall_on_unequal_lengths(spread):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(neighbours.BLOCK, 64))
    vectors *= np.exp(spread * rng.normal(size=(len(vectors), 1))) / np.linalg.norm(vectors, axis=1, keepdims=True)
    forest = neighbours.Forest(vectors)
    hits = 0
    for query, (found, _) in zip(vectors[:60], forest.nearest(vectors[:60], 21, np.arange(len(vectors))), strict=True):
        hits += len(set(found.tolist()) & set(np.argsort(-(vectors @ query))[:21].tolist()))
    assert hits / (60 * 21) >= 0.93


@pytest.mark.parametrize("offset", [0.3, 1.0, 3.0])
def test_forest_recall_beside_a_common_offset(offset):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(neighbours.BLOCK, 64)) + offset
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    forest = neighbours.Forest(vectors)
    hits = 0
    for query, (found, _) in zip(vectors[:60], forest.nearest(vectors[:60], 21, np.arange(len(vectors))), strict=True):
        hits += len(set(found.tolist()) & set(np.argsort(-(vectors @ query))[:21].tolist()))
    looked = np.mean([len(c) for c in forest.candidates(vectors[:60], neighbours.CANDIDATES)])
    assert hits / (60 * 21) >= 0.9 and looked < 0.4 * len(vectors)


def test_neighbours_of_extreme_lengths(spark):
    rows = [(i, [float(i + 1) * 1e-200, 1e-200]) for i in range(30)] + [(100, [1e200, 0.0]), (101, [1e150, 1e150])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r for r in neighbours.nearest(df, df.where("vec_id IN (20, 100)")).collect()}
    assert [got[20, k]["vec_id"] for k in range(1, 4)] == [100, 101, 0] and [got[100, k]["vec_id"] for k in range(1, 4)] == [101, 29, 28]
    assert got[100, 1]["score"] == float("inf") and len(got) == 40


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.5]) for i in range(60)]
    rows = [*same, (100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [None, 1.0]), (None, [1.0, 1.0]), (105, [1.0, 1.0, 1.0]), (120, [0.2, -1.0]), (120, [0.2, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got: dict[int, list] = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert got.keys() == {0, 20, 40, 120}  # 100 takes no part
    assert sorted(got[0]) == [(k, k) for k in range(1, 21)]
    assert [v for _, v in sorted(got[20])] == [*range(20)] and [v for _, v in sorted(got[40])] == [*range(20)]
    assert [v for _, v in sorted(got[120])] == [*range(20)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_flow():
    flow = reshard.minimum_cost_flow([10, 10, 10], [6, 6, 6, 6, 6])
    assert [sum(f) for f in flow] == [10] * 3 and [sum(f[j] for f in flow) for j in range(5)] == [6] * 5
    assert [flow[i][i] for i in range(3)] == [6] * 3  # nothing moves that could stay
    flow = reshard.minimum_cost_flow([0, 9, 3], [6, 6])
    assert [sum(f[j] for f in flow) for j in range(2)] == [6, 6] and flow[1][1] == 6
    with pytest.raises(ValueError):
        reshard.minimum_cost_flow([5], [4])


def test_flow_moves_least():
    """Against every way to deal small shards."""

    def ways(sizes, free):
        if not sizes:
            yield []
            return
        for parts in itertools.product(*(range(min(sizes[0], f) + 1) for f in free)):
            if sum(parts) == sizes[0]:
                for rest in ways(sizes[1:], [f - p for f, p in zip(free, parts, strict=True)]):
                    yield [parts, *rest]

    for sizes, free in [([3, 1], [2, 2]), ([4, 0, 2], [2, 2, 2]), ([1, 5], [2, 2, 2]), ([2, 2, 2], [3, 3]), ([0, 3, 1], [1, 1, 1, 1]), ([3, 3], [6, 1])]:
        moved = [sum(f for i, row in enumerate(way) for j, f in enumerate(row) if i != j) for way in (reshard.minimum_cost_flow(sizes, free), *ways(sizes, free))]
        assert moved[0] == min(moved[1:])


def test_reshard_equal_rows(spark):
    """A third of all rows are one row; the law holds nonetheless."""
    rows = [(7, "same row " * 12)] * 1000 + [(i, "x" * (60 + i % 97)) for i in range(2000)]
    got = reshard.reshard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    sums = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 16)
    assert len(got) == 3000 and sums.max() - sums.min() < 0.02 * sums.mean()
    for shard in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == [*range(len(slots))]
    blocks = reshard.measured(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("block").count().collect()
    assert max(r["count"] for r in blocks) < 10


def test_reshard(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_reshard"](spark, SF).collect()
    assert len(rows) == len(docs)
    by: dict[int, list] = {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
    assert by.keys() == set(range(16)) and all(sorted(r["slot"] for r in own) == [*range(len(own))] for own in by.values())
    sums = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sums) - min(sums) < 0.02 * sum(sums) / 16
    moved = sum(r["size"] for r in rows if r["shard"] != r["old_shard"])
    old = np.bincount([r["old_shard"] for r in rows], [r["size"] for r in rows])
    least = np.maximum(old - sum(sums) / 16, 0).sum()
    assert moved < least * 1.15


def test_reshard_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "same"), (3, "same"), (4, "y" * 100000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = reshard.reshard(df).collect()
    assert len(got) == 6 and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert reshard.reshard(df.limit(0)).count() == 0


def test_rewrite(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "layout")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    reshard.write_layout(docs, path)
    before = {f for _, _, files in os.walk(path) for f in files}
    affected = reshard.rewrite(spark, path, 16)
    stored = spark.read.parquet(path)
    want = {r["doc_id"]: r["shard"] for r in reshard.reshard(docs).collect()}
    assert {r["doc_id"]: r["shard"] for r in stored.collect()} == want and stored.count() == docs.count()
    kept = {f for d, _, files in os.walk(path) for f in files if f in before}
    assert set(range(12, 16)) <= set(affected) and (len(affected) == 16 or kept)
    reshard.rewrite(spark, path, 6)  # and back to fewer
    assert {r["shard"] for r in spark.read.parquet(path).select("shard").distinct().collect()} == set(range(6))
    assert spark.read.parquet(path).count() == docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "minhash near-dedup", "suffix-array dedup", "best-fit packing"]
    first, second, third, last = (f for _, f in corpus_pipeline.STAGES)
    kept = first(spark, docs, SF)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op7_quality"](spark, SF).collect()}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == {i for i, p in scores.items() if p}
    alone = second(spark, kept, SF).collect()
    root = brute.components([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.LIKENESS)
    assert {r["doc_id"] for r in alone} == set(root.values())
    cut = {r["doc_id"]: r for r in third(spark, spark.createDataFrame(alone, docs.schema), SF).collect()}
    flags = brute.repeated_bytes([(r["doc_id"], r["text"]) for r in alone])
    for r in alone:
        want = bytes(b for b, c in zip(r["text"].encode(), flags[r["doc_id"]], strict=True) if not c).decode("utf-8", "ignore")
        own = cut[r["doc_id"]]
        assert (own["text"], own["n_chars"], own["lang"], own["source"]) == (want, len(want), r["lang"], r["source"])
    result = corpus_pipeline.run(spark, SF)
    again = packing.pack(spark.createDataFrame(list(cut.values()), docs.schema), TOKENIZER)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, result.select(*columns).collect())) == sorted(map(tuple, again.select(*columns).collect()))


@pytest.mark.parametrize("extra", [("kept", "a b"), ("KEPT", "N_Bytes")])
def test_pipeline_odd_rows(spark, extra):
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, `{extra[0]}` boolean, `{extra[1]}` int"
    rows = [(1, None, None, "s", None, True, 1), (2, "", "en", "s", 0, False, 2), (None, "same text here", "en", "s", 14, True, 3), (3, "same text here", "en", "s", 14, True, 3), (3, "same text here", "en", "s", 14, True, 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
            passed = {tuple(r)[5:] for r in docs.collect()}
            assert passed <= {r[5:] for r in rows}
        docs = corpus_pipeline.STAGES[3][1](spark, docs, SF)
        docs.count()
