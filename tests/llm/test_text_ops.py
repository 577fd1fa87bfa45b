"""BPE, packing, byte-string removal, near-duplicates and fingerprints against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import duckdb
import pytest
from tokenizers import Tokenizer

from feedlake.llm import bpe, fingerprints, minhash, packing, suffixes, words
from feedlake.llm.queries import QUERIES, SQL, TOKENIZER
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, n_bytes int"
LONG = " ".join(f"w{i * 7919}" for i in range(60000))
ODD = [
    (1, "one two three four five six"), (2, None), (3, ""), (4, "   "), (5, "ONE two three four five six"), (6, LONG), (7, LONG + " end"),
    (8, "it's we'll I'VE 'tis  x\n\n y <|endoftext|> z<|endoftext|>"), (None, "no id at all"), (9, "naïve Straße 漢字 😀"), (10, "one two three four five six"), (10, "one two three four five six"),
]
DOCS = [(i, t, "en", 7) for i, t in ODD]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_split_is_the_tokenizers(tokenizer):
    rng = random.Random(4)
    parts = ["'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", "!", "1", "23", "x", "é", "漢", "<|endoftext|>", "<|", "　", "😀", "\x1c", "\x85", "¼", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20000)]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in [*range(1, 0x3000), *range(0xF000, 0x11000)] if not 0xD800 <= c < 0xE000]
    one = words.encoder(TOKENIZER)
    split = words.split_texts(texts, one.special_text)
    flat, starts = one.ragged(split.words.to_pylist())
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i, ids in enumerate(want):
        assert words.ragged_take(flat, starts, split.codes[split.bounds[i] : split.bounds[i + 1]])[0].tolist() == ids


def _bpe_row(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe(spark, odd, small, tokenizer):
    got = sorted(map(tuple, bpe.encode(odd, TOKENIZER, digest=True).collect()), key=str)
    assert got == sorted((_bpe_row(tokenizer, i, t) for i, t in ODD), key=str)
    got = sorted(map(tuple, QUERIES["op1_bpe"](spark, SF).collect()))
    assert got == sorted(_bpe_row(tokenizer, i, t) for i, t in small)
    encoded = bpe.encode(odd, TOKENIZER)
    texts = sorted(map(tuple, bpe.decode(encoded, TOKENIZER).collect()), key=str)
    assert texts == sorted(((i, t or "") for i, t in ODD), key=str)
    assert bpe.encode(odd.limit(0), TOKENIZER).count() == 0


def _check_packing(rows, docs, tokenizer, size):
    ids = {}
    for i, t in docs:
        ids[i] = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    by = {}
    for r in rows:
        assert r["ids_crc32"] == brute.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    for doc_id in ids:
        pieces = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == doc_id)
        assert sum(p[2] for p in pieces) % len(ids[doc_id]) == 0 and {p[2] for p in pieces if p[0]} <= {size}
    return len(by), -(-sum(r["length"] for r in rows) // size)


def test_packing(spark, odd, small, tokenizer):
    used, least = _check_packing(QUERIES["op9_packing"](spark, SF).collect(), small, tokenizer, 1024)
    assert used <= least * 1.02 + 1
    rows = packing.pack(odd, TOKENIZER, 1024, 2).collect()
    _check_packing(rows, ODD, tokenizer, 1024)
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_best_two_fit():
    import numpy as np

    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = 1, 1, 2
    # 6 and 3 leave a gap of 1; two pieces of 2 fit the gap that 3 gives back
    assert packing.best_two_fit(counts, 10) == [(1, [6, 2, 2]), (1, [3])]
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(0, 30, 51)
        counts[0] = 0
        plan = packing.best_two_fit(counts, 50)
        used = np.zeros(51, int)
        for times, lengths in plan:
            assert sum(lengths) <= 50
            for x in lengths:
                used[x] += times
        assert (used == counts).all()


def test_suffixes(spark, odd, small):
    want = brute.repeated_bytes([tuple(r) for r in small])
    got = {r["doc_id"]: r for r in QUERIES["op3_suffixes"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for doc_id, text in small:
        data, cover, row = text.encode(), want[doc_id], got[doc_id]
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        spans = sum(c and not p for p, c in zip(b"\0" + bytes(cover), cover, strict=False))
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest())


def test_suffixes_odd_rows(spark, odd):
    rows = suffixes.deduplicate(odd, kept="text").collect()
    assert set(rows[0].asDict()) == {"doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept"}
    kept = sorted(((r["doc_id"], r["kept"]) for r in rows), key=str)
    # 7 repeats 6, but for its own end; repeated rows are one document, and short ones stay
    want = sorted(((i, t or "") for i, t in ODD if i != 7), key=str)
    assert [k for k in kept if k[0] != 7] == want
    assert next(k for k in kept if k[0] == 7)[1] == " end"
    assert suffixes.deduplicate(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_suffixes_of_one_passage_in_many_surroundings(spark, monkeypatch, hot):
    """Pieces of 40 to 260 bytes of the same passages, cut anywhere: most buckets of 32 bytes hold different runs."""
    rng = random.Random(9)
    passages = ["".join(rng.choices("abcdefgh", k=400)) for _ in range(3)]

    def piece():
        low, text = rng.randrange(300), rng.choice(passages)
        return text[low : low + rng.randrange(40, 260)] if rng.random() < 0.6 else "".join(rng.choices("abcdefghij", k=rng.randrange(1, 120)))

    docs = [(i, "".join(piece() for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    want = brute.repeated_bytes(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    if hot:  # every second anchor goes from the first round to the last
        monkeypatch.setattr(suffixes, "_common_anchors", lambda keyed: sorted({r["bucket"] for r in suffixes.run_table(keyed).collect()})[::2])
    for row in suffixes.deduplicate(df).collect():
        data = docs[row["doc_id"]][1].encode()
        assert bytes(row["kept"]) == bytes(b for b, c in zip(data, want[row["doc_id"]], strict=True) if not c), row["doc_id"]


def test_suffixes_periodic(spark):
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefgh ", k=700))
    docs = [(i, t) for i, t in enumerate(["ab" * 300, "xab" + "ab" * 200, "a" * 150, base, base[50:400] + "é" + base[300:], "-" + base, base[:99], base[:100], ""])]
    want = brute.repeated_bytes(docs)
    for row in suffixes.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        data = docs[row["doc_id"]][1].encode()
        assert bytes(row["kept"]) == bytes(b for b, c in zip(data, want[row["doc_id"]], strict=True) if not c), row["doc_id"]


def test_near_duplicates(spark, small):
    want = brute.components([tuple(r) for r in small], 85)
    got = QUERIES["op2_minhash"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(brute.shingles(t)) for r, (_, t) in zip(sorted(got), sorted(small), strict=True))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, 85).collect()), key=str)
    want = brute.components([(i, t) for i, t in ODD], 85)
    assert got == sorted(((i, want.get(i), i is None or i == want[i]) for i, _ in ODD), key=str)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """A group of many edits of one text, with regions and tiles so small that all of them split."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = []
    for i in range(250):
        own = list(base)
        for k in rng.sample(range(120), rng.randrange(6)):
            own[k] = f"e{i}x{k}"
        docs.append((i * 3 + 1, " ".join(own)))
    want = brute.components(docs, 85)
    monkeypatch.setattr(minhash, "TILE_BYTES", 40_000)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 85).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [80, 85])
def test_links_at_the_wanted_likeness(percent):
    """Links of exactly the wanted likeness whose sketches agree less than usual."""
    rng = np.random.default_rng(percent)
    own = 100 - percent
    drawn = (rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(2000))
    pairs = [(np.sort(x[own // 2 :]), np.sort(x[: 100 - own + own // 2])) for x in drawn]  # percent in common of 100 in all
    agreed = [int((minhash.sketch(a) == minhash.sketch(b)).sum()) for a, b in pairs]
    low = [p for p, k in zip(pairs, agreed, strict=True) if k < (percent - 10) * 1.28]
    assert low and min(agreed) >= minhash.least_agreeing(percent)
    for a, b in low:
        assert len(np.intersect1d(a, b)) * 100 >= percent * len(np.union1d(a, b))
        assert minhash.linked_sets([a, b], percent).tolist() == [0, 0]
        assert minhash.linked_sets([a, b], percent, np.asarray([1, 1])).tolist() == [0, 1]
    chance = percent / 100 + own / 100 / 256
    assert (1 - chance ** minhash.least_depth(percent)) ** minhash.TREES <= 1e-5


def test_linked_sets_against_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 40)).astype(np.uint64)) for _ in range(120)]
    for apart in (None, rng.integers(0, 2, 120)):
        root = np.arange(120)
        for i in range(120):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if common and 100 * common >= 60 * (len(sets[i]) + len(sets[j]) - common) and (apart is None or apart[i] != apart[j]):
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
        assert minhash.linked_sets(sets, 60, apart).tolist() == root.tolist()


def test_fingerprints(spark, odd, small):
    rows = QUERIES["op10_fingerprints"](spark, SF).collect()
    order = sorted(small, key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in rows}
    errors = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        changed = fingerprints.edited(text, following)
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for column, other in (("near_edited", changed), ("near_next", following)):
            a, b = brute.shingles(text), brute.shingles(other)
            errors.append(row[column] - len(a & b) / len(a | b))
    assert max(map(abs, errors)) < 0.25 and sum(e * e for e in errors) / len(errors) < 0.03**2
    odd_rows = fingerprints.compared(odd).collect()
    assert len(odd_rows) == len(ODD)
    by_text = {r["n_chars"]: r["fingerprint"] for r in odd_rows}
    assert by_text[0] == "" and fingerprints.likeness(by_text[len(LONG)], by_text[len(LONG) + 4]) > 0.99
    assert len({r["fingerprint"] for r in odd_rows if r["doc_id"] in (1, 10)}) == 1
    assert fingerprints.compared(odd.limit(0)).count() == 0
    alone = fingerprints.compared(odd.where("doc_id = 1")).first()
    assert alone["near_next"] == 1.0


def test_likeness():
    assert fingerprints.likeness("", "") == 1.0
    one = fingerprints.fingerprint(fingerprints.mixed(__import__("numpy").arange(1000, dtype="uint64")))
    assert fingerprints.likeness(one, one) == 1.0 and fingerprints.likeness(one, "") == 0.0


def test_suffixes_of_texts_without_an_id(spark):
    """Different texts without ``doc_id`` stay apart, also where their 32-bit checksums agree."""
    rng = random.Random(8)
    seen, pair = {}, None
    while pair is None:
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randint(110, 260)))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        pair = (other, text) if other != text else None
    passage = "A passage of more than a hundred bytes that stands in a text with an id and in both of the texts without one, word by word. "
    rows = [(1, passage), (None, pair[0]), (None, pair[1]), (None, passage + pair[0]), (None, pair[1] + passage), (None, pair[1])]
    got = suffixes.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and sum(r["n_bytes"] for r in got) == sum(len(t) for _, t in rows)
    left = b"|".join(sorted(bytes(r["kept"]) for r in got))
    assert left.count(pair[0].encode()) == 1 and passage.encode() in left and sum(r["n_removed"] for r in got) > 2 * len(passage)


def test_suffixes_beside_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x" * 120, 5, "k"), (2, "x" * 120, 6, "l")], "doc_id bigint, text string, N_Bytes int, KEPT string")
    got = {r["doc_id"]: r for r in suffixes.deduplicate(docs).collect()}
    assert got[1]["n_bytes"] == 120 and got[2]["n_removed"] == 120 and bytes(got[2]["kept"]) == b""
    import corpus_pipeline

    out = corpus_pipeline.unrepeated(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "x", 5, "k"), (2, "", 6, "l")]


@pytest.mark.parametrize("name", ["op2_minhash", "op3_suffixes"])
def test_documents_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


def test_sql_of_odd_documents(spark):
    """Null, empty and short texts, letters beyond A-Z, overlapping and touching repeats: the SQL says the same."""
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(80))
    rows = [(1, None), (2, ""), (3, "Ä one TWO"), (4, "ä one two"), (5, "Ä ONE two"), (6, long), (7, "x" + long + long[:150]), (8, "z" * 250), (9, "é" * 70), (10, "é" * 70 + "!"), (11, " ".join(map(str, range(99)))), (12, " ".join(map(str, range(101))))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for name, got in (("op2_minhash", minhash.near_duplicates(df, percent=85)), ("op3_suffixes", suffixes.deduplicate(df, kept="sha256"))):
        want = con.sql(SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
