"""Lexical search, whitening and SimHash against plain versions."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from feedlake.llm import lexical, simhash, whitening
from feedlake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 30011}" for i in range(60000))


# --- lexical search ----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def _terms(text):
    return WORD.findall((text or "").translate(LOWER))


def _best(docs, items, best=10):
    """The contract, read literally."""
    held = [(i, Counter(_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, []).extend(_terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=str)


DOCS = [
    (1, "Alpha beta, gamma-delta"), (2, None), (3, ""), (4, "...!"), (5, "alpha ALPHA alpha"), (6, LONG), (None, "alpha beta"), (7, "naïve Straße 漢字 É é"),
    (8, "Alpha beta, gamma-delta"), (8, "Alpha beta, gamma-delta"), (9, "x\x7fy\x00z_w"), *[(100 + k, f"alpha common word{k} beta") for k in range(30)],
]
ITEMS = [
    (1, "alpha"), (1, "alpha"), (2, "beta beta gamma"), (3, None), (4, "---"), (5, "nowhere to be found"), (None, "straße É"), (6, "w7919 w15838 " + LONG[:4000]),
    (7, "alpha"), (7, "word3 word4"), (8, "y z w common"),
]


def test_search_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 5, "n") for i, t in DOCS], "doc_id bigint, text string, SCORE int, n string")
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id bigint, text string, rank int")
    got = lexical.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _best(DOCS, ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id IN (2, 3, 4)"), items)):
        assert lexical.search(d, i).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 8)
    monkeypatch.setattr(lexical, "SAMPLE", 10)
    got = lexical.search(spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == _best(DOCS, ITEMS)


def test_search_is_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(map(tuple, QUERIES["op11_lexical"](spark, SF).collect())) == sorted(con.sql(SQL["op11_lexical"]).fetchall())


@pytest.mark.parametrize("bucket", [1, 7, 64, 4096])
def test_search_bounds(monkeypatch, bucket):
    """Pruned by norms and coordinates at every size of bucket, nothing that counts is lost."""
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    size, n = 80, 700
    shares = 1 / np.arange(1, size + 1)
    rows = [np.unique(rng.choice(size, rng.integers(0, 25), p=shares / shares.sum())) for _ in range(n)]
    counts = [rng.integers(1, 6, len(r)) for r in rows]
    total = [int(c.sum()) + int(rng.integers(1, 60)) for c in counts]
    weight = np.asarray([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in r for r in rows) + 1))) for t in range(size)])
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(range(n)), "n": total, "ids": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), "counts": pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))}
    )
    items = [(k, t, rng.integers(1, 4, len(t))) for k, t in enumerate([rng.choice(size, s, replace=False) for s in (1, 3, 9, 25, 60)])]
    asked = lexical.Asked(n, sum(total), weight, items, np.zeros(len(items), np.int64), 10)
    none = np.zeros(0, np.int64)
    found = [lexical.Found(none, none.astype(bool), none) for _ in items]
    lexical._searched(asked, lexical.Order(asked, batch), found, asked.least.copy())
    for (_, terms, repeats), got in zip(items, found, strict=True):
        asked_for = dict(zip(terms.tolist(), repeats.tolist(), strict=True))
        want = []
        for i, (r, c) in enumerate(zip(rows, counts, strict=True)):
            m = 25 + 75 * total[i] * n // sum(total)
            want.append((-sum(asked_for.get(t, 0) * int(weight[t]) * (10**9 * f // (1000 * f + 8 * m)) for t, f in zip(r.tolist(), c.tolist(), strict=True)), i))
        want = [(i, -s) for s, i in sorted(want)[:10] if s < 0]
        assert list(zip(got.ids.tolist(), got.score.tolist(), strict=True)) == want


# --- whitening ---------------------------------------------------------------------


def _check_whitened(rows, vectors, components=4):
    """Against numpy's eigenvectors; ``vectors`` are those that take part."""
    x = {i: np.floor(np.asarray(v, np.float64) * 256).astype(np.int64) for i, v in vectors.items()}
    fit = np.unique(np.asarray(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert by.keys() == {(i, k + 1) for i in x for k in range(len(values))} and len(rows) == len(by)
    for k in range(len(values)):
        want = {i: (v - total / n) @ basis[:, k] / math.sqrt(values[k]) for i, v in x.items()}
        sign = np.sign(sum(by[i, k + 1]["whitened"] * w for i, w in want.items()))
        for i, w in want.items():
            r = by[i, k + 1]
            assert r["whitened"] * sign == pytest.approx(w, abs=1e-9)
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total, strict=True))
            assert r["explained"] == pytest.approx(values[k] / (centred**2).sum() * n, rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    _check_whitened(QUERIES["op12_whitening"](spark, SF).collect(), vectors)


def test_whitening_odd_rows(spark):
    rng = random.Random(3)
    good = {k: [rng.uniform(-300, 300) if k % 3 else rng.uniform(-1, 1) for _ in range(6)] for k in range(40)}
    good[40] = good[41] = good[0]
    odd = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (53, [float("nan")] * 6), (54, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (55, [1e30] * 6), (56, [1.0, 2.0])]
    rows = [(i, v, "x", 1.0) for i, v in [*good.items(), *odd]]
    schema = "vec_id bigint, embedding array<double>, component string, N double"
    _check_whitened(whitening.whitened(spark.createDataFrame(rows, schema)).collect(), good)
    # repeated rows and rows without an id stay, and change nothing
    more = [*rows, (7, good[7], "y", 2.0), (None, good[8], "y", 2.0)]
    got = whitening.whitened(spark.createDataFrame(more, schema)).collect()
    assert Counter(r["vec_id"] for r in got)[7] == 8 and Counter(r["vec_id"] for r in got)[None] == 4
    assert {r["n"] for r in got} == {40}
    for few in (rows[:0], rows[:1], [rows[0], rows[40]], rows[42:43]):
        assert whitening.whitened(spark.createDataFrame(few, schema)).count() == 0
    two = whitening.whitened(spark.createDataFrame([rows[0], rows[1]], schema)).collect()
    assert {r["component"] for r in two} == {1} and {abs(round(r["whitened"], 9)) for r in two} == {1.0}


def test_whitening_of_large_numbers(spark):
    """Beyond 64 bits sums stay exact and the deviation is null."""
    rows = [(k, [2.0**50 * (k - 2), 2.0**40 * (k * k - 3), 5.0]) for k in range(6)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} and {r["component"] for r in got} == {1, 2}
    assert max(r["identity_error"] for r in got) < 1e-6


@pytest.mark.parametrize("kind", ["plain", "pairs", "one value", "clusters", "rank one", "split", "small"])
def test_leading_eigenvectors(kind):
    rng = np.random.default_rng(11)
    a = rng.standard_normal((300, 48))
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    matrix = {
        "plain": a.T @ a,
        "pairs": np.repeat(a[:, :24], 2, axis=1).T @ np.repeat(a[:, :24], 2, axis=1),
        "one value": np.diag([3.0] * 40 + [1.0] * 8),
        "clusters": (q * np.asarray([5, 5, 5, 5 - 1e-12, 4] + [1] * 43)) @ q.T,
        "rank one": np.outer(a[0], a[0]),
        "split": np.kron(np.eye(24), np.asarray([[2.0, 1.0], [1.0, 2.0]])),
        "small": a.T @ a * 1e-200,
    }[kind]
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading(matrix, 4)
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    assert len(values) == (1 if kind == "rank one" else 4)
    assert values == pytest.approx(want[: len(values)], rel=1e-12)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


# --- SimHash -----------------------------------------------------------------------


def _fingerprint(text):
    words = (text or "").translate(LOWER)
    words = re.findall(r"[^\x20\x09-\x0d]+", words)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(values):
    """The smallest index that each fingerprint reaches over links of three bits, all pairs."""
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for j in range(len(values)):
        for i in range(j):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(values))]


def _check_simhash(got, docs):
    prints = [_fingerprint(t) for _, t in docs]
    label = _classes(prints)
    least = {}
    for (i, _), root in zip(docs, label, strict=True):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = [(i, f"{p:016x}", least[root]) for (i, _), p, root in zip(docs, prints, label, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_simhash_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    _check_simhash(QUERIES["op13_simhash"](spark, SF), docs)


def test_simhash_odd_rows(spark):
    docs = [
        (11, None), (12, ""), (13, " \t\n"), (14, "one"), (15, "ONE  "), (16, "one two"), (17, "a b c"), (18, "a b c a b c a b c"), (None, "a b c"), (None, "lonely row without id"),
        (19, LONG), (20, LONG + " end"), (21, "naïve Straße 漢字 É"), (21, "naïve Straße 漢字 É"), (5, "A\x0bB\x0cC"), (22, "x" * 3_000_000 + " y z " + "q " * 1_000_000),
    ]
    table = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id bigint, text string, FP int, component_id string")
    _check_simhash(simhash.near_duplicates(table), docs)
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_simhash_rows_of_one_document(spark):
    """Different texts of one id are one document for links."""
    docs = spark.createDataFrame([(1, "p q r s"), (2, "p q r s"), (2, "completely different words here"), (9, "completely different words here")], "doc_id bigint, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1}


@pytest.mark.parametrize("bucket", [4096, 40, 3])
def test_pivots_lose_no_link(spark, monkeypatch, bucket):
    """Random fingerprints, crowds within few bits of each other, and chains; with buckets dealt again and cut into tiles."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    values = [rng.getrandbits(64) for _ in range(300)]
    for centre in values[:6]:
        values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(60)]
    step = values[7]
    for _ in range(40):
        step ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.append(step)
    values = list(dict.fromkeys(values))
    signed = np.asarray(values, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = simhash.links(simhash.bounded_buckets(simhash.by_quarter(classes))).collect()
    place = {v: k for k, v in enumerate(signed)}
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for e in edges:
        a, b = sorted((find(place[e["u"]]), find(place[e["v"]])))
        label[b] = a
    assert [find(i) for i in range(len(values))] == _classes(values)


def test_quarter_distances_tell_contents_apart():
    """Two contents of a quarter seldom share all distances, so buckets stay as small as the bits allow."""
    contents = np.arange(1 << 16, dtype=np.uint64)
    assert len(np.unique(simhash._within(contents, simhash.distances(contents), simhash.QUARTERS[0]))) > 0.9 * (1 << 16)
