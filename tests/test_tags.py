import math
import re
from collections import Counter

from feedlake import fixed
from feedlake.operators import tags as TAG

RAW = {
    "technology\nai\nmachine-learning": ["technology", "ai", "machine-learning"],
    "1. technology\n2. ai\n3. science": ["technology", "ai", "science"],
    "- technology\n* ai\n• science": ["technology", "ai", "science"],
    "machine learning\nartificial intelligence": ["machine", "artificial"],
    "Technology\nAI\nScience": ["technology", "ai", "science"],
    "tech\nai\nscience\ndata\nml\ncloud\nweb": ["tech", "ai", "science", "data", "ml"],
    "tech\ntech\nai\nai": ["tech", "ai"],
    "x\n\n  Straße!\n" + "a" * 31: ["straße"],
    "": [],
}


def test_clean_tags(values):
    assert values(TAG.clean_tags("x"), RAW) == list(RAW.values())


def test_topic_terms_against_a_plain_count(spark):
    texts = {
        1: "Spark spark streaming data the the",
        2: "data lake data feed",
        3: "Füße feed-reader spark",
        4: "",
    }
    tokens = {k: [t for t in re.findall(r"[^\W\d_][\w-]{2,29}", v.lower()) if t not in fixed.STOP_WORDS] for k, v in texts.items()}
    df = Counter(t for ts in tokens.values() for t in set(ts))
    want = {}
    for k, ts in tokens.items():
        scored = [(t, round(n * (math.log((1 + len(texts)) / (1 + df[t])) + 1), 6)) for t, n in Counter(ts).items()]
        for rank, (t, s) in enumerate(sorted(scored, key=lambda p: (-p[1], p[0]))[:5], 1):
            want[(k, rank)] = (t, s)
    rows = TAG.topic_terms(spark.createDataFrame(list(texts.items()), "id int, text string"), "id").collect()
    assert {(r.id, r["rank"]): (r.term, r.score) for r in rows} == want


def test_merge_and_rollup(spark):
    items = spark.createDataFrame(
        [("f", "1", ["video"]), ("f", "2", []), ("g", "1", ["video", "b"])], "feed string, id string, tags array<string>"
    )
    topics = spark.createDataFrame([("1", "zeta"), ("1", "video"), ("1", "alpha")], "id string, term string")
    merged = {(r.feed, r.id): r.tags for r in TAG.add_topics(items, topics).collect()}
    assert merged == {("f", "1"): ["alpha", "video", "zeta"], ("f", "2"): [], ("g", "1"): ["alpha", "b", "video", "zeta"]}
    assert sorted(map(tuple, TAG.tag_rollup(items).collect())) == [("f", "video", 1), ("g", "b", 1), ("g", "video", 1)]
