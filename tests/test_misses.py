"""The report of date shapes against plain counts."""

import re
from collections import Counter

from feedlake.functions import dates as D
from feedlake.operators import misses as MISS

SHAPES = {"2025-01-05T10:00:00Z": "9999-99-99a99:99:99a", "  March  3rd, 2025 ": "a 9a, 9999", "": "", "Größe ٣": "a 9", None: ""}


def test_shapes(values):
    assert values(D.date_shape("x"), list(SHAPES)) == list(SHAPES.values())


def test_sketches_of_runs_add_up(spark):
    rows = [(f"{'x' * (k % 4)}{'-' * (k % 9)} {k}",) for k in range(3000)] + [("2025-01-02",)] * 50 + [(None,)] * 7 + [(" ",)]
    texts = MISS.read_dates(spark.createDataFrame(rows, "date_raw string").repartition(5))
    parts = [MISS.shape_part(texts.where(f"pmod(xxhash64(date_raw), 2) = {k}")) for k in (0, 1)]
    report = MISS.shape_report(parts[0].unionByName(parts[1]), top=1000)
    got = {(r.outcome, r.shape): (r.n, r.texts) for r in report.collect()}
    outcomes = {r.date_raw: r.outcome for r in texts.collect()}
    totals, want = Counter(), Counter()
    for (t,) in rows:
        totals[outcomes[t]] += 1
        want[outcomes[t], re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", " ".join((t or "").split())))] += 1
    assert got == {(o, s): (totals[o], n) for (o, s), n in want.items()}
    assert totals["none"] == 8 and totals["read"] >= 50


def test_common_shapes_survive_a_small_sketch(spark):
    """Far more shapes than are tracked: the common ones are still found, and nothing grows with the shapes."""
    rows = [("-" * (k % 3 + 1) + " seen",) for k in range(900)] + [("".join("-." [(k >> b) & 1] for b in range(11)) + "!",) for k in range(2000)]
    part = MISS.shape_part(MISS.read_dates(spark.createDataFrame(rows, "date_raw string")), tracked=64)
    top = {r.shape for r in MISS.shape_report(part, top=3, tracked=64).collect()}
    assert top == {"- a", "-- a", "--- a"}
    assert MISS.shape_report(part.limit(0)).count() == 0
