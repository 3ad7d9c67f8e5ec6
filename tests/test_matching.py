"""Fuzzy candidates: exact for every threshold, every title scored once."""

import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators.matching import match_titles, probes, segments


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def titles(rng, n):
    words = ["mario", "kart", "super", "quest", "ii", "world", "tour", "of", "dragon", "x"]
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8)))
        for _ in range(rng.randrange(0, 4)):
            p = rng.randrange(len(t) + 1)
            t = rng.choice([t[:p] + rng.choice("abcx") + t[p:], t[:p] + t[p + 1:], t[:p] + rng.choice("mnz") + t[p + 1:]])
        out.append(" ".join(t.split()))
    return out


@pytest.mark.parametrize("threshold", [60.0, 70.0, 85.0, 95.0])
def test_matches_all_pairs(spark, threshold):
    rng = random.Random(int(threshold))
    left = [(i, t, "ab"[i % 2]) for i, t in enumerate(titles(rng, 120) + [""])]
    right = [(i, t, "ab"[i % 2]) for i, t in enumerate(titles(rng, 90) + ["", "zz"])]
    got = match_titles(spark.createDataFrame(left, "item_id int, title string, platform string"),
                       spark.createDataFrame(right, "seq int, title string, platform string").withColumn("pay", F.col("seq") * 10),
                       threshold=threshold, payload=["pay"]).collect()
    first = {}
    for s, t, p in right:
        first.setdefault((p, t), s)
    want = {}
    for i, t, p in left:
        if (p, t) in first:
            want[i] = ("exact", 100.0, first[p, t] * 10)
            continue
        best = max(((100.0 * (1 - distance(t, u) / max(len(t), len(u), 1)), -s) for (q, u), s in first.items() if q == p), default=(0, 0))
        ok = best[0] >= threshold
        want[i] = ("fuzzy", best[0], -best[1] * 10) if ok else ("unmatched", None, None)
    assert len(got) == len(left)
    for r in got:
        kind, score, pay = want[r.item_id]
        assert (r.match_type, r.pay) == (kind, pay), (left[r.item_id], r)
        assert score is None or abs(r.match_score - score) <= 0.051
    assert {"exact", "unmatched"} <= {k for k, *_ in want.values()}
    assert threshold > 90 or any(k == "fuzzy" for k, *_ in want.values())


def test_low_thresholds_are_refused(spark):
    df = spark.createDataFrame([(1, "a", "p")], "item_id int, title string, platform string")
    with pytest.raises(ValueError):
        match_titles(df, df.withColumnRenamed("item_id", "seq"), threshold=50.0)


def test_repeated_titles_are_probed_once(spark):
    """Copies of a title add rows to the result, not candidates."""
    df = spark.createDataFrame([(i, "super mario kartt", "p") for i in range(50)], "item_id int, title string, platform string")
    right = spark.createDataFrame([(1, "super mario kart", "p")], "seq int, title string, platform string")
    got = match_titles(df, right, payload=[]).collect()
    assert len(got) == 50 and {r.match_type for r in got} == {"fuzzy"}


def test_segments_cover_the_title(spark):
    df = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz" * k,) for k in (1, 2)], "t string")
    for r in df.select("t", segments(F.col("t"), 0.85).alias("s"), F.size(probes(F.col("t"), 0.85)).alias("n")).collect():
        assert "".join(x.text for x in r.s) == r.t and r.n < 6 * len(r.t) ** 2
