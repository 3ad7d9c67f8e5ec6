"""Weighted ratio: hand-computed values, the bound search against all pairs, the match on Spark."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators import matching as M
from pricelens.operators import scoring as S
from pricelens.operators.matching import containment_match, match_titles
from pricelens.functions.text import STOP_WORDS

WORDS = "super mario kart zelda quest ii iii the of legend world tour x dragon age fantasy final tactics advance story pocket".split()


def titles(rng, n):
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 8)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.randrange(len(t) + 1)
            t = t[:p] + rng.choice("abz ") + t[p + rng.randrange(2):]
        out.append(" ".join(t.split()))
    return out


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 25))) for _ in range(2))
        assert S.common_length(a, b) == common(a, b)
    texts = titles(rng, 60) + ["", "x" * 64, "ab" * 32]
    columns = S.Columns(texts)
    for a in titles(rng, 10) + ["x" * 70]:
        assert columns.common_lengths(a).tolist() == [common(t, a) for t in texts]


@pytest.mark.parametrize("a,b,want", [
    # plain: 14 of 15 characters in common, 100 * 28 / 29; 95 by the words
    ("this is a test", "this is a tests", 100 * 28 / 29),
    # word order: 100 * 0.95
    ("kart mario super", "super mario kart", 95.0),
    # repeated words count once in the sets
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", 95.0),
    # shared "a bear but fuzzy not was" (24), each has 3 more: 1 - 4 / 52 of the shared part, times 0.95; plain 100 * 54 / 60 is less than 90
    ("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat", max(95 * (1 - 4 / 52), 100 * 54 / 60)),
    # twice as long and more: a stretch counts 0.9, a shared word 0.855
    ("zelda", "the legend of zelda", 90.0),
    ("zeldas", "the legend of zelda", 0.9 * 100 * 10 / 11),
    ("zelda ii", "quest of zelda the story", 85.5),
    # beyond 8 times 0.6
    ("ab", "ab" + " word" * 6, 60.0),
    ("", "x", 0.0), ("x", "", 0.0), ("same title", "same title", 100.0),
])
def test_hand_computed_values(a, b, want):
    assert abs(S.weighted_ratio(a, b) - want) < 1e-9
    assert abs(S.weighted_ratio(b, a) - want) < 1e-9


@pytest.mark.parametrize("threshold", [65.0, 85.0, 92.0])
def test_best_matches_look_at_no_fewer_pairs_than_needed(threshold):
    rng = random.Random(int(threshold))
    left, right = titles(rng, 120) + ["", "long " * 20 + "title"], titles(rng, 90) + ["", "long " * 19 + "title"]
    order = np.array(rng.sample(range(1000), len(right)))
    got = {i: (s, k) for i, s, k in S.best_matches(left, right, order, threshold)}
    for i, a in enumerate(left):
        score, k = max((S.weighted_ratio(a, b), -int(order[j])) for j, b in enumerate(right))
        assert (i in got) == (score >= threshold)
        assert i not in got or (abs(got[i][0] - score) < 1e-9 and got[i][1] == -k)


@pytest.mark.parametrize("block", [2048, 7])
def test_weighted_match_on_spark(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_TITLES", block)
    rng = random.Random(3)
    left = [(i, t, "abc"[i % 3]) for i, t in enumerate(titles(rng, 80) + ["", "!!"])] + [(900, "super mario", "only left"), (901, None, "a")]
    right = [(i, t, "ab"[i % 2]) for i, t in enumerate(titles(rng, 60) + ["", "zz"])]
    got = match_titles(spark.createDataFrame(left, "item_id int, title string, platform string"),
                       spark.createDataFrame(right, "seq int, title string, platform string").withColumn("pay", F.col("seq") * 10),
                       payload=["pay"], scorer="weighted").collect()
    first, kinds = {}, set()
    for s, t, p in right:
        first.setdefault((p, t), s)
    assert len(got) == len(left)
    by = {r.item_id: r for r in got}
    for i, t, p in left:
        t = (t or "").replace("!!", "")
        if (p, t) in first:
            want = ("exact", 100.0, first[p, t] * 10)
        else:
            best = max(((S.weighted_ratio(t, u), -s) for (q, u), s in first.items() if q == p), default=(0.0, 0))
            want = ("fuzzy", best[0], -best[1] * 10) if best[0] >= 85 else ("unmatched", None, None)
        r = by[i]
        kinds.add(want[0])
        assert (r.match_type, r.pay) == (want[0], want[2]), (t, r, want)
        assert want[1] is None or abs(r.match_score - want[1]) <= 0.051
    assert kinds == {"exact", "fuzzy", "unmatched"}


def test_containment_matches_all_pairs(spark):
    """Any number of words, wide names and titles, ties, ranks."""
    rng = random.Random(9)
    vocabulary = WORDS + [f"rare{i}" for i in range(40)]
    name = lambda lo, hi: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(lo, hi)))
    left = [(i, name(1, 9), "ab"[i % 2]) for i in range(120)] + [(200 + i, name(14, 40), "a") for i in range(6)] + [(300, "the of", "a"), (301, None, "b")]
    right = [(i, name(1, 9), "ab"[i % 2], i % 3, 1990 + i % 5, 1991, 1993) for i in range(150)]
    right += [(400 + i, name(14, 60), "a", 0, None, 1991, 1993) for i in range(6)]
    right += [(500 + i, right[i][1], right[i][2], 0, 1992, 1991, 1993) for i in range(0, 20, 3)]       # equal names, other ranks
    got = {r.item_id: r for r in containment_match(
        spark.createDataFrame(left, "item_id int, title string, platform string"),
        spark.createDataFrame(right, "id int, name string, platform string, category int, year int, year_lo int, year_hi int")).collect()}
    assert len(got) == len(left)
    words = lambda t: set((t or "").split()) - set(STOP_WORDS)
    hits = 0
    for i, t, p in left:
        mine, pool = words(t), [r for r in right if r[2] == p]
        pool = [r for r in pool if r[1] == (t or "")] or pool
        score = lambda r: len(mine & words(r[1])) / len(mine) if mine else 1.0
        best = max(map(score, pool))
        rank = lambda r: (r[3] != 0, not (r[4] is not None and r[5] <= r[4] <= r[6]), r[0])
        want = min((r for r in pool if score(r) >= best - 0.05 - 1e-12), key=rank) if best >= 0.6 else None
        assert got[i].match_id == (want and want[0]), (t, got[i], want)
        hits += want is not None
    assert 30 < hits < len(left)


def test_candidates_thin_out_as_names_share_more_words(spark):
    """Titles of six words out of 92: keys of several words leave far fewer candidates than single words."""
    rng = random.Random(2)
    rows = [(" ".join(rng.sample([f"w{i}" for i in range(92)], 6)),) for _ in range(600)]
    names = spark.createDataFrame(rows, "t string").select(F.split("t", " ").alias("kw"), "t")
    keyed = lambda k: names.select("t", F.explode(M._subsets(F.col("kw"), k)).alias("key"))
    shares = [keyed(k).join(keyed(k).withColumnRenamed("t", "u"), "key").select("t", "u").distinct().count() / 600 ** 2 for k in (1, 2, 3)]
    assert shares[0] > 0.3 and shares[1] < 0.08 and shares[2] < 0.01
