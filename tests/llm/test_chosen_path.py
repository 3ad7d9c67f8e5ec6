import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import chosen_path as C
from pricelens.llm import components as parts
from pricelens.llm.common import table
from pricelens.llm.components import components
from pricelens.session import checkpoint
from rows import docs_of  # noqa: F401


def shingles(text):
    return frozenset(C.ngrams((text or "").encode()).tolist())


def brute(rows, threshold=0.8):
    """All linked pairs of rows (by place) and the smallest id of each row's component, by definition."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links.append((i, j))
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    ids = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return links, [ids[find(i)] for i in range(len(rows))]


def unheld(got, rows, links):
    """Checks representatives and pairs of a result over unique ids; returns the links that it does not hold."""
    by = {r.doc_id: r for r in got}
    sets = {i: shingles(t) for i, t in rows}
    assert len(by) == len(got) == len(rows)

    def linked(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    members = {}
    for r in got:
        assert r.rep_id == r.copy_id or linked(r.doc_id, r.rep_id)
        assert not r.linked_reps or r.rep_id == r.copy_id
        assert sets[r.doc_id] == sets[r.copy_id] and by[r.rep_id].rep_id == r.rep_id
        members.setdefault(r.rep_id, []).append(r.doc_id)
    for r in got:
        for other in r.linked_reps:
            assert r.copy_id in by[other].linked_reps and by[other].class_id == r.class_id
            assert any(linked(x, y) for x in members[r.copy_id] for y in members[other])
    lost = []
    for i, j in links:
        a, b = by[rows[i][0]], by[rows[j][0]]
        if a.rep_id != b.rep_id and b.rep_id not in by[a.rep_id].linked_reps:
            lost.append((rows[i][0], rows[j][0]))
    return lost


def corpus(rng, n=60, family=12):
    word = lambda: "w%d" % rng.randrange(400)
    rows = []
    passage = [word() for _ in range(25)]
    for i in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 60, 120]))] + (passage if i % 2 else [])
        for _ in range(rng.choice([1, 1, family])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("bucket,group", [(256, 1024), (4, 5), (8, 3)])
def test_matches_all_pairs(spark, docs_of, bucket, group):
    rows = corpus(random.Random(11))
    got = C.jaccard_join(docs_of(rows), recall=0.9999, bucket_sets=bucket, last_sets=bucket, group_sets=group).collect()
    links, classes = brute(rows)
    assert len(links) > 150
    assert unheld(got, rows, links) == []
    assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in zip(rows, classes)}


@pytest.mark.parametrize("pivots", [64, 4])
def test_large_group_of_near_copies(spark, docs_of, monkeypatch, pivots):
    """A base text with few to many changes, a second base, and pairs that share rare changes."""
    monkeypatch.setattr(C, "PIVOTS", pivots)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    second = [w if i % 9 else f"s{i}" for i, w in enumerate(base)]
    rows = []
    for i in range(260):
        text = list(base if i % 4 else second)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            text[rng.randrange(150)] = f"x{rng.randrange(100_000)}"
        rows.append((len(rows), " ".join(text)))
        if i % 6 == 0:                          # a copy with one more change
            text[rng.randrange(150)] = "y"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    links, classes = brute(rows)
    assert len(links) > 2000 and 10 < len(set(classes)) < 200
    got = C.jaccard_join(docs_of(rows), recall=0.9999, bucket_sets=16, last_sets=16, group_sets=24)
    out = got.collect()
    assert unheld(out, rows, links) == []
    assert {r.doc_id: r.class_id for r in out} == {i: c for (i, _), c in zip(rows, classes)}
    kept = {r.doc_id for r in C.keep_one_of_each(docs_of(rows), recall=0.9999, bucket_sets=16, last_sets=16, group_sets=24).collect()}
    assert kept == set(classes)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_documents(spark, sf):
    """All against all on the smaller table, ids divisible by 10 against all rows on the larger."""
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = C.jaccard_join(docs).collect()
    if sf == "sf0.01":
        links, classes = brute(rows)
        if not unheld(got, rows, links):
            assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in zip(rows, classes)}
    else:
        sets, holders, links = [shingles(t) for _, t in rows], {}, []
        for i, s in enumerate(sets):
            for g in s:
                holders.setdefault(g, []).append(i)
        for i, (doc_id, _) in enumerate(rows):
            if doc_id % 10 == 0:
                near = {j for g in sets[i] for j in holders[g] if j != i}
                links += [(i, j) for j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    by = {r.doc_id: r for r in got}
    held = sum(by[rows[i][0]].rep_id == by[rows[j][0]].rep_id or by[rows[j][0]].rep_id in by[by[rows[i][0]].rep_id].linked_reps for i, j in links)
    different = sum(by[rows[i][0]].copy_id != by[rows[j][0]].copy_id for i, j in links)
    print(f"{sf}: {held} of {len(links)} links, {different} between different texts")
    assert len(links) > 100 and held >= 0.99 * len(links)
    if sf == "sf0.01":
        assert {r.doc_id for r in C.keep_one_of_each(docs).collect()} == {r.class_id for r in got}


def test_edge_rows(spark, docs_of):
    t = " ".join(f"x{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, "..."), (None, t), (5, t), (4, t.upper()), (4, t.upper()), (7, "two words"), (8, "two words"), (None, "alone here now"),
            (None, "alone here now"), (9, t + " more"), (10, "y " * 50_000), (11, "z"), (2, "")]
    docs = docs_of(rows).withColumn("key", F.lit("clash")).withColumn("class_id", F.lit(1)).withColumn("__row", F.lit(2))
    got = C.jaccard_join(docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.class_id, r.copy_id, r.rep_id, r.linked_reps, r.n_copies))
    assert sum(map(len, by.values())) == len(rows)
    assert by[1] == [(1, 1, 1, [], 0)] and by[2] == [(2, 2, 2, [], 0)] * 2 and by[11] == [(11, 11, 11, [], 0)]
    # either of two linked texts may represent the other
    rep = by[9][0][2]
    assert rep in (4, 9) and by[4] == [(4, 4, rep, [], 3)] * 2 and by[5] == [(4, 4, rep, [], 3)] and by[9] == [(4, 9, rep, [], 0)]
    assert by[7] == [(7, 7, 7, [], 1)] and (None, None, None, [], 1) in by[None] and (4, 4, rep, [], 3) in by[None]
    kept = C.keep_one_of_each(docs)
    assert kept.columns == [c for c in docs.columns if c != "__row"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 2, 3, 4, 7, None, 10, 11], key=repr)
    assert C.jaccard_join(docs.limit(0)).count() == 0 and C.keep_one_of_each(docs.limit(0)).count() == 0
    # rows that repeat an id and a text but differ elsewhere: one stays
    twice = docs_of([(1, t), (1, t), (1, t)]).withColumn("other", F.monotonically_increasing_id())
    assert C.keep_one_of_each(twice).count() == 1


def test_runs_and_signatures():
    assert C.runs_for(0.99, 0.8, 1) < C.runs_for(0.99, 0.8, 6) <= 10
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    equal = np.mean([np.mean(C.signature(a[i:]) == C.signature(b[i:])) for i in range(0, 200, 10)])
    assert abs(equal - 0.78) < 0.08
    both = C.overlaps([a, b, a[:10]])
    assert both[0, 1] == 800 and both[2, 0] == 10 and both[1, 1] == len(b)
    like, foreign = C.links_between([a, b], [a[:10], b, a[:0]])
    assert like[0, 0] == 10 / 900 and like[1, 1] == 1 and like[1, 0] == 800 / 1000 and like[2].tolist() == [0, 0]
    assert not len(foreign[1]) and not len(foreign[0])
    assert C.represent(np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], bool)).tolist() == [1, 1, 1]


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_runs_that_share_coordinates_reach_the_recall(levels):
    rng = np.random.default_rng(levels)
    n, k = 100_000, C.COORDINATES
    agree = rng.binomial(k, 0.8, n)
    found = np.zeros(n, bool)
    for _ in range(C.runs_for(0.99, 0.8, levels)):
        nodes = np.ones(n, int)              # nodes that both sets of a pair reach
        for _ in range(levels):
            double = rng.binomial(nodes, 1 / 0.8 - 1)
            nodes = rng.binomial(nodes + double, agree / k)
        found |= nodes > 0
    assert found.mean() >= 0.99 - 0.001


def test_deep_trees_find_pairs_at_the_threshold(spark, docs_of):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        # 90 n-grams, of which 10 hold the changed words: similarity 80 / 100
        a = [f"w{i}x{j}" for j in range(94)]
        b = [f"c{w}" if j in (20, 60) else w for j, w in enumerate(a)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    rng.shuffle(rows)
    got = C.jaccard_join(docs_of(rows), bucket_sets=1, last_sets=1)
    assert got.groupBy("rep_id").count().filter("count = 2").count() * 2 >= 0.98 * len(rows)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_components_join_every_edge_twice_a_round(spark, monkeypatch):
    """Stars are not joined at all; a round that is needed has one join for each of its two steps."""
    joins = []

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return checkpoint(df)
    monkeypatch.setattr(parts, "checkpoint", counted)
    stars = [(i, i % 3) for i in range(3, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: i % 3 for i in range(60)} and sum(joins) == 0
    path = [(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 101), (101, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} and max(joins) == 1 and sum(joins) % 2 == 0


def test_signatures_are_joined_once_a_level(docs_of, monkeypatch):
    """The children of large nodes are counted and met with their counts: what made them is done once."""
    joins = []

    def counted(df):
        if df.columns == ["path", "key", "n"]:
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return checkpoint(df)
    monkeypatch.setattr(C, "checkpoint", counted)
    base = ["w%d" % i for i in range(60)]
    texts = [(i, " ".join([*base, "x%d" % i])) for i in range(40)]
    got = C.jaccard_join(docs_of(texts), bucket_sets=4).collect()
    assert {r.class_id for r in got} == {0} and len(joins) > 2 and set(joins) == {1}
