import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricelens.llm import mixing as M
from pricelens.llm.common import table
from pricelens.llm.queries import QUERIES
from rows import docs_of  # noqa: F401


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by definition: share, stop the full ones, reshare."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        got = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if got[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return got
        full |= over


def check(rows, n_shards=16):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for source, r in rows:
        size[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
        assert len(r.shards) >= (r.taken > 0) and all(0 <= s < n_shards for s in r.shards)
    want = targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])
    assert all(r.source_size == size[s] for s, r in rows)


def test_targets_are_met_on_documents(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = {r.doc_id: r for r in table(spark, d, "documents").collect()}
        got = M.mix(table(spark, d, "documents"), with_columns=False).collect()
        assert len(got) == len(docs)
        assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text)) for r in got)
        check([(docs[r.doc_id].source, r) for r in got])


def test_reruns_agree(spark):
    d = "/root/testdata/sf0.001"
    assert sorted(QUERIES["op9_source_mixing"](spark, d).collect()) == sorted(QUERIES["op9_source_mixing"](spark, d).collect())


def test_edge_rows(spark, docs_of):
    rng = random.Random(1)
    items = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "é", None, ""])) for i in range(300)]
    items += [(300, None, "empty"), (301, "", "empty"), (None, "x y z", "tiny"), (303, "w " * 60_000, "a"), (5, "dup row", "b"), (5, "dup row", "b")]
    docs = docs_of(items).withColumn("size", F.lit("clash")).withColumn("extra", F.lit(1))
    got = M.mix(docs)
    assert got.columns == [*[c for c in docs.columns if c != "size"], "size", "source_size", "target", "taken", "shards", "shard_order"]
    rows = got.collect()
    assert len(rows) == len(items)
    check([(r.source, r) for r in rows])
    assert M.mix(docs.limit(0)).count() == 0
    none = M.mix(docs.filter("source = 'empty'")).collect()
    assert [(r.taken, r.target) for r in none] == [(0, 0.0)] * 2


def test_split_is_exact_and_spread(spark):
    quotas = {"a": 4000, "b": 90, "c": 1, None: 0, "d": 2500}
    df = spark.createDataFrame(list(quotas.items()), "__source string, quota long")
    for n in (1, 5, 16):
        rows = M.split_quotas(df, n).collect()
        by_source, by_shard = defaultdict(int), defaultdict(int)
        for r in rows:
            assert r.quota >= 0
            by_source[r["__source"]] += r.quota
            by_shard[r.shard] += r.quota
        assert dict(by_source) == quotas and len(by_shard) == n
        mean = sum(quotas.values()) / n
        assert all(abs(v - mean) <= 5 for v in by_shard.values())
        assert all(abs(r.quota - quotas["a"] / n) <= 6 * (quotas["a"] / n) ** 0.5 for r in rows if r["__source"] == "a")


def test_hypergeometric_has_its_mean_and_variance(spark):
    u = (F.col("id") + 0.5) / 2000
    n, k, m = 500, 120, 200
    df = spark.range(2000).select(M.hypergeometric(*[F.lit(x).cast("long") for x in (n, k, m)], u).alias("x"))
    got = df.agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    assert got[0] == pytest.approx(m * k / n, abs=0.05)
    assert got[1] == pytest.approx(m * k / n * (1 - k / n) * (n - m) / (n - 1), rel=0.03)
