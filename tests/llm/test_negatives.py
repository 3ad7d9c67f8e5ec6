import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import duck, same
from pricelens.llm import negatives as N
from pricelens.llm.common import table
from pricelens.llm.queries import QUERIES
from pricelens.llm.vectors import LIMIT

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("largest,length", [(1, 1), (255, 64), (40_000, 64), (LIMIT, 64), (LIMIT, 100), (1000, 300)])
def test_products_are_exact(largest, length):
    rng = np.random.default_rng(length)
    a = rng.integers(-largest, largest + 1, (40, length))
    b = rng.integers(-largest, largest + 1, (60, length))
    a[0], b[0], a[1], b[1] = largest, largest, -largest, largest
    primes = N.primes_for(largest, length)
    want = a.astype(object) @ b.T.astype(object)
    got = N.products([N.residues(a, p) for p in primes], [N.residues(b, p) for p in primes], primes)
    assert (got == want).all()
    assert all(all(p % k for k in range(2, p)) for p in primes) and np.prod([float(p) for p in primes]) > 2.0 * length * largest * largest
    assert max(primes) < 1024 and N.DIMENSIONS * (max(primes) // 2) ** 2 < 1 << 24


def test_window_bounds():
    for s in list(range(-300, 300)) + [10 ** 18 + 7, -(10 ** 18) - 7]:
        low, high = (int(x) for x in N.percent(np.array([s], np.int64), 50, 95) for x in x)
        assert 100 * low >= 50 * s > 100 * (low - 1) and 100 * high <= 95 * s < 100 * (high + 1)


def brute(rows, anchors):
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), label) for i, v, label in rows
            if v is not None and label is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = []
    for a, av, al in rows:
        if a is None or a not in anchors:
            continue
        key = lambda x: (-x[0], float("inf") if x[1] is None else x[1])
        scored = [(int(av @ v), i, label) for i, v, label in rows if i != a]
        for ps, p, _ in sorted((x for x in scored if x[2] == al), key=key)[:5]:
            found = sorted((x for x in scored if x[2] != al and 50 * ps <= 100 * x[0] <= 95 * ps), key=key)[:3]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(found)]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [N.BLOCK_BYTES, 8 * 6 * 4])
def test_matches_brute_force_with_ties_and_blocks(spark, block_bytes):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-0.1, 0.0, 0.1, 0.2, 0.5]) for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [(500 + i, rows[0][1], i % 3) for i in range(30)]           # one common vector
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = result(N.mine_negatives(df, F.col("id") % 20 == 0, block_bytes=block_bytes))
    assert len(got) > 100 and got == brute(rows, {i for i in range(0, 600, 20)})


def test_matches_sql(spark):
    for sf in ("sf0.001", "sf0.1"):
        path = f"/root/testdata/{sf}"
        con = duck()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
        assert len(same(QUERIES["op11_hard_negatives"](spark, path), con, N.QUERY_SQL)) > 100
    assert table(spark, path, "embeddings").count() == 2000


def test_edge_rows(spark):
    v = [0.5] * 8
    rows = [(0, v, 1), (1, v, 1), (2, [0.25] * 8, 1), (3, [0.4] * 8, 2), (4, [0.3] * 8, 0), (5, [0.3] * 8, 2), (6, None, 2), (7, v, None),
            (8, [float("nan")] * 8, 2), (9, [float("inf")] * 8, 2), (10, [None] * 8, 2), (11, [0.4] * 4, 2), (None, [0.4] * 8, 2), (12, [0.2] * 8, 0),
            (3, [0.4] * 8, 2), (50, [], 1), (60, [-0.5] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("slot", F.lit(1))
    usable = [r for r in rows if r[1] is None or len(r[1]) == 8]
    got = result(N.mine_negatives(df, F.col("id") % 10 == 0))
    assert got == brute(usable, {0, 10, 50, 60})
    assert {(r[0], r[1]) for r in got} == {(0, 1), (0, 2)} and [r[3] for r in got if r[1] == 1] == [3, 3, None]
    assert N.mine_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert N.mine_negatives(df, F.col("id") == 999).count() == 0
    alone = spark.createDataFrame([(0, v, 1), (50, v, 2)], SCHEMA)
    assert N.mine_negatives(alone, F.col("id") % 50 == 0).count() == 0
