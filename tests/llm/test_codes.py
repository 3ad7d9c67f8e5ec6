import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import duck, same
from pricelens.llm import codes as C
from pricelens.llm.common import table
from pricelens.llm.vectors import LIMIT


def brute_codes(v, book):
    """All distances."""
    data = C._split(v, len(book))
    away = ((data[:, :, None, :] - book[:, None, :, :]) ** 2).sum(axis=3)
    return away.argmin(axis=2).T, away.min(axis=2).sum(axis=0)


@pytest.mark.parametrize("n,entries,length", [(1, 1, 64), (5, 3, 64), (100, 64, 64), (2000, 64, 64), (700, 10, 30), (50, 7, 9)])
def test_tree_descent_matches_all_distances(n, entries, length):
    rng = np.random.default_rng(n)
    v = np.floor(256 * rng.normal(0, 0.12, (n, length))).astype(np.int64)
    v[rng.random(n) < 0.2] = v[0]                   # ties, also between entries
    book = C._split(v[rng.integers(0, n, entries)], 16)
    code, error = C.batch_codes(v, book)
    want, distance = brute_codes(v, book)
    assert (code == want).all() and (error == distance).all()
    count, total = C.batch_sums(v, book)
    data = C._split(v, 16)
    for p in range(16):
        assert (count[p] == np.bincount(want[:, p], minlength=entries)).all()
        for e in range(entries):
            assert (total[p, e] == data[p][want[:, p] == e].sum(axis=0)).all()


def test_extreme_components_stay_exact():
    rng = np.random.default_rng(4)
    v = rng.choice([-LIMIT, 0, LIMIT], (300, 64)).astype(np.int64)
    book = C._split(v[:20], 16)
    assert all((a == b).all() for a, b in zip(C.batch_codes(v, book), brute_codes(v, book)))


def test_most_pairs_are_pruned_for_clustered_parts():
    rng = np.random.default_rng(5)
    middle = rng.integers(-10_000, 10_000, (1, 64, 4))
    data = (middle[:, rng.integers(0, 64, 8000)] + rng.integers(-20, 20, (1, 8000, 4)))
    forest = C.grow(data, C.LEAF_POINTS)
    count, _ = C.node_sums(forest, data)
    whole = sum(count[level][nodes].sum() for level, nodes, _ in C.descend(forest, data, C.grow(middle, 1), middle) if level is not None)
    assert whole > 0.9 * 8000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duck()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    if sf == "sf0.001":
        same(C.code_digest(table(spark, path, "embeddings")), con, C.QUERY_SQL)
    else:       # several tasks
        same(C.code_digest(table(spark, path, "embeddings").repartition(5)), con, C.QUERY_SQL)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5] * 16, 1), (3, [0.25] * 16, None), (9, None, 1), (4, [0.1] * 15 + [None], 1), (6, [nan] + [0.1] * 15, 1),
            (7, [inf] + [0.1] * 15, 1), (None, [0.5] * 16, None), (8, [0.1] * 8, 2), (5, [0.5] * 16, 1), (10, [], 3), (11, [-1e30] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("v", F.lit(0)) \
        .withColumn("n", F.lit(1)).withColumn("of", F.lit(1))
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in C.code_digest(df).collect()), key=repr)
    # entries by id: 3, 5, 5 (never wins), 11, null (never wins)
    assert got == sorted([(3, "00" * 16, 0, 0), (5, "01" * 16, 0, 0), (5, "01" * 16, 0, 0), (11, "03" * 16, 0, 0), (None, "01" * 16, 0, 0)], key=repr)
    _, book, length = C.compress(df)
    assert length == 16 and book[0, :, 0].tolist() == [64, 128, 128, -LIMIT, 128]
    text = ",".join(",".join(str(x) for x in (64, 128, 128, -LIMIT, 128)) for _ in range(16))
    assert C.code_digest(df).first().codebooks_sha256 == hashlib.sha256(text.encode()).hexdigest()
    empty = C.code_digest(df.limit(0))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    # parts that do not divide the length
    codes, book, length = C.compress(spark.createDataFrame([(1, [0.1] * 18, 0), (2, [0.2] * 18, 0)], df.select("vec_id", "embedding", "label").schema))
    assert book.shape == (16, 2, 2) and length == 18 and len(C.codebooks_text(book, length).split(",")) == 36
    assert [r.code for r in codes.orderBy("vec_id").collect()] == [[0] * 16, [1] * 9 + [0] * 7]
