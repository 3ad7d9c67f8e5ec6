import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricelens.llm import substrings as S
from pricelens.llm.queries import QUERIES
from oracle import duck, same
from rows import docs_of  # noqa: F401


def brute(rows, window):
    """By definition, over (id, text) rows."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p:p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p:p + window])] < i:
                    gone.update(range(p, p + window))
        left = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    got = same(QUERIES["op1_substring_dedup"](spark, d), duck(d), S.QUERY_SQL)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("block,bucket", [(1 << 20, 1 << 20), (300, 200)])
def test_matches_brute_force(spark, docs_of, monkeypatch, block, bucket):
    monkeypatch.setattr(S, "LEAST_BLOCK_BYTES", 200)
    rng = random.Random(block)
    passage = [" ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(4)]
    rows = [(i * 7 % 101, " ".join([*(rng.choice("abcdefgh") for _ in range(rng.randrange(40))), *rng.choice(passage).split()[:rng.randrange(20)],
                                    *(rng.choice("xyz") for _ in range(rng.randrange(9)))])) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(3, rows[5][1]), (3, rows[5][1])]
    got = S.dedup_substrings(docs_of(rows), window=5, block_bytes=block, bucket_bytes=bucket)
    assert digest(got) == brute(rows, 5)
    for r in got.collect():
        assert sum(b - a for a, b in r.intervals) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(r.intervals, r.intervals[1:]))
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_rows_of_one_id_or_text_are_spread(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BLOCK_BYTES", 200)
    passage = " ".join("abcdefgh")
    rows = [(7, f"{passage} only{i}") for i in range(100)] + [(8, passage)] * 100 + [(None, passage)] * 100 + [(3, passage), (9, passage)]
    docs = docs_of(rows)
    per_block = S.blocked(docs.select("doc_id", "text").coalesce(1), 20).groupBy("block").agg(F.count("*").alias("n"), F.sum("times").alias("t")).collect()
    assert max(r.n for r in per_block) <= 20 and sum(r.t for r in per_block) == len(rows)
    assert digest(S.dedup_substrings(docs, window=5, block_bytes=300, bucket_bytes=200)) == brute(rows, 5)


def test_edge_rows(spark, docs_of):
    long_ = " ".join(f"w{i}" for i in range(60_000))
    part = " ".join(f"w{i}" for i in range(100, 140))
    rows = [(1, None), (2, ""), (3, "one two"), (None, part), (None, part), (4, long_), (5, part + " é\x1cx new"), (5, part), (-6, part), (7, "a " * 40), (8, "a " * 40)]
    docs = docs_of(rows).withColumn("block", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = S.dedup_substrings(docs)
    assert digest(got) == brute(rows, 13)
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].n_removed == 40 and by[4].intervals == [[100, 140]] and by[8].n_removed == 40 and by[7].n_removed == 0
    assert S.dedup_substrings(docs.limit(0)).count() == 0
    assert S.dedup_substrings(docs.filter("doc_id = 1")).first().n_words == 0


def test_texts_are_shuffled_once(spark, docs_of):
    df = S.dedup_substrings(docs_of(["a b c"] * 3))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2
