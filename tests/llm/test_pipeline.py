from collections import defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from pricelens.llm import toxicity as T
from pricelens.llm.common import table
from test_chosen_path import brute as near
from test_contamination import words
from test_secrets import brute as secrets
from rows import docs_of  # noqa: F401

D = "/root/testdata/sf0.001"


def grams(w):
    return [tuple(w[i:i + 10]) for i in range(len(w) - 9)]


def test_stages_match_brute_force_versions(spark):
    docs = table(spark, D, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [words(r.text) for r in table(spark, D, "benchmark").collect()]
    assert min(map(len, items)) >= 10
    windows = {g for w in items for g in grams(w)}
    for name, stage in P.STAGES:
        out = stage(spark, docs, D).cache()
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        if name != "mixing":
            assert out.columns == columns
        if name == "toxicity":
            chain = T.fit_chain(docs, table(spark, D, "labels"), T.label_categories())
            assert set(after) == {i for i, r in before.items() if chain.logits(r.text.encode())[1] < chain.thresholds[1]}
        elif name == "jaccard":
            assert set(after) == set(near([(i, r.text) for i, r in before.items()])[1])
        elif name == "decontaminate":
            assert set(after) == {i for i, r in before.items() if not windows & set(grams(words(r.text)))}
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                found = secrets(before[i].text)[-1]
                assert (r.text == before[i].text) == (not found) and r.n_chars == len(r.text)
                assert r.text.count("[REDACTED]") >= (1 if found else 0)
                assert not secrets(r.text)[-1]
        else:
            assert set(after) <= set(before) and all(r.taken > 0 for r in rows)
            taken, target = defaultdict(int), {}
            for r in rows:
                taken[r.source] += r.taken
                target[r.source] = r.target
                assert r.text == before[r.doc_id].text
            assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
        if name not in ("secrets", "mixing"):
            assert all(after[i] == before[i] for i in after)
        before, docs = after, out


def test_run_gives_the_last_stage(spark):
    rows = P.run(spark, D).collect()
    assert rows and {"doc_id", "text", "taken", "shards"} <= set(rows[0].asDict())


def test_stages_take_empty_and_odd_tables(spark, docs_of):
    odd = docs_of([(1, None), (2, ""), (None, "a text without id"), (4, "same text twice"), (4, "same text twice"), (5, "x" * 200_000)])
    odd = odd.withColumn("key", F.lit("clash")).withColumn("size", F.lit(1))
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            stage(spark, docs, D).count()
