import random

import numpy as np
from pyspark.sql import functions as F

from pricelens.llm import toxicity as T
from pricelens.llm.common import table
from rows import docs_of  # noqa: F401

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    train, held = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    chain = T.fit_chain(docs, train, T.label_categories())
    got = T.score(docs, chain).join(held, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 1000
    clean = [r for r in got if not r.toxic]
    assert sum(r.is_toxic for r in clean) <= 0.005 * len(clean)
    toxic = [r for r in got if r.toxic and r.quality and r.lang == "en"]
    assert len(toxic) > 50 and sum(r.is_toxic for r in toxic) >= 0.99 * len(toxic)
    assert sum(r.is_low_quality == (r.quality == 0) for r in got) >= 0.85 * len(got)


def test_held_out_recall_in_every_language(spark, capsys):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = []
    for k in range(3):                   # every labelled toxic document is held out once
        chain = T.fit_chain(docs, labels.filter(f"doc_id % 3 != {k}"), T.label_categories())
        held = labels.filter(f"doc_id % 3 = {k} AND toxic = 1").join(docs.select("doc_id", "lang"), "doc_id")
        got += T.score(docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi"), chain).join(held, "doc_id").collect()
    assert len({r.doc_id for r in got}) > 400
    langs = sorted({r.lang for r in got})
    assert {"de", "en", "es", "fr"} <= set(langs)
    recall = {}
    for good in (1, 0):
        for lang in langs:
            hits = [r.is_toxic for r in got if r.lang == lang and r.quality == good]
            if hits:
                recall[good, lang] = sum(hits), len(hits)
    with capsys.disabled():
        print("\nheld-out recall (quality, language): found, labelled", recall)
    for lang in langs:
        found, n = recall[1, lang]
        assert n > 10 and found >= 0.85 * n, (lang, recall)
    assert any(not good for good, _ in recall)


def test_newton_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(400)]
    y = np.array([float(3 in r or rng.random() < 0.1) for r in rows])
    m = T.fit_linear(rows, np.zeros((400, 0)), y, 30)
    assert 3 in m.words
    x = np.column_stack((T.indicator(rows, m.words), np.ones(400)))
    p = 1 / (1 + np.exp(-x @ m.weights))
    penalty = np.r_[np.full(len(m.words), T.RIDGE), 1e-6]
    assert np.abs(x.T @ (y - p) - penalty * m.weights).max() < 1e-4


def test_threshold_and_one_class():
    assert T.best_threshold(np.array([-2.0, -1.0, 3.0, 5.0]), np.array([0, 0, 1, 1.0])) == 1.0
    assert T.best_threshold(np.zeros(3), np.zeros(3)) == float("inf")
    m = T.fit_linear([np.array([0])] * 4, np.zeros((4, 4)), np.zeros(4), 1)
    assert m.logit(np.zeros((1, 0)), np.zeros((1, 4)))[0] < 0


def test_chain_passes_logits_on_and_edge_rows(spark, docs_of):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.randrange(20, 60)))
    items = [(i, prose() + (" vile" if i % 4 == 0 else "")) for i in range(200)]
    docs = docs_of(items + [(900, None), (901, ""), (None, "so vile"), (902, "x " * 100_000 + "vile"), (0, items[0][1])]).withColumn("p_toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(200)] + [(0, 0, 1), (None, 1, 1), (7, None, 0)], LABELS)
    chain = T.fit_chain(docs, labels, T.label_categories())
    assert len(chain.models[1].weights) == len(chain.models[1].words) + T.RATIOS + 1 + 1
    got = T.score(docs, chain).collect()
    assert len(got) == 205
    assert all(r.is_toxic == (r.doc_id is None or r.doc_id % 4 == 0 and r.doc_id < 200) for r in got if r.doc_id is None or r.doc_id < 200)
    left = T.remove_rejected(docs, chain)
    assert left.columns == docs.columns and left.filter("doc_id < 200").count() == 150
    assert T.score(docs.limit(0), chain).count() == 0
    none = T.fit_chain(docs, labels.limit(0), T.label_categories())
    assert not any(r.is_toxic for r in T.score(docs, none).collect())
    assert T.remove_rejected(docs, none).count() == 205


def test_probabilities_match_a_plain_chain(spark):
    """Every probability from the weights, one document and one word at a time; earlier probabilities are inputs of later models."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    chain = T.fit_chain(table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels"), T.label_categories())
    assert [len(m.weights) - len(m.words) - 1 for m in chain.models] == [T.RATIOS, T.RATIOS + 1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in T.score(docs, chain).collect():
        known, dense = T.read(texts[r.doc_id].encode())
        earlier = []
        for name, m, threshold in zip(chain.categories, chain.models, chain.thresholds):
            z = m.weights[-1]
            for word, weight in zip(m.words, m.weights):
                z += weight if chain.vocabulary[word] in known else 0.0
            for value, weight in zip([*dense, *earlier], m.weights[len(m.words):]):
                z += value * weight
            p = 1 / (1 + np.exp(-z))
            assert abs(r[f"p_{name}"] - p) < 1e-4
            assert abs(z - threshold) < 1e-3 or r[f"is_{name}"] == (z >= threshold)
            earlier.append(p)
