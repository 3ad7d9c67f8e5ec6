import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pricelens.llm import language as L
from pricelens.llm.common import table
from rows import docs_of  # noqa: F401


def plain_counts(text):
    """Bucket counts by definition, one n-gram at a time."""
    s = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = "\0" + "\0".join(s) + "\0" if s else ""
    found = Counter()
    for n in L.SIZES:
        for i in range(len(s) - n + 1):
            gram = s[i:i + n]
            if n == 1 and gram == "\0":
                continue
            h = 0
            for k, c in enumerate(gram):
                h = ((h ^ ord(c)) * int(L._MIX[k])) & 0xFFFFFFFF
                h ^= h >> 15
            found[((h + n * int(L._MIX[0])) & 0xFFFFFFFF) >> 18] += 1
    return found


def test_counts_match_plain_loop(monkeypatch):
    texts = ["", "a", "Ab c", "été! l'eau", "x" * 50, "日本 text 1 2", "..", "ß\U0001f600İ"]
    for block in (1 << 18, 3):
        monkeypatch.setattr(L, "BLOCK_CHARS", block)
        for t in texts:
            term, times = L.term_counts(t.encode())
            assert dict(zip(term.tolist(), times.tolist())) == dict(plain_counts(t)), t
    assert len(L.term_counts(None)[0]) == 0


def test_prediction_matches_plain_cosine(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = L.fit(docs)
    assert model.languages == sorted(r.lang for r in docs.select("lang").distinct().collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    # the idf of all documents
    df = Counter()
    for t in texts.values():
        df.update(set(plain_counts(t)))
    n = sum(any(c.isalpha() for c in t) for t in texts.values())
    assert all(abs(model.idf[b] - (np.log((1 + n) / (1 + df[b])) + 1)) < 1e-9 for b in range(L.BUCKETS))
    centroids = {c: dict(zip(np.flatnonzero(model.centroids[:, c]), model.centroids[:, c][model.centroids[:, c] != 0])) for c in range(len(model.owner))}
    for r in L.identify(docs, model).collect():
        x = {b: (1 + np.log(k)) * model.idf[b] for b, k in plain_counts(texts[r.doc_id]).items()}
        size = np.sqrt(sum(w * w for w in x.values()))
        if not x:
            assert (r.nearest, r.score, r.language) == ("und", 0.0, None)
            continue
        cosine = [sum(w * centroids[c].get(b, 0.0) for b, w in x.items()) / size for c in centroids]
        assert abs(max(cosine) - r.score) < 1e-4
        assert max(cosine) - max(v for v, o in zip(cosine, model.owner) if model.languages[o] == r.nearest) < 1e-4
        if abs(r.score - model.least[model.languages.index(r.nearest)]) > 1e-4:
            assert (r.language is None) == (r.score < model.least[model.languages.index(r.nearest)])


def test_held_out_accuracy_and_rejection(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = L.language_digest(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    for lang in ("de", "en", "es", "fr"):
        own = [r for r in got if r.held_out and r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.97 * len(own)
    held = [r for r in got if r.held_out]
    assert sum(r.rejected for r in held) <= 0.05 * len(held)
    # a language that was never learned is far from all centroids
    rng = random.Random(1)
    strange = [(i, " ".join("".join(rng.choice("кгжщъыбюя") for _ in range(6)) for _ in range(40))) for i in range(20)]
    model = L.fit(docs.filter(~L.held_out()))
    assert all(r.language is None for r in L.identify(spark.createDataFrame(strange, "doc_id long, text string"), model).collect())


def test_lang_source_and_id_are_no_inputs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = L.fit(docs.filter(~L.held_out()))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")})
    a = {r.doc_id: (r.nearest, r.score) for r in L.identify(docs, model).collect()}
    assert {-r.doc_id: (r.nearest, r.score) for r in L.identify(changed, model).collect()} == a
    # what is held out teaches nothing
    other = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    b = {r.doc_id: (r.lang_pred, r.score) for r in L.language_digest(other).collect()}
    assert b == {r.doc_id: (r.lang_pred, r.score) for r in L.language_digest(docs).collect()}


def test_edge_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "12 ..."), (None, "the cat"), (5, "the cat"), (5, "the cat"), (6, "word " * 100_000), (7, "x")]
    docs = docs_of(rows).withColumn("nearest", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("term", F.lit(1))
    got = L.language_digest(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3))
    assert all(by[i].lang_pred == "en" for i in (None, 5, 6, 7)) and by[None].held_out is False
    assert L.language_digest(docs.limit(0)).count() == 0
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.language_digest(untaught).collect()} == {("und", 0.0)}


def test_centroids_split_clusters():
    rng = np.random.default_rng(3)
    x = np.abs(np.repeat(np.eye(3, 40, dtype=np.float32), 20, axis=0) + rng.normal(0, 0.02, (60, 40)).astype(np.float32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = L.cluster(x, 3)
    assert sorted(found.argmax(axis=1).tolist()) == [0, 1, 2]
    assert len(L.cluster(x[:1], 4)) == 1 and len(L.cluster(np.repeat(x[:1], 5, axis=0), 4)) == 1
