import random
import re

from pyspark.sql import functions as F

from pricelens.llm import contamination as C
from pricelens.llm.queries import QUERIES
from oracle import duck, same
from rows import docs_of  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w, hit, ids, longest = words(text), set(), set(), 0
    for name, item in items:
        x = words(item)
        n = min(window, len(x))
        grams = {tuple(x[j:j + n]) for j in range(len(x) - n + 1)} if x else set()
        for p in range(len(w) - n + 1 if x else 0):
            if tuple(w[p:p + n]) in grams:
                hit.update(range(p, p + n))
                ids.add(name)
        for p in range(len(w)):
            for j in range(len(x)):
                k = 0
                while p + k < len(w) and j + k < len(x) and w[p + k] == x[j + k]:
                    k += 1
                longest = max(longest, k if k >= n else 0)
    return len(w), len(hit), sorted(ids), longest


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    got = same(QUERIES["op8_suffix_decontamination"](spark, d), duck(d), C.QUERY_SQL)
    assert any(r[0] for r in got)


def test_matches_brute_force(spark, docs_of):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdef")
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    items = [(str(i % 9), " ".join(word() for _ in range(rng.choice([0, 2, 5, 8, 12])))) for i in range(14)] + [("x", texts[0]), ("y", texts[1] + " zz")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for part in (1 << 20, 60):
        got = {r.doc_id: r for r in C.contamination(docs_of(texts), bench, window=4, part_bytes=part).collect()}
        for i, t in enumerate(texts):
            r = got[i]
            assert (r.n_words, r.n_hit, r["items"], r.longest_match) == brute(t, items, 4), (part, i, t)
            assert r.contaminated == (r.n_hit > 0) and sum(b - a for a, b in r.spans) == r.n_hit
            if r.longest_match:
                owners = [words(t)[r.longest_item_start:r.longest_item_start + r.longest_match] for n, t in items if n == r.longest_item]
                assert words(t)[r.longest_doc_start:r.longest_doc_start + r.longest_match] in owners
        left = {r.doc_id for r in C.remove_contaminated(docs_of(texts), bench, window=4, part_bytes=part).collect()}
        assert left == {i for i in got if not got[i].contaminated}


def test_edge_rows(spark, docs_of):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = docs_of([(1, None), (2, ""), (None, "A " + passage.upper() + " b"), (4, "filler " * 100_000 + passage), (5, passage), (5, passage),
                    (6, passage[:-4])]).withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame([(1, passage), (1, "short item"), (2, None), (None, ""), (3, passage)], "item_id long, text string")
    got = C.contamination(docs, bench).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].n_words == by[2].n_hit == 0
    assert by[None].n_hit == 12 and by[None]["items"] == ["1", "3"] and by[None].longest_doc_start == 1
    assert by[4].n_hit == 12 and by[4].longest_doc_start == 100_000
    assert by[6].n_hit == 11 and by[6].longest_match == 11
    assert C.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in C.contamination(docs, bench.limit(0)).collect()} == {0}
    kept = C.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2}
