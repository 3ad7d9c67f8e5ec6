import os

import pytest
from pyspark.sql import functions as F

from pricelens.llm.common import table
from pricelens.llm.tokens import VOCABULARY, Automaton, greedy_count, load_vocabulary, token_counts
from rows import docs_of  # noqa: F401

PIECES = [bytes([b]) for b in range(256)] + [b" a", b" ab", b"abc", b" abcde", b"bc", b"cd", b"def", b"aaaa", b"aa"]


def test_automaton_matches_greedy_on_all_small_words():
    auto, pieces = Automaton(PIECES), set(PIECES)
    words = [b""]
    for _ in range(6):
        words = [w + bytes([c]) for w in words for c in b"abcd"] + [b""]
        for w in words:
            assert auto.count(b" " + w) == greedy_count(b" " + w, pieces), w


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
def test_counts_match_brute_force_on_documents(spark):
    vocabulary = load_vocabulary()
    pieces, memo = set(vocabulary), {}
    longest = max(map(len, pieces))

    def greedy(word):
        n = 0
        while word:
            k = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces)
            word, n = word[k:], n + 1
        return n

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(docs, vocabulary).collect()}
    for r in docs.collect():
        words = r.text.encode().split()
        for w in words:
            if w not in memo:
                memo[w] = greedy(b" " + w)
        assert got[r.doc_id] == (len(words), sum(memo[w] for w in words))


def test_edge_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "ab"), (4, "abc " * 50_000), (5, "x" * 100_000), (6, "\U0001f600 é"), (6, "\U0001f600 é")])
    docs = docs.withColumn("n_tokens", F.lit("clash"))
    got = token_counts(docs, PIECES).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7
    assert (by[1].n_tokens, by[2].n_words, by[1].n_bytes) == (0, 0, 0)
    assert by[None].n_tokens == 1 and by[4].n_tokens == 50_000 * 2 and by[5].n_tokens == 100_001
    assert by[6].n_tokens == 5 + 3
    assert token_counts(docs.limit(0), PIECES).count() == 0
