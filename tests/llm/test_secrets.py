import hashlib
import re

from pyspark.sql import functions as F

from pricelens.llm import secrets as S
from pricelens.llm.common import table
from pricelens.llm.queries import QUERIES
from oracle import duck, same
from rows import docs_of  # noqa: F401


def brute(text):
    """Base kinds by their definition, others by their pattern."""
    text, spans = text or "", []
    base = [("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
             lambda m: len(m[1]) >= 8),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    more = [(r.kind, re.compile(r.pattern), lambda m: True) for r in S.METHOD_RULES]
    for i, (kind, rx, ok) in enumerate(base + more):
        spans += [(m.start(), i, m.end(), kind) for m in rx.finditer(text) if ok(m)]
    spans.sort()
    join = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in xs)
    return (*(sum(k == kind for *_, k in spans) for kind in ("assign", "access", "hex")),
            hashlib.sha256(join([s for s in spans if s[1] < 3]).encode()).hexdigest(), join(spans))


SAMPLES = [
    'say Password = "hunter2hunter2" and token:abc, SECRET: "short" api_key=AAAABBBBCCCC',
    "token: secret: abcdefghij", "password=token=abcdefgh", "é\U0001f600 api-key=12345678 APIKEY='x/y+z=12345' passwd :  q1234567",
    "AKIAABCDEFGHIJKL AKIAABC AKIAAKIA0123456789", "f" * 31, "deadbeef" * 4, "g" + "0a" * 40 + "z" + "ab" * 16,
    "ghp_" + "a1B2" * 9, "xoxb-12345-abcde", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJ_-x",
    "https://user:pw@host/ Bearer abcdefghijklmnopqrstuv sk-" + "a" * 40, "AIza" + "A" * 35 + " sk_live_" + "9" * 20,
    "npm_" + "a" * 36 + " SG." + "a" * 20 + "." + "b" * 20, "password: Key token=ſecretsecret",
    "secret\n=\n12345678 secret =12345678\n", "token=" + "A" * 100_000]


def test_samples_match_brute_force(spark, docs_of):
    got = S.digest(docs_of(SAMPLES)).collect()
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == brute(SAMPLES[r.doc_id]), SAMPLES[r.doc_id][:80]
    assert sum(r.n_assign for r in got) > 6


def test_query_matches_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.001"
    same(QUERIES["op3_secret_scan"](spark, d), duck(d), S.QUERY_SQL)
    texts = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    for r in QUERIES["op3_secret_scan"](spark, d).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == brute(texts[r.doc_id])


def test_trigram_queries():
    assert S.trigram_query("AKIA[A-Z0-9]{12,}") == [[frozenset({"aki", "kia"})]]
    assert S.trigram_query("[0-9a-f]{32,}") == []
    assert S.trigram_query("ab[xy]c+") == [sorted([frozenset({"abx"}), frozenset({"aby"})], key=sorted)]
    assert S.trigram_query("(?:foo|ba)+z") == []
    assert S.trigram_query("(?:abc|d+)xyz") == [[frozenset({"xyz"})]]
    assert len(S.trigram_query(S.BASE_RULES[0].pattern)[0]) >= 6


def test_every_match_satisfies_its_trigram_query():
    for text in SAMPLES:
        for rule in S.RULES:
            if re.search(rule.pattern, text):
                low = text.lower()
                assert all(any(all(t in low for t in alt) for alt in g) for g in S.trigram_query(rule.pattern)), (rule, text[:60])


def test_candidates_come_from_the_index(spark, docs_of):
    got = {r["__key"]: set(r["__rules"]) for r in S.candidates(docs_of(["a password here", "pass word", "AKIA x", ""]), chunk_docs=2).collect()}
    assert got == {0: {0}, 2: {1}}


def test_edge_rows_and_redaction(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "token=abcdefgh!"), (4, "clean text"), (4, "api_key=abcdefgh"), (4, "api_key=abcdefgh"),
                    (None, "é\U0001f600 " + "ab" * 20 + " end password=" + "0a" * 20 + ".")]).withColumn("spans", F.lit("clash")).withColumn("__key", F.lit(1))
    got = S.digest(docs).collect()
    assert len(got) == 7 and sorted(r.n_assign for r in got) == [0, 0, 0, 1, 1, 1, 1]
    assert S.digest(docs.limit(0)).count() == 0
    out = S.redact(docs)
    assert out.columns == [c for c in docs.columns if c != "__key"]
    texts = sorted((r.text or "", r.n_chars or 0) for r in out.collect())
    assert ("é\U0001f600 [REDACTED] end [REDACTED]", 28) in texts and texts.count(("[REDACTED]", 10)) == 2
    assert ("[REDACTED]!", 11) in texts and ("clean text", 10) in texts
