import re
from collections import Counter

from pyspark.sql import functions as F

from pricelens.llm.common import table
from pricelens.llm.quality import line_failure, quality_rules
from rows import docs_of  # noqa: F401

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in quality_rules(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_edge_rows(spark, docs_of):
    sentence = "This is a plain sentence of ten quite ordinary English words."
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(9))
    docs = docs_of([(1, None), (2, ""), (3, " \t\n"), (None, sentence), (5, prose),
                    (5, prose), (7, "w " * 30000), (8, "é \x1c b " * 10)])
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(-1))
    got = quality_rules(docs).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and not by[1].kept and by[1].base_failed
    assert by[5].kept and by[5].n_dup_lines == 0
    assert by[7].n_repeat_words == 30000 and not by[7].kept
    assert by[8].n_words == 20 and by[None].n_words == 11
    assert quality_rules(docs.limit(0)).count() == 0


def test_line_rules():
    assert line_failure("Home | About | Products | Contact | Login") == "navigation"
    assert line_failure("Please read our privacy policy here.") == "boilerplate"
    assert line_failure("wh*** reed&&& the%%% on$$$") == "noise"
    assert line_failure("Ha. Ha. Ha. Ha. Ha.") == "noise"
    assert line_failure("no end of sentence here at all") == "punctuation"
    for good in ("A sentence.", "", "He said “yes.”", "What? (Really!)", "See:", "a | b is a pipe in prose.", "One sentence. Call 555 0101"):
        assert line_failure(good) is None


def test_rejects_documents_losing_too_much(spark, docs_of):
    menu = "Home | News | Shop | Help | About %d"
    def text(n):
        return [" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(n)]
    docs = docs_of([(1, "\n".join(text(6))), (2, "\n".join(text(2) + [menu % i for i in range(20)])),
                    (3, "\n".join(text(20) + [menu % 1]))])
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert got[1].kept and not got[2].kept and got[3].kept
    assert got[3].n_navigation_lines == 1 and "Home" not in got[3].clean_text


def test_keeps_clean_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    got = quality_rules(table(spark, d, "documents"), with_text=False).join(table(spark, d, "labels"), "doc_id")
    clean = got.filter("quality = 1 and not base_failed")
    assert clean.filter("not kept").count() <= 0.01 * clean.count()
