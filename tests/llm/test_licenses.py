import re

from pyspark.sql import functions as F

from pricelens.llm import licenses as L
from pricelens.llm.common import table
from pricelens.llm.queries import QUERIES
from rows import docs_of  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """Base places by definition; all rules on every text; containment by comparing all pairs."""
    w = words(text)
    places = [(i, label) for phrase, label in L.BASE_PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    plain = " " + " ".join(w) + " "
    found = []
    for place, s in enumerate(L.SIGNATURES):
        for m in re.finditer(" " + s.pattern + "(?= )", plain):
            start = plain[:m.start()].count(" ")
            found.append((start, start + m[0].count(" "), s.priority, place, s))
    kept = [d for d in found if not any(
        o is not d and o[0] <= d[0] and o[1] >= d[1] and (
            o[2] < d[2] or o[2] == d[2] and (o[1] - o[0] > d[1] - d[0] or (o[:2] == d[:2] and o[3] < d[3]))) for o in found)]
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {d[4].label for d in kept})), max([d[4].relevance for d in kept], default=0.0))


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


SAMPLES = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "CC BY cc-by CC/BY 4.0 and CC BY-NC 4.0", "The MIT License (MIT)\nCopyright (c) 2020 X\nPermission is hereby granted, free of charge, to any person obtaining a copy",
    "SPDX-License-Identifier: GPL-3.0-or-later", "mitlicense mit licenses apache", "x" * 50 + " BSD 3-Clause License é GNU Lesser General Public License",
    "dedicated to the public domain. All rights reserved.", "MİT License K", "mit license " * 300]


def test_there_are_hundreds_of_rules_and_each_holds_its_keyword():
    assert len(L.SIGNATURES) > 200
    for s in L.SIGNATURES:
        re.compile(s.pattern)


def test_samples_match_brute_force(spark, docs_of):
    got = L.license_scan(docs_of(SAMPLES)).collect()
    for r in got:
        assert row(r) == brute(SAMPLES[r.doc_id]), SAMPLES[r.doc_id][:80]
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "gpl,gpl-3.0" and by[1].score == 1.0
    assert {"cc-by", "cc-by-nc", "cc-by-4.0"} <= set(by[2].labels.split(","))
    assert by[9].n_base == 300 and by[9].last_word == 598


SHORT = {"This is under the GPL.": "gpl", "LGPL v2.1 applies": "lgpl-2.1", "see AGPL-3.0 here": "agpl-3.0", "MPL-2.0 code": "mpl-2.0",
         "(EPL-2.0)": "epl-2.0", "released under the MPL": "mpl", "epl table and mpl unit": "",
         "this product includes software developed by the OpenSSL Project": "openssl"}


def test_short_names_and_notices(spark, docs_of):
    texts = list(SHORT)
    for r in L.license_scan(docs_of(texts)).collect():
        assert row(r) == brute(texts[r.doc_id])
        assert SHORT[texts[r.doc_id]] in r.labels.split(","), (texts[r.doc_id], r.labels)


def test_work_grows_with_the_hits_not_their_square(spark, docs_of):
    import time
    text = "licensed under the mit license and apache license version 2 0 "
    took = []
    for n in (2000, 8000):
        docs = docs_of([text * n])
        L.license_scan(docs).collect()
        start = time.time()
        r = L.license_scan(docs).collect()[0]
        took.append(time.time() - start)
        assert r.n_base == 2 * n and r.last_word == 11 * n - 5 and len(r.licenses) >= 2 * n
    assert took[1] < 8 * took[0] + 1


def test_query_matches_brute_force(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
        got = QUERIES["op5_license_scan"](spark, d).collect()
        assert len(got) == len(texts) and any(r.n_base for r in got)
        for r in got:
            assert row(r) == brute(texts[r.doc_id]), r.doc_id


def test_edge_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "..."), (None, "mit license"), (5, "cc by"), (5, "cc by"),
                    (6, "word " * 100_000 + "apache license")]).withColumn("labels", F.lit("clash")).withColumn("words", F.lit(1))
    got = L.license_scan(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7
    assert [row(by[i]) for i in (1, 2, 3)] == [(0, 0, None, None, "", "", 0.0)] * 3
    assert by[None].base_labels == "mit" and by[6].first_word == by[6].last_word == 100_000
    assert L.license_scan(docs.limit(0)).count() == 0
