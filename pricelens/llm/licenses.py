"""License scan with ordered signature rules.

A text is brought to lower-case words with one blank between them.  A keyword
prefilter picks the rules that can match at all; each of these is a regular
expression over the words.  Of overlapping detections, one that lies within
another of the same or a higher priority is dropped.

Everything happens within a document, in DataFrame functions: one pass, no
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import let, running

# The phrases whose places are counted, and their labels (fixed values).
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_VERSION = r"(?: (?:version|v) ?\d+(?: \d+)?| v?\d+(?: \d+)?)?(?: or (?:any )?later(?: version)?)?"

# label: (keyword every form contains, names as patterns over lower-case words).
# A form without an own keyword is found by the label's first word.
NAMES: dict[str, tuple[str, tuple[str, ...]]] = {
    "gpl": ("gnu", (r"gnu general public license", r"gnu gpl")),
    "gpl-2.0": ("2", (r"gnu general public license (?:version |v ?)?2(?: 0)?", r"gpl (?:version |v ?)?2(?: 0)?", r"gplv2")),
    "gpl-3.0": ("3", (r"gnu general public license (?:version |v ?)?3(?: 0)?", r"gpl (?:version |v ?)?3(?: 0)?", r"gplv3")),
    "lgpl": ("gnu l", (r"gnu lesser general public license", r"gnu library general public license", r"gnu lgpl")),
    "agpl": ("gnu a", (r"gnu affero general public license", r"gnu agpl")),
    "fdl": ("gnu free", (r"gnu free documentation license",)),
    "apache": ("apache", (r"apache license", r"apache software license", r"apache public license")),
    "apache-2.0": ("apache", (r"apache license (?:version |v ?)?2(?: 0)?", r"apache 2(?: 0)?")),
    "apache-1.1": ("apache", (r"apache (?:software )?license (?:version |v ?)?1 1",)),
    "mit": ("mit", (r"mit license", r"mit x11 license", r"expat license mit")),
    "mit-0": ("mit", (r"mit no attribution(?: license)?", r"mit 0")),
    "bsd": ("bsd", (r"bsd license", r"bsd style license", r"berkeley software distribution bsd license")),
    "bsd-2-clause": ("bsd", (r"(?:simplified|freebsd) bsd license", r"bsd 2 clause(?: license)?", r"2 clause bsd(?: license)?")),
    "bsd-3-clause": ("bsd", (r"(?:new|modified|revised) bsd license", r"bsd 3 clause(?: license)?", r"3 clause bsd(?: license)?")),
    "bsd-4-clause": ("bsd", (r"original bsd license", r"bsd 4 clause(?: license)?", r"4 clause bsd(?: license)?")),
    "isc": ("isc", (r"isc license",)),
    "mpl": ("mozilla", (r"mozilla public license",)),
    "mpl-1.1": ("mozilla", (r"mozilla public license (?:version |v ?)?1 1",)),
    "mpl-2.0": ("mozilla", (r"mozilla public license (?:version |v ?)?2(?: 0)?",)),
    "epl": ("eclipse", (r"eclipse public license",)),
    "epl-2.0": ("eclipse", (r"eclipse public license (?:version |v ?)?2(?: 0)?",)),
    "cddl": ("common development", (r"common development and distribution license",)),
    "cpl": ("common public", (r"common public license",)),
    "artistic": ("artistic", (r"artistic license", r"perl artistic license")),
    "artistic-2.0": ("artistic", (r"artistic license (?:version |v ?)?2(?: 0)?",)),
    "boost": ("boost", (r"boost software license",)),
    "zlib": ("zlib", (r"zlib license", r"zlib libpng license")),
    "unlicense": ("unlicense", (r"(?:the )?unlicense",)),
    "wtfpl": ("wtfpl", (r"wtfpl", r"do what the fuck you want to public license wtfpl")),
    "psf": ("python", (r"python software foundation license", r"python license")),
    "eupl": ("european", (r"european union public licen[cs]e",)),
    "ms-pl": ("microsoft public", (r"microsoft public license",)),
    "ms-rl": ("microsoft reciprocal", (r"microsoft reciprocal license",)),
    "ofl": ("open font", (r"sil open font license", r"open font license")),
    "odbl": ("open d", (r"open database license", r"open data commons open database license")),
    "odc-by": ("open data", (r"open data commons attribution license",)),
    "pddl": ("public domain", (r"public domain dedication and license",)),
    "osl": ("open software", (r"open software license",)),
    "afl": ("academic", (r"academic free license",)),
    "qpl": ("q public", (r"q public license",)),
    "upl": ("universal", (r"universal permissive license",)),
    "mulan": ("mulan", (r"mulan (?:permissive software|psl) license", r"mulan psl")),
    "openssl": ("openssl", (r"openssl license",)),
    "php": ("php", (r"php license",)),
    "ruby": ("ruby", (r"ruby license",)),
    "vim": ("vim", (r"vim license",)),
    "postgresql": ("postgresql", (r"postgresql licen[cs]e",)),
    "ncsa": ("illinois", (r"university of illinois ncsa open source license",)),
    "bsl": ("business", (r"business source license",)),
    "sspl": ("server side", (r"server side public license",)),
    "elastic": ("elastic", (r"elastic license",)),
    "cc0": ("cc0", (r"cc0(?: 1 0)?", r"creative commons zero cc0")),
    "cc-by": ("cc by", (r"cc by",)),
    "cc-by-4.0": ("cc by", (r"cc by 4(?: 0)?",)),
    "cc-by-sa": ("cc by sa", (r"cc by sa",)),
    "cc-by-nc": ("cc by nc", (r"cc by nc",)),
    "cc-by-nd": ("cc by nd", (r"cc by nd",)),
    "cc-by-nc-sa": ("cc by nc sa", (r"cc by nc sa",)),
    "cc-by-nc-nd": ("cc by nc nd", (r"cc by nc nd",)),
    "cc": ("creative commons", (r"creative commons attribution(?: noncommercial| non commercial)?(?: sharealike| share alike| noderivs| no derivatives)?"
                                r"(?: \d 0)?(?: international| unported)?(?: public)? license", r"creative commons license")),
}

_V = r"(?:version |v ?)?"
_UNDER = r"under (?:the )?(?:terms of (?:the )?)?"
# Short names: keyword, pattern.  A name that also means other things needs a
# version or a grant.
SHORT: dict[str, tuple[tuple[str, str], ...]] = {
    "gpl": (("gpl", r"gpl"),),
    "lgpl": (("lgpl", r"lgpl"),),
    "lgpl-2.1": (("lgpl", rf"lgpl {_V}2 1"), ("lgplv2", r"lgplv2 1")),
    "lgpl-3.0": (("lgpl", rf"lgpl {_V}3(?: 0)?"), ("lgplv3", r"lgplv3")),
    "agpl": (("agpl", r"agpl"),),
    "agpl-3.0": (("agpl", rf"agpl {_V}3(?: 0)?"), ("agplv3", r"agplv3")),
    "fdl": (("gfdl", r"gfdl"),),
    "mpl": (("mpl", _UNDER + r"mpl"),),
    "mpl-1.1": (("mpl", rf"mpl {_V}1 1"),),
    "mpl-2.0": (("mpl", rf"mpl {_V}2(?: 0)?"),),
    "epl": (("epl", _UNDER + r"epl"),),
    "epl-1.0": (("epl", rf"epl {_V}1 0"),),
    "epl-2.0": (("epl", rf"epl {_V}2(?: 0)?"),),
    "cddl": (("cddl", r"cddl"),),
    "eupl": (("eupl", r"eupl"),),
    "sspl": (("sspl", r"sspl"),),
    "odbl": (("odbl", r"odbl"),),
    "ofl": (("ofl", rf"ofl {_V}1 1"),),
    "mit": (("mit", _UNDER + r"mit"),),
    "bsd": (("bsd", _UNDER + r"bsd"),),
}

# Sentences that identify a license by its own text or notice: keyword, pattern.
NOTICES: dict[str, tuple[tuple[str, str], ...]] = {
    "mit": (("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
            ("the above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies")),
    "isc": (("permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),),
    "bsd": (("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
            ("neither the name", r"neither the name of(?: \S+){1,12} nor the names of its contributors")),
    "gpl": (("free software", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
            ("you should have received", r"you should have received a copy of the gnu general public license"),),
    "lgpl": (("you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),),
    "agpl": (("you should have received", r"you should have received a copy of the gnu affero general public license"),),
    "apache-2.0": (("unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license"),
                   ("you may not use this file", r"you may not use this file except in compliance with the license")),
    "mpl-2.0": (("this source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),),
    "boost": (("permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),),
    "zlib": (("provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors"),),
    "unlicense": (("free and unencumbered", r"this is free and unencumbered software released into the public domain"),),
    "cc0": (("waived all copyright", r"has waived all copyright and related or neighboring rights"),),
    "fdl": (("permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),),
    "mpl-1.1": (("the contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1"),),
    "epl": (("the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),),
    "cddl": (("the contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),),
    "ofl": (("this font software", r"this font software is licensed under the sil open font license"),),
    "openssl": (("openssl project", r"this product includes software developed by the openssl project"),),
    "php": (("php software", r"this product includes php software(?: freely)? available from"),),
    "bsd-4-clause": (("all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),),
    "ms-pl": (("this license governs", r"this license governs use of the accompanying software if you use the software you accept this license"),),
    "postgresql": (("written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),),
    "public-domain": (("public domain", r"(?:released|dedicated|placed|is) (?:in ?to|in) the public domain"),),
    "proprietary": (("all rights reserved", r"all rights reserved"),
                    ("confidential", r"proprietary and confidential"),),
    "copyright": (("copyright", r"copyright (?:c )?(?:19|20)\d\d"),),
}

GRANT = (r"(?:licensed|released|distributed|available|provided|published|covered|redistributed)(?: \S+){0,3}? (?:under|by)(?: the)?"
         r"(?: terms(?: and conditions)? of)?(?: the| an?)? ")


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int       # smaller suppresses larger
    relevance: float
    base: bool = False


def signatures() -> list[Signature]:
    """The ordered rules: base phrases, then for each label its tag, grants, notices and names."""
    rules = [Signature(label, phrase, phrase, 9, 0.9, True) for phrase, label in BASE_PHRASES.items()]
    # of equal ranges the more specific label wins
    for label, (keyword, names) in sorted(NAMES.items(), key=lambda x: -len(x[0])):
        tag = " ".join("".join(c if c.isalnum() else " " for c in label).split())
        rules.append(Signature(label, "spdx license identifier", rf"spdx license identifier {tag}(?: \d+)*(?: only| or later)?", 0, 1.0))
        for name in names:
            rules.append(Signature(label, keyword, GRANT + name + r"(?: license)?" + _VERSION, 1, 1.0))
            rules.append(Signature(label, keyword, name + r"(?: license)?" + _VERSION, 3, 0.8))
    # the longer pattern, which has a version, comes first
    rules += [Signature(label, k, p + r"(?: license)?" + _VERSION, 3, 0.8) for label, short in sorted(SHORT.items(), key=lambda x: -len(x[0])) for k, p in short]
    for label, notices in NOTICES.items():
        weak = label in ("copyright", "proprietary", "public-domain")
        rules += [Signature(label, k, p, 4 if weak else 2, 0.4 if weak else 0.95) for k, p in notices]
    return rules


SIGNATURES = signatures()


def plain_words(text: F.Column) -> F.Column:
    """Lower-case words with one blank before each and one at the end ('' without words)."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.when(spaced == " ", F.lit("")).otherwise(spaced)


def _blanks(s: F.Column) -> F.Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))


DETECTION = "struct<start:bigint,upto:bigint,priority:int,place:int,label:string,relevance:double,base:boolean>"


def detections(words: F.Column) -> F.Column:
    """All matches of all signatures as word ranges, outer ones first."""
    by_keyword: dict[str, list[F.Column]] = {}
    for i, s in enumerate(SIGNATURES):
        by_keyword.setdefault(s.keyword, []).append(F.struct(
            F.lit(" " + s.pattern + "(?= )").alias("pattern"), F.lit(s.priority).alias("priority"), F.lit(i).alias("place"),
            F.lit(s.label).alias("label"), F.lit(s.relevance).alias("relevance"), F.lit(s.base).alias("base")))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_keyword.items()])
    able = F.flatten(F.transform(F.filter(table, lambda k: F.contains(words, k["keyword"])), lambda k: k["rules"]))

    def of_hits(rule, found):
        n = F.transform(found, lambda x: _blanks(x).cast("long"))
        gaps = F.transform(F.slice(F.split(words, rule["pattern"], F.lit(-1)), F.lit(1), F.size(found)), lambda x: _blanks(x).cast("long"))
        pairs = F.zip_with(n, gaps, lambda n, g: F.struct(n.alias("n"), g.alias("gap")))

        def placed(pairs):
            before = let(F.transform(pairs, lambda p: p["n"] + p["gap"]), lambda sizes: running(sizes, F.lit(0).cast("long"), lambda a, x: a + x))
            return F.zip_with(pairs, before, lambda p, at: F.struct(
                (at + p["gap"]).alias("start"), (at + p["gap"] + p["n"]).alias("upto"), *(rule[c].alias(c) for c in ("priority", "place", "label", "relevance", "base"))))
        return let(pairs, placed)

    def of_rule(rule):
        # most rules that pass the gate match nothing, and are done with one search
        return let(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), lambda found: F.when(
            F.size(found) > 0, of_hits(rule, found)).otherwise(F.array().cast(f"array<{DETECTION}>")))

    return F.array_sort(F.flatten(F.transform(able, of_rule)), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int"))
                        .when(a["upto"] != b["upto"], F.signum(b["upto"] - a["upto"]).cast("int"))
                        .when(a["priority"] != b["priority"], a["priority"] - b["priority"]).otherwise(a["place"] - b["place"]))


def unsuppressed(found: F.Column) -> F.Column:
    """Detections not within an earlier one of the same or a higher priority.

    In the given order a containing range always comes first, so a detection is
    within one if the earlier ones of its priority or a higher reach as far.
    What contains a dropped detection's container contains the detection too.
    """
    levels = sorted({s.priority for s in SIGNATURES})

    def reach_of(p: int) -> F.Column:
        ends = F.transform(found, lambda d: F.when(d["priority"] <= p, d["upto"]).otherwise(F.lit(-1).cast("long")))
        return let(ends, lambda e: running(e, F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x)))
    reach = F.array(*map(reach_of, levels))
    level = lambda d: F.array_position(F.array(*[F.lit(p) for p in levels]), d["priority"]).cast("int") - 1
    kept = let(reach, lambda r: F.filter(found, lambda d, i: F.get(F.get(r, level(d)), i) < d["upto"]))
    return F.when(F.size(found) > 1, kept).otherwise(found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document.

    ``doc_id``; ``n_words``; ``n_base``, ``first_word``, ``last_word``: number,
    smallest and largest start word of all places of the base phrases (null
    without one); ``base_labels`` and ``labels`` (with those of the surviving
    detections), distinct, sorted, comma-joined; ``score``: the largest
    relevance of a surviving detection, 0 without one; ``licenses``: the
    surviving detections as word ranges.

    Null texts have no words; null ids and repeated rows are kept; an empty
    table gives an empty result; other columns are ignored whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_words(text).alias("words"))
    keywords = sorted({s.keyword for s in SIGNATURES})
    # the general gate: no signature matches a text without any keyword
    shortest = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    gate = F.exists(F.array(*[F.lit(k) for k in shortest]), lambda k: F.contains(F.col("words"), k))
    none = F.array().cast(f"array<{DETECTION}>")
    rows = rows.select("doc_id", F.greatest(_blanks(F.col("words")) - 1, F.lit(0)).cast("long").alias("n_words"),
                       F.when(gate, detections(F.col("words"))).otherwise(none).alias("found"))
    rows = rows.withColumns({"base": F.filter("found", lambda d: d["base"]), "kept": unsuppressed(F.col("found"))})
    labels = lambda c: F.transform(c, lambda d: d["label"])
    starts = F.transform("base", lambda d: d["start"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(labels("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels("base"), labels("kept")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["relevance"])), F.lit(0.0)).alias("score"), F.col("kept").alias("licenses"))
