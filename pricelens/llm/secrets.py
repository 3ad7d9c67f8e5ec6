"""Secret scan over a trigram inverted index.

1. From every rule's regular expression a Boolean trigram query is derived: the
   trigrams that any matching text must hold, as a conjunction of alternatives.
2. The index has, for each of these trigrams, posting lists of document keys,
   cut into chunks of a bounded number of documents.
3. A rule's candidates are the intersections and unions of its posting lists.
4. Candidates are verified by the regular expression on their whole text; rules
   without mandatory trigrams scan every text.

Only DataFrame functions.  The index shuffles a few numbers for each document;
the texts are shuffled once, by document key, to meet their candidates.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import let, running

# Documents whose postings meet in one row of the index.
CHUNK_DOCS = 2048
# Strings that an alternative may expand to before its trigrams are taken.
MAX_STRINGS = 24
REDACTED = "[REDACTED]"


def either(word: str) -> str:
    """A pattern for ``word`` with its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str            # valid in Java, Python and RE2; never matches nothing
    group: int = 0          # matches whose group is shorter than ``least`` are dropped
    least: int = 0


ASSIGN_KEYS = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
BASE_RULES = (
    Rule("assign", rf"""({ASSIGN_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),       # the longest run after AKIA, 16 or more in all
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Public formats of keys and tokens.
METHOD_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_api", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[0-9a-zA-Z]{16,}"),
    Rule("package", r"(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,})"),
    Rule("mail_api", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("model_api", r"sk-[A-Za-z0-9_-]{32,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^/\x20\x09-\x0D:@]{1,64}:[^/\x20\x09-\x0D:@]{1,64}@"),
    Rule("bearer", rf"{either('bearer')}\x20+[A-Za-z0-9._~+/-]{{20,}}"),
)
RULES = BASE_RULES + METHOD_RULES


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Conjunction of groups; a group holds if all trigrams of one alternative occur.

    Trigrams are lower case.  Runs of the pattern that expand to few strings
    give a group; what follows an open end starts a new run.  An empty list
    means that nothing is mandatory.
    """
    groups: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        grams = {_trigrams(s) for s in strings}
        if grams and all(grams) and list(grams) not in groups:
            groups.append(sorted(grams, key=sorted))

    def expand(items) -> tuple[set[str], bool]:
        """Strings of ``items``; whether they are whole.  Closes runs on the way."""
        run, whole = {""}, True
        for item in items:
            more = strings_of(item)
            if more is not None and len(run) * len(more) <= MAX_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            # a piece that fits no longer can begin the next run
            run, whole = (more if more is not None and len(more) <= MAX_STRINGS else {""}), False
        return run, whole

    def strings_of(item) -> set[str] | None:
        op, arg = item
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            return {chr(c).lower() for _, c in arg}
        if op is sre.SUBPATTERN:
            return branch([arg[3]])
        if op is sre.BRANCH:
            return branch(arg[1])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            inside = branch([arg[2]])
            return None if inside is None else inside | ({""} if arg[0] == 0 else set())
        return None

    def branch(options) -> set[str] | None:
        """All strings of the options, or None if one of them is open."""
        kept, out = len(groups), set()
        for option in options:
            run, whole = expand(option)
            if not whole:
                del groups[kept:]           # what holds in one option alone is not mandatory
                return None
            out |= run
        return out

    run, _ = expand(sre_parser.parse(pattern))
    close(run)
    return groups


def _key(id_col: str, text_col: str) -> F.Column:
    """Where a row's postings go.  Rows may share a key: candidates are verified on the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
               chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """(``__key``, ``__rules``): rules whose trigram query a document's postings satisfy."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    terms = {t: i for i, t in enumerate(sorted({t for q in queries.values() for g in q for alt in g for t in alt}))}
    vocabulary = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(t).alias("gram")) for t, i in terms.items()])
    chunks = max(1, -(-docs.count() // chunk_docs))
    text = F.lower(F.col(text_col).cast("string"))
    postings = docs.select(_key(id_col, text_col).alias("key"), text.alias("text")).select(
        "key", F.explode(F.filter(vocabulary, lambda v: F.contains(F.col("text"), v["gram"]))["t"]).alias("t"))
    index = (postings.groupBy(F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"), "t")
             .agg(F.collect_set("key").alias("keys")))
    chunk = index.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("t", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def every(items: F.Column, postings) -> F.Column:
        """Keys that are in the postings of all items."""
        rest = F.slice(items, F.lit(2), F.size(items))
        return F.aggregate(rest, postings(items[0]), lambda keys, item: F.array_intersect(keys, postings(item)))

    def of_trigram(t: F.Column) -> F.Column:
        return F.coalesce(F.try_element_at("lists", t), none)

    def of_group(alternatives: F.Column) -> F.Column:
        return F.array_distinct(F.flatten(F.transform(alternatives, lambda alt: every(alt, of_trigram))))

    # the queries are data: rule -> groups -> alternatives -> trigram numbers
    number = lambda alt: F.array(*[F.lit(terms[t]) for t in sorted(alt)])
    rule_queries = F.array(*[F.struct(F.lit(i).alias("rule"), F.array(*[F.array(*map(number, g)) for g in q]).alias("groups"))
                             for i, q in queries.items()])
    found = chunk.select(F.explode(F.transform(rule_queries, lambda r: F.struct(
        r["rule"].alias("rule"), every(r["groups"], of_group).alias("keys")))).alias("x"))
    return (found.select(F.col("x.rule").alias("rule"), F.explode("x.keys").alias("__key"))
            .groupBy("__key").agg(F.collect_set("rule").alias("__rules")))


def _spans(text: F.Column, place: int, rule: Rule) -> F.Column:
    """Matches of one rule as (start, place, end, kind), in code points."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pairs = F.zip_with(matches, values, lambda m, v: F.struct(F.char_length(m).cast("long").alias("n"), (F.char_length(v) >= rule.least).alias("ok")))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.char_length(g).cast("long"))
    steps = F.zip_with(pairs, F.slice(gaps, F.lit(1), F.size(pairs)), lambda m, g: F.struct(m["n"].alias("n"), m["ok"].alias("ok"), g.alias("gap")))

    def placed(steps):
        before = let(F.transform(steps, lambda x: x["gap"] + x["n"]), lambda sizes: running(sizes, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.zip_with(steps, before, lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), F.lit(place).alias("place"), (at + x["gap"] + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"), x["ok"].alias("ok")))
    found = F.filter(let(steps, placed), lambda s: s["ok"])
    return F.transform(found, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "place", "end", "kind"))))


def with_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
               chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """``docs`` and ``__spans``: the verified matches of every whole text.

    ``__spans`` holds (start, place of the rule, end, kind) by start, then place.
    A null text is empty.  Rows stay as they are, repeated ones and null ids
    included; columns ``__key``, ``__rules`` and ``__spans`` of the input are
    replaced.
    """
    own = [c for c in docs.columns if c not in ("__key", "__rules", "__spans")]
    docs = docs.select(*own)
    picked = candidates(docs, rules, id_col, text_col, chunk_docs).withColumnRenamed("__key", "__of")
    met = docs.withColumn("__key", _key(id_col, text_col)).join(picked, F.col("__key") == F.col("__of"), "left")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = []
    for i, rule in enumerate(rules):
        gate = F.array_contains("__rules", i) if trigram_query(rule.pattern) else F.rlike(text, F.lit(rule.pattern))
        each.append(F.when(gate, _spans(text, i, rule)))
    nothing = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return met.select(*own, F.array_sort(F.concat(*[F.coalesce(x, nothing) for x in each])).alias("__spans"))


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, a count ``n_<kind>`` for every rule and ``spans``
    (kind:start:end in code points, end exclusive, by start, then rule order, comma-joined).

    Null texts have no secrets; null ids and repeated rows are kept; an empty
    table gives an empty result; other columns are ignored whatever their names.
    """
    found = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rules)
    def count(kind: str) -> F.Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in rules),
                        _joined(F.col("__spans")).alias("spans"), F.col("__spans").alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts of the base kinds, a hash of their spans, all spans."""
    found = secret_scan(docs)
    base = _joined(F.filter("found", lambda s: s["place"] < len(BASE_RULES)))
    return found.select("doc_id", *(f"n_{r.kind}" for r in BASE_RULES), F.sha2(base, 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret's characters replaced by ``[REDACTED]``; overlapping spans as one.

    Columns and rows stay; ``length_col`` follows the new text where it changes.
    A null text stays null.
    """
    found = with_spans(docs, rules, id_col, text_col)
    text = F.col(text_col)

    def cut(spans):
        """The texts between the spans, each but the last followed by a mark."""
        before = let(F.transform(spans, lambda s: s["end"]), lambda ends: running(ends, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x)))
        pieces = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(
            F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), F.lit(REDACTED))).otherwise(F.lit("")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, (last + 1).cast("int"), F.char_length(text)))

    done = let(F.col("__spans"), cut)
    any_ = F.size("__spans") > 0
    out = found.withColumn("__new", F.when(any_, done).otherwise(text))
    columns = [F.col("__new").alias(c) if c == text_col
               else F.when(any_, F.char_length("__new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == length_col
               else F.col(c) for c in docs.columns if c not in ("__key", "__rules", "__spans")]
    return out.select(*columns)


def _sql() -> str:
    """DuckDB twin of :func:`digest`: the same patterns on every text, without an index."""
    kinds = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        kinds.append(f"""SELECT row, {i} AS place, '{r.kind}' AS kind, i,
  string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS v, {r.least} AS least
  FROM (SELECT row, text, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i FROM d)""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(kinds)}),
spans AS (
  SELECT row, place, kind, length(m[i]) AS n,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM found WHERE length(v[i]) >= least),
named AS (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR) AS s FROM spans),
agg AS (SELECT row, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
  string_agg(s, ',' ORDER BY start, place) FILTER (place < {len(BASE_RULES)}) AS base, string_agg(s, ',' ORDER BY start, place) AS spans
  FROM named GROUP BY row)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}' for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (row)
"""


QUERY_SQL = _sql()
