"""Benchmark decontamination with suffix arrays of the training text.

Every Arrow batch of documents is a shard.  Its words become integers (0: not a
benchmark word), its suffixes are sorted, and every benchmark suffix is
binary-searched in that order.  The interval found holds all verbatim
occurrences of the suffix's first ``window`` words; consecutive occurrences on
one diagonal are one longest match, with its place in the document and item.

A suffix that meets an unknown word before the shortest benchmark window ends
cannot match, so it is left out of the array; most of the text goes that way.
A document is never split and shards are independent: one pass, no shuffle.
The benchmark is sent to the workers in parts of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import text_bytes

WINDOW = 10
# Benchmark text that is broadcast at once.  A larger benchmark goes in parts,
# with one pass over the documents for each.
PART_BYTES = 16 << 20

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
              for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words after folding A-Z: runs of ASCII letters, digits and all else beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def suffix_array(tokens: np.ndarray, shortest: int, depth: int) -> np.ndarray:
    """Positions of the suffixes of at least ``shortest`` known words, in the order of their first ``depth`` words.

    ``tokens`` ends with a 0; a suffix ends before the next 0.  Prefix doubling
    over the runs that are long enough.
    """
    zeros = np.flatnonzero(tokens == 0)
    starts = np.concatenate(([0], zeros[:-1] + 1))
    keep = zeros - starts >= shortest
    starts, ends = starts[keep], zeros[keep]
    if len(starts) == 0:
        return np.empty(0, np.int64)
    length = ends - starts + 1                      # with the closing 0
    first = np.cumsum(length) - length
    at = np.arange(length.sum()) + np.repeat(starts - first, length)
    left = np.repeat(ends, length) - at             # known words from here on
    rank, k = tokens[at].astype(np.int64), 1
    while k < depth:
        then = np.zeros_like(rank)
        more = np.flatnonzero(left >= k)
        then[more] = rank[more + k]
        seen, rank = np.unique(rank * (rank.max() + 1) + then, return_inverse=True)
        k *= 2
        if len(seen) == len(rank) - len(starts) + 1:
            break
    order = np.argsort(rank, kind="stable")
    return at[order[left[order] >= shortest]]


class Benchmark:
    """Distinct windows of the items, and where each stands."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.window, self.ids = window, {}
        known: dict[tuple[int, ...], int] = {}
        places: list[list[tuple[int, int]]] = []
        names: dict[str, int] = {}
        for row, (name, text) in enumerate(items):
            tokens = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if not tokens:
                continue
            names.setdefault(name, len(names))
            n = min(window, len(tokens))
            for j in range(len(tokens) - n + 1):
                w = known.setdefault(tuple(tokens[j:j + n]), len(known))
                if w == len(places):
                    places.append([])
                places[w].append((row, j))
        self.rows = [name for name, _ in items]
        self.places = [np.array(p, np.int64) for p in places]
        self.length = np.array([len(k) for k in known], np.int64)
        self.table = np.zeros((len(known), window), np.int64)
        for k, w in known.items():
            self.table[w, :len(k)] = k

    def _bound(self, tokens: np.ndarray, sa: np.ndarray, after: bool) -> np.ndarray:
        """For every window the first suffix not below it (``after``: above it)."""
        lo, hi = np.zeros(len(self.table), np.int64), np.full(len(self.table), len(sa))
        columns = np.arange(self.window)
        inside = columns < self.length[:, None]
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            diff = (tokens[sa[mid][:, None] + columns] - self.table[open_]) * inside[open_]
            sign = diff[np.arange(len(open_)), (diff != 0).argmax(axis=1)]
            below = sign <= 0 if after else sign < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

    def occurrences(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``tokens`` and windows of all verbatim occurrences, by position."""
        none = np.empty(0, np.int64)
        if not len(self.table):
            return none, none
        sa = suffix_array(tokens, int(self.length.min()), self.window)
        if not len(sa):
            return none, none
        padded = np.concatenate([tokens, np.zeros(self.window, tokens.dtype)])
        lo, hi = self._bound(padded, sa, False), self._bound(padded, sa, True)
        n = hi - lo
        at = sa[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
        which = np.repeat(np.arange(len(n)), n)
        order = np.argsort(at, kind="stable")
        return at[order], which[order]

    def search(self, texts: list[bytes | None]) -> list[dict]:
        """For each text of one shard: words, hit spans, items and the longest match."""
        get, arrays = self.ids.get, []
        for text in texts:
            words = words_of(text)
            arrays.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        size = np.array([len(a) for a in arrays], np.int64)
        start = np.cumsum(size + 1) - size - 1
        zero = np.zeros(1, np.int32)
        at, which = self.occurrences(np.concatenate([x for a in arrays for x in (a, zero)] or [zero]))
        out = [{"n_words": int(n), "n_hit": 0, "spans": [], "items": [], "longest": None} for n in size]
        doc = np.searchsorted(start, at, side="right") - 1
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            d = int(doc[a])
            out[d] |= self._document(at[a:b] - start[d], which[a:b])
        return out

    def _document(self, at: np.ndarray, which: np.ndarray) -> dict:
        spans: list[list[int]] = []
        for p, n in zip(at.tolist(), self.length[which].tolist()):
            if spans and p <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], p + n)
            else:
                spans.append([p, p + n])
        distinct = np.unique(which)
        rows = np.unique(np.concatenate([self.places[w][:, 0] for w in distinct]))
        # (item row, diagonal, place in item): neighbours on a diagonal are one match
        every = np.concatenate([np.column_stack((self.places[w][:, 0], self.places[w][:, 1] - p,
                                                 self.places[w][:, 1], np.full(len(self.places[w]), self.length[w])))
                                for p, w in zip(at.tolist(), which.tolist())])
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        new = np.ones(len(every), bool)
        new[1:] = (np.diff(every[:, 0]) != 0) | (np.diff(every[:, 1]) != 0) | (np.diff(every[:, 2]) > 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(every)) - 1
        long = every[last, 2] - every[first, 2] + every[last, 3]
        best = first[np.argmax(long)]
        return {"spans": spans, "n_hit": sum(b - a for a, b in spans), "items": sorted({self.rows[r] for r in rows.tolist()}),
                "longest": (int(long.max()), self.rows[every[best, 0]], int(every[best, 2]), int(every[best, 2] - every[best, 1]))}


_STATE: dict[int, Benchmark] = {}


def _benchmark(sent, window: int) -> Benchmark:
    """A worker's tables of the benchmark part, kept between its tasks."""
    key = hash((tuple(sent.value), window))
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = Benchmark(sent.value, window)
    return _STATE[key]


def benchmark_parts(items: DataFrame, id_col: str, text_col: str, part_bytes: int) -> list:
    """The benchmark as broadcasts of about ``part_bytes`` of text; rows of one item stay together."""
    items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                         F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // part_bytes) or 1
    spark = items.sparkSession
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k) if n > 1 else items
        yield spark.sparkContext.broadcast(sorted((r.id, (r.text or "").encode()) for r in part.collect()))


HITS = "spans array<array<long>>, items array<string>, longest_match long, longest_item string, longest_item_start long, longest_doc_start long"
_HITS = [("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest_match", pa.int64()),
         ("longest_item", pa.string()), ("longest_item_start", pa.int64()), ("longest_doc_start", pa.int64())]


def _scan(docs: DataFrame, sent, window: int) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), *_HITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _benchmark(sent, window).search(text_bytes(batch.column(2)))
            longest = [x["longest"] or (0, None, None, None) for x in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x["n_words"] for x in found], pa.int64()),
                pa.array([x["spans"] for x in found], arrow.field("spans").type),
                pa.array([x["items"] for x in found], arrow.field("items").type),
                *(pa.array([x[i] for x in longest], arrow.field(5 + i).type) for i in range(4))], schema=arrow)
    return docs.mapInArrow(run, f"doc_id long, text_key long, n_words long, {HITS}")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Verbatim benchmark passages in every document; one output row for each input row.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  Columns: ``doc_id``, ``n_words``, ``n_hit``
    (words inside occurrences), ``n_items`` and ``items`` (ids of items with an
    occurring window, sorted as strings), ``spans`` (hit word ranges, merged),
    ``longest_match`` in words with item, place in the item and in the document
    (0 and null without a match; ties: the smallest item row, then place),
    ``contaminated``.

    Null texts have no words; a null item id counts as the id ''.  Rows of one
    item id count as one item.  Null document ids and repeated rows are kept,
    empty tables give no hits or an empty result, other columns are ignored
    whatever their names.  A benchmark of more than ``part_bytes`` is searched
    in parts, whose hits are merged for each document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
                       F.col(text_col).cast("string").alias("text"))
    found = [_scan(rows, sent, window) for sent in benchmark_parts(items, item_col, item_text_col, part_bytes)]
    out = found[0]
    if len(found) > 1:
        # equal rows have equal hits, so the rows of later parts may be merged by id and text
        hits = None
        for more in found[1:]:
            more = more.filter("longest_match > 0").drop("n_words").dropDuplicates(["doc_id", "text_key"])
            hits = more if hits is None else hits.unionByName(more)
        hits = hits.groupBy("doc_id", "text_key").agg(
            F.flatten(F.collect_list("spans")).alias("m_spans"), F.flatten(F.collect_list("items")).alias("m_items"),
            F.max_by(F.struct("longest_match", "longest_item", "longest_item_start", "longest_doc_start"), "longest_match").alias("m"))
        hits = hits.withColumnsRenamed({"doc_id": "m_id", "text_key": "m_key"})
        out = out.join(hits, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("text_key").eqNullSafe(F.col("m_key")), "left")
        longer = F.coalesce(F.col("m.longest_match"), F.lit(0)) > F.col("longest_match")
        spans = F.array_sort(F.concat("spans", F.coalesce("m_spans", F.array().cast("array<array<long>>"))))
        out = out.select(
            "doc_id", "n_words", merged_spans(spans).alias("spans"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("m_items", F.array().cast("array<string>"))))).alias("items"),
            *(F.when(longer, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c)
              for c in ("longest_match", "longest_item", "longest_item_start", "longest_doc_start")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
                      "longest_match", "longest_item", "longest_item_start", "longest_doc_start",
                      (n_hit > 0).alias("contaminated"))


def merged_spans(spans: F.Column) -> F.Column:
    """Sorted [start, end) pairs with overlapping and touching ones joined."""
    return F.aggregate(spans, F.array().cast("array<array<long>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= s[0]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1),
                 F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1])))))
        .otherwise(F.concat(acc, F.array(s))))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents without a hit word, with all their columns.

    Rows are filtered where they are: no shuffle, for each benchmark part one
    pass over what the parts before it left.  Edge cases as in
    :func:`contamination`; documents with a null text stay.
    """
    place = docs.columns.index(text_col)
    for sent in benchmark_parts(items, item_col, item_text_col, part_bytes):
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _benchmark(sent, window).search(text_bytes(batch.column(place)))
                yield batch.filter(pa.array([not x["spans"] for x in found], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


QUERY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT row, p, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT row, p, n, item FROM grams JOIN windows USING (n, k)),
words AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT row, unnest(range(p, p + n)) AS pos FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""
