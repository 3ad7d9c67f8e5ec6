"""Substring dedup with Rabin-Karp window hashes.

A window of ``window`` words is removed from a document if the same words start
in a document with a smaller id; removed windows merge into maximal intervals.

Rows are hashed into blocks by id and text; equal rows of a batch are counted
as one.  A block hashes every window of its texts and
then works in two rounds over hash buckets:

1. Of every distinct window of a block, the bucket number and 32 more bits of
   the hash are counted.  As the buckets grow in number with the input, these
   bits tell windows apart equally well at any size.  A block gets back which
   of its prints other blocks have too.
2. Of these, the whole 64-bit hash and the block's smallest document id are
   compared.  A block gets back the hashes that a smaller id elsewhere has.

What is shuffled for a window does not depend on how many documents of a block
repeat it, so a passage in a third of all rows costs one entry for each block.
Blocks and buckets have bounded sizes and depend on the rows alone, so a lost
partition is computed again with the same result.  The texts are shuffled once
(the three uses share one exchange).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
# Text of a block, and text whose windows meet in one bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
# Blocks are made smaller than this only to keep all cores busy.
LEAST_BLOCK_BYTES = 256 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)       # the odd multiplier of the rolling hash


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits (the finalizer of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all windows over word hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, window):
        total *= _BASE
        total += words[k:k + n]
    return _mixed(total)


class Block:
    """Window hashes of a block's documents, in the order of their ids."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        times = table.column("times").to_pylist()
        self.times = [times[i] for i in order]
        self.ids, self.texts, self.window = [ids[i] for i in order], [texts[i] or b"" for i in order], window
        parts, self.n_words = [], []
        for doc_id, text in zip(self.ids, self.texts):
            words = text.split()
            self.n_words.append(len(words))
            if doc_id is None:              # no order: neither removes nor is removed from
                parts.append(np.empty(0, np.uint64))
            else:
                parts.append(window_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), window))
        size = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(size) - size
        self.size = size
        self.hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, ascending, and the smallest document id of each."""
        seen, at = np.unique(self.hashes, return_index=True)
        doc = np.searchsorted(self.first, at, side="right") - 1
        return seen, np.array([-1 if i is None else i for i in self.ids], np.int64)[doc]

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """For every window whether it goes, given the hashes with a smaller id elsewhere."""
        seen, smallest = self.distinct()
        at = np.searchsorted(seen, self.hashes)
        own = np.repeat(np.array([-1 if i is None else i for i in self.ids], np.int64), self.size)
        gone = np.zeros(len(seen), bool)
        gone[np.searchsorted(seen, elsewhere)] = True
        return gone[at] | (smallest[at] < own) if len(seen) else np.zeros(0, bool)


def _by_bucket(block: int, keys: np.ndarray, bits: int, **columns) -> pa.Table:
    """One row for each bucket that has keys (ascending hashes); ``columns`` are cut alike."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cuts[1:], len(bucket)]
    out = {"bucket": pa.array(bucket[cuts], pa.int64()), "block": pa.array(np.full(len(cuts), block), pa.int64())}
    for name, values in columns.items():
        out[name] = pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())
    return pa.table(out)


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    raw = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(raw), dtype), np.array([len(r) // size for r in raw], np.int64)


def _answer(blocks: np.ndarray, values: np.ndarray, hit: np.ndarray, bucket: int, name: str) -> pa.Table:
    """The hit values, packed for each block."""
    blocks, values = blocks[hit], values[hit]
    order = np.argsort(blocks, kind="stable")
    blocks, values = blocks[order], values[order]
    cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
    ends = [*cuts[1:], len(blocks)]
    return pa.table({"block": pa.array(blocks[cuts], pa.int64()), "bucket": pa.array([bucket] * len(cuts), pa.int64()),
                     name: pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())})


def _prints(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a hash behind its bucket's bits."""
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def blocked(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows (``doc_id``, ``text``) with their ``block``; equal rows of a batch are one with their number ``times``.

    Rows of one id may be in different blocks: ids are compared strictly.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.schema.names
            once = pa.Table.from_batches([batch]).group_by(keys).aggregate([([], "count_all")])
            yield from once.select([*keys, "count_all"]).rename_columns([*keys, "times"]).to_batches()

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))
    return rows.withColumn("block", block).mapInArrow(counted, "doc_id long, text string, block long, times long")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, with_text: bool = True) -> DataFrame:
    """Remove repeated word windows; one output row for each input row.

    Words are maximal runs without ASCII white space.  Columns: ``doc_id``,
    ``n_words``, ``n_removed``, ``intervals`` (maximal removed word ranges),
    ``kept_sha256`` (of the kept words, joined by one space) and ``kept_text``
    (``with_text``).  Windows are judged on the input: a window may repeat one
    that is itself removed.

    A null text has no words.  Rows with a null id have no place in the order:
    they lose nothing and cause no removal.  Rows of one id do not remove each
    other's windows.  Texts shorter than the window lose nothing, an empty table
    gives an empty result, other columns are ignored whatever their names.

    Windows count as equal if their 64-bit hashes are: n windows are expected
    to hold n * n / 2**65 false pairs.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, total // block_bytes, min(partitions, total // LEAST_BLOCK_BYTES))
    bits = max(4, (total // bucket_bytes).bit_length())
    rows = blocked(rows, n_blocks)

    def count_prints(table: pa.Table) -> pa.Table:
        seen, _ = Block(table, window).distinct()
        return _by_bucket(table.column("block")[0].as_py(), seen, bits, prints=_prints(seen, bits))

    def shared_prints(table: pa.Table) -> pa.Table:
        prints, sizes = _joined(table.column("prints"), np.uint32)
        blocks = np.repeat(table.column("block").to_numpy(), sizes)
        # a print counts once a block
        _, at, times = np.unique(prints, return_inverse=True, return_counts=True)
        return _answer(blocks, prints, times[at] > 1, table.column("bucket")[0].as_py(), "prints")

    def send_hashes(table: pa.Table, shared: pa.Table) -> pa.Table:
        if table.num_rows == 0 or shared.num_rows == 0:
            return _by_bucket(0, np.empty(0, np.uint64), bits, hashes=np.empty(0, np.uint64), ids=np.empty(0, np.int64))
        seen, smallest = Block(table, window).distinct()
        bucket, prints = (seen >> np.uint64(64 - bits)).astype(np.int64), _prints(seen, bits)
        pick = np.zeros(len(seen), bool)
        starts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for b, packed in zip(shared.column("bucket").to_pylist(), shared.column("prints").to_pylist()):
            a, z = starts[b], starts[b + 1]
            pick[a:z] |= np.isin(prints[a:z], np.frombuffer(packed, np.uint32))
        return _by_bucket(table.column("block")[0].as_py(), seen[pick], bits, hashes=seen[pick], ids=smallest[pick])

    def smaller_elsewhere(table: pa.Table) -> pa.Table:
        hashes, sizes = _joined(table.column("hashes"), np.uint64)
        ids, _ = _joined(table.column("ids"), np.int64)
        blocks = np.repeat(table.column("block").to_numpy(), sizes)
        seen, at = np.unique(hashes, return_inverse=True)
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, at, ids)
        return _answer(blocks, hashes, ids > least[at], table.column("bucket")[0].as_py(), "hashes")

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("intervals", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string()),
                     *([("kept_text", pa.string())] if with_text else []), ("times", pa.int64())])

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        results = []
        if table.num_rows:
            block = Block(table, window)
            gone = block.removed(_joined(found.column("hashes"), np.uint64)[0])
            for i, text in enumerate(block.texts):
                a = block.first[i]
                starts = np.flatnonzero(gone[a:a + block.size[i]])
                cut = np.flatnonzero(np.diff(starts, prepend=-window - 1) > window)
                spans = [[int(starts[x]), int(starts[y - 1]) + window] for x, y in zip(cut, [*cut[1:], len(starts)])]
                words, kept, at = text.split(), [], 0
                for x, y in spans:
                    kept += words[at:x]
                    at = y
                left = b" ".join(kept + words[at:])
                results.append((block.ids[i], len(words), sum(y - x for x, y in spans), spans, hashlib.sha256(left).hexdigest(),
                                *([left.decode("utf-8", "replace")] if with_text else []), block.times[i]))
        columns = list(zip(*results)) or [[] for _ in out]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    shared = (rows.groupBy("block").applyInArrow(count_prints, "bucket long, block long, prints binary")
              .groupBy("bucket").applyInArrow(shared_prints, "block long, bucket long, prints binary"))
    found = (rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_hashes, "bucket long, block long, hashes binary, ids binary")
             .groupBy("bucket").applyInArrow(smaller_elsewhere, "block long, bucket long, hashes binary"))
    schema = ("doc_id long, n_words long, n_removed long, intervals array<array<long>>, kept_sha256 string"
              + (", kept_text string" if with_text else "") + ", times long")
    once = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, schema)
    # equal rows come back as often as they stood there
    again = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return once.select("*", again.alias("again")).drop("times", "again")


QUERY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT row, doc_id, p, array_to_string(w[p:p + 12], ' ') AS k
  FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
firsts AS (SELECT k, min(doc_id) AS first FROM grams GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT row, unnest(range(p, p + 13)) AS pos FROM grams JOIN firsts USING (k) WHERE first < doc_id),
words AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (row, pos) GROUP BY row),
removed AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row) LEFT JOIN removed USING (row)
"""
