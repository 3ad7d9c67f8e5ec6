"""Hard-negative mining with inner products in a residue number system.

Vectors are whole numbers.  Their matrices are reduced modulo several small
primes and multiplied in float32: residues lie around zero and are so small that
no sum of products leaves the whole numbers that float32 holds exactly.  The
residues of a score are put together to the exact signed score by Chinese
remaindering (mixed radix, around zero); as many primes are taken as the largest
component asks for.

The anchors are a stated query set against all rows.  They go out in blocks of a
bounded size, with two passes over the rows for each: the first finds the
anchors' positives, the second the negatives in the window below each positive's
score.  A task keeps the best few rows of every anchor and sends no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.vectors import LIMIT, matrix, whole_vectors
from pricelens.session import checkpoint

POSITIVES = 5
NEGATIVES = 3
ANCHOR_EVERY = 50
# Bounds of the window in percent of the positive's score.
LEAST_PERCENT, MOST_PERCENT = 50, 95
# Bytes of the anchors that are broadcast at once.
BLOCK_BYTES = 8 << 20
# Scores that a task holds at once.
TILE = 1 << 20
FLOAT_WHOLE = 1 << 24
# Dimensions of one float32 product; longer vectors add up several products.
DIMENSIONS = 64
NO_ID = (1 << 63) - 1


def primes_for(largest: int, length: int, dimensions: int = DIMENSIONS) -> list[int]:
    """Descending primes whose products stay exact in float32 and whose product exceeds every score's range."""
    most = 2 * math.isqrt((FLOAT_WHOLE - 1) // dimensions) + 1
    span, found, product = 2 * length * largest * largest + 1, [], 1
    for p in range(most, 2, -1):
        if product > span:
            break
        if all(p % k for k in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
    return found or [3]


def residues(v: np.ndarray, prime: int) -> np.ndarray:
    """Residues around zero, as float32."""
    half = prime // 2
    return ((v + half) % prime - half).astype(np.float32)


def digits_to_scores(found: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers that have these residues: mixed-radix digits around zero."""
    score, weight = np.zeros(found[0].shape, np.int64), 1
    for residue, p in zip(found, primes):
        half = p // 2
        digit = ((residue - score % p) * pow(weight % p, -1, p) + half) % p - half
        score += digit * weight
        weight *= p
        if weight >= NO_ID:     # what follows is zero: the score fits
            break
    return score


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``, given by their residues for each prime."""
    found = []
    for x, y, p in zip(a, b, primes):
        total = np.zeros((len(x), len(y)), np.int64)
        for k in range(0, x.shape[1], dimensions):
            total += (x[:, k:k + dimensions] @ y[:, k:k + dimensions].T).astype(np.int64)
        found.append(total % p)
    return digits_to_scores(found, primes)


class Best:
    """The ``most`` best rows of each slot: by score, higher first, then by id."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.score = np.full((slots, most), -NO_ID - 1, np.int64)
        self.id = np.full((slots, most), NO_ID, np.int64)
        self.have = np.zeros((slots, most), bool)

    def add(self, first: int, scores: np.ndarray, may: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the slots from ``first`` on against rows with ascending ids."""
        n, width = scores.shape
        here = slice(first, first + n)
        s = np.where(may, scores, -NO_ID - 1)
        floor = self.score[here, -1]
        if width > self.most:       # the last place that these rows alone would leave
            floor = np.maximum(floor, np.partition(s, width - self.most, axis=1)[:, width - self.most])
        slot, col = np.nonzero(may & (s >= floor[:, None]))
        old, place = np.nonzero(self.have[here])
        slot, score, ident = (np.concatenate(x) for x in ((old, slot), (self.score[here][old, place], s[slot, col]), (self.id[here][old, place], ids[col])))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = rank < self.most
        slot, rank = slot[top], rank[top]
        self.score[here], self.id[here], self.have[here] = -NO_ID - 1, NO_ID, False
        self.score[first + slot, rank], self.id[first + slot, rank], self.have[first + slot, rank] = score[top], ident[top], True

    def batch(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.have)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(self.score[slot, place]), pa.array(self.id[slot, place])],
                                          names=["slot", "score", "id"])


def percent(score: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole numbers n with least * score <= 100 * n <= most * score."""
    whole, rest = score // 100, score % 100
    return whole * least - (-rest * least // 100), whole * most + rest * most // 100


def _tiles(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, primes: list[int], length: int):
    """(first anchor, scores, ids, labels) of all anchors against the batches' rows, which come by ascending id."""
    by_anchor = [residues(anchors, p) for p in primes]
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], part.column(1).to_numpy(zero_copy_only=False)[order]
            v = matrix(part.column(2), length)[order]
            by_row = [residues(v, p) for p in primes]
            step = max(1, TILE // len(ids))
            for first in range(0, len(anchors), step):
                yield first, products([x[first:first + step] for x in by_anchor], by_row, primes), ids, labels


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of what the tasks sent, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _block(rows: DataFrame, anchors: pa.Table, primes: list[int], length: int, positives: int, negatives: int,
           least: int, most: int) -> DataFrame:
    """The result for one block of anchors."""
    spark = rows.sparkSession
    ids, labels, vectors = anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), matrix(anchors.column("v").combine_chunks(), length)
    sent = spark.sparkContext.broadcast((ids, labels, vectors))

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, v = sent.value
        best = Best(len(own), positives)
        for first, scores, row_ids, row_labels in _tiles(batches, v, primes, length):
            here = slice(first, first + len(scores))
            best.add(first, scores, (row_labels == label[here, None]) & (row_ids != own[here, None]), row_ids)
        yield best.batch()
    found = _merged(rows.mapInArrow(positive, "slot long, score long, id long"), positives).toArrow()
    slot, place, score = (found.column(c).to_numpy() for c in ("slot", "rank", "score"))
    # at most ``positives`` windows for each anchor of the block; empty ones have their ends crossed
    low, high = np.full((len(ids), positives), 1, np.int64), np.zeros((len(ids), positives), np.int64)
    low[slot, place - 1], high[slot, place - 1] = percent(score, least, most)
    windows = spark.sparkContext.broadcast((low, high))

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, v = sent.value
        lo, hi = windows.value
        best = [Best(len(own), negatives) for _ in range(positives)]
        for first, scores, row_ids, row_labels in _tiles(batches, v, primes, length):
            here = slice(first, first + len(scores))
            other = (row_labels != label[here, None]) & (row_ids != own[here, None])
            for k, b in enumerate(best):
                b.add(first, scores, other & (scores >= lo[here, k, None]) & (scores <= hi[here, k, None]), row_ids)
        for k, b in enumerate(best):
            out = b.batch()
            yield out.set_column(0, "slot", pa.array(out.column(0).to_numpy() * positives + k))
    chosen = _merged(rows.mapInArrow(negative, "slot long, score long, id long"), negatives)
    positive_id = found.column("id").to_numpy()
    named = spark.createDataFrame(pa.table({
        "of": slot * positives + place - 1, "anchor_id": ids[slot], "positive_id": pa.array(positive_id, mask=positive_id == NO_ID), "positive_score": score}))
    return chosen.join(F.broadcast(named), F.col("slot") == F.col("of")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") < NO_ID, F.col("id")).alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def mine_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT,
                   most: int = MOST_PERCENT, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor and positive, the best rows of other labels in the window below the positive's score.

    Columns: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score``, ``negative_score``.  ``is_anchor`` is a condition on
    ``id`` and ``label``.  Scores are inner products of ``floor(256 * x)``; a row
    is in the window if its score is between ``least`` and ``most`` percent of
    the positive's.  Higher scores come first, then smaller ids.

    Rows without a label and those that :func:`whole_vectors` leaves out take no
    part, nor do vectors that are not as long as that of the smallest id.  Rows
    with the anchor's own id are neither its positives nor its negatives; of
    repeated rows each counts.  Null ids come last and are never anchors.  An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, label_col).filter("label IS NOT NULL")
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    first = rows.agg(F.min_by(F.size("v"), F.struct(F.coalesce("id", F.lit(NO_ID)), "v")).alias("length"), largest.alias("largest")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if first.length is None:
        return spark.createDataFrame([], schema)
    length, primes = first.length, primes_for(min(LIMIT, first.largest), first.length)
    rows = rows.filter(F.size("v") == length)
    size = max(1, block_bytes // (8 * length))
    anchors = rows.filter(is_anchor & F.col("id").isNotNull())
    blocks = -(-anchors.count() // size)
    # dealt at random, so that repeated rows spread too; the result does not depend on it
    dealt = checkpoint(anchors.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(max(1, blocks)))))
    data = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "v")
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        block = dealt.filter(F.col("block") == k).orderBy("id").toArrow()
        for a in range(0, block.num_rows, size):
            out = out.unionByName(checkpoint(_block(data, block.slice(a, size), primes, length, positives, negatives, least, most)))
    return out


def anchors_of_query() -> F.Column:
    return F.col("id") % ANCHOR_EVERY == 0


QUERY_SQL = f"""
WITH data AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM data a JOIN data b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scores USING (anchor_id)
WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}"""
