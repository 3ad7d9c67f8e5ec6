"""Vector code compression: product codes by dual-tree Lloyd rounds.

Vectors are cut into equal parts, and each part position has a codebook.  A
round assigns every part to the nearest entry and replaces the entries by the
means of their parts, in whole numbers.  Every Arrow batch builds, for each
position, a balanced tree over its parts and one over the entries, and descends
both at once: a pair of nodes whose least distance exceeds another pair's
largest one is pruned.  A node of parts that is left with one entry is assigned
whole, by its cached count and sum; what is still uncertain in the leaves is
compared in exact integers.

A round is one pass over the rows.  A task sends one sum for each entry, and the
driver keeps the codebooks alone, whose size does not depend on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.components import apart
from pricelens.llm.vectors import matrix, whole_vectors
from pricelens.session import checkpoint

PARTS = 16
ENTRIES = 64
ROUNDS = 2
LEAF_POINTS = 8
MOST = (1 << 63) - 1


@dataclass
class Forest:
    """Balanced trees over ``trees`` sets of points, level by level from the roots.

    Node ``i`` of a level stands for an equal share of the slots; its children
    are ``2 i`` and ``2 i + 1`` of the next level.  Slots beyond the points are
    fill: they repeat a point, weigh nothing and are not ``real``.
    """

    slot: np.ndarray            # trees x slots: the point of each slot
    real: np.ndarray            # trees x slots
    low: list[np.ndarray]       # per level: nodes x components
    high: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.low) - 1


def grow(points: np.ndarray, leaf: int) -> Forest:
    """Trees over ``points`` (trees x points x components); every node is cut in the middle of its widest side."""
    trees, n, width = points.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    slots = -(-n // (1 << depth)) << depth
    order = np.broadcast_to(np.arange(slots), (trees, slots)).copy()
    tree = np.arange(trees)[:, None]
    for level in range(depth):
        nodes, m = trees << level, slots >> level
        p = points[tree, np.minimum(order, n - 1)].reshape(nodes, m, width)
        widest = (p.max(axis=1) - p.min(axis=1)).argmax(axis=1)
        side = np.take_along_axis(p, widest[:, None, None], axis=2)[..., 0]
        order = np.take_along_axis(order.reshape(nodes, m), np.argpartition(side, m // 2, axis=1), axis=1).reshape(trees, slots)
    slot = np.minimum(order, n - 1)
    p = points[tree, slot].reshape(trees << depth, slots >> depth, width)
    low, high = [p.min(axis=1)], [p.max(axis=1)]
    for _ in range(depth):
        low.append(low[-1].reshape(-1, 2, width).min(axis=1))
        high.append(high[-1].reshape(-1, 2, width).max(axis=1))
    return Forest(slot, order < n, low[::-1], high[::-1])


def node_sums(forest: Forest, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts and sums of the points of every node, by level."""
    trees, n, width = points.shape
    real = forest.real.reshape(trees << forest.depth, -1)
    p = points[np.arange(trees)[:, None], forest.slot].reshape(*real.shape, width)
    count, total = [real.sum(axis=1)], [(p * real[..., None]).sum(axis=1)]
    for _ in range(forest.depth):
        count.append(count[-1].reshape(-1, 2).sum(axis=1))
        total.append(total[-1].reshape(-1, 2, width).sum(axis=1))
    return count[::-1], total[::-1]


def least_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, first, axis=0)


def descend(points: Forest, data: np.ndarray, entries: Forest, book: np.ndarray):
    """Assign every point: yields (level, nodes, entry of each) for whole nodes of
    points, and at last (None, leaf nodes, entry of each of their slots).

    ``data`` and ``book`` are trees x points x components.  Ties go to the lower
    entry: only pairs that are strictly farther are pruned.
    """
    trees, n_entries, width = book.shape
    # equal entries: only the first can win
    usable = np.ones((trees, n_entries), bool)
    for t in range(trees):
        usable[t] = False
        usable[t, np.unique(book[t], axis=0, return_index=True)[1]] = True
    e_slot, e_real = entries.slot.reshape(-1), entries.real.reshape(-1)
    e_tree = np.repeat(np.arange(trees), entries.slot.shape[1])
    wins = e_real & usable[e_tree, e_slot]
    q, e, level, e_level = np.arange(trees), np.arange(trees), 0, 0
    while len(q):
        low, high, e_low, e_high = points.low[level][q], points.high[level][q], entries.low[e_level][e], entries.high[e_level][e]
        gap = np.maximum(0, np.maximum(low - e_high, e_low - high))
        reach = np.maximum(high - e_low, e_high - low)
        near, far = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        times = np.diff(np.r_[first, len(q)])
        keep = near <= np.repeat(least_by(far, first), times)
        q, e = q[keep], e[keep]
        if e_level == entries.depth:
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            alone = np.repeat(np.diff(np.r_[first, len(q)]) == 1, np.diff(np.r_[first, len(q)]))
            if alone.any():
                yield level, q[alone], e_slot[e[alone]]
                q, e = q[~alone], e[~alone]
        more, e_more = level < points.depth, e_level < entries.depth
        if not more and not e_more:
            break
        if e_more:
            q, e, e_level = np.repeat(q, 2), (2 * e[:, None] + [0, 1]).reshape(-1), e_level + 1
            if e_level == entries.depth:
                q, e = q[wins[e]], e[wins[e]]
        if more:
            # the pairs of a node stay together
            left = np.argsort(np.concatenate((2 * q, 2 * q + 1)), kind="stable")
            q, e, level = np.concatenate((2 * q, 2 * q + 1))[left], np.concatenate((e, e))[left], level + 1
    if len(q):
        leaf = points.slot.reshape(len(data) << points.depth, -1)
        tree, entry = q >> points.depth, e_slot[e]
        away = data[tree[:, None], leaf[q]] - book[tree, entry][:, None, :]
        away = (away * away).sum(axis=2)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        best = np.repeat(least_by(away, first), np.diff(np.r_[first, len(q)]), axis=0)
        yield None, q[first], least_by(np.where(away == best, entry[:, None], n_entries), first)


def _split(v: np.ndarray, parts: int) -> np.ndarray:
    """parts x rows x components of a part; a short last part is filled with zeros."""
    width = -(-v.shape[1] // parts)
    v = np.pad(v, ((0, 0), (0, parts * width - v.shape[1])))
    return np.ascontiguousarray(v.reshape(len(v), parts, width).transpose(1, 0, 2))


def batch_sums(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the parts nearest to every entry: parts x entries (x components)."""
    data = _split(v, len(book))
    forest = grow(data, LEAF_POINTS)
    counts, totals = node_sums(forest, data)
    n, total = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
    for level, nodes, entry in descend(forest, data, grow(book, 1), book):
        if level is not None:
            tree = nodes >> level
            np.add.at(n, (tree, entry), counts[level][nodes])
            np.add.at(total, (tree, entry), totals[level][nodes])
        else:
            per = entry.shape[1]
            tree = np.repeat(nodes >> forest.depth, per)
            slot, real = forest.slot.reshape(-1, per)[nodes].reshape(-1), forest.real.reshape(-1, per)[nodes].reshape(-1)
            at = (tree[real], entry.reshape(-1)[real])
            np.add.at(n, at, 1)
            np.add.at(total, at, data[tree[real], slot[real]])
    return n, total


def batch_codes(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part (rows x parts) and the squared distances summed over the parts."""
    data = _split(v, len(book))
    forest = grow(data, LEAF_POINTS)
    by_slot = np.zeros(forest.slot.shape, np.int64)
    for level, nodes, entry in descend(forest, data, grow(book, 1), book):
        if level is not None:
            by_slot.reshape(len(book) << level, -1)[nodes] = entry[:, None]
        else:
            by_slot.reshape(len(book) << forest.depth, -1)[nodes] = entry
    code = np.empty(data.shape[:2], np.int64)
    tree = np.broadcast_to(np.arange(len(book))[:, None], forest.slot.shape)
    code[tree[forest.real], forest.slot[forest.real]] = by_slot[forest.real]
    away = data - book[np.arange(len(book))[:, None], code]
    return code.T, (away * away).sum(axis=(0, 2))


def _round(rows: DataFrame, book: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round over all rows."""
    parts, entries, width = book.shape
    sent = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                more, sums = batch_sums(matrix(batch.column(0), length), sent.value)
                n, total = n + more, total + sums
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]),
                                          pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
    sums = rows.select("v").mapInArrow(run, "part long, entry long, n long, total array<long>")
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(20,0)")).alias(f"c{i}") for i in range(width)]
    new = book.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).toLocalIterator():
        new[r.part, r.entry] = [int(r[f"c{i}"]) // r.n for i in range(width)]
    sent.destroy()
    return new


def codebooks_text(book: np.ndarray, length: int) -> str:
    """All entries' components by part, entry and position; a short last part has no fill here."""
    parts, entries, width = book.shape
    return ",".join(str(x) for p in range(parts) for entry in book[p] for x in entry[:max(0, length - p * width)])


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray, int]:
    """Codes of all vectors, the codebooks (parts x entries x components) and the vectors' length.

    Columns of the codes: ``vec_id``, ``label``, ``code`` (array of entry
    numbers, one for each part) and ``error`` (squared distances summed over the
    parts).  Codebooks start as the parts of the ``entries`` smallest ids (null
    ids last; rows of one id by their components); with fewer rows there are
    fewer entries.  Ties go to the lower entry, unused entries stay.

    Rows are left out as in :func:`whole_vectors`, and also those whose vector is
    not as long as that of the smallest id.  Null labels and ids are kept, and
    repeated rows count each.  If the parts do not divide the length, the last
    ones are shorter.  An empty table gives an empty result and no codebooks.
    Errors are exact while they stay under 2^63.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    in_order = [F.asc_nulls_last("id"), F.col("v")]
    start = [r.v for r in rows.orderBy(*in_order).limit(entries).collect()]
    if not start:
        return spark.createDataFrame([], "vec_id long, label long, code array<int>, error long"), np.zeros((parts, 0, 0), np.int64), 0
    length = len(start[0])
    rows = rows.filter(F.size("v") == length)
    if any(len(v) != length for v in start):
        start = [r.v for r in rows.orderBy(*in_order).limit(entries).collect()]
    book = _split(np.array(start, np.int64), parts)
    for _ in range(rounds):
        book = _round(rows, book, length)
    sent = spark.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, error = batch_codes(matrix(batch.column(2), length), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(code), pa.list_(pa.int32())), pa.array(error)],
                                                 names=["vec_id", "label", "code", "error"])
    return rows.mapInArrow(run, "vec_id long, label long, code array<int>, error long"), book, length


def code_digest(vectors: DataFrame) -> DataFrame:
    """One row for each coded vector, with the error of its label and the hash of all codebooks."""
    codes, book, length = compress(vectors)
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    # the codes are needed twice
    coded = checkpoint(codes.select("vec_id", "label", digits.alias("code"), "error"))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(30,0)")).cast("long")
    by_label = apart(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"))
    digest = hashlib.sha256(codebooks_text(book, length).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as plain SQL: all distances of a part position, smallest first."""
    nearest = """
d{r} AS (SELECT p.row, p.part, e.entry, list_sum(list_transform(generate_series(1, len(p.x)), lambda i: (p.x[i] - e.x[i]) * (p.x[i] - e.x[i]))) AS away
  FROM parts p JOIN book{r} e USING (part)),
a{r} AS (SELECT row, part, entry, away FROM d{r} QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY away, entry) = 1)"""
    update = """
means{r} AS (SELECT a.part, a.entry, u.i, CAST(floor_div(sum(p.x[u.i]), count(*)) AS BIGINT) AS m
  FROM a{r} a JOIN parts p USING (row, part), unnest(generate_series(1, len(p.x))) u(i) GROUP BY ALL),
lists{r} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM means{r} GROUP BY ALL),
book{n} AS (SELECT b.part, b.entry, coalesce(l.x, b.x) AS x FROM book{r} b LEFT JOIN lists{r} l USING (part, entry))"""
    update = update.replace("floor_div(sum(p.x[u.i]), count(*))",
                            "(sum(p.x[u.i]) - ((sum(p.x[u.i]) % count(*)) + count(*)) % count(*)) // count(*)")
    steps = [nearest.format(r=0)]
    for r in range(ROUNDS):
        steps += [update.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    last = ROUNDS
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT row, u.part, v[(len(v) // {PARTS}) * u.part + 1:(len(v) // {PARTS}) * (u.part + 1)] AS x
  FROM kept, unnest(generate_series(0, {PARTS - 1})) u(part)),
book0 AS (SELECT part, row AS entry, x FROM parts WHERE row < {ENTRIES}),{",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{last} GROUP BY row),
hash AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), hash"""


QUERY_SQL = _sql()
