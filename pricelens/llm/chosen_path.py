"""N-gram Jaccard join by the chosen-path method.

1. Texts become sets of word n-grams; equal sets are one class from here on.
2. Every set has a signature of min-hashes, and a tree of paths: at a node (the
   same for all sets that reach it) one or two coordinates are drawn, 1 /
   threshold on average, and a set goes on along its value at each.  A node with
   few sets is a bucket; one with more is split on.  Runs repeat the tree with
   other draws until a pair at the threshold shares a bucket with the target
   recall.
3. Buckets compare signatures, all pairs; a node that is still large at the last
   level compares its chunks, each with pivots, and then what the pivots left
   apart.  Similar sets form groups (connected components).
4. Every group's sets are compared exactly.  The result is a membership: every
   set has a representative, itself or a set it is linked with, and pairs of
   representatives whose members are linked.

A group's n-grams are stored once.  A group that one task can hold is compared
there.  In a larger one all sets meet the same pivots: sets linked with a pivot
join it, sets of which a fifth stands nowhere else in the group have no link, and
only the few others, for which no such bound decides, meet all sets of the group.
Pairs inside a large group are never written out, and nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import text_bytes
from pricelens.llm.components import apart, components, parts_for
from pricelens.llm.contamination import words_of
from pricelens.llm.substrings import window_hashes
from pricelens.session import checkpoint

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.99
LEVELS = 6
COORDINATES = 64
# A node with more sets is split on; sets of a chunk of a node that is large at
# the last level; sets and n-grams of a group that one task compares.
BUCKET_SETS = 256
LAST_SETS = 1024
GROUP_SETS = 1024
GROUP_GRAMS = 4 << 20
# Expected number of pivots of a large node or group.
PIVOTS = 64
# Share of equal coordinates below which two sets of a bucket are not similar:
# four standard errors under the threshold (one pair at the threshold in 20,000
# is below).
SKETCH_MARGIN = 0.2
# Ids that may be broadcast to pick the texts of step 4; beyond, they are joined.
BROADCAST_ROWS = 200_000
SEED = 5

_MULTIPLIERS = (np.random.default_rng(SEED).integers(1, 1 << 62, COORDINATES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def ngrams(text: bytes | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text is one n-gram."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(window_hashes(hashes, min(n, len(words))))


def set_key(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def signature(grams: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for a in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[a:a + 4096, None] * _MULTIPLIERS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).astype(np.int32)


def meeting(share: float, threshold: float, levels: int) -> float:
    """Probability that two sets of which a ``share`` of the coordinates agrees meet in one run, in the deepest node."""
    extra, p = 1 / threshold - 1, 1.0
    for _ in range(levels):
        # two drawn coordinates differ
        one, both = share, share * max(0.0, share * COORDINATES - 1) / (COORDINATES - 1)
        p = (1 - extra) * one * p + extra * (2 * (one - both) * p + both * (1 - (1 - p) ** 2))
    return p


def runs_for(recall: float, threshold: float, levels: int) -> int:
    """Runs until a pair at the threshold meets with the target recall, even in the deepest node.

    All runs draw from the same coordinates, so they are independent only given
    how many of these agree: the failure is averaged over that number.
    """
    agree = [math.comb(COORDINATES, k) * threshold ** k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    met = [meeting(k / COORDINATES, threshold, levels) for k in range(COORDINATES + 1)]
    runs = 1
    while sum(a * (1 - p) ** runs for a, p in zip(agree, met)) > 1 - recall:
        runs += 1
    return runs


def _prints(docs: DataFrame, n: int) -> DataFrame:
    """Id, row key, set key (null without words) and signature of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams(t, n) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int32())), pa.array([len(s) for s in sets], pa.int64())],
                names=["doc_id", "row", "key", "sig", "size"])
    return docs.mapInArrow(run, "doc_id long, row long, key long, sig array<int>, size long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), text.alias("text"))


def row_key(id_col: str, text_col: str) -> F.Column:
    """Rows with the same id and text have the same key."""
    return F.xxhash64(F.lit(SEED), F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _step(rows: DataFrame, threshold: float) -> DataFrame:
    """Children (``path``, ``key``) of rows with ``path``, ``key`` and ``sig``."""
    first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
    two = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1 << 20)) < F.lit(int((1 / threshold - 1) * (1 << 20)))
    drawn = F.when(two, F.array(first, second)).otherwise(F.array(first))
    child = F.transform(drawn, lambda c: F.xxhash64(F.col("path"), c, F.get("sig", c)))
    return rows.select(F.explode(child).alias("path"), "key")


def _counted(rows: DataFrame, by: str) -> DataFrame:
    """Rows of values of ``by`` that occur twice or more, with their number ``n``."""
    times = apart(rows.groupBy(by).agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed(by, "__by"))
    return rows.join(times, F.col(by) == F.col("__by")).drop("__by")


def _chunk(key: str, chunks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), chunks).cast("int")


def _with_pivots(rows: DataFrame, by: str, chunks: F.Column) -> DataFrame:
    """Deals the rows of a large group to chunks: ``group``, and whether it is the
    row's own chunk (``home``).  About ``PIVOTS`` rows of the group, drawn by their
    keys, are in all its chunks (``pivot``)."""
    share = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("key")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.withColumns({"chunks": chunks, "own": _chunk("key", chunks), "pivot": (chunks > 1) & (share < F.lit(float(PIVOTS)) / F.col("n"))})
    to = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).otherwise(F.array("own"))
    dealt = drawn.withColumn("to", F.explode(to))
    return dealt.withColumns({"group": F.xxhash64(F.col(by), "to"), "home": F.col("to") == F.col("own")}).drop("to", "own", "chunks")


def _crossed(few: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Deals two sides so that every row of ``few`` meets every row of ``rows`` with
    the same ``by`` in one ``group``; both carry their number of ``chunks``."""
    sides = few.groupBy(by).agg(F.first("chunks").alias("few_chunks")).withColumnRenamed(by, "__by")
    other = rows.groupBy(by).agg(F.first("chunks").alias("row_chunks")).withColumnRenamed(by, "__by")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    a = few.join(apart(other), F.col(by) == F.col("__by")).withColumns({"i": _chunk("key", F.col("chunks")), "j": upto("row_chunks"), "side": F.lit(0)})
    b = rows.join(apart(sides), F.col(by) == F.col("__by")).withColumns({"i": upto("few_chunks"), "j": _chunk("key", F.col("chunks")), "side": F.lit(1)})
    keep = [c for c in few.columns if c != "chunks"]
    one = a.select(*keep, "side", F.xxhash64(F.col(by), "i", "j").alias("group"))
    return one.unionByName(b.select(*keep, "side", F.xxhash64(F.col(by), "i", "j").alias("group")))


def _by_group(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function(table of one group)`` -> columns, over groups of a bounded size.

    The rows of a partition are sorted by group; groups are cut out of the
    batches, so small groups cost little.
    """
    fields = [f.split() for f in schema.split(", ")]
    names, types = [n for n, _ in fields], [{"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _ended(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = pa.concat_tables([rest, table]) if table is not None else rest
            if table is None or table.num_rows == 0:
                continue
            group = table.column("group").to_numpy()
            cuts = np.flatnonzero(np.diff(group)) + 1
            end = len(group) if batch is None else (int(cuts[-1]) if len(cuts) else 0)
            out: list[list] = [[] for _ in names]
            done = table.slice(0, end).combine_chunks()
            for a, b in zip([0, *cuts], [*cuts, len(group)]):
                if b <= end and b - a > 1:
                    for column, values in zip(out, function(done.slice(a, b - a))):
                        column.extend(values)
            rest = table.slice(end)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
    parts = rows.repartition("group").sortWithinPartitions("group")
    return parts.mapInArrow(run, schema)


def _ended(batches):
    yield from batches
    yield None


def _trees(like: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a small symmetric matrix."""
    root = np.arange(len(like))
    while True:
        new = np.where(like, root[None, :], len(like)).min(axis=1)
        new = np.minimum(root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def _similar_in_bucket(least: float):
    def function(table: pa.Table):
        keys, sigs = table.column("key").to_numpy(), _matrix(table.column("sig"), COORDINATES)
        like = np.empty((len(keys), len(keys)), bool)
        for i in range(len(keys)):
            like[i] = (sigs == sigs[i]).mean(axis=1) >= least
        root = keys[_trees(like)]
        other = root != keys
        return keys[other].tolist(), root[other].tolist()
    return function


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[size[0], both], [both, size[1]]], float)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    # what one set alone has counts on the diagonal only
    shared = times[code] > 1
    code, owner = (np.cumsum(times > 1) - 1)[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    n, width = int(code[-1]) + 1 if len(code) else 0, 1024
    for a in range(0, n, width):
        lo, hi = np.searchsorted(code, (a, a + width))
        part = np.zeros((len(sets), min(width, n - a)), np.float32)
        part[owner[lo:hi], code[lo:hi] - a] = 1
        total += part @ part.T
    total[np.arange(len(sets)), np.arange(len(sets))] = size
    return total.astype(float)


def links_between(few: list[np.ndarray], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of all sets (rows) with a few (columns), and for each set the n-grams that none of the few has (flat, by set)."""
    size, of = np.array([len(s) for s in sets], float), np.array([len(s) for s in few], float)
    gram = np.concatenate(few) if few else np.empty(0, np.uint64)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], np.repeat(np.arange(len(few)), of.astype(int))[order]
    both, foreign = np.zeros((len(sets), len(few))), []
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(gram, s, "left"), np.searchsorted(gram, s, "right")
        times = hi - lo
        at = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        both[i] = np.bincount(owner[at], minlength=len(few))
        foreign.append(s[times == 0])
    return both / np.maximum(1.0, size[:, None] + of[None, :] - both), foreign


def _grams_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in table.column("grams").to_pylist()]


def represent(like: np.ndarray) -> np.ndarray:
    """A representative for each row of a symmetric link matrix: rows with most links first, each takes what is still free."""
    rep, free = np.arange(len(like)), np.ones(len(like), bool)
    for k in np.argsort(-like.sum(axis=1), kind="stable"):
        if free[k]:
            taken = free & like[k]
            rep[taken] = rep[k] = k
            free[taken] = free[k] = False
    return rep


def _small_group(threshold: float):
    """Representatives of a whole group, and for each the representatives with linked members."""
    def function(table: pa.Table):
        # rows that repeat an id and a text come from several tasks
        keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
        sets = _grams_of(table.take(pa.array(first)))
        if len(sets) < 2:
            return [], [], []
        both, size = overlaps(sets), np.array([len(s) for s in sets], float)
        like = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(like, False)
        rep = represent(like)
        a, b = np.nonzero(like)
        met: dict[int, set] = {}
        for x, y in set(zip(rep[a].tolist(), rep[b].tolist())):
            if x != y:
                met.setdefault(x, set()).add(int(keys[y]))
        linked = np.flatnonzero(like.any(axis=1))
        return keys[linked].tolist(), keys[rep[linked]].tolist(), [sorted(met.get(int(i), ())) for i in linked]
    return function


def _against_pivots(threshold: float):
    """For the sets of a chunk: pivots they are linked with, pivots within twice the distance of a link, and n-grams that no pivot has."""
    def function(table: pa.Table):
        keys, sets = table.column("key").to_numpy(), _grams_of(table)
        pivot, home = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("pivot", "home"))
        likeness, foreign = links_between([sets[i] for i in pivot], [sets[i] for i in home])
        linked, near = likeness >= threshold - 1e-12, likeness >= 2 * threshold - 1 - 1e-12
        return (keys[home].tolist(), table.column("comp").to_numpy()[home].tolist(), [len(sets[i]) for i in home],
                [keys[pivot[x]].tolist() for x in linked], [keys[pivot[x]].tolist() for x in near], [f.view(np.int64).tolist() for f in foreign])
    return function


def _linked_pairs(threshold: float):
    """Distinct pairs of representatives with a link between the sides."""
    def function(table: pa.Table):
        side, keys, sets = table.column("side").to_numpy(), table.column("key").to_numpy(), _grams_of(table)
        comp, rep = table.column("comp")[0].as_py(), table.column("rep").to_numpy()
        few, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = set()
        if len(few) and len(rest):
            likeness, _ = links_between([sets[i] for i in few], [sets[i] for i in rest])
            y, x = np.nonzero(likeness >= threshold - 1e-12)
            x, y = few[x], rest[y]
            other = (keys[x] != keys[y]) & (rep[x] != rep[y])
            found = set(zip(rep[x][other].tolist(), rep[y][other].tolist()))
        return [comp] * len(found), [min(p) for p in found], [max(p) for p in found]
    return function


def _with_grams(texts: DataFrame, n: int) -> DataFrame:
    """The n-grams of the rows whose text has the expected key, each key once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep, grams = [], []
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(4))):
                g = ngrams(text, n) if key not in seen else None
                new = g is not None and set_key(g) == key
                keep.append(new)
                if new:
                    seen.add(key)
                    grams.append(g.tobytes())
            left = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*left.columns[:4], pa.array(grams, pa.binary())], names=["key", "comp", "n", "total", "grams"])
    return texts.mapInArrow(run, "key long, comp long, n long, total long, grams binary")


def _chunks(sets: F.Column, grams: F.Column, group_sets: int) -> F.Column:
    return F.greatest(F.ceil(sets / group_sets), F.ceil(grams / GROUP_GRAMS), F.lit(1))


def _large_groups(sets: DataFrame, threshold: float, group_sets: int) -> DataFrame:
    """(``key``, ``rep``, ``linked``) for the sets of groups that no single task compares."""
    parts = parts_for(sets, sets.count())
    few = lambda df: apart(df.coalesce(parts), parts)
    dealt = _with_pivots(sets, "comp", _chunks(F.col("n"), F.col("total"), group_sets))
    seen = checkpoint(_by_group(dealt.select("group", "key", "comp", "pivot", "home", "grams"), _against_pivots(threshold),
                                "key long, comp long, size long, linked array<long>, near array<long>, foreign array<long>")).coalesce(parts)
    # pivots with most links first; a set joins the first one it is linked with, a pivot that a set has joined stands for itself
    covers = seen.select("comp", F.explode("linked").alias("p")).groupBy("comp", "p").agg((-F.count("*")).alias("c"))
    order = covers.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("c", "p"))).alias("order")).select(
        F.col("comp").alias("of"), F.transform("order", lambda x: x["p"]).alias("order"))
    joined = checkpoint(seen.join(few(order), F.col("comp") == F.col("of"), "left").drop("of").withColumn(
        "rep", F.get(F.filter("order", lambda p: F.array_contains("linked", p)), F.lit(0))))
    used = joined.filter("rep IS NOT NULL").groupBy("comp").agg(F.collect_set("rep").alias("used")).withColumnRenamed("comp", "of")
    stood = joined.join(few(used), F.col("comp") == F.col("of"), "left").drop("of").withColumn(
        "rep", F.when(F.array_contains("used", F.col("key")), F.col("key")).otherwise(F.col("rep")))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    met = stood.filter("rep IS NOT NULL").select("comp", "rep", F.explode(F.filter("linked", lambda p: F.array_contains("used", p) & (p != F.col("rep")))).alias("p"))
    direct = checkpoint(met.select("comp", pair(F.col("p"), F.col("rep")).alias("x")).distinct().coalesce(parts))
    flags = direct.groupBy("comp").agg(F.collect_list("x").alias("flags")).withColumnRenamed("comp", "of")
    # of the n-grams that no pivot has, those that stand in one set alone
    alone = seen.select("comp", "key", F.explode("foreign").alias("gram")).groupBy("comp", "gram").agg(F.count("*").alias("n"), F.min("key").alias("only"))
    alone = alone.filter("n = 1").groupBy("only").agg(F.count("*").alias("alone")).coalesce(parts)
    far = stood.join(few(flags), F.col("comp") == F.col("of"), "left").join(alone, F.col("key") == F.col("only"), "left")
    place = lambda p: F.array_position("order", p)
    undecided = F.exists("near", lambda p: F.array_contains("used", p) & (place(p) < place(F.col("rep"))) & ~F.coalesce(
        F.array_contains("flags", pair(p, F.col("rep"))), F.lit(False)))
    could = F.col("size") - F.coalesce("alone", F.lit(0)) >= threshold * F.col("size") - 1e-9
    state = checkpoint(far.select("key", "rep", F.when(F.col("rep").isNull(), could).otherwise(F.coalesce(undecided, F.lit(False))).alias("open")).coalesce(parts))
    shown = sets.join(state.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select(
        "key", "comp", "grams", F.coalesce("rep", "key").alias("rep"), "open", (F.col("rep").isNotNull() | F.col("open")).alias("may"))

    def chunked(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("comp").agg(F.count("*").alias("m"), F.sum(F.octet_length("grams") / 8).alias("g"))
        sums = sums.select(F.col("comp").alias("of"), _chunks(F.col("m"), F.col("g"), group_sets).alias("chunks"))
        return rows.join(few(sums), F.col("comp") == F.col("of")).select("key", "comp", "grams", "rep", "chunks")
    found = _by_group(_crossed(chunked(shown.filter("open")), chunked(shown.filter("may")), "comp"), _linked_pairs(threshold), "comp long, a long, b long")
    pairs = direct.select("x.a", "x.b").unionByName(found.select("a", "b")).distinct()
    linked = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("linked"))
    return state.select("key", F.coalesce("rep", "key").alias("rep")).join(linked, F.col("key") == F.col("a"), "left").select(
        "key", "rep", F.coalesce("linked", F.array().cast("array<long>")).alias("linked"))


def _similar(buckets: DataFrame, sigs: DataFrame, least: float, most: int) -> DataFrame:
    """(``node``, ``root``) of sets that similar signatures in one bucket connect."""
    similar = _similar_in_bucket(least)
    with_sig = lambda rows: rows.select("group", "key").join(sigs, F.col("key") == F.col("of")).drop("of")
    dealt = _with_pivots(buckets, "path", F.greatest(F.ceil(F.col("n") / most), F.lit(1)))
    found = components(_by_group(with_sig(dealt), similar, "a long, b long"))
    large = buckets.filter(F.col("n") > most)
    if large.isEmpty():
        return found
    # what its chunks and pivots did not connect with most of a node meets all of it
    rooted = checkpoint(large.join(found.withColumnRenamed("node", "of"), F.col("key") == F.col("of"), "left").select(
        "path", "key", F.coalesce("root", "key").alias("root"), F.ceil(F.col("n") / most).alias("chunks")))
    each = rooted.groupBy("path", "root").agg(F.count("*").alias("c"))
    most_of = each.groupBy("path").agg(F.max(F.struct("c", "root")).alias("x"), F.sum("c").alias("all")).select(
        F.col("path").alias("of"), F.col("x.root").alias("main"), F.ceil((F.col("all") - F.col("x.c")) / most).alias("rest"))
    apart_rows = rooted.join(apart(most_of), F.col("path") == F.col("of")).filter("root <> main").select("path", "key", F.col("rest").alias("chunks"))
    again = _by_group(with_sig(_crossed(apart_rows, rooted.select("path", "key", "chunks"), "path")), similar, "a long, b long")
    return components(again.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _joined(docs: DataFrame, n: int, threshold: float, recall: float, levels: int, id_col: str, text_col: str,
            bucket_sets: int, last_sets: int, group_sets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``doc_id``, ``row``, ``key``), classes of equal sets, and (``key``, ``rep``, ``linked``) of linked classes."""
    rows = _rows(docs, id_col, text_col)
    prints = checkpoint(_prints(rows, n))
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = checkpoint(prints.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct(last.alias("id"), F.col("row"))).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
        .select("key", F.when(F.col("least.id") < (1 << 63) - 1, F.col("least.id")).alias("first_id"), F.col("least.row").alias("first_row"), "copies", "sig", "size"))

    n_runs = runs_for(recall, threshold, levels)
    roots = classes.select(F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run"), "key", "sig")
    rest, buckets = _step(roots.select(F.xxhash64(F.lit(SEED), F.col("run")).alias("path"), "key", "sig"), threshold), None
    sigs = classes.select(F.col("key").alias("of"), "sig")
    for level in range(levels):
        found = checkpoint(_counted(rest, "path"))
        ready = found if level + 1 == levels else found.filter(F.col("n") <= bucket_sets)
        buckets = ready if buckets is None else buckets.unionByName(ready)
        more = found.filter(F.col("n") > bucket_sets)
        if level + 1 == levels or more.isEmpty():
            break
        # children are counted and then met with their counts: the join below them is done once
        rest = checkpoint(_step(more.select("path", "key").join(sigs, F.col("key") == F.col("of")).drop("of"), threshold))

    similar = _similar(buckets, sigs, max(0.0, threshold - SKETCH_MARGIN), max(bucket_sets, last_sets))
    members = similar.join(classes.select(F.col("key").alias("of"), "first_row", "size"), F.col("node") == F.col("of"))
    sums = apart(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumnRenamed("root", "comp"))
    wanted = checkpoint(members.join(sums, F.col("root") == F.col("comp")).select(F.col("node").alias("key"), "comp", "n", "total", "first_row"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, F.col("row") == F.col("first_row")).select("key", "comp", "n", "total", "text")
    sets = checkpoint(_with_grams(texts, n))
    small = (F.col("n") <= group_sets) & (F.col("total") <= GROUP_GRAMS)
    shown = _by_group(sets.filter(small).select(F.col("comp").alias("group"), "key", "grams"), _small_group(threshold), "key long, rep long, linked array<long>")
    if not wanted.filter(~small).isEmpty():
        # rows that repeat an id and a text have the same n-grams: one of them is kept
        shown = shown.unionByName(_large_groups(checkpoint(sets.filter(~small).dropDuplicates(["key"])), threshold, group_sets))
    return prints.select("doc_id", "row", "key"), classes.drop("sig", "size"), checkpoint(shown)


def _classed(classes: DataFrame, shown: DataFrame) -> DataFrame:
    """Every class with its component's root and its representative."""
    edges = shown.select(F.col("key").alias("a"), F.col("rep").alias("b")).unionByName(
        shown.select(F.col("key").alias("a"), F.explode("linked").alias("b")))
    found = classes.join(components(edges), F.col("key") == F.col("node"), "left").drop("node").join(
        shown.select(F.col("key").alias("of"), "rep"), F.col("key") == F.col("of"), "left")
    return found.select("key", "first_id", "first_row", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("rep", "key").alias("rep"))


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS,
                 id_col: str = "doc_id", text_col: str = "text", bucket_sets: int = BUCKET_SETS, last_sets: int = LAST_SETS,
                     group_sets: int = GROUP_SETS) -> DataFrame:
    """One row for each document with its class, its representative and the representatives it has links with.

    Two documents are linked if the Jaccard similarity of their word n-gram sets
    is at least ``threshold``.  Columns: ``doc_id``; ``class_id``, the smallest
    id of all documents that links connect; ``copy_id``, the smallest id of
    those with an equal set; ``rep_id``, a document that this one is linked with
    or equal to, or its own; ``linked_reps``, for documents that represent
    themselves or their copies, the other representatives that have a link from
    one of their members to one of this one's; ``n_copies``, the number of other
    documents with an equal set.

    So both ends of every link have the same representative or representatives
    that list each other, and every pair listed has a link.  A link at the
    threshold is found with probability ``recall`` or more; what is found is
    exact but for equal 64-bit hashes: of g n-grams, g^2 / 2^65 false pairs are
    expected, and as many of sets.  A text of fewer than ``n`` words is one
    n-gram.  Texts without words, null ones included, have no links and are
    their own class.  Null ids are kept and come last; a class of null ids alone
    has a null class id.  Repeated rows are documents like others.  An empty
    table gives an empty result; other columns are ignored whatever their names.
    """
    rows, classes, shown = _joined(docs, n, threshold, recall, levels, id_col, text_col, bucket_sets, last_sets, group_sets)
    each = checkpoint(_classed(classes, shown))
    first = apart(each.groupBy("root").agg(F.min("first_id").alias("class_id")).withColumnRenamed("root", "r"))
    named = each.select(F.col("key").alias("id_of"), F.col("first_id").alias("named_id"))
    pairs = shown.select(F.col("key").alias("rep_key"), F.explode("linked").alias("other")).join(named, F.col("other") == F.col("id_of"))
    pairs = pairs.groupBy("rep_key").agg(F.sort_array(F.collect_list("named_id")).alias("linked_reps"))
    each = each.join(first, F.col("root") == F.col("r")).join(apart(named.withColumnRenamed("named_id", "rep_id")), F.col("rep") == F.col("id_of"))
    each = each.join(pairs, F.col("key") == F.col("rep_key"), "left").select(
        F.col("key").alias("of"), "class_id", "first_id", "rep_id", "copies", "linked_reps")
    own = lambda c: F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col(c))
    return rows.join(each, F.col("key") == F.col("of"), "left").select(
        "doc_id", own("class_id").alias("class_id"), own("first_id").alias("copy_id"), own("rep_id").alias("rep_id"),
        F.coalesce("linked_reps", F.array().cast("array<long>")).alias("linked_reps"), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"))


def keep_one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS,
                     id_col: str = "doc_id", text_col: str = "text", bucket_sets: int = BUCKET_SETS, last_sets: int = LAST_SETS,
                     group_sets: int = GROUP_SETS) -> DataFrame:
    """The documents with the smallest id of their class, with all their columns.

    Edge cases as in :func:`jaccard_join`: documents without words all stay, of
    repeated rows one stays (the one whose columns hash lowest).  Columns
    ``__row`` and ``__turn`` of the input are replaced.
    """
    rows, classes, shown = _joined(docs, n, threshold, recall, levels, id_col, text_col, bucket_sets, last_sets, group_sets)
    last = F.coalesce("first_id", F.lit((1 << 63) - 1))
    kept = _classed(classes, shown).groupBy("root").agg(F.min(F.struct(last.alias("id"), F.col("first_row"))).alias("x")).select(F.col("x.first_row").alias("__kept"))
    times = rows.filter("key IS NOT NULL").groupBy("row").agg(F.count("*").alias("n"))
    # rows that repeat an id and a text are rare; only their keys need a turn
    kept = kept.join(times, F.col("__kept") == F.col("row")).select("__kept", (F.col("n") > 1).alias("__many"))
    empty = rows.filter("key IS NULL").select(F.col("row").alias("__kept"), F.lit(False).alias("__many")).distinct()
    own = [c for c in docs.columns if c not in ("__row", "__turn")]
    met = docs.select(*own).withColumn("__row", row_key(id_col, text_col)).join(kept.unionByName(empty), F.col("__row") == F.col("__kept"))
    # equal rows are combined where they are, before those of one key meet
    many = met.filter("__many").dropDuplicates().withColumn("__turn", F.xxhash64(*own))
    least = many.groupBy("__row").agg(F.min("__turn").alias("__least")).withColumnRenamed("__row", "__of")
    one = many.join(least, (F.col("__row") == F.col("__of")) & (F.col("__turn") == F.col("__least")))
    return met.filter("NOT __many").select(*own).unionByName(one.select(*own))
