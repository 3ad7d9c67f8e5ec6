"""Title reconciliation between two tables on the same platform.

* exact match on a normalised title (right side deduplicated, first in input
  order wins);
* fuzzy match: best Levenshtein ratio, or best weighted ratio, >= threshold;
* containment match: share of the left title's key words found in the right
  title, with an exact-normalised bucket taking precedence.

No operator emits all pairs of a platform.  Levenshtein candidates share a
segment at a matching place (exact for any threshold, see ``segments``).  The
weighted ratio compares blocks of titles (a shared word or a common stretch is
enough for it, so no key narrows the candidates): the left titles are a query set
against all right ones, only the best of each is returned.  Containment
candidates share one, two or three words at once, whichever gives a title the
fewest of them (see ``word_keys``); the degenerate cases (same normalised title,
empty key-word set) are resolved with group aggregates instead of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd
from pricelens.functions.text import containment_score, key_words, normalize_folded, normalize_plain
from pricelens.operators.cleaning import first_in_order
from pricelens.operators.scoring import best_matches
from pricelens.session import checkpoint


# ---------------------------------------------------------- segment helpers
MIN_THRESHOLD = 60.0


def _most_edits(n: Column, share: float) -> Column:
    """Largest distance between a title of ``n`` characters and any title whose
    ratio to it is at least ``share``: that title has at most n / share
    characters, and the distance is at most (1 - share) of the longer one."""
    return F.floor(n * (1 - share) / share + 1e-9).cast("int")


def _segment(n: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th of ``k + 1`` even segments."""
    base, short = F.floor(n / (k + 1)).cast("int"), k + 1 - n % (k + 1)
    return (i - 1) * base + F.greatest(F.lit(0), i - 1 - short) + 1, base + F.when(i > short, 1).otherwise(0)


def segments(norm: Column, share: float) -> Column:
    """The indexed side: (length, number, text) of a title's segments.

    A title is cut into one segment more than the edits that any match allows,
    so at least one segment stands unchanged in the other title.
    """
    n = F.length(norm)
    k = _most_edits(n, share)

    def one(i):
        start, size = _segment(n, k, i)
        return F.struct(n.alias("n"), i.alias("i"), F.substring(norm, start, size).alias("text"))
    return F.transform(F.sequence(F.lit(1), k + 1), one)


def probes(norm: Column, share: float) -> Column:
    """The probing side: (length, number, text) of the substrings that can be a
    segment of a matching title, for every length such a title may have.

    Segment ``i`` can have moved by at most i - 1 characters counted from the
    left end, and by as many as there are segments after it from the right end
    (otherwise an earlier or later segment matches as well).
    """
    n = F.length(norm)
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n * share - 1e-9).cast("int")), F.floor(n / share + 1e-9).cast("int"))

    def of_length(m):
        k = _most_edits(m, share)

        def of_segment(i):
            start, size = _segment(m, k, i)
            shift = n - m
            first = F.greatest(F.lit(1), start - (i - 1), start + shift - (k + 1 - i))
            last = F.least(n - size + 1, start + (i - 1), start + shift + (k + 1 - i))
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda p: F.struct(m.alias("n"), i.alias("i"), F.substring(norm, p, size).alias("text")))
        return F.flatten(F.transform(F.sequence(F.lit(1), k + 1), of_segment))
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m > 0, F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / m)).otherwise(F.lit(100.0))


# ------------------------------------------------------------- title matching
def _best_levenshtein(titles: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(``platform``, ``norm``, ``_score``, ``_rid``) of the best right title; scored
    where the candidates meet, so that only matches are shuffled."""
    share = threshold / 100
    probe = titles.select("platform", F.col("norm").alias("_ln"), F.explode(probes(F.col("norm"), share)).alias("_s"))
    index = right.select("platform", "_rid", F.col("norm").alias("_rn"), F.explode(segments(F.col("norm"), share)).alias("_s"))
    longer = F.greatest(F.length("_ln"), F.length("_rn"))
    most = F.floor(longer * (1 - share) + 1e-9).cast("int")
    pairs = probe.join(index, ["platform", "_s"]).withColumn("_most", most).where(F.abs(F.length("_ln") - F.length("_rn")) <= F.col("_most"))
    away = pairs.withColumn("_away", F.expr("levenshtein(_ln, _rn, _most)")).where("_away >= 0")
    cand = away.withColumn("_score", F.lit(100.0) * (F.lit(1.0) - F.col("_away") / longer)).where(F.col("_score") >= threshold)
    best = cand.groupBy("platform", "_ln").agg(F.max(F.struct("_score", (-F.col("_rid")).alias("_neg"))).alias("_b"))
    return best.select("platform", F.col("_ln").alias("norm"), F.col("_b._score").alias("_score"), (-F.col("_b._neg")).alias("_rid"))


# Titles of a side that meet in one task.
BLOCK_TITLES = 2048


def _best_weighted(titles: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The same by :func:`pricelens.operators.scoring.weighted_ratio`: every block of
    left titles meets every block of right titles of its platform."""
    blocks = lambda df, name: df.groupBy("platform").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TITLES).cast("int").alias(name))
    grid = blocks(titles, "_nl").join(blocks(right, "_nr"), "platform")
    own = lambda n: F.pmod(F.xxhash64("norm"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = titles.join(grid, "platform").select("platform", own("_nl").alias("_i"), every("_nr").alias("_j"), "norm", F.lit(None).cast("bigint").alias("_rid"))
    b = right.join(grid, "platform").select("platform", every("_nl").alias("_i"), own("_nr").alias("_j"), "norm", F.col("_rid").cast("bigint").alias("_rid"))

    def best(block: pa.Table) -> pa.Table:
        norm, rid = block.column("norm").to_pylist(), block.column("_rid").to_pylist()
        left, right = [t for t, r in zip(norm, rid) if r is None], [(t, r) for t, r in zip(norm, rid) if r is not None]
        found = best_matches(left, [t for t, _ in right], np.array([r for _, r in right], np.int64), threshold) if left and right else []
        return pa.table({"platform": pa.array([block.column("platform")[0].as_py()] * len(found), pa.string()), "norm": pa.array([left[i] for i, _, _ in found], pa.string()),
                         "_score": pa.array([x for _, x, _ in found], pa.float64()), "_rid": pa.array([k for _, _, k in found], pa.int64())})
    met = a.unionByName(b).groupBy("platform", "_i", "_j").applyInArrow(best, "platform string, norm string, _score double, _rid bigint")
    top = met.groupBy("platform", "norm").agg(F.max(F.struct("_score", (-F.col("_rid")).alias("_neg"))).alias("_b"))
    return top.select("platform", "norm", F.col("_b._score").alias("_score"), (-F.col("_b._neg")).alias("_rid"))


SCORERS = {"levenshtein": _best_levenshtein, "weighted": _best_weighted}


def match_titles(left: DataFrame, right: DataFrame, left_key: str = "item_id", right_order: str = "seq",
                 threshold: float = 85.0, payload: list[str] | None = None, scorer: str = "levenshtein") -> DataFrame:
    """Exact-then-fuzzy match of ``left(title, platform)`` to
    ``right(title, platform, <order>, payload...)``.

    Returns one row per left row with ``match_type`` exact / fuzzy /
    unmatched, ``match_score`` (100, rounded score, NULL) and the payload of
    the matched right row.  ``scorer``: ``levenshtein`` or ``weighted``.  Of
    equal scores the first right row wins.  ``threshold`` is at least
    ``MIN_THRESHOLD``: below it segments get too short to tell titles apart.
    """
    if threshold < MIN_THRESHOLD:
        raise ValueError(f"threshold {threshold} is below {MIN_THRESHOLD}")
    payload = payload or []
    # both sides feed several branches: materialise each once (reliable
    # checkpoint in the shared folder) instead of recomputing its lineage
    L = checkpoint(left.select(left_key, "platform", normalize_plain(F.col("title")).alias("norm")))
    R = right.select("platform", right_order, normalize_plain(F.col("title")).alias("norm"), *payload)
    R = checkpoint(first_in_order(R, ["platform", "norm"], [right_order]))   # one row per normalised title

    exact = L.join(R, ["platform", "norm"]).select(
        left_key, F.lit("exact").alias("match_type"), F.lit(100.0).alias("match_score"), *payload)
    rest = L.join(R.select("platform", "norm"), ["platform", "norm"], "left_anti")

    # --- fuzzy: best per distinct title
    some = F.length("norm") > 0
    titles = rest.where(some).select("platform", "norm").distinct()
    best = SCORERS[scorer](titles, R.where(some).select("platform", F.col(right_order).alias("_rid"), "norm"), threshold)
    best = best.join(R.select(F.col("platform").alias("_rp"), F.col(right_order).alias("_ro"), *payload),
                     (F.col("platform") == F.col("_rp")) & (F.col("_rid") == F.col("_ro")))
    fuzzy = rest.join(best, ["platform", "norm"]).select(
        left_key, F.lit("fuzzy").alias("match_type"), rnd("_score", 1).alias("match_score"), *payload)
    matched = exact.unionByName(fuzzy)
    out = L.select(left_key).join(matched.hint("shuffle_hash"), left_key, "left")      # spares a sort of both sides
    return out.withColumn("match_type", F.coalesce("match_type", F.lit("unmatched")))


# ---------------------------------------------------------- containment match
MOST_AT_ONCE = 3        # words of a key
# Titles of more words are indexed by single words, and asked for by single words.
WIDE_NAME, WIDE_TITLE = 12, 24


def _subsets(words: Column, k: int) -> Column:
    """All k-word subsets of an array, each as one text of its words in sorted order."""
    def grow(rest: Column, taken: int) -> Column:
        if taken == 1:
            return F.transform(rest, lambda w: F.array(w))
        return F.flatten(F.transform(rest, lambda w, i: F.transform(
            grow(F.slice(rest, i + 2, F.size(rest)), taken - 1), lambda more: F.concat(F.array(w), more))))
    return F.transform(grow(words, k), lambda s: F.array_join(F.array_sort(s), " "))


def _keys(words: Column, k: int, name: int) -> Column:
    return F.transform(_subsets(words, k), lambda x: F.struct(F.lit(name).alias("k"), x.alias("key")))


def index_keys(words: Column) -> Column:
    """Keys of a right title: its one-, two- and three-word subsets; of a wide one its words alone (k = 0)."""
    narrow = F.concat(*(_keys(words, k, k) for k in range(1, MOST_AT_ONCE + 1)))
    return F.when(F.size(words) <= WIDE_NAME, narrow).otherwise(_keys(words, 1, 0))


def word_keys(ordered: Column, t: Column) -> Column:
    """Keys that a left title may be looked up by, for every k up to the ``t`` words
    that a candidate must share; ``ordered``: its words, rarest first."""
    n = F.size(ordered)
    none = F.array().cast("array<struct<k:int,key:string>>")

    def of(k: int, name: int) -> Column:
        usable = (t >= k) & ((n <= WIDE_TITLE) if k > 1 else F.lit(True))
        return F.when(usable, _keys(F.slice(ordered, F.lit(1), n - t + k), k, name)).otherwise(none)
    return F.concat(of(1, 0), *(of(k, k) for k in range(1, MOST_AT_ONCE + 1)))


def containment_match(left: DataFrame, right: DataFrame, left_key: str = "item_id",
                      right_key: str = "id", threshold: float = 0.6, slack: float = 0.05) -> DataFrame:
    """Best right row per left title by key-word containment.

    Candidates: right rows with the same folded-normalised title if any,
    otherwise every right row on the platform; score |A∩B|/|A| (empty A ->
    1); best must reach ``threshold``; among scores >= best - slack the
    lowest (is_main, in_year_range, id) wins.  ``right`` carries
    ``name, platform, category, year, year_lo, year_hi``.
    """
    L = left.select(left_key, "platform", normalize_folded(F.col("title")).alias("norm"))
    L = checkpoint(L.withColumn("kw", key_words(F.col("norm"))))
    rank = F.struct(
        F.when(F.coalesce(F.col("category"), F.lit(99)) == 0, 0).otherwise(1).alias("r_main"),
        F.when(F.col("year").between(F.col("year_lo"), F.col("year_hi")), 0).otherwise(1).alias("r_year"),
        F.coalesce(F.col(right_key), F.lit(999999)).alias("r_id"),
        F.col(right_key).alias("rid"))
    R = right.select(right_key, "platform", normalize_folded(F.col("name")).alias("norm"),
                     rank.alias("rank"))
    R = checkpoint(R.withColumn("kw", key_words(F.col("norm"))))

    # 1) same normalised title: every candidate scores the same -> min rank
    bucket_best = R.groupBy("platform", "norm").agg(F.min("rank").alias("best"))
    in_bucket = L.join(bucket_best, ["platform", "norm"]).select(
        left_key, F.col("best.rid").alias("match_id"),
        F.lit(1.0).alias("match_score"))
    rest = L.join(bucket_best.select("platform", "norm"), ["platform", "norm"], "left_anti")

    # 2) empty key-word set: all platform rows score 1.0 -> platform min rank
    plat_best = R.groupBy("platform").agg(F.min("rank").alias("best"))
    empty = rest.where(F.size("kw") == 0).join(plat_best, "platform").select(
        left_key, F.col("best.rid").alias("match_id"), F.lit(1.0).alias("match_score"))

    # 3) general case.  Every kept candidate overlaps A in at least
    #    t = ceil((threshold - slack)|A|) words, so of A's first |A| - t + k words
    #    in any fixed order it has k or more, and shares one of their k-word
    #    subsets.  Rarest-first keeps hot words out; every title takes the k that
    #    gives it the fewest candidates.  Equal titles are looked up once, and of
    #    equal right titles the one with the best rank stands for all.
    gen = rest.where(F.size("kw") > 0).groupBy("platform", "norm").agg(F.first("kw").alias("kw")).withColumn("_title", F.monotonically_increasing_id())
    gen = checkpoint(gen)
    names = checkpoint(bucket_best.join(R.groupBy("platform", "norm").agg(F.first("kw").alias("kw")), ["platform", "norm"])
                       .select("platform", F.col("norm").alias("_name"), "kw", "best"))
    lo = threshold - slack
    t = F.ceil(F.size("kw") * F.lit(lo) - F.lit(1e-9)).cast("int")
    freq = names.select("platform", F.explode("kw").alias("w")).groupBy("platform", "w").agg(F.count(F.lit(1)).alias("df"))
    words = gen.select("_title", "platform", F.explode("kw").alias("w"), t.alias("_t")) \
               .join(freq, ["platform", "w"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = words.groupBy("_title", "platform", "_t").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("_ws")) \
                  .withColumn("_ws", F.transform("_ws", lambda x: x["w"]))
    index = names.select("platform", "_name", F.explode(index_keys(F.col("kw"))).alias("_k"))
    times = index.groupBy("platform", "_k").agg(F.count(F.lit(1)).alias("n"))
    asked = checkpoint(ranked.select("_title", "platform", F.explode(word_keys(F.col("_ws"), F.col("_t"))).alias("_k")).join(times, ["platform", "_k"], "left"))
    cost = asked.where("_k.k > 0").groupBy("_title", F.col("_k.k").alias("k")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
    chosen = cost.groupBy("_title").agg(F.min(F.struct("cost", "k")).alias("_c")).select("_title", F.col("_c.k").alias("_chosen"))
    probe = asked.where("n > 0").join(chosen, "_title").where((F.col("_k.k") == 0) | (F.col("_k.k") == F.col("_chosen")))
    pairs = probe.join(index, ["platform", "_k"]).select("platform", "_title", "_name").distinct()
    cand = (pairs.join(gen.select("_title", F.col("kw").alias("a_kw")), "_title")
            .join(names.select("platform", "_name", F.col("kw").alias("b_kw"), F.col("best").alias("rank")), ["platform", "_name"]))
    cand = cand.withColumn("score", containment_score(F.col("a_kw"), F.col("b_kw"))).where(F.col("score") >= lo).select("_title", "score", "rank")
    best = cand.groupBy("_title").agg(F.max("score").alias("best"))
    keep = cand.join(best, "_title").where((F.col("best") >= threshold) & (F.col("score") >= F.col("best") - F.lit(slack)))
    found = keep.groupBy("_title").agg(F.min(F.struct("rank", "score")).alias("_m")).join(gen.select("_title", "platform", "norm"), "_title")
    general = rest.join(found, ["platform", "norm"]).select(
        left_key, F.col("_m.rank.rid").alias("match_id"), F.col("_m.score").alias("match_score"))

    matched = in_bucket.unionByName(empty).unionByName(general)
    return L.select(left_key).join(matched, left_key, "left")
