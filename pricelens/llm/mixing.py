"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source is cut into permuted blocks of documents (by hash).
2. Targets: weights share all words; a source stops at ``max_epochs`` times its
   size and the excess goes to the others by weight (water filling).
3. A source's quota is an exact number of block draws: whole passes over its
   blocks, then permuted blocks up to the target, the last one in part.
4. The quotas are split among the output shards by a binary tree: at every node
   the left half's draws of each source are multivariate hypergeometric.
5. A shard draws its quota of each source from the permuted block draws, without
   overlap, and shuffles its documents locally by hash.

Only DataFrame functions.  Documents meet the plan by (source, block); the plan
has at most ``N_BLOCKS`` rows a source and is broadcast if it is small, so the
documents stay where they are but for those of the one block of each source that
its target cuts.
All randomness is a hash of the seed and the row: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import SPACE_WORD
from pricelens.session import checkpoint

N_BLOCKS = 1024
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
N_SHARDS = 16
# Rows of a plan that may be broadcast; a larger one is joined.
BROADCAST_ROWS = 200_000
SEED = 17


def _hash(*parts) -> F.Column:
    return F.xxhash64(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def _uniform(*parts) -> F.Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(_hash(*parts), 11) / F.lit(float(1 << 53))


def keyed(docs: DataFrame, source_col: str, text_col: str, id_col: str, seed: int = SEED) -> DataFrame:
    """Adds ``__source``, ``__draw`` (a hash of id and text) and ``__block``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    draw = _hash(seed, F.col(id_col), text)
    return docs.withColumns({"__source": F.col(source_col).cast("string"), "__draw": draw,
                             "__block": F.pmod(_hash(seed + 1, draw), F.lit(N_BLOCKS)).cast("int")})


def word_count(text_col: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(SPACE_WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``__source``, ``source_size`` -> also ``target``.  One row per source goes in and out.

    Weights repeat over the sources in code-point order, null last.  Sources
    are sorted by the level at which they saturate; the level that holds for
    the others is found by running sums over that order.
    """
    named = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                  (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("__source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    level = ((F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), none))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), none)))
    ranked = ranked.withColumn("level", level)
    free = F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    # rounding may leave no free source when all are full
    return ranked.withColumn("free", free).select(
        "__source", "source_size", F.least("cap", F.coalesce(F.col("free") * F.col("w"), F.col("cap"))).alias("target"))


def hypergeometric(total: F.Column, good: F.Column, draws: F.Column, u: F.Column) -> F.Column:
    """A hypergeometric number by inversion of ``u``, exact within 12 standard deviations of the mode.

    ``draws`` of ``total`` things are taken, of which ``good`` are good.
    """
    def bounds(x):
        n, k, m = (x[c].cast("double") for c in ("total", "good", "draws"))
        sd = F.sqrt(F.greatest(F.lit(0.0), m * k / F.greatest(n, F.lit(1.0)) * (1 - k / F.greatest(n, F.lit(1.0)))))
        mode, span = F.floor((m + 1) * (k + 1) / (n + 2)), F.ceil(12 * sd) + 10
        low = F.greatest(F.lit(0).cast("long"), x["draws"] - (x["total"] - x["good"]), (mode - span).cast("long"))
        high = F.greatest(low, F.least(x["good"], x["draws"], (mode + span).cast("long")))
        return F.struct(n.alias("n"), k.alias("k"), m.alias("m"), low.alias("low"), high.alias("high"))

    def masses(x):
        """Probabilities from low to high, up to a factor: each from the one before."""
        def up(state, i):
            y = i.cast("double") - 1
            p = F.when(i == x["low"], F.lit(1.0)).otherwise(
                state["p"] * (x["k"] - y) * (x["m"] - y) / ((y + 1) * (x["n"] - x["k"] - x["m"] + y + 1)))
            return F.struct(p.alias("p"), F.concat(state["all"], F.array(p)).alias("all"))
        start = F.struct(F.lit(0.0).alias("p"), F.array().cast("array<double>").alias("all"))
        return F.struct(x["low"].alias("low"), F.aggregate(F.sequence(x["low"], x["high"]), start, up)["all"].alias("p"))

    def summed(x):
        return F.struct(x["low"].alias("low"), x["p"].alias("p"), (F.aggregate(x["p"], F.lit(0.0), lambda t, p: t + p) * u).alias("goal"))

    def found(x):
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("i"))
        return x["low"] + F.aggregate(x["p"], start, lambda t, p: F.struct(
            (t["sum"] + p).alias("sum"), (t["i"] + F.when(t["sum"] + p < x["goal"], 1).otherwise(0)).alias("i")))["i"]

    # every step is worked out once: it is the element of an array that the next step transforms
    steps = F.array(F.struct(total.cast("long").alias("total"), good.cast("long").alias("good"), draws.cast("long").alias("draws")))
    for step in (bounds, masses, summed, found):
        steps = F.transform(steps, step)
    return F.least(steps[0], good, draws)


def split_quotas(quotas: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(``__source``, ``quota``) -> (``__source``, ``shard``, ``quota``) by the splitting tree.

    Shards get equal totals (up to one draw at each level); given the totals,
    the sources' shares are multivariate hypergeometric at every node.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("__source"), F.lit("")).alias("o"),
                                                            F.col("__source").alias("s"), F.col("quota").alias("q")))).alias("has"))
    nodes = nodes.withColumns({"lo": F.lit(0), "hi": F.lit(n_shards)})
    for _ in range(max(0, (n_shards - 1).bit_length())):
        nodes = nodes.withColumn("mid", F.ceil((F.col("lo") + F.col("hi")) / 2).cast("int"))
        total = F.aggregate("has", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        take = F.round(total * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        nodes = nodes.withColumns({"total": total, "take": take})

        def draw(state, x):
            got = F.when(state["m"] <= 0, F.lit(0).cast("long")).otherwise(hypergeometric(
                state["n"], x["q"], state["m"], _uniform(seed + 2, F.col("lo"), F.col("hi"), x["s"], x["o"])))
            return F.struct((state["n"] - x["q"]).alias("n"), (state["m"] - got).alias("m"),
                            F.concat(state["out"], F.array(got)).alias("out"))

        first = F.struct(F.col("total").alias("n"), F.col("take").alias("m"), F.array().cast("array<bigint>").alias("out"))
        nodes = nodes.withColumn("left", F.aggregate("has", first, draw)["out"])
        half = lambda f: F.zip_with("has", "left", lambda x, g: F.struct(x["o"].alias("o"), x["s"].alias("s"), f(x, g).alias("q")))
        parts = F.when(F.col("hi") - F.col("lo") <= 1, F.array(F.struct("lo", "hi", "has"))).otherwise(F.array(
            F.struct("lo", F.col("mid").alias("hi"), half(lambda x, g: g).alias("has")),
            F.struct(F.col("mid").alias("lo"), "hi", half(lambda x, g: x["q"] - g).alias("has"))))
        nodes = nodes.select(F.explode(parts).alias("n")).select("n.lo", "n.hi", "n.has")
    return nodes.select(F.col("lo").alias("shard"), F.explode("has").alias("x")).select(
        F.col("x.s").alias("__source"), "shard", F.col("x.q").alias("quota"))


def block_plan(blocks: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
               n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """(``__source``, ``__block``, ``words``) -> what is drawn of every block.

    Adds ``source_size``, ``target``, ``copies`` (whole draws), ``part`` (words
    of one more draw that ends at the target, else 0) and ``shards`` (the shard
    of each draw in turn).
    """
    row = Window.partitionBy("__source").orderBy("turn", "__block")
    blocks = blocks.withColumn("turn", _hash(seed + 3, F.col("__source"), F.col("__block")))
    # at most N_BLOCKS rows a source
    blocks = blocks.withColumn("end", F.sum("words").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sources = blocks.groupBy("__source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, max_epochs).withColumnRenamed("__source", "of")
    blocks = blocks.join(targets, F.col("__source").eqNullSafe(F.col("of"))).drop("of")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - passes * F.col("source_size")).cast("long")
    begin = F.col("end") - F.col("words")
    blocks = blocks.withColumns({
        "copies": passes + F.when((F.col("words") > 0) & (F.col("end") <= rest), 1).otherwise(0),
        "part": F.when((begin < rest) & (rest < F.col("end")), rest - begin).otherwise(0).cast("long")})
    draws = blocks.withColumn("n", (F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int"))
    quotas = draws.groupBy("__source").agg(F.sum("n").cast("long").alias("quota"))
    shards = split_quotas(quotas, n_shards, seed).groupBy("__source").agg(
        F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("quotas")).withColumnRenamed("__source", "of")
    slots = draws.filter("n > 0").select("__source", "__block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    turn = Window.partitionBy("__source").orderBy(_hash(seed + 4, F.col("__source"), F.col("__block"), F.col("copy")), "__block", "copy")
    slots = slots.withColumn("slot", F.row_number().over(turn)).join(shards, F.col("__source").eqNullSafe(F.col("of")))
    # the shard in whose range of the permuted draws the slot falls
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(None).cast("int").alias("shard"))
    shard = F.aggregate("quotas", state, lambda a, q: F.struct(
        (a["end"] + q["quota"]).alias("end"),
        F.when(a["shard"].isNull() & (F.col("slot") <= a["end"] + q["quota"]), q["shard"]).otherwise(a["shard"]).alias("shard")))["shard"]
    slots = slots.select("__source", "__block", F.struct("copy", shard.alias("shard")).alias("x"))
    slots = slots.groupBy(F.col("__source").alias("of"), F.col("__block").alias("b")).agg(
        F.transform(F.array_sort(F.collect_list("x")), lambda x: x["shard"]).alias("shards"))
    return draws.join(slots, F.col("__source").eqNullSafe(F.col("of")) & (F.col("__block") == F.col("b")), "left").select(
        "__source", "__block", "source_size", "target", "copies", "part",
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, n_shards: int = N_SHARDS,
        seed: int = SEED, with_columns: bool = True) -> DataFrame:
    """What the mix draws of every document; one output row for each input row.

    Keeps the columns of ``docs`` (``with_columns=False``: only the id) and adds
    ``size`` (words), ``source_size``, ``target`` (the source's words in the
    mix), ``taken`` (words of this document in the mix, repeats counted),
    ``shards`` (the output shard of every draw, one of a cut draw included) and
    ``shard_order`` (the document's place in its shards, ascending).  Input
    columns of these names are replaced.  Of each source one document may be
    cut: its last draw ends at the source's target.

    A null text has no words and is never taken; null sources are one source,
    last in order.  Repeated rows count as often as they stand there; equal rows
    are ordered arbitrarily, with the same multiset of results.  An empty table
    gives an empty result.
    """
    rows = keyed(docs, source_col, text_col, id_col, seed)
    own = [] if not with_columns else [c for c in docs.columns if c not in
                                       ("size", "source_size", "target", "taken", "shards", "shard_order")]
    narrow = checkpoint(rows.select(F.col(id_col).alias("doc_id"), "__source", "__block", "__draw", word_count(text_col).alias("__size")))
    blocks = narrow.groupBy("__source", "__block").agg(F.sum("__size").alias("words"))
    plan = checkpoint(block_plan(blocks, weights, max_epochs, n_shards, seed).withColumnsRenamed({"__source": "of", "__block": "b"}))
    if with_columns:
        size = word_count(text_col)
    else:
        rows, own, size = narrow, ["doc_id"], F.col("__size")
    small = plan.count() <= BROADCAST_ROWS
    order = Window.partitionBy("__source", "__block").orderBy("__draw", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.sum("__size").over(order) - F.col("__size")

    def drawn(cut_blocks: bool) -> DataFrame:
        part = plan.filter((F.col("part") > 0) == F.lit(cut_blocks))
        met = rows.join(F.broadcast(part) if small else part, F.col("__source").eqNullSafe(F.col("of")) & (F.col("__block") == F.col("b")))
        met = met.withColumn("__size", size)
        cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), F.col("part") - begin)) if cut_blocks else F.lit(0).cast("long")
        met = met.withColumn("__cut", cut)
        return met.select(
            *own, F.col("__size").alias("size"), "source_size", "target",
            (F.col("copies") * F.col("__size") + F.col("__cut")).alias("taken"),
            F.when(F.col("__cut") > 0, F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.col("copies").cast("int"))).alias("shards"),
            _hash(seed + 5, F.col("__draw")).alias("shard_order"))
    return drawn(False).unionByName(drawn(True))
