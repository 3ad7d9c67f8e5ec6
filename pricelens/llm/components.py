"""Connected components of a large graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.session import checkpoint


# Rows of a partition of the tables below, which hold a few numbers a row.
ROWS_PER_PART = 100_000


def apart(sums: DataFrame, parts: int | None = None) -> DataFrame:
    """Sums by a key, dealt out once more before they are joined to the rows they sum.

    Without this the join would use the aggregate's own partitions, and Spark
    could not split the rows of a key that has very many.
    """
    return sums.repartition(parts or int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parts_for(df: DataFrame, rows: int) -> int:
    """Partitions for a number of rows: few rows need not be written in as many pieces as many."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PART)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``root``) for every node of an edge; the root is the component's smallest node.

    Edges point from the larger to the smaller node.  A large step hangs a
    node's larger neighbours on its smallest one, a small step its smaller
    neighbours; both keep the components and end, after a number of rounds that
    grows with the logarithm of the nodes, in one star for each.  A round joins
    every edge twice, and the rounds end as soon as there are only stars.  The
    edges of a node are never gathered: its smallest neighbour is an aggregate
    that is joined back, so a node with very many edges can be split between
    tasks.
    """
    x, y = F.col(a), F.col(b)
    ways = lambda *pairs: F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in pairs))).alias("e")
    now = checkpoint(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while True:
        parts = parts_for(now, 2 * now.count())
        now = now.coalesce(parts)
        both = now.select(ways(("u", "v"), ("v", "u"))).select("e.u", "e.v")
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("up"), F.count_if(F.col("v") > F.col("u")).alias("down"))
                           .withColumnRenamed("u", "w").coalesce(parts))
        # stars: every node hangs on one other, on which none hangs in turn, or on none
        if least.filter("up > 1 OR up = 1 AND down > 0").isEmpty():
            break
        large = both.filter("v > u").join(apart(least.select("w", "m"), parts), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large.coalesce(parts).distinct().coalesce(parts))
        least = apart(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w").coalesce(parts), parts)
        small = large.join(least, F.col("u") == F.col("w")).select(ways(("u", "m"), ("v", "m"))).select("e.u", "e.v")
        now = checkpoint(small.filter("u > v").coalesce(parts).distinct().coalesce(parts))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
