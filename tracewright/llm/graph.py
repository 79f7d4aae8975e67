"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Work

#: Edges that one task works on, and the most edges whose aggregates are broadcast.
ROWS_A_TASK = 100_000
SMALL = 500_000


def components(work: Work, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, comp)`` for every id of an edge; ``comp`` is the least id that it can reach.

    Each step is two aggregations and two joins on ids; the edges never leave the executors.  The
    number of steps grows with the logarithm of the longest chain.  Loops are ignored.
    """
    u, v = F.col("u"), F.col("v")
    e = work.table(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    sizes = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    mark = sizes(e)
    while True:
        # as many tasks as the edges need; one side is broadcast only if it is known to be small
        few = lambda df, n=1 + mark[0] // ROWS_A_TASK: df.coalesce(n)
        sent = F.broadcast if mark[0] <= SMALL else (lambda df: df)
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        # large star: a larger neighbour points at the least one
        large = both.where(v > u).join(sent(least), "u").select(v.alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours point at the least of them
        down = large.where(u != v)  # repeats do no harm before the distinct() below
        low = few(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(sent(low), "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        new = work.table(few(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()), "edges")
        now = sizes(new)
        work.drop(e)
        e = new
        if now == mark:
            break
        mark = now
    return e.select(u.alias("id"), v.alias("comp")).unionByName(e.select(v.alias("id"), v.alias("comp")).distinct())
