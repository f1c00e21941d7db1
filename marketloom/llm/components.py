"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fitted

MAX_ROUNDS = 60
#: Edges (16 bytes each) to a task; beyond as many tasks as there are shuffle partitions, those are left to Spark.
EDGES_A_TASK = 100_000


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself; n: number of edges, which doesn't grow."""
    both = few(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
    # Cut, so that Spark can split the rows of a node with many neighbours in the join.
    least = cut(few(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), n))
    near = few(both.filter("v > u").join(few(least, n), F.col("u") == F.col("x")), n)
    return few(near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), n)


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; edges point from the larger to the smaller end; n: as above."""
    down = few(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n)
    least = cut(few(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), n))
    near = few(down.join(few(least, n), F.col("u") == F.col("x")), n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return few(few(near.unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u <> v"), n).distinct(), n)


def few(df: DataFrame, n: int) -> DataFrame:
    return fitted(df, n, EDGES_A_TASK)


def mark(edges: DataFrame) -> tuple[int, int]:
    """Count and hash of a set of edges; only these two numbers reach the driver."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return int(r.n), int(r.h)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component): each linked node with the least node it reaches. Loops and repeats do no harm."""
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        n = seen[0]
        now = cut(small_star(cut(large_star(few(now, n), n)), n))
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    now = few(now, seen[0])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
