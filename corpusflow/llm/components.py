"""Connected components of an edge table by alternating star contraction.

Every round is two aggregations (a minimum per vertex, combined on the map side) and two
joins that AQE can split; the edges are written to the shared folder after each, so lineage
stays short and no vertex's neighbours are gathered. Rounds grow with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour of each vertex. Dealt anew, so that the join with the edges is one AQE can split."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).repartition(F.xxhash64("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the greater to the smaller vertex."""
    m = _least(edges)
    down = edges.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(m.select("u", F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs in any order to ``(u, root)``: root is the least vertex reachable.

    Vertices that are their own root are left out. Loops, repeated edges and nulls are dropped.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    e = materialize(e, "edges")
    seen = _print(e)
    while seen[0]:
        e = materialize(_small_star(_large_star(e).where("u != v").distinct()).where("u != v").distinct(), "edges")
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e.withColumnRenamed("v", "root")
