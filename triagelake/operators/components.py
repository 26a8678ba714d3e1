"""Connected components of an edge list, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.session import staged

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half of the alternating star contraction.

    Large star: every neighbour larger than ``u`` is linked to the least of
    ``u`` and its neighbours.  Small star: ``u`` and its smaller neighbours
    are linked to the least of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(u, v)``.

    Alternating large-star and small-star contraction: about log(n) rounds
    whatever the diameter, each round two aggregations over the edges that
    are left.  The component is its least node.  Null ends are ignored; nodes
    without edges are not listed.
    """
    e = staged(edges.select("u", "v").where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        e = staged(_star(_star(e, True), False))
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
