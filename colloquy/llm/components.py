"""Connected components of an edge table by alternating star contraction.

Each round rewires every vertex to the smallest neighbour it knows (first
towards larger neighbours, then towards smaller ones) until the edges form
stars around the smallest vertex of each component; the number of rounds
grows with the logarithm of a component's diameter. Every round is a few
aggregations and joins over (long, long) rows, written to the shared
folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Parts that the edges of one vertex are dealt to.
PARTS = 32


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_low(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(u, v) with the smallest v of their u as ``m``, (u, m) alone).

    The edges of one u are dealt to ``PARTS`` parts, so the centre of a large
    star is not one task's work.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    low = parts.groupBy("u").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("u", "part").join(low, "u"), ["u", "part"]).drop("part"), low


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    held, _ = _with_low(both)
    return held.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    held, low = _with_low(down)
    moved = held.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges(u, v)`` (longs, no nulls).

    ``component`` is the smallest vertex reachable. Self loops and repeated
    edges do no harm; an empty table gives an empty result.
    """
    current = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = stage(_small_star(_large_star(current)), "stars")
        new = _state(current)
        if new == state:
            break
        state = new
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
