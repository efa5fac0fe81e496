"""Connected components by alternating stars: every node ends at the least node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import materialise


# Tasks that the edges of one node are dealt to.
SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least v of u. A hub is minimised part by part, so its edges never meet in one task."""
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("part"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("u", "part").join(least, "u"), ["u", "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours meet at the least of them (edges run from larger to smaller)."""
    told = _with_least(edges)
    moved = told.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Table (node, component) of every node on an edge between different nodes; ``component`` is the least node reachable.

    Each round is written to the shared folder, so a lost executor repeats one round at most. Minima are combined before
    they are shuffled, and the edges of a busy hub are dealt to many tasks. Edges with a null end are ignored.
    """
    edges = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, f"{name}-edges")
    state = _state(edges)
    while True:
        # a star of a forest of stars is the same again
        edges = materialise(_small_star(_large_star(edges)), f"{name}-edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
