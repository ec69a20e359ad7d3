"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, join_counted, staged


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """Per node its least neighbour m, and the number n of its edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node hands its larger neighbours to the least node of its neighbourhood (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbours(both).select("u", F.least("u", "m").alias("m"), "n")
    return join_counted(both.where("v > u"), least, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them. Edges point from larger to smaller ids."""
    least = _least_neighbours(edges)
    handed = join_counted(edges, least, ["u"], "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) of any order, repeated or not. Returns (id, component) for every linked node, the component's least id.

    Each round's edges are written to the shared folder; least neighbours are aggregated before they are dealt out, so that
    a node with very many links is no single task's work. Links of a node with itself or with null are ignored.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        large = staged(large_star(edges, before[0]).distinct(), "edges")
        after = staged(small_star(large, before[0]).distinct(), "edges")
        drop_staged(large)
        drop_staged(edges)
        edges, digest = after, _digest(after)
        if digest == before:
            break
        before = digest
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
