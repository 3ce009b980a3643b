"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # no more rows than edges


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # the row of the least neighbour is u's own link
    from_u = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return down.join(least, "u").select(from_u.alias("u"), F.col("m").alias("v")).distinct()


def connected_components(links: DataFrame, stored: bool = False) -> DataFrame:
    """links (u, v) of any orderable type to (node, component): the smallest node reachable.

    Only nodes with a link to another node are returned. A node with very many links is summed
    before it is shuffled, and its join is a skewed join that adaptive execution splits. Each round
    is a written table, so that a lost executor repeats one round at most. Rounds end when all links
    lead to nodes that have none to a smaller one. stored: links are read from tables, and hardly repeat.
    """
    edges = links.select("u", "v").filter("u != v")
    edges = edges if stored else written(edges.distinct(), "links")
    for _ in range(MAX_ROUNDS):
        edges = written(_small_star(_large_star(edges)), "links")
        if edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extended_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """components (node, component) joined further by links (u, v): only links between different ones are looked
    at, as links of the components themselves, so that what is joined already costs nothing more."""
    own = lambda n: components.select(F.col("node").alias(n), F.col("component").alias(f"{n}_root"))
    placed = links.select("u", "v").join(own("u"), "u", "left").join(own("v"), "v", "left")
    apart = placed.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    roots = written(connected_components(apart), "component-roots")
    known = components.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    new = roots.join(components.select("node"), "node", "left_anti")
    return known.select("node", F.coalesce("root", "component").alias("component")).union(new.select("node", "component"))
