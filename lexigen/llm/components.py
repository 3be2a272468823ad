"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigen.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest id around it to its larger neighbours."""
    near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its other smaller neighbours and itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether some node is below two others, or below one and above another: not all edges lead to a root yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.agg(F.count_if((F.col("below") > 1) | (F.col("below") == 1) & (F.col("above") == 1))).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the smallest id it can reach.
    Every round is stored in the shared folder, so no round is computed again; ``edges`` should be stored too."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while _open(edges):
        edges = materialize(_small_star(_large_star(edges)), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links (u, v) between their nodes: the components that
    the links join are edges among themselves, so the work grows with the links."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
    edges = links.join(of("u"), "u").join(of("v"), "v").select(F.col("component_u").alias("u"), F.col("component_v").alias("v"))
    roots = components(materialize(edges, "edges")).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
