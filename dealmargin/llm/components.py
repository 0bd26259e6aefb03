"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmargin.operators.joins import Settled, settle, spread_join


def _star(directed: DataFrame, keep_all: bool) -> DataFrame:
    """Link each neighbour of a node, and the node, to the smallest of them.

    With keep_all only neighbours above the node are linked anew (large star);
    without it the node itself is linked too (small star). The smallest is an
    aggregate met again by a join, so a node with very many neighbours is split.
    """
    least = directed.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
    met = spread_join(directed, least, ["_u"], "inner")
    if keep_all:
        linked = met.where(F.col("_v") > F.col("_u")).select(F.col("_v").alias("_a"), "_m")
    else:
        linked = met.select(F.col("_v").alias("_a"), "_m").unionByName(
            least.select(F.col("_u").alias("_a"), "_m")
        )
    return (
        linked.where(F.col("_a") != F.col("_m"))
        .select(F.col("_a").alias("_u"), F.col("_m").alias("_v"))
        .distinct()
    )


def _settled(edges: DataFrame) -> tuple[Settled, tuple]:
    kept = settle(edges)
    mark = kept.rows.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("_u", "_v"))
    ).first()
    return kept, tuple(mark)


def component_roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every node that has an edge, as node, with the smallest node it reaches, as root.

    Nodes are of one orderable type. Repeated edges and loops change nothing;
    no edges give no rows. Rounds end once the edges, each from a node to a
    smaller one, stop changing: then every node points at its root. Each round
    is a checkpoint in the shared folder, so lost executors cost one round.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")
    ).where(F.col("_u") != F.col("_v")).distinct()
    kept, mark = _settled(pairs)
    while kept.count:
        both = kept.rows.unionByName(
            kept.rows.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"))
        )
        stars = _star(_star(both, keep_all=True), keep_all=False)
        kept, new = _settled(stars)
        if new == mark:
            break
        mark = new
    nodes = kept.rows.select(F.col("_u").alias("node"), F.col("_v").alias("root"))
    roots = kept.rows.select(F.col("_v").alias("node"), F.col("_v").alias("root"))
    return nodes.unionByName(roots.distinct())
