"""Connected components by alternating large and small stars: every round is two grouped minima and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, own_query


def _stamp(edges: DataFrame) -> tuple:
    with own_query(edges.sparkSession):
        return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the undirected ``links`` (a, b), the smallest node that it reaches, roots themselves left out.

    Each round's edges are written to the shared folder, and replace the last round's; a node with very many edges is a skewed side of a plain join,
    which adaptive execution splits, and its minimum is taken within tasks first. Links of a node to itself are ignored;
    no links give no rows.
    """
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = _stamp(edges)
    while stamp[0]:
        # large star: larger neighbours are linked to the smallest of the neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        star = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        forget(edges, least)
        # small star: smaller neighbours and the node itself are linked to the smallest
        least = materialize(star.groupBy("u").agg(F.min("v").alias("m")))
        smaller = star.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(smaller.union(least.select("u", F.col("m").alias("v"))).distinct())
        forget(star, least)
        before, stamp = stamp, _stamp(edges)
        if stamp == before:
            break
    return edges.withColumnsRenamed({"u": "node", "v": "root"})
