"""Connected components of a graph of links, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.staging import drop_staged, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least node among itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # Written first: a join of two plain shuffles can be split where a node has very many neighbours.
    least = staged(least, "components-least")
    if large:
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "u").select("v", "m", "u")
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the least node it reaches.

    Each round is written to the shared folder; the rounds end when neither star changes an edge.
    A node's neighbours are never gathered: only their minimum is, with map-side partial aggregates.
    """
    state = lambda df: df.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % (1 << 31)))).first()
    edges = staged(edges.filter("u <> v").select("u", "v").distinct(), label)
    before = None
    while True:
        stars = staged(_stars(_stars(edges, large=True), large=False), label)
        drop_staged(edges)
        edges, now = stars, state(stars)
        if now == before or now[0] == 0:
            break
        before = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
