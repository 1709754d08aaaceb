"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, join_by_key, written

#: Edges that one partition of an intermediate table holds about.
EDGES_PER_PART = 500_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // EDGES_PER_PART)))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (u, v) with v < u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    # large: larger neighbours of u go to the least of u and its neighbours; a centre of very many is broadcast
    large = join_by_key(both.filter("v > u"), least, ["u"], "c").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small: u and its smaller neighbours, few after the large star, go to the least of them
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for every node on an edge, from columns ``u`` and ``v``; a written table.

    Self-loops, repeated edges and nulls count for nothing.  Only counts and a
    checksum reach the driver; each round is a written table, so lost
    executors and long lineages cost nothing.
    """
    seal = lambda d: d.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = seal(now)
    while last["n"]:
        new = written(_sized(_stars(now), last["n"]), "stars")
        drop_written(now)
        now, was = new, last
        last = seal(now)
        if last == was:
            break
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
    drop_written(now)
    return out
