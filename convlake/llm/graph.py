"""Connected components by alternating star contractions, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Join every node's neighbours to the least of them and itself: those above it (``both``), or those below."""
    seen = edges.select("u", "v")
    if both:
        seen = seen.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = seen.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = seen.join(least, "u")
    if both:
        out = joined.where("v > u").select("v", "m")
    else:
        out = joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (u, v: long).

    Each round joins neighbours to the least one around, first upwards, then downwards; it ends when the
    edges are a star around every root. Rounds grow with the logarithm of the longest path.
    """
    edges = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{path}/0")
    last, k = None, 0
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("v"))
    while (now := tuple(edges.agg(mark.alias("m")).first()["m"])) != last and now[0]:
        last, k = now, k + 1
        edges = staged(_stars(_stars(edges, both=True), both=False), f"{path}/{k}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

