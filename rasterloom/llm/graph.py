"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `links` (a long, b long) that are not the smallest of their group: component is the
    smallest node that links reach, and has no row itself.

    Alternating large-star and small-star rounds over a table of links u > v. Each round costs two aggregations, which
    combine before their shuffle, and two joins of written tables, whose hot keys (the hub of a large group) adaptive
    execution splits. Links from a node to itself and repeated links are allowed; null ends are dropped.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    edges = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _digest(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        # large star: every larger neighbour of u now hangs on u's smallest neighbour
        large = cut(
            edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
            .union(least.where("m < u").select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(), "star",
        )
        # small star: every smaller neighbour of u, and u, hang on the smallest of them
        small = cut(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        after = cut(
            large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct(), "links",
        )
        now = _digest(after)
        for old in (edges, least, large, small):
            drop_cut(old)
        edges = after
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _digest(edges: DataFrame) -> tuple:
    """Number and checksum of the links, to see when a round changes nothing."""
    mixed = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.sum(F.shiftright(mixed, 24)).alias("s")).first()
    return row["n"], row["x"], row["s"]
