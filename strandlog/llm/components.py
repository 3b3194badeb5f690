"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dropped, written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbours and itself."""
    around = both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these. Edges have a > b, as large_star leaves them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def marked(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The distinct edges, written, and their number and the exclusive or of their hashes, observed as they are written."""
    seen = Observation()
    found = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")), "components")
    return found, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: of each node with an edge, but for the roots themselves, the least node of its component.

    `edges` has columns a and b of one orderable type, in any direction, without nulls. Every round is written to the shared folder;
    the rounds end when two in a row have the same edges, by number and hashes.
    """
    now, mark = marked(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        after, new = marked(small_star(large_star(now)))
        dropped(now)
        now, mark, before = after, new, mark
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
