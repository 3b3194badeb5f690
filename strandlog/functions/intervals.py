"""Range joins by nodes of a binary tree of time: an equi-join on (key, level, node), never a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def right(x: Column, by: Column) -> Column:
    """`x` divided by a power of two, rounded down."""
    return F.call_function("shiftright", x, by.cast("int"))


def covering_nodes(low: Column, high: Column) -> Column:
    """The fewest nodes (level, node) that cover the buckets from `low` to `high` and no others: a node of a level stands for 2^level buckets.

    On each level at most the first and the last node inside the range have a parent that reaches beyond it, so that there are
    no more than two for each binary digit of the range's length.
    """
    first = lambda level: -right(-low, level)
    last = lambda level: right(high + 1, level) - 1

    def ends(level: Column) -> Column:
        kept = F.filter(F.array_distinct(F.array(first(level), last(level))), lambda i: (first(level) <= i) & (i <= last(level)) & ~((first(level + 1) <= right(i, F.lit(1))) & (right(i, F.lit(1)) <= last(level + 1))))
        return F.transform(kept, lambda i: F.struct(level.alias("level"), i.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(high - low + 1)) - 1), ends))


def points_in_intervals(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, key: str, width: int) -> DataFrame:
    """Pairs of a point and an interval of the same key with low < at < high; a null high is open.

    Time is cut into buckets of `width`. An interval is laid on the nodes that cover its buckets, some 2 log2(n) of them however long it is, and a
    point on its ancestors of those levels that the key's intervals have: where all are short that is a level or two. What remains for one
    node is many points for few intervals, which adaptive execution can split on the points' side.
    """
    last = points.groupBy(key).agg(F.max(at).alias("last point"))
    bucket = lambda c: F.floor(c / width).cast("long")
    end = F.least(F.coalesce(F.col(high), F.col("last point")), F.col("last point"))
    cut = intervals.join(last, key).where(F.col(low) < F.col("last point")).withColumns({"first bucket": bucket(F.col(low)), "last bucket": bucket(end)})
    cut = cut.where(F.col("last bucket") >= F.col("first bucket"))
    laid = cut.withColumn("tree", F.explode(covering_nodes(F.col("first bucket"), F.col("last bucket")))).withColumns({"tree level": F.col("tree.level"), "tree node": F.col("tree.node")}).drop("tree", "first bucket", "last bucket", "last point")
    levels = laid.groupBy(key).agg(F.collect_set("tree level").alias("levels"))
    climbed = points.join(levels, key).withColumn("tree level", F.explode("levels")).withColumn("tree node", right(bucket(F.col(at)), F.col("tree level"))).drop("levels")
    inside: Column = (F.col(at) > F.col(low)) & (F.col(high).isNull() | (F.col(at) < F.col(high)))
    return climbed.join(laid, [key, "tree level", "tree node"]).where(inside).drop("tree level", "tree node")
