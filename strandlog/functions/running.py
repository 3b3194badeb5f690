"""Running aggregates of long groups: by blocks of the order, with what earlier blocks carry over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMBINED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}


def running(df: DataFrame, keys: list[str], order: str, value, how: str, out: str, before: bool = False, width: int = 1 << 16) -> DataFrame:
    """`df` with `out`: sum, min or max of `value` over the rows of its keys up to this one, or `before` it. Keys aren't null, `order` is a number without ties.

    A block of `width` numbers is a task's window; one row for each block is carried in a second one.
    """
    total = getattr(F, how)
    cut = df.withColumn("own block", F.floor(F.col(order) / width)).withColumn("own value", value)
    blocks = cut.groupBy(*keys, "own block").agg(total("own value").alias("own value"))
    earlier = Window.partitionBy(*keys).orderBy("own block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "own block", total("own value").over(earlier).alias("carried"))
    inside = Window.partitionBy(*keys, "own block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    both = cut.withColumn("own value", total("own value").over(inside)).join(carried, [*keys, "own block"])
    return both.withColumn(out, COMBINED[how](F.col("own value"), F.col("carried"))).drop("own block", "own value", "carried")


def last_before(points: DataFrame, rows: DataFrame, keys: list[str], at: str, start: str) -> DataFrame:
    """`points` that have a row of the same keys before them (start < at), with the other columns of the last such row. Keys aren't null, and a row has no number that a point has."""
    last = F.struct(start, *[c for c in rows.columns if c not in (*keys, start)])
    both = points.unionByName(rows.select(*keys, F.col(start).alias(at), last.alias("last row")), allowMissingColumns=True)
    found = running(both.withColumn("is point", F.col("last row").isNull()), keys, at, F.col("last row"), "max", "found row")
    return found.where("`is point` and `found row` is not null").select(*points.columns, "found row.*")


def floor_walk(df: DataFrame, keys: list[str], order: str, up: Column, before: str, after: str, width: int = 1 << 16) -> DataFrame:
    """`df` with a counter of each key before and after every row: one more where `up`, else one less, but never below zero. Keys aren't null.

    The counter is the sum of steps less its smallest value so far. A block sends the sum of its steps and the smallest sum within it.
    """
    cut = df.withColumn("own block", F.floor(F.col(order) / width)).withColumn("own step", F.when(up, 1).otherwise(-1).cast("long"))
    inside = Window.partitionBy(*keys, "own block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("own sum", F.sum("own step").over(inside)).withColumn("own least", F.min("own sum").over(inside))
    blocks = summed.groupBy(*keys, "own block").agg(F.sum("own step").alias("all steps"), F.min("own sum").alias("least sum"))
    earlier = Window.partitionBy(*keys).orderBy("own block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried sum", F.coalesce(F.sum("all steps").over(earlier), F.lit(0)))
    carried = carried.withColumn("carried least", F.least(F.coalesce(F.min(F.col("carried sum") + F.col("least sum")).over(earlier), F.lit(0)), F.lit(0)))
    both = summed.join(carried.select(*keys, "own block", "carried sum", "carried least"), [*keys, "own block"])
    count = F.col("carried sum") + F.col("own sum") - F.least("carried least", F.col("carried sum") + F.col("own least"))
    both = both.withColumn(after, count)
    # One less leaves zero from one, or from zero where it makes a new least.
    lower = F.col("carried sum") + F.col("own sum") < F.least(F.col("carried least"), F.coalesce(F.col("carried sum") + F.min("own sum").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.when(F.col("own step") > 0, F.col(after) - 1).when(lower, F.lit(0)).otherwise(F.col(after) + 1)
    return both.withColumn(before, first).drop("own block", "own step", "own sum", "own least", "carried sum", "carried least")
