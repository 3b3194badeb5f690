"""Constraints of the trace database, which Spark does not enforce, as one query over all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}: repeated key").alias("constraint"), "n")


def failing(df: DataFrame, name: str, condition: str) -> DataFrame:
    return df.where(f"not ({condition})").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}: {condition}").alias("constraint"), "n")


def orphans(df: DataFrame, name: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    own = df.where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
    return own.join(parent.select(F.col(key).alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}.{column}: no parent").alias("constraint"), "n")


def violated(db) -> DataFrame:
    """constraint, n: how many keys or rows violate each constraint."""
    found = [
        repeated(db.accesses, "accesses", ["id"]),
        repeated(db.locks_held, "locks_held", ["txn_id", "lock_id"]),
        repeated(db.structs_layout, "structs_layout", ["data_type_id", "byte_offset"]),
        repeated(db.member_blacklist, "member_blacklist", ["subclass_id", "member_name_id"]),
        failing(db.allocations, "allocations", "size > 0"),
        failing(db.accesses, "accesses", "type in ('r', 'w')"),
        failing(db.locks, "locks", "sub_lock in ('r', 'w')"),
        orphans(db.accesses, "accesses", "alloc_id", db.allocations, "id"),
        orphans(db.accesses, "accesses", "txn_id", db.locks_held, "txn_id"),
        orphans(db.locks_held, "locks_held", "lock_id", db.locks, "id"),
        orphans(db.locks, "locks", "embedded_in", db.allocations, "id"),
        orphans(db.allocations, "allocations", "subclass_id", db.subclasses, "id"),
    ]
    return reduce(DataFrame.unionAll, found)
