"""Additions to the blacklists of members and functions, as unions with looked-up rows. Names that aren't known add nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subclass_ids(db, data_type: str, subclass: str | None) -> DataFrame:
    of_type = db.data_types.where(F.col("name") == data_type).select(F.col("id").alias("data_type_id"))
    named = F.col("name").isNull() if subclass is None else F.col("name") == subclass
    return db.subclasses.where(named).join(of_type, "data_type_id", "left_semi").select(F.col("id").alias("subclass_id"))


def with_members(db, data_type: str, subclass: str | None, members: list[str]) -> DataFrame:
    """The member blacklist (subclass_id, member_name_id) with members of a subclass; a member that is there already stays once."""
    asked = subclass_ids(db, data_type, subclass).select("subclass_id", F.explode(F.array(*map(F.lit, members))).alias("name"))
    added = asked.join(db.member_names.select(F.col("id").alias("member_name_id"), "name"), "name").select("subclass_id", "member_name_id")
    return db.member_blacklist.select("subclass_id", "member_name_id").unionByName(added).distinct()


def with_functions(db, data_type: str, subclass: str | None, functions: list[str]) -> DataFrame:
    """The function blacklist (subclass_id, member_name_id, fn, sequence) with functions for a subclass, or for all accesses where the type is `any`."""
    spark = db.function_blacklist.sparkSession
    known = spark.range(1).select(F.lit(None).cast("int").alias("subclass_id")) if data_type == "any" else subclass_ids(db, data_type, subclass)
    added = known.select("subclass_id", F.lit(None).cast(dict(db.function_blacklist.dtypes)["member_name_id"]).alias("member_name_id"), F.explode(F.array(*map(F.lit, functions))).alias("fn"), F.lit(None).cast("int").alias("sequence"))
    return db.function_blacklist.select("subclass_id", "member_name_id", "fn", "sequence").unionByName(added)
