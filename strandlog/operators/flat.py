"""Wide derived tables: accesses with their members and without blacklisted ones, embedded locks, and the checks on them.

`db` is anything with the base tables as attributes, as strandlog.sources.events.Trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_members(db) -> DataFrame:
    """Accesses joined with allocation, type, and the member at their offset; null members where the layout has none."""
    at = db.accesses.withColumnsRenamed({"id": "ac_id", "type": "ac_type", "size": "ac_size"}).join(db.allocations.select(F.col("id").alias("alloc_id"), "subclass_id", "base_address"), "alloc_id")
    typed = at.join(db.subclasses.select(F.col("id").alias("subclass_id"), "data_type_id"), "subclass_id").withColumn("helper_offset", (F.col("address") - F.col("base_address")).cast("int"))
    layout = db.layout_flat.select("data_type_id", "helper_offset", "member_name_id", "byte_offset", F.col("data_type_name").alias("member_type"))
    return typed.join(layout, ["data_type_id", "helper_offset"], "left")


def blacklisted(rules: DataFrame, frames: DataFrame) -> tuple[DataFrame, Column]:
    """Frames that a function rule names, and the condition under which the rule holds for an access's subclass and member."""
    hits = rules.join(frames.select(F.col("id").alias("stacktrace_id"), F.col("function").alias("fn"), F.col("sequence").alias("frame")), "fn").where("sequence is null or sequence = frame")
    hits = hits.select("stacktrace_id", F.col("subclass_id").alias("bl_subclass"), F.col("member_name_id").alias("bl_member"), "fn", "frame")
    holds = (F.col("bl_subclass").isNull() & F.col("bl_member").isNull()) | ((F.col("bl_subclass") == F.col("subclass_id")) & (F.col("bl_member").isNull() | (F.col("bl_member") == F.col("member_name_id"))))
    return hits, holds


FLAT = ("ac_id", "txn_id", "alloc_id", "ac_type", "context", "subclass_id", "data_type_id", "stacktrace_id", "member_name_id", "byte_offset")


def accesses_flat(db) -> DataFrame:
    found = with_members(db).where("member_name_id is not null").join(db.member_blacklist, ["subclass_id", "member_name_id"], "left_anti")
    hits, holds = blacklisted(db.function_blacklist, db.stacktraces)
    hits = hits.withColumnRenamed("stacktrace_id", "bl_stack").drop("fn", "frame")
    return found.join(hits, (F.col("stacktrace_id") == F.col("bl_stack")) & holds, "left_anti").select(*FLAT)


def locks_embedded_flat(db) -> DataFrame:
    a = db.allocations.select(F.col("id").alias("alloc_id"), "subclass_id", "base_address")
    found = db.locks.select(F.col("id").alias("lock_id"), "sub_lock", "address", F.col("embedded_in").alias("alloc_id")).join(a, "alloc_id").join(db.subclasses.select(F.col("id").alias("subclass_id"), "data_type_id"), "subclass_id")
    found = found.withColumn("helper_offset", (F.col("address") - F.col("base_address")).cast("int")).join(db.layout_flat, ["data_type_id", "helper_offset"])
    return found.select("lock_id", "sub_lock", "alloc_id", "subclass_id", "data_type_id", "member_name_id")


def broken_accesses(db) -> DataFrame:
    """Accesses that no member covers; a sound trace has none."""
    return with_members(db).where("member_name_id is null").select("ac_id", "alloc_id", "address", "data_type_id")


def without_atomics(db, exact: bool = True) -> DataFrame:
    """Accesses whose member isn't of an atomic type. The second pattern's star is literal unless `exact` is off."""
    patterns = [r"%atomic\_t%", r"%atomic64\_t*" if exact else r"%atomic64\_t%", r"%atomic\_long\_t%"]
    atomic = F.lit(False)
    for p in patterns:
        atomic = atomic | F.col("member_type").like(p)
    gone = with_members(db).where(atomic).select(F.col("ac_id").alias("id"))
    return db.accesses.join(gone, "id", "left_anti")


def ignored_accesses(db) -> DataFrame:
    """Accesses that a blacklist drops: a row for each frame and matching rule, with flags of what matched."""
    found = with_members(db).where("member_name_id is not null")
    frames = db.stacktraces.select(F.col("id").alias("stacktrace_id"), "sequence", "function")
    rules = db.function_blacklist.select(F.col("fn").alias("function"), F.col("subclass_id").alias("bl_subclass"), F.col("member_name_id").alias("bl_member"), F.col("sequence").alias("bl_sequence"), F.col("id").alias("rule_id"))
    holds = (F.col("bl_subclass").isNull() & F.col("bl_member").isNull()) | ((F.col("bl_subclass") == F.col("subclass_id")) & (F.col("bl_member").isNull() | (F.col("bl_member") == F.col("member_name_id"))))
    at = found.join(frames, "stacktrace_id").alias("x")
    r = rules.alias("r")
    hit = (F.col("x.function") == F.col("r.function")) & holds & (F.col("bl_sequence").isNull() | (F.col("bl_sequence") == F.col("sequence")))
    members = db.member_blacklist.withColumn("by_member", F.lit(1))
    both = at.join(r, hit, "left").drop(F.col("r.function")).join(members, ["subclass_id", "member_name_id"], "left").where("rule_id is not null or by_member is not null")
    return both.select("ac_id", "sequence", "function", "rule_id", F.when(F.col("rule_id").isNotNull(), 1).otherwise(0).alias("by_function"), F.coalesce("by_member", F.lit(0)).alias("by_member"))
