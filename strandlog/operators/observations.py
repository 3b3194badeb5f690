"""Which locks were held while which members were accessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.labels import described_locks, joined_in_order, label


def type_names(db, subclasses: bool) -> DataFrame:
    """type_id and type_name, for data types or for subclasses as type:subclass."""
    if not subclasses:
        return db.data_types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    dt = db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("dt_name"))
    return db.subclasses.join(dt, "data_type_id").select(F.col("id").alias("type_id"), F.concat_ws(":", "dt_name", "name").alias("type_name"))


def chosen(db, subclasses: bool, data_type: str | None, member: str | None) -> DataFrame:
    flat = db.accesses_flat.withColumn("type_id", F.col("subclass_id" if subclasses else "data_type_id"))
    if data_type not in (None, "any"):
        flat = flat.join(F.broadcast(db.data_types.where(F.col("name") == data_type).select(F.col("id").alias("data_type_id"))), "data_type_id", "left_semi")
    named = flat.join(db.member_names.select(F.col("id").alias("member_name_id"), F.col("name").alias("member")), "member_name_id")
    return named if member in (None, "any") else named.where(F.col("member") == member)


def txn_members_locks(db, subclasses: bool = False, write_over_read: bool = False, data_type: str | None = None, member: str | None = None) -> DataFrame:
    """type_id, type_name, members_accessed, locks_held, occurrences.

    Accesses are folded within a transaction and allocation, to one per member and access type, or to the write if there is one
    (`write_over_read`). Accesses without locks are each a transaction of their own.
    """
    flat = chosen(db, subclasses, data_type, member)
    keys = ["alloc_id", "txn_id", "type_id"]
    inside = flat.where("txn_id is not null")
    if write_over_read:
        folded = inside.groupBy(*keys, "byte_offset", "member").agg(F.max("ac_type").alias("ac_type"))
    else:
        folded = inside.select(*keys, "byte_offset", "member", "ac_type").distinct()
    groups = folded.groupBy(*keys).agg(joined_in_order(["byte_offset", "ac_type", "member"], F.concat_ws(":", "ac_type", "member"), ",").alias("members_accessed"))
    held = groups.join(db.locks_held.select("txn_id", "lock_id", "start"), "txn_id").join(described_locks(db, subclasses), "lock_id")
    locked = held.groupBy(*keys, "members_accessed").agg(joined_in_order(["start", "lock_id"], label(F.col("alloc_id")), ",").alias("locks_held")).select("type_id", "members_accessed", "locks_held")
    free = flat.where("txn_id is null").select("type_id", F.concat_ws(":", "ac_type", "member").alias("members_accessed"), F.lit("").alias("locks_held"))
    return locked.unionAll(free).groupBy("type_id", "members_accessed", "locks_held").agg(F.count(F.lit(1)).alias("occurrences")).join(type_names(db, subclasses), "type_id").select("type_id", "type_name", "members_accessed", "locks_held", "occurrences")


def stack_members_locks(db, subclasses: bool = False, data_type: str | None = None, member: str | None = None) -> DataFrame:
    """type_name, member, locks_held, occurrences: distinct stack traces for each member, access type and sequence of locks."""
    flat = chosen(db, subclasses, data_type, member)
    keys = ["type_id", "member", "ac_type", "stacktrace_id"]
    held = flat.where("txn_id is not null").join(db.locks_held.select("txn_id", "lock_id", "start"), "txn_id").join(described_locks(db, subclasses), "lock_id")
    locked = held.groupBy("ac_id", *keys).agg(joined_in_order(["start", "lock_id"], label(F.col("alloc_id")), ",").alias("locks_held"))
    every = locked.select(*keys, "locks_held").unionAll(flat.where("txn_id is null").select(*keys, F.lit("").alias("locks_held")))
    counted = every.groupBy("type_id", "member", "ac_type", "locks_held").agg(F.countDistinct("stacktrace_id").alias("occurrences"))
    return counted.join(type_names(db, subclasses), "type_id").select("type_name", F.concat_ws(":", "ac_type", "member").alias("member"), "locks_held", "occurrences")


def most_accessed_types(db) -> DataFrame:
    return db.accesses_flat.groupBy("data_type_id").agg(F.count(F.lit(1)).alias("n")).join(db.data_types.withColumnRenamed("id", "data_type_id"), "data_type_id").select("name", "n")


def txn_members(db) -> DataFrame:
    """Member combinations by transaction and allocation, without regard to locks."""
    flat = chosen(db, False, None, None).where("txn_id is not null")
    folded = flat.groupBy("alloc_id", "txn_id", "type_id", "byte_offset", "member").agg(F.max("ac_type").alias("ac_type"))
    groups = folded.groupBy("alloc_id", "txn_id", "type_id").agg(joined_in_order(["byte_offset", "member"], F.concat_ws(":", "ac_type", "member"), ",").alias("members_accessed"))
    return groups.groupBy("type_id", "members_accessed").agg(F.count(F.lit(1)).alias("occurrences"))


def lock_free_accesses(db) -> DataFrame:
    return db.accesses_flat.where("txn_id is null").groupBy("data_type_id", "ac_type").agg(F.count(F.lit(1)).alias("n"))


def lock_distribution(db) -> DataFrame:
    """Accesses for each allocation, member and set of lock types held."""
    types = db.locks_held.join(db.locks.select(F.col("id").alias("lock_id"), "lock_type_name", "sub_lock"), "lock_id").groupBy("txn_id").agg(joined_in_order(["start", "lock_id"], F.concat("lock_type_name", F.lit("["), "sub_lock", F.lit("]")), "+").alias("locks"))
    return db.accesses_flat.join(types, "txn_id", "left").groupBy("alloc_id", "member_name_id", "ac_type", F.coalesce("locks", F.lit("")).alias("locks")).agg(F.count(F.lit(1)).alias("n"))


def type_members(db, subclasses: bool = True) -> DataFrame:
    """Distinct members of each type's layout."""
    n = db.structs_layout.groupBy("data_type_id").agg(F.countDistinct("member_name_id").alias("members"))
    names = db.subclasses.join(db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("dt_name")), "data_type_id") if subclasses else db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("dt_name"), F.lit(None).cast("string").alias("name"))
    return names.join(n, "data_type_id").select(F.concat_ws(":", "dt_name", "name").alias("type_name"), "members")


def blacklisted_members(db) -> DataFrame:
    return db.member_blacklist.groupBy("subclass_id").agg(F.count(F.lit(1)).alias("n"))


def atomic_members(db) -> DataFrame:
    atomic = F.col("data_type_name").like(r"%atomic\_t%") | F.col("data_type_name").like(r"%atomic64\_t%") | F.col("data_type_name").like(r"%atomic\_long\_t%")
    return db.structs_layout.where(atomic).join(db.data_types.select(F.col("id").alias("data_type_id"), F.col("name").alias("type_name")), "data_type_id").join(db.member_names.select(F.col("id").alias("member_name_id"), F.col("name").alias("member")), "member_name_id").select("type_name", "member", "byte_offset")


def callgraph_traces(db) -> DataFrame:
    """Trace text and count by stack trace; the frames are joined before the grouping, so that every frame repeats once per access."""
    frames = db.stacktraces.select(F.col("id").alias("stacktrace_id"), "sequence", "function")
    joined = db.accesses_flat.select("ac_id", "stacktrace_id").join(frames, "stacktrace_id")
    return joined.groupBy("stacktrace_id").agg(joined_in_order(["sequence", "ac_id"], F.col("function"), ",").alias("trace"), F.count(F.lit(1)).alias("n"))


def call_edges(db) -> DataFrame:
    """caller, callee, n: adjacent frames of the accesses' stack traces."""
    frames = db.stacktraces.select(F.col("id").alias("stacktrace_id"), "sequence", "function")
    above = frames.select("stacktrace_id", (F.col("sequence") - 1).alias("sequence"), F.col("function").alias("caller"))
    edges = frames.join(above, ["stacktrace_id", "sequence"]).select("stacktrace_id", "caller", F.col("function").alias("callee"))
    used = db.accesses_flat.groupBy("stacktrace_id").agg(F.count(F.lit(1)).alias("k"))
    return edges.join(used, "stacktrace_id").groupBy("caller", "callee").agg(F.sum("k").alias("n"))


def lock_addresses(db) -> DataFrame:
    return db.locks.select(F.col("id").alias("lock_id"), F.hex("address").alias("address_hex"), F.hex(F.shiftright("address", 8)).alias("page_hex"))


def totals(db) -> DataFrame:
    """Locks by whether they are embedded, and accesses by type."""
    locks = db.locks.select(F.when(F.col("embedded_in").isNull(), "locks, global").otherwise("locks, embedded").alias("what"))
    accesses = db.accesses.select(F.concat(F.lit("accesses, "), "type").alias("what"))
    return locks.unionAll(accesses).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def event_histogram(db) -> DataFrame:
    return db.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def context_distribution(db) -> DataFrame:
    """Accesses by type, member, top lock's type and kind of context, which bit masks on the event's k tell apart."""
    top = db.locks_held.join(db.locks.select(F.col("id").alias("lock_id"), "lock_type_name"), "lock_id").groupBy("txn_id").agg(F.max(F.struct("start", "lock_id", "lock_type_name")).alias("t"))
    flags = db.events.select(F.col("seq").alias("ac_id"), F.col("k").alias("flags"))
    where = F.when(F.col("flags").bitwiseAND(0x40) != 0, "hardirq").when(F.col("flags").bitwiseAND(0x20) != 0, "softirq").otherwise("task")
    return db.accesses_flat.join(flags, "ac_id").join(top, "txn_id", "left").groupBy("ac_type", "member_name_id", F.coalesce("t.lock_type_name", F.lit("none")).alias("lock"), where.alias("irq")).agg(F.count(F.lit(1)).alias("n"))
